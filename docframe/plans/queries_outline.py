"""Outline, style, relationship and slide queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions.numbering import counter_text
from docframe.operators import outline as O
from docframe.plans.registry import query
from docframe.sources.fixtures import Fixtures


# The sequential rule, one paragraph at a time, with three counters (0 = unset).
_WALK = """
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn, kind = 'auto' AND text <> '' AS counted FROM outline),
walk AS (
  SELECT doc_id, ord, rn, level, counted, auto_type,
         CASE WHEN level = 0 AND counted THEN start_at ELSE 0 END AS c0,
         CASE WHEN level = 1 AND counted THEN start_at ELSE 0 END AS c1,
         CASE WHEN level = 2 AND counted THEN start_at ELSE 0 END AS c2
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.doc_id, o.ord, o.rn, o.level, o.counted, o.auto_type,
    CASE WHEN o.level > 0 THEN w.c0 WHEN o.counted THEN CASE WHEN w.c0 <> 0 THEN w.c0 + 1 ELSE o.start_at END WHEN o.kind = 'auto' THEN w.c0 ELSE 0 END,
    CASE WHEN o.level > 1 THEN w.c1 WHEN o.level < 1 THEN 0 WHEN o.counted THEN CASE WHEN w.c1 <> 0 THEN w.c1 + 1 ELSE o.start_at END WHEN o.kind = 'auto' THEN w.c1 ELSE 0 END,
    CASE WHEN o.level < 2 THEN 0 WHEN o.counted THEN CASE WHEN w.c2 <> 0 THEN w.c2 + 1 ELSE o.start_at END WHEN o.kind = 'auto' THEN w.c2 ELSE 0 END
  FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1),
numbered AS (SELECT doc_id, ord, auto_type, CASE WHEN counted THEN CASE level WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END END AS number FROM walk)
"""
_ALPHA = "concat(CASE WHEN number > 26 THEN chr(CAST(96 + (number - 1) // 26 AS INTEGER)) ELSE '' END, CASE WHEN number > 0 THEN chr(CAST(97 + (number - 1) % 26 AS INTEGER)) ELSE '' END)"
_ROMAN = """concat(['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'][number // 10 % 10 + 1], ['','i','ii','iii','iv','v','vi','vii','viii','ix'][number % 10 + 1])"""


@query(
    "outline_numbers",
    f"""SELECT doc_id, ord, number, CASE WHEN number IS NULL THEN NULL ELSE CASE auto_type
          WHEN 'arabicPeriod' THEN concat(number, '.') WHEN 'alphaLcParenR' THEN concat({_ALPHA}, ')')
          WHEN 'romanUcPeriod' THEN concat(upper({_ROMAN}), '.') WHEN 'alphaUcParenBoth' THEN concat('(', upper({_ALPHA}), ')')
          WHEN 'romanLcMinus' THEN concat('- ', {_ROMAN}, ' -') ELSE CAST(number AS VARCHAR) END END AS marker
        FROM numbered""",
    _WALK,
)
def _outline(f: Fixtures):
    return O.outline_numbers(f.outline()).select("doc_id", "ord", "number", "marker")


@query(
    "counter_text",
    f"""SELECT o_orderkey, lower_roman, upper_alpha, zero_led FROM (
          SELECT o_orderkey, number, CASE WHEN number < 1 THEN CAST(number AS VARCHAR) ELSE {_ROMAN} END AS lower_roman,
                 CASE WHEN number < 1 THEN CAST(number AS VARCHAR) ELSE upper({_ALPHA}) END AS upper_alpha,
                 CASE WHEN number BETWEEN 0 AND 9 THEN concat('0', number) ELSE CAST(number AS VARCHAR) END AS zero_led
          FROM (SELECT o_orderkey, o_orderkey % 100 AS number FROM orders))""",
)
def _counter(f: Fixtures):
    n = F.col("o_orderkey") % 100
    return f.t("orders").select(
        "o_orderkey",
        counter_text(n, F.lit("lower-roman")).alias("lower_roman"),
        counter_text(n, F.lit("upper-alpha")).alias("upper_alpha"),
        counter_text(n, F.lit("decimal-leading-zero")).alias("zero_led"),
    )


@query(
    "cascade",
    """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN concat('own', c_custkey) END,
                CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS fill,
              coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'none' END, CASE WHEN n_nationkey % 4 = 0 THEN concat('font ', n_name) END,
                CASE WHEN r_regionkey <> 1 THEN concat('font ', r_name) END, 'default') AS font
       FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
def _cascade(f: Fixtures):
    slides = f.t("customer").selectExpr(
        "c_custkey", "c_nationkey AS layout",
        "CASE WHEN c_custkey % 3 = 0 THEN concat('own', CAST(c_custkey AS STRING)) END AS fill",
        "CASE WHEN c_custkey % 5 = 0 THEN 'none' END AS font",
    )
    layouts = f.t("nation").selectExpr(
        "n_nationkey AS layout", "n_regionkey AS master", "CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS fill",
        "CASE WHEN n_nationkey % 4 = 0 THEN concat('font ', n_name) END AS font",
    )
    masters = f.t("region").selectExpr(
        "r_regionkey AS master", "r_name AS fill", "CASE WHEN r_regionkey <> 1 THEN concat('font ', r_name) END AS font"
    )
    out = O.cascade(slides, [(layouts, "layout"), (masters, "master")], ["fill", "font"])
    return out.select("c_custkey", "fill", F.coalesce("font", F.lit("default")).alias("font"))


@query(
    "inherit_chain",
    """SELECT style_id, coalesce(any_value(value) FILTER (WHERE value IS NOT NULL), FALSE) AS effective FROM chain GROUP BY style_id""",
    """chain AS (
         SELECT style_id, based_on, value, 1 AS depth FROM styles
         UNION ALL
         SELECT c.style_id, s.based_on, s.value, c.depth + 1 FROM chain c JOIN styles s ON s.style_id = c.based_on
         WHERE c.value IS NULL AND c.depth < 20)""",
)
def _chain(f: Fixtures):
    return O.inherit_chain(f.styles())


@query(
    "adjacent_rule",
    """SELECT doc_id, ord,
         CASE WHEN lag(style) OVER w = style AND lag(contextual) OVER w AND contextual THEN 0.0 ELSE 6.0 END::DOUBLE AS space_before,
         CASE WHEN lead(style) OVER w = style AND lead(contextual) OVER w AND contextual THEN 0.0 ELSE 8.0 END::DOUBLE AS space_after
       FROM (SELECT doc_id, ord, kind AS style, level <> 1 AS contextual FROM outline) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""",
)
def _adjacent(f: Fixtures):
    paras = f.outline().select(
        "doc_id", "ord", F.col("kind").alias("style"), (F.col("level") != 1).alias("contextual"),
        F.lit(6.0).alias("space_before"), F.lit(8.0).alias("space_after"),
    )
    return O.adjacent_rule(paras).select("doc_id", "ord", "space_before", "space_after")


@query(
    "resolve_rels",
    """SELECT concat('ppt/slides/slide', o_orderkey, '.xml') AS part,
              concat('ppt/slideLayouts/slideLayout', o_orderkey % 11, '.xml') AS "slideLayout",
              concat('ppt/slideMasters/slideMaster', o_orderkey % 11 % 3, '.xml') AS "slideMaster",
              concat('ppt/theme/theme', o_orderkey % 11 % 3, '.xml') AS theme FROM orders""",
)
def _rels(f: Fixtures):
    return O.follow_rels(O.resolve_rels(f.rels()))


@query(
    "resolve_targets",
    """SELECT concat('ppt/slides/slide', o_orderkey, '.xml') AS part, CAST(2 AS BIGINT) AS ord, 'https://example.org/../a' AS resolved FROM orders
       UNION ALL SELECT concat('ppt/slides/slide', o_orderkey, '.xml'), 1, concat('ppt/slideLayouts/slideLayout', o_orderkey % 11, '.xml') FROM orders
       UNION ALL SELECT DISTINCT concat('ppt/slideLayouts/slideLayout', o_orderkey % 11, '.xml'), 1,
                        concat('ppt/slideMasters/slideMaster', o_orderkey % 11 % 3, '.xml') FROM orders
       UNION ALL SELECT DISTINCT concat('ppt/slideMasters/slideMaster', o_orderkey % 11 % 3, '.xml'), 1,
                        concat('ppt/theme/theme', o_orderkey % 11 % 3, '.xml') FROM orders""",
)
def _targets(f: Fixtures):
    return O.resolve_rels(f.rels()).select("part", "ord", "resolved")


_DECKS = "decks AS (SELECT deck, count(*) FILTER (WHERE NOT hidden) AS shown, count(*) FILTER (WHERE hidden) AS hidden_count FROM slides GROUP BY deck)"


@query(
    "ordered_visible",
    """SELECT s.deck, s.ord, s.part, hidden_count, row_number() OVER (PARTITION BY s.deck ORDER BY s.ord) AS out_no
       FROM slides s JOIN decks USING (deck) WHERE shown = 0 OR NOT hidden""",
    _DECKS,
)
def _visible(f: Fixtures):
    return O.ordered_visible(f.slides()).select("deck", "ord", "part", "hidden_count", "out_no")


@query(
    "interleave_notes",
    """SELECT deck, ord, kind, body, row_number() OVER (PARTITION BY deck ORDER BY ord, sub) AS out_no FROM (
         SELECT deck, ord, 0 AS sub, 'slide' AS kind, part AS body FROM slides
         UNION ALL SELECT deck, ord, 1, 'note', note FROM slides WHERE trim(regexp_replace(coalesce(note, ''), '<[^>]*>', '', 'g')) <> '')""",
)
def _notes(f: Fixtures):
    return O.interleave_notes(f.slides())


_SHAPES = """
shapes AS (SELECT p_size AS layout, p_partkey AS ord, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 9 END AS idx,
             ['title','body','obj','subTitle','pic'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS type, concat('shape', p_partkey) AS shape FROM part),
wants AS (SELECT s_suppkey AS item, CAST(s_suppkey % 60 AS INTEGER) AS layout, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 9 END AS idx,
             ['ctrTitle','body','obj','chart','subTitle','title'][CAST(s_suppkey % 6 + 1 AS INTEGER)] AS type FROM supplier),
cand AS (
  SELECT w.item, s.ord, s.shape, CASE WHEN w.idx = s.idx THEN 1 WHEN w.type = s.type THEN 2 ELSE 3 END AS prio
  FROM wants w JOIN shapes s ON s.layout = w.layout AND (w.idx = s.idx OR w.type = s.type OR
    CASE WHEN w.type = 'ctrTitle' THEN 'title' WHEN w.type IN ('subTitle', 'obj') THEN 'body' ELSE w.type END
    = CASE WHEN s.type = 'ctrTitle' THEN 'title' WHEN s.type IN ('subTitle', 'obj') THEN 'body' ELSE s.type END))
"""


@query(
    "priority_match",
    """SELECT w.item, w.type, any_value(c.shape) AS shape, CASE any_value(c.prio) WHEN 1 THEN 'idx' WHEN 2 THEN 'type' WHEN 3 THEN 'folded type' END AS matched_by
       FROM wants w LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY item ORDER BY prio, ord) AS rn FROM cand) c ON c.item = w.item AND c.rn = 1
       GROUP BY 1, 2""",
    _SHAPES,
)
def _priority(f: Fixtures):
    shapes = f.t("part").selectExpr(
        "p_size AS layout", "p_partkey AS ord", "CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 9 END AS idx",
        "element_at(array('title','body','obj','subTitle','pic'), CAST(p_partkey % 5 + 1 AS INT)) AS type",
        "concat('shape', CAST(p_partkey AS STRING)) AS shape",
    )
    wants = f.t("supplier").selectExpr(
        "s_suppkey AS item", "CAST(s_suppkey % 60 AS INT) AS layout", "CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 9 END AS idx",
        "element_at(array('ctrTitle','body','obj','chart','subTitle','title'), CAST(s_suppkey % 6 + 1 AS INT)) AS type",
    )
    return O.priority_match(wants, shapes).select("item", "type", "shape", "matched_by")
