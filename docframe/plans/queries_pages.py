"""Page-table queries (packing, selections, merging, labels, render plans)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.operators import pages as P
from docframe.plans.packing import pack_pages, page_segments
from docframe.plans.registry import query
from docframe.sources.fixtures import Fixtures

# Greedy packing, one step per item (the check for the bucketed version).
PACK_SQL = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY idx) AS rn FROM items),
walk AS (
  SELECT k, idx, rn, size, brk, cap, size AS used, CAST(1 AS BIGINT) AS page_seq FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.k, o.idx, o.rn, o.size, o.brk, o.cap,
         CASE WHEN w.brk OR w.used + o.size > o.cap + 0.5 THEN o.size ELSE w.used + o.size END,
         CASE WHEN w.brk OR w.used + o.size > o.cap + 0.5 THEN w.page_seq + 1 ELSE w.page_seq END
  FROM walk w JOIN ordered o ON o.k = w.k AND o.rn = w.rn + 1)
"""

_LINE_ITEMS = "items AS (SELECT doc_id AS k, line_no AS idx, CAST(12 + length(text) // 80 * 12 AS DOUBLE) AS size,"
_LINE_ITEMS += " line_no % 37 = 0 AS brk, 120::DOUBLE AS cap FROM lines)"


def line_items(f: Fixtures):
    """Lines as items: one row of text is 80 characters, 12 points high; a break every 37 lines."""
    return f.lines().selectExpr(
        "doc_id", "line_no AS idx", "CAST(12 + floor(length(text) / 80) * 12 AS DOUBLE) AS size", "line_no % 37 = 0 AS brk"
    )


@query(
    "pack_pages",
    "SELECT k AS doc_id, CAST(idx AS BIGINT) AS idx, size, page_seq FROM walk",
    f"{_LINE_ITEMS}, {PACK_SQL}",
)
def _pack_pages(f: Fixtures):
    return pack_pages(line_items(f), ["doc_id"], "idx", "size", 120.0, "brk")


@query(
    "page_segments",
    """SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY page_seq) AS page_no,
              CAST(min(idx) AS BIGINT) AS first_idx, CAST(max(idx) AS BIGINT) AS last_idx, sum(size) AS used
       FROM walk GROUP BY k, page_seq HAVING sum(size) > 0""",
    f"{_LINE_ITEMS.replace('CAST(12', 'CASE WHEN line_no % 3 = 0 THEN 0 ELSE 1 END * CAST(12')}, {PACK_SQL}",
)
def _page_segments(f: Fixtures):
    items = line_items(f).withColumn("size", F.when(F.col("idx") % 3 == 0, F.lit(0.0)).otherwise(F.col("size")))
    packed = pack_pages(items, ["doc_id"], "idx", "size", 120.0, "brk")
    return page_segments(packed, ["doc_id"]).drop("page_seq")


@query(
    "pack_rows_wide",
    """SELECT k AS sheet, CAST(idx AS BIGINT) AS idx, size, page_seq FROM walk""",
    'items AS (SELECT sheet AS k, "row" AS idx, CAST(l_quantity AS DOUBLE) AS size, FALSE AS brk, 200::DOUBLE AS cap'
    f" FROM sheet_rows), {PACK_SQL}",
)
def _pack_rows_wide(f: Fixtures):
    """Same packing with buckets far smaller than a key, so every key is chained."""
    return pack_pages(f.sheet_rows(), ["sheet"], "row", "l_quantity", 200.0, bucket_rows=64)


# Tokens of a selection, checked one by one in order.
_PARSE = r"""
toks AS (
  SELECT doc_id, sel, page_count, CAST(generate_subscripts(t, 1) AS INTEGER) AS range_no, trim(unnest(t)) AS tok, len(t) AS n
  FROM (SELECT doc_id, sel, page_count, string_split(sel, ',') AS t FROM selections JOIN page_counts USING (doc_id))),
spans AS (
  SELECT *, TRY_CAST(regexp_extract(tok, '^(\d+)(\s*-\s*(\d+))?$', 1) AS BIGINT) AS "first",
         TRY_CAST(CASE WHEN regexp_extract(tok, '^(\d+)(\s*-\s*(\d+))?$', 3) = '' THEN regexp_extract(tok, '^(\d+)(\s*-\s*(\d+))?$', 1)
              ELSE regexp_extract(tok, '^(\d+)(\s*-\s*(\d+))?$', 3) END AS BIGINT) AS "last"
  FROM toks),
codes AS (
  SELECT *, CASE WHEN NOT regexp_matches(tok, '^(\d+)(\s*-\s*(\d+))?$') OR "first" < 1 OR "last" < "first" THEN 'invalid-selection'
                 WHEN "last" > page_count THEN 'page-out-of-range' END AS code
  FROM spans),
clashing AS (
  SELECT DISTINCT a.doc_id FROM codes a JOIN codes b ON a.doc_id = b.doc_id AND a.range_no < b.range_no
  AND a."first" <= b."last" AND b."first" <= a."last"),
parsed AS (
  SELECT c.doc_id, any_value(sel) AS sel, any_value(page_count) AS page_count,
         CASE WHEN bool_or(tok = '') THEN 'invalid-selection' WHEN any_value(n) > 20 THEN 'too-many-ranges'
              WHEN count(code) > 0 THEN min_by(code, range_no) FILTER (WHERE code IS NOT NULL)
              WHEN bool_or(o.doc_id IS NOT NULL) THEN 'overlapping-ranges' END AS error
  FROM codes c LEFT JOIN clashing o ON o.doc_id = c.doc_id GROUP BY c.doc_id),
good AS (SELECT codes.* FROM codes JOIN parsed USING (doc_id) WHERE error IS NULL),
picked AS (
  SELECT doc_id, range_no, "first", "last", unnest(range("first", "last" + 1)) AS page_no FROM good)
"""


@query(
    "parse_ranges",
    """SELECT doc_id, sel, page_count, error,
              (SELECT string_agg(concat("first", '-', "last"), ',' ORDER BY range_no) FROM good WHERE good.doc_id = parsed.doc_id) AS spans
       FROM parsed""",
    _PARSE,
)
def _parse_ranges(f: Fixtures):
    parsed = P.parse_ranges(f.selections(), f.page_counts())
    spans = F.array_join(
        F.transform("ranges", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ","
    )
    return parsed.select("doc_id", "sel", "page_count", "error", spans.alias("spans"))


@query(
    "split_pages",
    """SELECT p.doc_id, p.page_no, range_no, concat('pages-', "first", '-', "last") AS output_name, length(text) AS n_chars
       FROM picked JOIN doc_pages p ON p.doc_id = picked.doc_id AND p.page_no = picked.page_no""",
    _PARSE,
)
def _split_pages(f: Fixtures):
    parsed = P.parse_ranges(f.selections(), f.page_counts())
    return P.split_pages(f.doc_pages(), parsed).select(
        "doc_id", "page_no", "range_no", "output_name", F.length("text").cast("long").alias("n_chars")
    )


@query(
    "extract_pages",
    """SELECT p.doc_id, p.page_no, p.text,
              row_number() OVER (PARTITION BY p.doc_id ORDER BY range_no, p.page_no) AS out_no
       FROM picked JOIN doc_pages p ON p.doc_id = picked.doc_id AND p.page_no = picked.page_no""",
    _PARSE.replace("any_value(n) > 20", "any_value(n) > any_value(page_count)"),
)
def _extract_pages(f: Fixtures):
    parsed = P.parse_ranges(f.selections(), f.page_counts(), max_ranges=None)
    return P.extract_pages(f.doc_pages(), parsed).select("doc_id", "page_no", "text", "out_no")


@query(
    "remove_pages",
    """SELECT p.doc_id, p.page_no, p.text, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.page_no) AS out_no,
              NULL::VARCHAR AS error
       FROM doc_pages p JOIN parsed ON parsed.doc_id = p.doc_id AND parsed.error IS NULL
       WHERE NOT EXISTS (SELECT 1 FROM picked k WHERE k.doc_id = p.doc_id AND k.page_no = p.page_no)
       UNION ALL
       SELECT doc_id, NULL, NULL, NULL, coalesce(error, 'no-pages-left') FROM parsed
       WHERE error IS NOT NULL OR page_count <= (SELECT count(*) FROM picked k WHERE k.doc_id = parsed.doc_id)""",
    _PARSE.replace("any_value(n) > 20", "any_value(n) > any_value(page_count)"),
)
def _remove_pages(f: Fixtures):
    parsed = P.parse_ranges(f.selections(), f.page_counts(), max_ranges=None)
    kept = P.remove_pages(f.doc_pages(), parsed).select(
        "doc_id", "page_no", "text", "out_no", F.lit(None).cast("string").alias("error")
    )
    return kept.unionByName(P.remove_errors(parsed), allowMissingColumns=True)


_ORDER = """
checked AS (
  SELECT c.doc_id, coalesce(count(o.page_no) > 0 AND count(DISTINCT o.page_no) = count(o.page_no) AND min(o.page_no) >= 1
           AND max(o.page_no) <= any_value(page_count) AND bool_and(rotation IN (0, 90, 180, 270)), FALSE) AS valid
  FROM page_counts c LEFT JOIN page_order o ON o.doc_id = c.doc_id GROUP BY c.doc_id)
"""


@query(
    "organize_pages",
    """SELECT o.doc_id, o.pos AS out_no, p.page_no, (p.rotation + o.rotation) % 360 AS rotation, p.text, NULL::VARCHAR AS error
       FROM page_order o JOIN checked c ON c.doc_id = o.doc_id AND c.valid
       JOIN doc_pages p ON p.doc_id = o.doc_id AND p.page_no = o.page_no
       UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'invalid-page-order' FROM checked WHERE NOT valid""",
    _ORDER,
)
def _organize_pages(f: Fixtures):
    return P.organize_pages(f.doc_pages(), f.page_order(), f.page_counts()).select(
        "doc_id", "out_no", "page_no", "rotation", "text", "error"
    )


@query(
    "merge_docs",
    """SELECT d.source AS batch, p.doc_id, p.page_no, p.text,
              row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id DESC, p.page_no) AS merged_no
       FROM doc_pages p JOIN documents d ON d.doc_id = p.doc_id""",
)
def _merge_docs(f: Fixtures):
    order = f.t("documents").select(F.col("source").alias("batch"), (-F.col("doc_id")).alias("ord"), "doc_id")
    return P.merge_docs(f.doc_pages(), order).select("batch", "doc_id", "page_no", "text", "merged_no")


@query(
    "number_pages",
    """SELECT doc_id, page_no, concat(999990 + page_no - 1, ' of ', 999990 + page_count - 1) AS label, NULL::VARCHAR AS error
       FROM doc_pages JOIN page_counts USING (doc_id) WHERE 999990 + page_count - 1 <= 1000000
       UNION ALL SELECT doc_id, page_no, NULL, 'invalid-edit' FROM doc_pages JOIN page_counts USING (doc_id)
       WHERE 999990 + page_count - 1 > 1000000""",
)
def _number_pages(f: Fixtures):
    return P.number_pages(f.doc_pages(), 999_990, "of").select("doc_id", "page_no", "label", "error")


@query(
    "stamp_range",
    """SELECT p.doc_id, p.page_no, label, p.text, NULL::VARCHAR AS error
       FROM r JOIN doc_pages p ON p.doc_id = r.doc_id AND p.page_no BETWEEN start_page AND stop WHERE NOT bad
       UNION ALL SELECT doc_id, NULL, label, NULL, 'invalid-page-range' FROM r WHERE bad""",
    """r AS (SELECT *, start_page < 1 OR stop < start_page OR stop > page_count AS bad FROM (
         SELECT s.*, page_count, CASE WHEN end_page = 0 THEN page_count ELSE end_page END AS stop
         FROM stamps s JOIN page_counts USING (doc_id)))""",
)
def _stamp_range(f: Fixtures):
    return P.stamp_range(f.doc_pages(), f.stamps()).select("doc_id", "page_no", "label", "text", "error")


@query(
    "validate_children",
    """SELECT m.doc_id, count(*) AS n_items,
              CASE WHEN count(*) > 500 OR NOT bool_and(coalesce(x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND font_size BETWEEN 6 AND 96
                AND x <= width AND y <= height AND w <= width AND h <= height AND regexp_matches(color, '^#[0-9a-fA-F]{6}$')
                AND (kind = 'rectangle' OR trim(m.text) <> ''), FALSE)) THEN 'invalid-edit' END AS error
       FROM markups m LEFT JOIN doc_pages p ON p.doc_id = m.doc_id AND p.page_no = m.page_no GROUP BY m.doc_id""",
)
def _validate_children(f: Fixtures):
    return P.validate_children(f.doc_pages(), f.markups())


@query(
    "render_plan",
    """SELECT doc_id, page_no, CAST(px_w AS BIGINT) AS px_w, CAST(px_h AS BIGINT) AS px_h, CAST(used AS BIGINT) AS used_pixels,
              CASE WHEN page_no >= first_bad THEN 'page-too-large' END AS error
       FROM (SELECT *, min(CASE WHEN px_w * px_h > 2200000 OR used > 6000000 THEN page_no END) OVER (PARTITION BY doc_id) AS first_bad
             FROM (SELECT *, sum(px_w * px_h) OVER (PARTITION BY doc_id ORDER BY page_no) AS used
                   FROM (SELECT doc_id, page_no, CAST(ceil(width * (150.0::DOUBLE / 72.0::DOUBLE)) AS BIGINT) AS px_w,
                                CAST(ceil(height * (150.0::DOUBLE / 72.0::DOUBLE)) AS BIGINT) AS px_h FROM doc_pages)))""",
)
def _render_plan(f: Fixtures):
    plan = P.render_plan(f.doc_pages(), 150.0, 2_200_000, 6_000_000)
    return plan.select("doc_id", "page_no", "px_w", "px_h", "used_pixels", "error")


@query(
    "render_plan_fit",
    """SELECT doc_id, page_no, round(s, 6) AS scale, CAST(greatest(1, floor(width * s)) AS BIGINT) AS px_w,
              CAST(greatest(1, floor(height * s)) AS BIGINT) AS px_h
       FROM (SELECT *, least(2.2::DOUBLE, 2800.0::DOUBLE / width, 2800.0::DOUBLE / height, sqrt(1500000.0::DOUBLE / (width * height))) AS s
             FROM doc_pages)""",
)
def _render_plan_fit(f: Fixtures):
    plan = P.render_plan(f.doc_pages(), 2.2 * 72, 1e12, 1e18, max_edge=2800, fit_pixels=1_500_000, rounding="floor")
    return plan.select("doc_id", "page_no", F.round("scale", 6).alias("scale"), "px_w", "px_h")


@query(
    "paper_fit",
    """SELECT ord, round(pw, 3) AS page_w, round(ph, 3) AS page_h, round(width * s, 3) AS draw_w, round(height * s, 3) AS draw_h
       FROM (SELECT *, least((pw - 48) / width, (ph - 48) / height) AS s FROM (
         SELECT ord, width, height, CASE WHEN width / height > 595.28::DOUBLE / 841.89::DOUBLE THEN 841.89::DOUBLE ELSE 595.28::DOUBLE END AS pw,
           CASE WHEN width / height > 595.28::DOUBLE / 841.89::DOUBLE THEN 595.28::DOUBLE ELSE 841.89::DOUBLE END AS ph FROM pdf_files))""",
)
def _paper_fit(f: Fixtures):
    out = P.paper_fit(f.pdf_files().select("ord", "width", "height"), "a4", 24)
    return out.select("ord", *[F.round(c, 3).alias(c) for c in ("page_w", "page_h", "draw_w", "draw_h")])


@query(
    "fill_page_markers",
    """SELECT doc_id, page_no, concat('page ', page_no, ' / ', page_count, ': ', page_no, ' ', text) AS text
       FROM doc_pages JOIN page_counts USING (doc_id)""",
)
def _fill_page_markers(f: Fixtures):
    one, all_ = P.field_marker(F.lit(" page \\* MERGEFORMAT")), P.field_marker(F.lit("NUMPAGES"))
    marked = f.doc_pages().withColumn(
        "text", F.concat(F.lit("page "), one, F.lit(" / "), all_, F.lit(": "), one, F.lit(" "), F.col("text"))
    )
    return P.fill_page_markers(marked).select("doc_id", "page_no", "text")


@query(
    "header_footer",
    """SELECT doc_id, page_no,
              CASE WHEN page_no = 1 THEN '' WHEN page_no % 2 = 0 THEN '' ELSE concat('left ', page_no + 4) END AS h_l,
              CASE WHEN page_no = 1 THEN concat('Cover R&D ', source) WHEN page_no % 2 = 0 THEN concat(page_no + 4, '/', page_count)
                   ELSE '' END AS h_c,
              CASE WHEN page_no = 1 THEN '' WHEN page_no % 2 = 0 THEN '2024-01-31' ELSE concat('doc', doc_id, '.xlsx end') END AS h_r
       FROM doc_pages JOIN page_counts USING (doc_id) JOIN documents USING (doc_id)""",
)
def _header_footer(f: Fixtures):
    docs = f.t("documents").select(
        "doc_id",
        F.col("source").alias("sheet"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".xlsx")).alias("file"),
        F.lit('&C&"Arial,Bold"&14Cover R&&D &A').alias("first_t"),
        F.lit("&P/&N&R&D").alias("even_t"),
        F.lit("&L&KFF0000left &P&R&F &Bend").alias("odd_t"),
    ).join(f.page_counts(), "doc_id")
    pages = P.attach(f.doc_pages().select("doc_id", "page_no"), docs, ["doc_id"], P.bucket_of("page_no"))
    out = P.header_footer(pages, "h", date="2024-01-31", first_page_number=5)
    return out.select("doc_id", "page_no", "h_l", "h_c", "h_r")


@query(
    "inherit_headers",
    """SELECT doc_id, section_no, kind, type, ref, last_value(ref IGNORE NULLS) OVER (
         PARTITION BY doc_id, kind, type ORDER BY section_no ROWS UNBOUNDED PRECEDING) AS effective
       FROM (SELECT conv_id AS doc_id, turn AS section_no, 'headerReference' AS kind, role AS type,
                    CASE WHEN (turn + conv_id) % 3 = 0 THEN concat('h', turn) END AS ref FROM conversations)""",
)
def _inherit_headers(f: Fixtures):
    sections = f.t("conversations").selectExpr(
        "conv_id AS doc_id", "turn AS section_no", "'headerReference' AS kind", "role AS type",
        "CASE WHEN (turn + conv_id) % 3 = 0 THEN concat('h', CAST(turn AS STRING)) END AS ref",
    )
    return P.inherit_headers(sections).select("doc_id", "section_no", "kind", "type", "ref", "effective")


