"""Cell-grid queries over sheets made from the order lines of one supplier each."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions import refs as R
from docframe.operators import grid as G
from docframe.plans.queries_pages import PACK_SQL
from docframe.plans.registry import query
from docframe.plans.stage import stage
from docframe.sources.fixtures import Fixtures

_REFS = r"""refs AS (SELECT p_partkey, CASE p_partkey % 7
    WHEN 0 THEN concat('$', chr(CAST(65 + p_size % 26 AS INTEGER)), '$', p_partkey + 1)
    WHEN 1 THEN concat('''My, Sheet''!A', chr(CAST(65 + p_size % 26 AS INTEGER)), p_partkey + 1, ':$B$', p_size)
    WHEN 2 THEN concat('$', p_size, ':$', p_partkey) WHEN 3 THEN concat('$B:$', chr(CAST(65 + p_size % 26 AS INTEGER)))
    WHEN 4 THEN concat('  ', chr(CAST(97 + p_size % 26 AS INTEGER)), '5 ') WHEN 5 THEN 'A:1' ELSE p_name END AS ref, p_size, p_partkey % 7 AS kind FROM part)"""


def _refs(f: Fixtures):
    letter = "char(65 + p_size % 26)"
    return f.t("part").selectExpr(
        "p_partkey",
        f"""CASE p_partkey % 7 WHEN 0 THEN concat('$', {letter}, '$', CAST(p_partkey + 1 AS STRING))
            WHEN 1 THEN concat("'My, Sheet'!A", {letter}, CAST(p_partkey + 1 AS STRING), ':$B$', CAST(p_size AS STRING))
            WHEN 2 THEN concat('$', CAST(p_size AS STRING), ':$', CAST(p_partkey AS STRING)) WHEN 3 THEN concat('$B:$', {letter})
            WHEN 4 THEN concat('  ', lower({letter}), '5 ') WHEN 5 THEN 'A:1' ELSE p_name END AS ref""",
    )


@query(
    "parse_range",
    """SELECT p_partkey,
         CASE kind WHEN 0 THEN p_partkey + 1 WHEN 1 THEN least(p_partkey + 1, p_size) WHEN 2 THEN p_size WHEN 3 THEN 1 WHEN 4 THEN 5 END AS r1,
         CASE kind WHEN 0 THEN p_size % 26 + 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN p_size % 26 + 1 END::BIGINT AS c1,
         CASE kind WHEN 0 THEN p_partkey + 1 WHEN 1 THEN greatest(p_partkey + 1, p_size) WHEN 2 THEN p_partkey WHEN 3 THEN 1048576 WHEN 4 THEN 5 END AS r2,
         CASE kind WHEN 0 THEN p_size % 26 + 1 WHEN 1 THEN 27 + p_size % 26 WHEN 2 THEN 16384 WHEN 3 THEN p_size % 26 + 1 WHEN 4 THEN p_size % 26 + 1 END::BIGINT AS c2
       FROM refs""",
    _REFS,
)
def _parse_range(f: Fixtures):
    return _refs(f).select("p_partkey", R.parse_range(F.col("ref")).alias("r")).select("p_partkey", "r.*")


@query(
    "split_areas",
    r"""SELECT p_partkey, CAST(generate_subscripts(a, 1) AS INTEGER) AS part_no, unnest(a) AS area FROM (
          SELECT p_partkey, list_transform(regexp_extract_all(concat(',', ref, ',Other!$A$1:B2'), ',(?:''[^'']*''|[^,''])*'), lambda s: substr(s, 2)) AS a FROM refs)""",
    _REFS,
)
def _split_areas(f: Fixtures):
    areas = R.split_areas(F.concat("ref", F.lit(",Other!$A$1:B2,")))
    return _refs(f).select("p_partkey", F.posexplode(areas).alias("pos", "area")).select("p_partkey", (F.col("pos") + 1).alias("part_no"), "area")


@query(
    "to_cells",
    """SELECT c_custkey, c_custkey + 1 AS "row", col, CASE WHEN num IS NULL THEN 's' ELSE 'n' END AS type, num,
              CASE WHEN num IS NULL THEN raw END AS str
       FROM (SELECT *, CASE WHEN regexp_matches(trim(raw), '^[-+]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][-+]?\\d+)?$') AND length(trim(raw)) < 16
                       THEN CAST(trim(raw) AS DOUBLE) END AS num
             FROM (SELECT c_custkey, 1 AS col, c_name AS raw FROM customer
                   UNION ALL SELECT c_custkey, 2, CAST(c_acctbal AS VARCHAR) FROM customer
                   UNION ALL SELECT c_custkey, 3, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN '1234567890123456' ELSE ' .5e3 ' END FROM customer
                   UNION ALL SELECT c_custkey, 4, c_mktsegment FROM customer) WHERE raw <> '')""".replace("\\\\", "\\"),
)
def _to_cells(f: Fixtures):
    wide = f.t("customer").selectExpr(
        "c_custkey", "c_custkey + 1 AS row", "c_name", "c_acctbal",
        "CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN '1234567890123456' ELSE ' .5e3 ' END AS odd", "c_mktsegment",
    )
    return G.to_cells(wide, ["c_custkey"], ["c_name", "c_acctbal", "odd", "c_mktsegment"], "row")


@query(
    "resolve_strings",
    """SELECT sheet, "row", col, tag, CASE WHEN tag = 's' THEN coalesce(p_name, '') ELSE raw END AS raw
       FROM cells LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) ON tag = 's' AND CAST(p_partkey AS VARCHAR) = raw""",
)
def _strings(f: Fixtures):
    shared = f.t("part").filter("p_partkey % 10 <> 0").selectExpr("p_partkey AS idx", "p_name AS text")
    return G.resolve_strings(f.cells(), shared)


@query(
    "type_cells",
    """SELECT sheet, "row", col, CASE WHEN tag IN ('s', 'str') THEN 's' WHEN tag = 'd' THEN 'd' ELSE 'n' END AS type,
              CASE WHEN tag = 'n' THEN CAST(raw AS DOUBLE) WHEN tag = 'd' THEN CAST(datediff('day', DATE '1899-12-30', CAST(raw AS DATE)) AS DOUBLE) END AS num,
              CASE WHEN tag IN ('s', 'str') THEN raw END AS str, NULL::BOOLEAN AS bool FROM cells""",
)
def _type_cells(f: Fixtures):
    return G.type_cells(f.cells())


@query(
    "empty_formulas",
    """SELECT sheet, bool_or(l_linenumber = 5) AS empty_formulas FROM sheet_rows GROUP BY sheet""",
)
def _empty_formulas(f: Fixtures):
    return G.empty_formula_sheets(f.cells().withColumn("formula", F.col("tag") == "str"))


@query(
    "serial_dates",
    """SELECT o_orderkey, CAST(datediff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS DOUBLE) AS serial,
              CAST(datediff('day', DATE '1904-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS serial_1904, CAST(o_orderdate AS DATE) AS back FROM orders""",
)
def _serials(f: Fixtures):
    return f.t("orders").select(
        "o_orderkey",
        G.date_to_serial(F.col("o_orderdate")).alias("serial"),
        G.date_to_serial(F.col("o_orderdate"), True).alias("serial_1904"),
        G.serial_to_date(G.date_to_serial(F.col("o_orderdate"))).alias("back"),
    )


_FMT = "['General','0','0.00','#,##0','#,##0.00']"


@query(
    "resolve_style",
    f"""SELECT sheet, "row", col, style, coalesce(CASE WHEN style % 6 = 5 THEN concat('custom ', style) END,
               CASE WHEN style % 6 < 5 THEN {_FMT}[CAST(style % 6 + 1 AS INTEGER)] END, 'General') AS format
        FROM (SELECT sheet, "row", col, coalesce(CASE WHEN "row" % 4 = 0 AND col = 1 THEN "row" % 20 END, CASE WHEN "row" % 10 = 3 THEN "row" % 7 END,
                CASE WHEN col <> 2 THEN 10 + col END, 0) AS style FROM cells)""",
)
def _style(f: Fixtures):
    cells = f.cells().selectExpr("sheet", "row", "col", "CASE WHEN row % 4 = 0 AND col = 1 THEN row % 20 END AS style")
    rows = f.sheet_rows().filter("row % 10 = 3").selectExpr("sheet", "row", "row % 7 AS style")
    cols = f.t("supplier").selectExpr("s_suppkey AS sheet", "explode(array(1, 3, 4, 5)) AS col").withColumn("style", (F.col("col") + 10).cast("long"))
    styles = cells.sparkSession.range(0, 32).selectExpr("id AS style", "CASE WHEN id % 6 = 5 THEN 164 + id ELSE id % 6 END AS fmt_id")
    formats = cells.sparkSession.range(0, 32).filter("id % 6 = 5").selectExpr("164 + id AS fmt_id", "concat('custom ', CAST(id AS STRING)) AS code")
    return G.resolve_style(cells, rows, cols, styles, formats)


@query(
    "expand_col_spans",
    """SELECT sheet, idx, arg_max(width, ord) AS width FROM (
         SELECT s_suppkey AS sheet, k AS ord, CAST(8 + k AS DOUBLE) AS width,
                unnest(range(1 + k * 3, CASE WHEN k = 2 THEN least(16384, 7 + 2000) ELSE least(16384, 1 + k * 3 + s_suppkey % 5) END + 1)) AS idx
         FROM supplier CROSS JOIN (VALUES (0), (1), (2)) v(k)) GROUP BY 1, 2""",
)
def _spans(f: Fixtures):
    spans = f.t("supplier").selectExpr("s_suppkey AS sheet", "explode(array(0, 1, 2)) AS ord").selectExpr(
        "sheet", "ord", "CAST(1 + ord * 3 AS BIGINT) AS min",
        "CASE WHEN ord = 2 THEN 16384L ELSE 1 + ord * 3 + sheet % 5 END AS max", "CAST(8 + ord AS DOUBLE) AS width",
    )
    return G.expand_col_spans(spans)


@query(
    "autosize_columns",
    "SELECT sheet, col, round(least(60.0, greatest(9.14, max(length(text)) * 1.1 + 1.8)), 4)::DOUBLE AS width FROM valued GROUP BY 1, 2",
)
def _autosize(f: Fixtures):
    return G.autosize_columns(f.valued()).select("sheet", "col", F.round("width", 4).alias("width"))


_OFF = """
off AS MATERIALIZED (SELECT sheet, dim, idx, CASE WHEN hidden THEN 0 ELSE size END AS size,
          coalesce(sum(CASE WHEN hidden THEN 0 ELSE size END) OVER (PARTITION BY sheet, dim ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
        FROM axis)
"""


@query("axis_offsets", """SELECT sheet, dim, idx, size, "offset" FROM off""", _OFF)
def _offsets(f: Fixtures):
    return G.axis_offsets(f.axis()).select("sheet", "dim", "idx", "size", "offset")


@query(
    "span_size",
    """SELECT m.sheet, r1, r2, coalesce((SELECT sum(size) FROM off WHERE off.sheet = m.sheet AND dim = 'row' AND idx BETWEEN r1 AND r2), 0) AS height
       FROM merges m""",
    _OFF,
)
def _span_size(f: Fixtures):
    return G.span_size(G.axis_offsets(f.axis()), f.merges(), "row", "r1", "r2", "height").select("sheet", "r1", "r2", "height")


_POINTS = """points AS (SELECT sheet, 'row' AS dim, "row" AS id, CAST("row" * 37 % 20000 AS DOUBLE) AS pos FROM sheet_rows
  UNION ALL SELECT sheet, 'col', "row", CAST("row" * 7 % 600 AS DOUBLE) - 5 FROM sheet_rows)"""


@query(
    "locate",
    """SELECT p.sheet, p.dim, id, pos, coalesce((SELECT max(idx) FROM off WHERE off.sheet = p.sheet AND off.dim = p.dim AND size > 0
          AND "offset" <= greatest(0, pos) AND greatest(0, pos) < "offset" + size),
          (SELECT max(idx) + 1 FROM off WHERE off.sheet = p.sheet AND off.dim = p.dim)) AS idx FROM points p""",
    f"{_OFF}, {_POINTS}",
)
def _locate(f: Fixtures):
    rows = f.sheet_rows().selectExpr("sheet", "'row' AS dim", "row AS id", "CAST(row * 37 % 20000 AS DOUBLE) AS pos")
    cols = f.sheet_rows().selectExpr("sheet", "'col' AS dim", "row AS id", "CAST(row * 7 % 600 AS DOUBLE) - 5 AS pos")
    return G.locate(rows.unionByName(cols), G.axis_offsets(f.axis()))


_CORNERS = """
anchors AS (SELECT s_suppkey AS sheet, s_suppkey AS anchor_id, 1 + s_suppkey % 4 AS c1, CAST(s_suppkey % 200 AS DOUBLE) AS dx1, 1 + s_suppkey % 50 AS r1, 25::DOUBLE AS dy1,
              CASE WHEN s_suppkey % 3 > 0 THEN 2 + s_suppkey % 4 END AS c2, 5::DOUBLE AS dx2, CASE WHEN s_suppkey % 3 > 0 THEN 4 + s_suppkey % 50 END AS r2, 7::DOUBLE AS dy2
       FROM supplier),
corners AS (SELECT sheet, anchor_id, 'x' AS corner, 'col' AS dim, c1 AS idx, dx1 AS delta FROM anchors UNION ALL SELECT sheet, anchor_id, 'y', 'row', r1, dy1 FROM anchors
  UNION ALL SELECT sheet, anchor_id, 'x2', 'col', c2, dx2 FROM anchors UNION ALL SELECT sheet, anchor_id, 'y2', 'row', r2, dy2 FROM anchors),
placed AS (SELECT c.sheet, anchor_id, corner, coalesce("offset" + least(delta, size), ends) AS spot FROM corners c
  LEFT JOIN off o ON o.sheet = c.sheet AND o.dim = c.dim AND o.idx = c.idx
  LEFT JOIN (SELECT sheet, dim, max("offset" + size) AS ends FROM off GROUP BY sheet, dim) e ON e.sheet = c.sheet AND e.dim = c.dim WHERE c.idx IS NOT NULL),
drawn AS (SELECT sheet, anchor_id, x, y, CASE WHEN x2 IS NULL THEN 120 ELSE greatest(1, x2 - x) END::DOUBLE AS width, CASE WHEN y2 IS NULL THEN 80 ELSE greatest(1, y2 - y) END::DOUBLE AS height
  FROM (SELECT sheet, anchor_id, coalesce(max(spot) FILTER (corner = 'x'), 0) AS x, coalesce(max(spot) FILTER (corner = 'y'), 0) AS y,
               max(spot) FILTER (corner = 'x2') AS x2, max(spot) FILTER (corner = 'y2') AS y2 FROM placed GROUP BY sheet, anchor_id))
"""


def _drawings(f: Fixtures):
    return f.t("supplier").selectExpr(
        "s_suppkey AS sheet", "s_suppkey AS anchor_id", "1 + s_suppkey % 4 AS c1", "CAST(s_suppkey % 200 AS DOUBLE) AS dx1", "1 + s_suppkey % 50 AS r1",
        "CAST(25 AS DOUBLE) AS dy1", "CASE WHEN s_suppkey % 3 > 0 THEN 2 + s_suppkey % 4 END AS c2", "CAST(5 AS DOUBLE) AS dx2",
        "CASE WHEN s_suppkey % 3 > 0 THEN 4 + s_suppkey % 50 END AS r2", "CAST(7 AS DOUBLE) AS dy2",
        "CAST(120 AS DOUBLE) AS ext_w", "CAST(80 AS DOUBLE) AS ext_h",
    )


@query("anchor_boxes", "SELECT sheet, x, y, width, height FROM drawn", f"{_OFF}, {_CORNERS}")
def _anchors(f: Fixtures):
    return G.anchor_boxes(_drawings(f), G.axis_offsets(f.axis())).select("sheet", "x", "y", "width", "height")


_SPILL = f"""
written AS (
  SELECT sheet, "row", col, CASE WHEN col < 4 AND "row" % 2 = 0 THEN repeat(text, 15) ELSE text END AS text
  FROM valued WHERE NOT (col IN (2, 3) AND "row" % 3 = 0)),
spill AS (
  SELECT sheet, "row", col, length(text) * (0.52::DOUBLE * 96 / 72 * 11) + 4 AS need, lead(col) OVER (PARTITION BY sheet, "row" ORDER BY col) AS nxt FROM written),
runs AS (
  SELECT col, k, sum(CASE WHEN col + k <= 12 THEN 64 + 10 * (col + k) ELSE {G.DEFAULT_COL_PX} END) OVER (PARTITION BY col ORDER BY k) AS run
  FROM (SELECT unnest(range(1, 6)) AS col) CROSS JOIN (SELECT unnest(range(0, 50)) AS k)),
reach AS (
  SELECT s.sheet, s."row", s.col, CASE WHEN s.col = 5 OR s."row" % 2 = 0
      THEN greatest(s.col, least(coalesce(s.nxt - 1, s.col + 50), s.col + count(*) FILTER (r.run < s.need))) ELSE s.col END AS end_col
  FROM spill s JOIN runs r ON r.col = s.col GROUP BY s.sheet, s."row", s.col, s.nxt)
"""


def _written(f: Fixtures):
    """Rows where text of columns 1 to 3 is long, and rows where columns 2 and 3 are empty, in all four combinations."""
    cells = f.valued().filter("NOT (col IN (2, 3) AND row % 3 = 0)")
    return cells.withColumn("text", F.expr("CASE WHEN col < 4 AND row % 2 = 0 THEN repeat(text, 15) ELSE text END"))


def _overflow(f: Fixtures):
    cells = _written(f).withColumn("spills", F.expr("col = 5 OR row % 2 = 0"))
    sizes = f.t("supplier").selectExpr("s_suppkey AS sheet", "explode(sequence(1, 12)) AS col").selectExpr(
        "sheet", "col", "CAST(64 + 10 * col AS DOUBLE) AS size"
    )
    return G.overflow_extent(cells, sizes, 0.52 * 96 / 72 * 11)


@query("overflow_extent", """SELECT sheet, "row", col, CAST(end_col AS INTEGER) AS end_col FROM reach""", _SPILL)
def _overflow_query(f: Fixtures):
    return _overflow(f).select("sheet", "row", "col", F.col("end_col").cast("int").alias("end_col"))


@query(
    "used_range",
    """SELECT sheet, min(r) AS r1, CAST(min(c) AS BIGINT) AS c1, max(r) AS r2, CAST(max(c) AS BIGINT) AS c2 FROM (
         SELECT sheet, "row" AS r, col AS c FROM written UNION ALL SELECT sheet, r1, c1 FROM merges UNION ALL SELECT sheet, r2, c2 FROM merges
         UNION ALL SELECT sheet, "row", end_col FROM reach) GROUP BY sheet""",
    _SPILL,
)
def _used(f: Fixtures):
    out = G.used_range(_written(f).withColumn("col", F.col("col").cast("long")), f.merges(), _overflow(f).withColumn("end_col", F.col("end_col").cast("long")))
    return out


@query(
    "expand_merges",
    """SELECT c.sheet, c."row", c.col, CASE WHEN m.r1 = c."row" AND m.c1 = c.col THEN m.r2 ELSE c."row" END AS end_row,
              CASE WHEN m.r1 = c."row" AND m.c1 = c.col THEN m.c2 ELSE c.col END AS end_col,
              m.r1 IS NOT NULL AND NOT (m.r1 = c."row" AND m.c1 = c.col) AS covered
       FROM valued c LEFT JOIN merges m ON m.sheet = c.sheet AND c."row" BETWEEN m.r1 AND m.r2 AND c.col BETWEEN m.c1 AND m.c2""",
)
def _merges(f: Fixtures):
    return G.expand_merges(f.valued(), f.merges()).select("sheet", "row", "col", "end_row", F.col("end_col").cast("long").alias("end_col"), "covered")


_SHOWN = """SELECT c.sheet, c."row", c.col FROM valued c JOIN ({sheets}) s ON s.sheet = c.sheet
  WHERE NOT EXISTS (SELECT 1 FROM axis a WHERE a.sheet = c.sheet AND a.hidden AND ((a.dim = 'row' AND a.idx = c."row") OR (a.dim = 'col' AND a.idx = c.col)))"""


@query("visible_all", _SHOWN.format(sheets="SELECT sheet FROM sheets WHERE NOT hidden"))
def _visible_all(f: Fixtures):
    return G.visible(f.valued(), f.axis(), f.sheets()).select("sheet", "row", "col")


@query(
    "visible_active",
    _SHOWN.format(
        sheets="""SELECT CASE WHEN a IS NOT NULL AND NOT ah THEN a ELSE v END AS sheet FROM (
          SELECT workbook, min(sheet) FILTER (WHERE active) AS a, arg_min(hidden, sheet) FILTER (WHERE active) AS ah,
                 min(sheet) FILTER (WHERE NOT hidden) AS v FROM sheets GROUP BY workbook)"""
    ),
)
def _visible_active(f: Fixtures):
    return G.visible(f.valued(), f.axis(), f.sheets(), "active").select("sheet", "row", "col")


def _segments_sql(cap_row: str, cap_col: str) -> str:
    return f"""
scales AS (SELECT sheet, greatest(0.1, least(4.0, least(1.0, 300.0::DOUBLE / w)))::DOUBLE AS scale FROM (
  SELECT sheet, sum(CASE WHEN dim = 'col' AND NOT hidden THEN size ELSE 0 END) AS w FROM axis GROUP BY sheet)),
bands AS (SELECT sheet, 'row' AS dim, tr1 AS t1, tr2 AS t2 FROM titles UNION ALL SELECT sheet, 'col', tc1, tc2 FROM titles),
taken AS (SELECT a.sheet, a.dim, sum(CASE WHEN hidden THEN 0 ELSE size END) AS taken FROM axis a JOIN bands b ON b.sheet = a.sheet AND b.dim = a.dim AND a.idx BETWEEN t1 AND t2 GROUP BY 1, 2),
items AS (
  SELECT concat(a.sheet, ':', a.dim) AS k, a.sheet, a.dim, a.idx, CASE WHEN hidden THEN 0 ELSE size END AS size, b.idx IS NOT NULL AS brk,
         CASE WHEN a.dim = 'row' THEN {cap_row} ELSE {cap_col} END / scale - coalesce(taken, 0) AS cap
  FROM axis a JOIN scales s ON s.sheet = a.sheet LEFT JOIN taken t ON t.sheet = a.sheet AND t.dim = a.dim
  LEFT JOIN breaks b ON b.sheet = a.sheet AND b.dim = a.dim AND b.idx = a.idx),
{PACK_SQL},
segs AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY page_seq) AS seg_no, min(idx) AS first_idx, max(idx) AS last_idx FROM walk GROUP BY k, page_seq HAVING sum(size) > 0),
segments AS (SELECT CAST(split_part(k, ':', 1) AS BIGINT) AS sheet, split_part(k, ':', 2) AS dim, seg_no, CAST(first_idx AS BIGINT) AS first_idx, CAST(last_idx AS BIGINT) AS last_idx FROM segs)
"""


_SEGMENTS = _segments_sql("400.0::DOUBLE", "300.0::DOUBLE")
_REGIONS = """
hits AS (
  SELECT DISTINCT v.sheet, r.seg_no AS row_seg, c.seg_no AS col_seg FROM valued v
  JOIN segments r ON r.sheet = v.sheet AND r.dim = 'row' AND v."row" BETWEEN r.first_idx AND r.last_idx
  JOIN segments c ON c.sheet = v.sheet AND c.dim = 'col' AND v.col BETWEEN c.first_idx AND c.last_idx
  UNION
  SELECT m.sheet, r.seg_no, c.seg_no FROM merges m
  JOIN segments r ON r.sheet = m.sheet AND r.dim = 'row' AND m.r2 >= r.first_idx AND m.r1 <= r.last_idx
  JOIN segments c ON c.sheet = m.sheet AND c.dim = 'col' AND m.c2 >= c.first_idx AND m.c1 <= c.last_idx),
pages_out AS (
  SELECT h.sheet, row_number() OVER (PARTITION BY h.sheet ORDER BY col_seg, row_seg) AS page_no, row_seg, col_seg,
         r.first_idx AS r1, r.last_idx AS r2, c.first_idx AS c1, c.last_idx AS c2
  FROM hits h JOIN segments r ON r.sheet = h.sheet AND r.dim = 'row' AND r.seg_no = row_seg
  JOIN segments c ON c.sheet = h.sheet AND c.dim = 'col' AND c.seg_no = col_seg)
"""


def _segments(f: Fixtures):
    axis = f.axis()
    scale = G.sheet_scale(axis, "fit-width", 300.0, 400.0)
    return G.grid_segments(axis, scale, 300.0, 400.0, f.breaks(), f.titles())


@query("grid_segments", "SELECT * FROM segments", _SEGMENTS)
def _segments_query(f: Fixtures):
    return _segments(f)


@query(
    "sheet_scale",
    """SELECT sheet, round(greatest(0.1, least(4.0, least(1.0, 300.0::DOUBLE / w))), 6)::DOUBLE AS fit_width,
              round(greatest(0.1, least(4.0, least(1.0, 300.0::DOUBLE / w, 400.0::DOUBLE / h))), 6)::DOUBLE AS fit_page,
              round(greatest(0.1, least(4.0, least(1.0, 300.0::DOUBLE / w, 2400.0::DOUBLE / h))), 6)::DOUBLE AS fit_pages, 4.0::DOUBLE AS fixed
       FROM (SELECT sheet, sum(CASE WHEN dim = 'col' AND NOT hidden THEN size END) AS w, sum(CASE WHEN dim = 'row' AND NOT hidden THEN size END) AS h FROM axis GROUP BY 1)""",
)
def _scale(f: Fixtures):
    axis, out = f.axis(), None
    for name, args in {
        "fit_width": ("fit-width", 300.0, 400.0), "fit_page": ("fit-page", 300.0, 400.0),
        "fit_pages": ("fit", 300.0, 400.0, 1, 6), "fixed": ("fixed", 300.0, 400.0, 0, 0, 900.0),
    }.items():
        part = G.sheet_scale(axis, *args).select("sheet", F.round("scale", 6).alias(name))
        out = part if out is None else out.join(part, "sheet")
    return out


@query("paginate_grid", "SELECT * FROM pages_out", f"{_SEGMENTS}, {_REGIONS}")
def _paginate(f: Fixtures):
    return G.paginate_grid(f.valued(), _segments(f), f.merges())


def _rectangles(segments):
    """Every pair of a row and a column segment of a sheet."""
    rows, cols = (segments.filter(F.col("dim") == d) for d in ("row", "col"))
    counts = cols.groupBy("sheet").agg(F.max("seg_no").alias("n"))
    return rows.select("sheet", F.col("seg_no").alias("row_seg")).join(counts, "sheet").select(
        "sheet", "row_seg", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("col_seg")
    )


@query("nonempty_regions", "SELECT sheet, row_seg, col_seg FROM hits", f"{_SEGMENTS}, {_REGIONS}")
def _regions(f: Fixtures):
    segments = _segments(f)
    return G.nonempty_regions(_rectangles(segments), f.valued(), segments, f.merges())


# Further sheets without any value: one cell that has a style only, or a drawing only.
_PRINTED = """
axis2 AS (SELECT * FROM axis UNION ALL
  SELECT s_suppkey + k, 'row', i, CAST(20 AS DOUBLE), i % 17 = 0 FROM supplier, (VALUES (1000000), (2000000)) e(k), range(1, 61) t(i) UNION ALL
  SELECT s_suppkey + k, 'col', i, CAST(64 + 10 * i AS DOUBLE), false FROM supplier, (VALUES (1000000), (2000000)) e(k), range(1, 9) t(i)),
looks AS (SELECT 0 AS style, false AS shown UNION ALL SELECT 1, true UNION ALL SELECT 2, true UNION ALL SELECT 3, false UNION ALL SELECT 4, true),
marked AS (SELECT sheet, "row", col FROM (
    SELECT sheet, "row", col, raw, ("row" + col) % 5 AS style FROM cells
    UNION ALL SELECT s_suppkey + 1000000, 5 + s_suppkey % 40, 2 + s_suppkey % 6, '', s_suppkey % 5 FROM supplier) JOIN looks USING (style) WHERE raw <> '' OR shown)
"""
_OFF2, _SEGMENTS2 = _OFF.replace("FROM axis", "FROM axis2"), _SEGMENTS.replace("FROM axis", "FROM axis2")
_CORNERS2 = _CORNERS.replace("FROM supplier)", "FROM supplier UNION ALL SELECT s_suppkey + 2000000, s_suppkey, 2 + s_suppkey % 4, 10, 3 + s_suppkey % 20, 4, 4 + s_suppkey % 4, 9, 12 + s_suppkey % 40, 3 FROM supplier)")
_HITS2 = """
ext AS (SELECT s.sheet, s.dim, seg_no, a."offset" AS lo, b."offset" + b.size AS hi FROM segments s
  JOIN off a ON a.sheet = s.sheet AND a.dim = s.dim AND a.idx = first_idx JOIN off b ON b.sheet = s.sheet AND b.dim = s.dim AND b.idx = last_idx),
hits2 AS (
  SELECT m.sheet, r.seg_no AS row_seg, c.seg_no AS col_seg FROM marked m
  JOIN segments r ON r.sheet = m.sheet AND r.dim = 'row' AND m."row" BETWEEN r.first_idx AND r.last_idx
  JOIN segments c ON c.sheet = m.sheet AND c.dim = 'col' AND m.col BETWEEN c.first_idx AND c.last_idx
  UNION SELECT * FROM hits
  UNION SELECT b.sheet, r.seg_no, c.seg_no FROM drawn b
  JOIN ext r ON r.sheet = b.sheet AND r.dim = 'row' AND y < r.hi AND y + height > r.lo JOIN ext c ON c.sheet = b.sheet AND c.dim = 'col' AND x < c.hi AND x + width > c.lo)
"""


def _printed(f: Fixtures):
    """Axes, printed cells and drawing boxes of all sheets, those without values included."""
    more = f.t("supplier").selectExpr("s_suppkey", "explode(array(1000000, 2000000)) AS k")
    rows = more.selectExpr("s_suppkey + k AS sheet", "'row' AS dim", "explode(sequence(1L, 60L)) AS idx").selectExpr("*", "20D AS size", "idx % 17 = 0 AS hidden")
    cols = more.selectExpr("s_suppkey + k AS sheet", "'col' AS dim", "explode(sequence(1L, 8L)) AS idx").selectExpr("*", "CAST(64 + 10 * idx AS DOUBLE) AS size", "false AS hidden")
    axis = f.axis().unionByName(rows).unionByName(cols)
    styled = f.cells().selectExpr("sheet", "row", "CAST(col AS BIGINT) AS col", "raw AS text", "(row + col) % 5 AS style").unionByName(
        f.t("supplier").selectExpr("s_suppkey + 1000000 AS sheet", "5 + s_suppkey % 40 AS row", "2 + s_suppkey % 6 AS col", "'' AS text", "s_suppkey % 5 AS style")
    )
    looks = f.t("region").sparkSession.createDataFrame(
        [(0, None, None, None, None, None), (1, None, None, None, None, True), (2, True, None, None, None, None), (3, False, False, False, False, False), (4, None, True, None, True, None)],
        "style long, fill boolean, b_left boolean, b_right boolean, b_top boolean, b_bottom boolean",
    )
    drawings = _drawings(f).unionByName(
        f.t("supplier").selectExpr(
            "s_suppkey + 2000000 AS sheet", "s_suppkey AS anchor_id", "2 + s_suppkey % 4 AS c1", "10D AS dx1", "3 + s_suppkey % 20 AS r1", "4D AS dy1",
            "4 + s_suppkey % 4 AS c2", "9D AS dx2", "12 + s_suppkey % 40 AS r2", "3D AS dy2", "CAST(NULL AS DOUBLE) AS ext_w", "CAST(NULL AS DOUBLE) AS ext_h",
        )
    )
    offsets = stage(G.axis_offsets(axis), "offsets")
    boxes = stage(G.anchor_boxes(drawings, offsets).select("sheet", "anchor_id", "x", "y", "width", "height"), "boxes")
    return axis, G.printed_cells(styled, looks), offsets, boxes


@query(
    "used_range_printed",
    """SELECT sheet, min(r) AS r1, CAST(min(c) AS BIGINT) AS c1, max(r) AS r2, CAST(max(c) AS BIGINT) AS c2 FROM (
         SELECT sheet, "row" AS r, col AS c FROM marked UNION ALL SELECT sheet, r1, c1 FROM merges UNION ALL SELECT sheet, r2, c2 FROM merges
         UNION ALL SELECT sheet, at_row, at_col FROM (SELECT sheet, unnest([y, y + height - 1]) AS py, unnest([x, x + width - 1]) AS px FROM drawn) p
           JOIN LATERAL (SELECT coalesce(max(idx) FILTER (size > 0 AND "offset" <= greatest(0, p.py) AND greatest(0, p.py) < "offset" + size), max(idx) + 1) AS at_row FROM off WHERE off.sheet = p.sheet AND dim = 'row') ON true
           JOIN LATERAL (SELECT coalesce(max(idx) FILTER (size > 0 AND "offset" <= greatest(0, p.px) AND greatest(0, p.px) < "offset" + size), max(idx) + 1) AS at_col FROM off WHERE off.sheet = p.sheet AND dim = 'col') ON true
       ) GROUP BY sheet""",
    f"{_PRINTED}, {_OFF2}, {_CORNERS2}",
)
def _used_printed(f: Fixtures):
    _, marked, offsets, boxes = _printed(f)
    return G.used_range(f.valued().withColumn("col", F.col("col").cast("long")), f.merges(), marked=marked, boxes=G.box_cells(boxes, offsets))


@query(
    "paginate_printed",
    "SELECT sheet, row_number() OVER (PARTITION BY sheet ORDER BY col_seg, row_seg) AS page_no, row_seg, col_seg FROM hits2",
    f"{_PRINTED}, {_OFF2}, {_SEGMENTS2}, {_REGIONS}, {_CORNERS2}, {_HITS2}",
)
def _paginate_printed(f: Fixtures):
    axis, marked, offsets, boxes = _printed(f)
    segments = G.grid_segments(axis, G.sheet_scale(axis, "fit-width", 300.0, 400.0), 300.0, 400.0, f.breaks(), f.titles())
    pages = G.paginate_grid(f.valued(), segments, f.merges(), marked=marked, boxes=boxes, offsets=offsets)
    return pages.select("sheet", "page_no", "row_seg", "col_seg")


@query(
    "repeat_titles",
    """SELECT p.sheet, page_no, 'corner' AS pane, tr1 AS r1, tr2 AS r2, tc1 AS c1, tc2 AS c2 FROM pages_out p JOIN titles t ON t.sheet = p.sheet WHERE p.r1 > tr2 AND p.c1 > tc2
       UNION ALL SELECT p.sheet, page_no, 'rows', tr1, tr2, p.c1, p.c2 FROM pages_out p JOIN titles t ON t.sheet = p.sheet WHERE p.r1 > tr2
       UNION ALL SELECT p.sheet, page_no, 'cols', p.r1, p.r2, tc1, tc2 FROM pages_out p JOIN titles t ON t.sheet = p.sheet WHERE p.c1 > tc2
       UNION ALL SELECT sheet, page_no, 'body', r1, r2, c1, c2 FROM pages_out""",
    f"{_SEGMENTS}, {_REGIONS}",
)
def _titles(f: Fixtures):
    return G.repeat_titles(G.paginate_grid(f.valued(), _segments(f), f.merges()), f.titles())


