"""Cell-grid operators: typing, styles, merges, visibility, geometry and page layout of sheets.

Cells are ``sheet, row, col`` plus payload, sizes ``sheet, dim ('row'/'col'), idx, size, hidden``.
Rows and columns count from 1.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions.js import trim
from docframe.plans.packing import pack_pages, page_segments
from docframe.plans.scan import attach, bucket_of, explode_span, last_before, ordered_scan
from docframe.plans.stage import stage

# Reference defaults.
COL_SPAN_LIMIT = 2_000
OVERFLOW_LIMIT = 50
COL_BLOCK = 256
STYLE_BLOCK = 256
DEFAULT_COL_WIDTH = 9.140625
# Fixed value: the default width at 7 pixels per digit, rounded.
DEFAULT_COL_PX = 64.0
NUMERIC = r"^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"
EPOCH_1904 = 1462

# Number formats with a built-in id.
BUILTIN_FORMATS = {
    0: "General",
    1: "0",
    2: "0.00",
    3: "#,##0",
    4: "#,##0.00",
    5: '"$"#,##0_);\\("$"#,##0\\)',
    6: '"$"#,##0_);[Red]\\("$"#,##0\\)',
    7: '"$"#,##0.00_);\\("$"#,##0.00\\)',
    8: '"$"#,##0.00_);[Red]\\("$"#,##0.00\\)',
    9: "0%",
    10: "0.00%",
    11: "0.00E+00",
    12: "# ?/?",
    13: "# ??/??",
    14: "m/d/yyyy",
    15: "d-mmm-yy",
    16: "d-mmm",
    17: "mmm-yy",
    18: "h:mm AM/PM",
    19: "h:mm:ss AM/PM",
    20: "h:mm",
    21: "h:mm:ss",
    22: "m/d/yyyy h:mm",
    37: "#,##0 ;(#,##0)",
    38: "#,##0 ;[Red](#,##0)",
    39: "#,##0.00;(#,##0.00)",
    40: "#,##0.00;[Red](#,##0.00)",
    41: '_(* #,##0_);_(* \\(#,##0\\);_(* "-"_);_(@_)',
    42: '_("$"* #,##0_);_("$"* \\(#,##0\\);_("$"* "-"_);_(@_)',
    43: '_(* #,##0.00_);_(* \\(#,##0.00\\);_(* "-"??_);_(@_)',
    44: '_("$"* #,##0.00_);_("$"* \\(#,##0.00\\);_("$"* "-"??_);_(@_)',
    45: "mm:ss",
    46: "[h]:mm:ss",
    47: "mmss.0",
    48: "##0.0E+0",
    49: "@",
}


# -- values ------------------------------------------------------------------------------------


def to_cells(df: DataFrame, key: Sequence[str], columns: Sequence[str], row: str) -> DataFrame:
    """Wide rows to typed cells: ``*key, row, col, type (n/s), num, str``; empty values are dropped.

    ``row`` is the 1-based row column. A value is numeric if it reads as a number and has fewer
    than 16 characters.
    """
    values = [F.struct(F.lit(i + 1).alias("col"), F.col(c).cast("string").alias("raw")) for i, c in enumerate(columns)]
    long = df.select(*key, F.col(row).alias("row"), F.inline(F.array(*values))).filter("raw IS NOT NULL AND raw <> ''")
    numeric = trim("raw").rlike(NUMERIC) & (F.length(trim("raw")) < 16)
    return long.select(
        *key,
        "row",
        "col",
        F.when(numeric, F.lit("n")).otherwise(F.lit("s")).alias("type"),
        F.when(numeric, trim("raw").try_cast("double")).alias("num"),
        F.when(~numeric, F.col("raw")).alias("str"),
    )


def resolve_strings(cells: DataFrame, shared: DataFrame) -> DataFrame:
    """Cells with tag ``s`` take the shared text of their index; a missing one is empty.

    ``shared``: ``idx, text``. Only string cells meet the table, so the others cannot pile up on a
    null key.
    """
    strings = cells.filter("tag = 's'").withColumn("idx", F.col("raw").try_cast("long"))
    joined = strings.join(shared, "idx", "left").withColumn("raw", F.coalesce("text", F.lit("")))
    return joined.select(*cells.columns).unionByName(cells.filter("NOT tag <=> 's'"))


def date_to_serial(ts: Column, epoch_1904: bool = False) -> Column:
    """Days since 1899-12-30 (or the 1904 epoch) as a double."""
    days = F.unix_micros(ts.cast("timestamp")) / F.lit(86_400e6) + F.lit(25_569.0)
    return days - F.lit(EPOCH_1904) if epoch_1904 else days


def serial_to_date(serial: Column, epoch_1904: bool = False) -> Column:
    """Calendar date of a day serial."""
    days = F.floor(serial + F.lit(EPOCH_1904 if epoch_1904 else 0)).cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), days)


def type_cells(cells: DataFrame) -> DataFrame:
    """Raw cells to typed ones: ``sheet, row, col, type, num, str, bool``.

    ``cells``: ``sheet, row, col, tag, raw`` with strings already resolved. Tags ``s``, ``str`` and
    ``inlineStr`` give text, ``b`` a flag, ``e`` an error code, ``d`` an ISO date as serial, anything
    else a number (blank = null).
    """
    tag, raw = F.col("tag"), F.col("raw")
    kind = F.when(tag.isin("s", "str", "inlineStr"), "s").when(tag.isin("b", "e", "d"), tag).otherwise("n")
    num = F.when(kind == "n", F.when(raw != "", raw.try_cast("double"))).when(
        kind == "d", date_to_serial(raw.try_cast("timestamp"))
    )
    text = F.when(kind == "s", F.coalesce(raw, F.lit(""))).when(kind == "e", F.coalesce(raw, F.lit("#N/A")))
    return cells.select(
        *[c for c in cells.columns if c not in ("tag", "raw")],
        kind.alias("type"), num.alias("num"), text.alias("str"), F.when(kind == "b", raw == "1").alias("bool"),
    )


def empty_formula_sheets(cells: DataFrame) -> DataFrame:
    """``sheet, empty_formulas``: some formula has no stored value (``formula`` flags formulas)."""
    return cells.groupBy("sheet").agg(
        F.bool_or(F.col("formula") & (F.coalesce("raw", F.lit("")) == "")).alias("empty_formulas")
    )


def _listed(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """One list per key with every ``value`` at its place ``__k`` (from 0); of several at one place the greatest."""
    one = df.filter(F.col(value).isNotNull()).groupBy(*keys, "__k").agg(F.max(value).alias("v"))
    at = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__k", "v"))).alias("__m"))
    return at.select(*keys, F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("__m"))), lambda k: F.try_element_at("__m", k)).alias(out))


def resolve_style(cells: DataFrame, rows: DataFrame, cols: DataFrame, styles: DataFrame, formats: DataFrame) -> DataFrame:
    """Style id = own, else row, else column, else 0; format code = custom, built-in, ``General``.

    ``cells``: ``sheet, row, col, style``; ``rows``: ``sheet, row, style``; ``cols``: ``sheet, col, style``;
    ``styles``: ``style, fmt_id``; ``formats``: ``fmt_id, code``.
    """
    # Styles of rows become short lists per block of a sheet, and those of its columns lie beside them: cells are dealt
    # once, by block, and look both up by place.
    block, place = (lambda c: F.floor(F.col(c) / STYLE_BLOCK).cast("long")), (lambda c: F.pmod(F.col(c), F.lit(STYLE_BLOCK)).cast("int"))
    codes = styles.join(formats, "fmt_id", "left").select("style", "fmt_id", F.col("code").alias("__code"))
    held = _listed(rows.select("sheet", block("row").alias("__blk"), place("row").alias("__k"), "style"), ["sheet", "__blk"], "style", "__rows")
    across = _listed(cols.select("sheet", block("col").alias("__b"), place("col").alias("__k"), "style"), ["sheet", "__b"], "style", "__part")
    across = _listed(across.select("sheet", F.col("__b").cast("int").alias("__k"), "__part"), ["sheet"], "__part", "__cols")
    cells = cells.withColumn("__blk", block("row"))
    blocks = cells.select("sheet", "__blk").distinct().join(held, ["sheet", "__blk"], "left").join(across, "sheet", "left")
    own = F.coalesce("style", F.get("__rows", place("row")), F.get(F.get("__cols", block("col").cast("int")), place("col")), F.lit(0).cast("long"))
    out = cells.join(blocks, ["sheet", "__blk"]).withColumn("style", own).drop("__rows", "__cols", "__blk")
    # Styles are few and shared by many cells: left to AQE, which broadcasts or splits the join.
    out = out.join(codes, "style", "left")
    builtin = F.create_map(*[F.lit(v) for pair in BUILTIN_FORMATS.items() for v in pair])
    code = F.coalesce("__code", F.try_element_at(builtin, F.col("fmt_id").cast("int")), F.lit("General"))
    return out.withColumn("format", code).drop("__code", "fmt_id")


def expand_col_spans(spans: DataFrame, limit: int = COL_SPAN_LIMIT) -> DataFrame:
    """``sheet, ord, min, max`` + payload to one row per column; a later span wins."""
    lo, top = F.col("min").cast("long"), F.least("max", F.col("min") + limit, F.lit(16_384)).cast("long")
    payload = [c for c in spans.columns if c not in ("sheet", "ord", "min", "max")]
    # Spans are cut at block borders and settled inside a block before any column is listed: one range of a block has
    # one winner, so a block holds at most COL_BLOCK^2 / 2 of them, and listing columns needs no memory.
    cut = spans.withColumn("__lo", lo).withColumn("__top", top).filter("__top >= __lo").withColumn(
        "__blk", F.explode(F.sequence(bucket_of("__lo", COL_BLOCK), bucket_of("__top", COL_BLOCK)))
    )
    start = F.col("__blk") * COL_BLOCK
    cut = cut.withColumn("__lo", F.greatest("__lo", start)).withColumn("__top", F.least("__top", start + COL_BLOCK - 1))
    ranges = cut.groupBy("sheet", "__blk", "__lo", "__top").agg(F.max("ord").alias("ord"), F.max_by(F.struct(*payload), "ord").alias("p"))
    blocks = ranges.groupBy("sheet", "__blk").agg(F.collect_list(F.struct("__lo", "__top", "ord", "p")).alias("__all"))
    later = F.array_sort("__all", lambda a, b: F.when(a["ord"] > b["ord"], -1).when(a["ord"] < b["ord"], 1).otherwise(0))
    wins = blocks.select("sheet", "__blk", later.alias("__all")).withColumn("idx", F.explode(F.sequence(start, start + COL_BLOCK - 1)))
    first = F.get(F.filter("__all", lambda s: (s["__lo"] <= F.col("idx")) & (F.col("idx") <= s["__top"])), F.lit(0))
    return wins.select("sheet", "idx", first.alias("w")).filter("w IS NOT NULL").select("sheet", "idx", "w.p.*")


# -- geometry ----------------------------------------------------------------------------------


def longest_line(text: Column) -> Column:
    """Characters in the longest line."""
    return F.when(~F.contains(text, F.lit("\n")), F.length(text)).otherwise(_longest_of_many(text))


def _longest_of_many(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, r"\r?\n", -1), lambda s: F.length(s)))


def autosize_columns(cells: DataFrame) -> DataFrame:
    """``sheet, col, width``: longest text line, clamped to 9.14 … 60 characters."""
    chars = cells.filter("text <> ''").groupBy("sheet", "col").agg(F.max(longest_line(F.col("text"))).alias("n"))
    return chars.select("sheet", "col", F.least(F.lit(60.0), F.greatest(F.lit(9.14), F.col("n") * 1.1 + 1.8)).alias("width"))


def shown_size() -> Column:
    """Size with hidden entries at 0."""
    return F.when(F.coalesce("hidden", F.lit(False)), F.lit(0.0)).otherwise(F.col("size"))


def axis_offsets(axis: DataFrame) -> DataFrame:
    """Adds ``offset`` (sum of the sizes before, hidden = 0) and sets ``size`` to the shown size."""
    return ordered_scan(
        axis.withColumn("size", shown_size()), ["sheet", "dim"], ["idx"], bucket_of("idx"), before={"offset": F.col("size")}
    )


def _axis_ends(offsets: DataFrame) -> DataFrame:
    """``sheet, dim, __last, __end``: last index and total size of every axis."""
    return offsets.groupBy("sheet", "dim").agg(F.max("idx").alias("__last"), F.max(F.col("offset") + F.col("size")).alias("__end"))


def span_size(offsets: DataFrame, ranges: DataFrame, dim: str, first: str, last: str, out: str) -> DataFrame:
    """Width or height of ``first..last`` as a difference of two offsets; what lies past the axis has no size."""
    side = offsets.filter(F.col("dim") == dim)
    lo = side.select("sheet", F.col("idx").alias(first), F.col("offset").alias("__lo"))
    hi = side.select("sheet", F.col("idx").alias(last), (F.col("offset") + F.col("size")).alias("__hi"))
    ends = _axis_ends(side).select("sheet", "__end")
    end = F.coalesce("__end", F.lit(0.0))
    return (
        ranges.join(lo.hint("merge"), ["sheet", first], "left")
        .join(hi.hint("merge"), ["sheet", last], "left")
        .join(ends, "sheet", "left")
        .withColumn(out, F.coalesce("__hi", end) - F.coalesce("__lo", end))
        .drop("__lo", "__hi", "__end")
    )


def locate(points: DataFrame, offsets: DataFrame) -> DataFrame:
    """Index that contains a position: ``points`` (``sheet, dim, pos``) + ``idx``.

    An as-of search over the offsets of shown rows and columns. Positions past the end get the last index + 1,
    positions before 0 the first shown one.
    """
    # Read as steps and for the ends of the axes: the running sums are made once.
    offsets = stage(offsets.select("sheet", "dim", "idx", "size", "offset"), "offsets")
    steps = offsets.filter("size > 0").select("sheet", "dim", F.col("offset").alias("__at"), "idx")
    # Steps leave no gaps, and the end of an axis is one more step behind them: a point is found by one search.
    ends = _axis_ends(offsets).select("sheet", "dim", F.col("__end").alias("__at"), (F.col("__last") + 1).alias("idx"))
    placed = last_before(points.withColumn("__p", F.greatest(F.lit(0.0), "pos")), steps.unionByName(ends), ["sheet", "dim"], "__p", "__at", "idx")
    return placed.select(*points.columns, "idx")


def anchor_boxes(anchors: DataFrame, offsets: DataFrame) -> DataFrame:
    """Drawing rectangles: adds ``x, y, width, height``.

    ``anchors``: ``sheet, anchor_id, c1, dx1, r1, dy1, c2, dx2, r2, dy2`` (``c2`` null = sized by
    ``ext_w, ext_h``), unique by ``sheet, anchor_id``. Offsets inside a cell are clamped to the cell; cells past
    the axis lie at its end. The corners are stacked, so the offsets are joined once.
    """
    corners = (("x", "col", "c1", "dx1"), ("y", "row", "r1", "dy1"), ("x2", "col", "c2", "dx2"), ("y2", "row", "r2", "dy2"))
    stacked = anchors.select(
        "sheet", "anchor_id",
        F.inline(F.array(*[F.struct(F.lit(n).alias("corner"), F.lit(d).alias("dim"), F.col(i).cast("long").alias("idx"), F.col(delta).cast("double").alias("delta")) for n, d, i, delta in corners])),
    ).filter("idx IS NOT NULL")
    at = F.coalesce(F.col("offset") + F.least("delta", "size"), "__end", F.lit(0.0))
    met = stacked.join(offsets.select("sheet", "dim", "idx", "offset", "size").hint("merge"), ["sheet", "dim", "idx"], "left").join(_axis_ends(offsets), ["sheet", "dim"], "left")
    boxes = met.groupBy("sheet", "anchor_id").agg(*[F.max(F.when(F.col("corner") == n, at)).alias(f"__{n}") for n, _, _, _ in corners])
    sized = F.col("c2").isNull()
    return anchors.join(boxes, ["sheet", "anchor_id"]).select(
        *[anchors[c] for c in anchors.columns], F.col("__x").alias("x"), F.col("__y").alias("y"),
        F.when(sized, F.coalesce("ext_w", F.lit(0.0))).otherwise(F.greatest(F.lit(1.0), F.col("__x2") - F.col("__x"))).alias("width"),
        F.when(sized, F.coalesce("ext_h", F.lit(0.0))).otherwise(F.greatest(F.lit(1.0), F.col("__y2") - F.col("__y"))).alias("height"),
    )


def box_cells(boxes: DataFrame, offsets: DataFrame) -> DataFrame:
    """First and last cell under every drawing rectangle: adds ``r1, c1, r2, c2``."""
    sides = (("c1", "col", F.col("x")), ("r1", "row", F.col("y")), ("c2", "col", F.col("x") + F.col("width") - 1), ("r2", "row", F.col("y") + F.col("height") - 1))
    points = boxes.select(
        "sheet", "anchor_id", F.inline(F.array(*[F.struct(F.lit(n).alias("side"), F.lit(d).alias("dim"), p.cast("double").alias("pos")) for n, d, p in sides]))
    )
    at = locate(points, offsets).groupBy("sheet", "anchor_id").agg(*[F.max(F.when(F.col("side") == n, F.col("idx"))).alias(n) for n, _, _ in sides])
    return boxes.join(at, ["sheet", "anchor_id"])


def printed_cells(cells: DataFrame, styles: DataFrame) -> DataFrame:
    """Cells with something to print: a value (``text`` not empty), or a style with a fill or a border.

    ``styles``: ``style, fill, b_left, b_right, b_top, b_bottom``. A few styles are shared by all cells, so dealing cells by
    style would put them in as few tasks; the styles are sent to the cells instead. A workbook holds at most 65,490 of them.
    """
    marks = [F.coalesce(c, F.lit(False)) for c in ("fill", "b_left", "b_right", "b_top", "b_bottom")]
    marked = styles.select("style", reduce(lambda a, b: a | b, marks).alias("__marked"))
    out = cells.join(F.broadcast(marked), "style", "left")
    return out.filter((F.coalesce("text", F.lit("")) != "") | F.coalesce("__marked", F.lit(False))).select(*[cells[c] for c in cells.columns])


def overflow_extent(
    cells: DataFrame, col_sizes: DataFrame, char_px: float = 0.52 * 96 / 72 * 11, default_size: float = DEFAULT_COL_PX
) -> DataFrame:
    """Last column reached by text that runs into empty neighbours: adds ``end_col``.

    ``cells``: all valued cells as ``sheet, row, col, text, spills`` (``spills`` marks unwrapped text that may
    overflow; the others only stop it); ``col_sizes``: ``sheet, col, size``, columns without an entry have
    ``default_size``. A row has at most 16,384 columns, so the window per row is bounded.
    """
    along = Window.partitionBy("sheet", "row").orderBy("col")
    steps = F.sequence(F.lit(0), F.lit(OVERFLOW_LIMIT - 1))
    at = F.col("col").cast("long")
    # Widths of a column and those ahead of it lie in its block of columns or the next one.
    blocks = col_sizes.groupBy("sheet", bucket_of(at, COL_BLOCK).alias("__blk")).agg(
        F.map_from_entries(F.collect_list(F.struct(at.alias("col"), "size"))).alias("__here")
    )
    ahead = blocks.select("sheet", (F.col("__blk") - 1).alias("__blk"), F.col("__here").alias("__ahead"))
    width = lambda k: F.coalesce(F.try_element_at("__here", at + k), F.try_element_at("__ahead", at + k), F.lit(default_size))
    # Running widths are added once per column of a sheet; cells only look them up.
    runs = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("used"), F.array().cast("array<double>").alias("runs")),
        lambda acc, k: F.struct((acc["used"] + width(k)).alias("used"), F.concat(acc["runs"], F.array(acc["used"] + width(k))).alias("runs")),
        lambda acc: acc["runs"],
    )
    spread = cells.select("sheet", "col", bucket_of("row").alias("__bucket")).distinct().withColumn("__blk", bucket_of(at, COL_BLOCK))
    spread = spread.join(blocks, ["sheet", "__blk"], "left").join(ahead, ["sheet", "__blk"], "left")
    spread = spread.select("sheet", "col", "__bucket", runs.alias("__runs"))
    fit = cells.withColumn("__need", longest_line(F.col("text")) * char_px + 4).withColumn("__next", F.lead("col").over(along))
    fit = fit.withColumn("__bucket", bucket_of("row")).join(spread, ["sheet", "col", "__bucket"])
    # Columns used = how many running widths are still below the needed width; none behind the next cell counts.
    room = F.greatest(F.lit(0), F.least(F.lit(OVERFLOW_LIMIT), F.col("__next") - F.col("col") - 1)).cast("int")
    reach = F.size(F.filter(F.slice("__runs", F.lit(1), room), lambda w: w < F.col("__need")))
    spilt = F.col("spills") & (room > 0) & (F.col("__need") > F.get("__runs", F.lit(0)))
    end = F.when(spilt, F.col("col") + reach).otherwise(F.col("col"))
    return fit.select(*cells.columns, end.alias("end_col"))


def valued_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges whose top-left cell holds a value."""
    heads = cells.select("sheet", F.col("row").alias("r1"), F.col("col").alias("c1"))
    return merges.join(heads, ["sheet", "r1", "c1"], "left_semi")


def used_range(
    cells: DataFrame, merges: DataFrame, overflow: DataFrame | None = None, marked: DataFrame | None = None, boxes: DataFrame | None = None
) -> DataFrame:
    """Bounding box per sheet: ``r1, c1, r2, c2``.

    It holds valued cells, valued merges and, where given, overflowing text, cells that only have a fill or a border
    (``marked``, see :func:`printed_cells`) and drawings (``boxes``, see :func:`box_cells`).
    """
    corners = F.inline(F.array(*[F.struct(F.col(r).alias("row"), F.col(c).alias("col")) for r, c in (("r1", "c1"), ("r2", "c2"))]))
    parts = cells.select("sheet", "row", "col").unionByName(valued_merges(cells, merges).select("sheet", corners))
    if overflow is not None:
        parts = parts.unionByName(overflow.select("sheet", "row", F.col("end_col").alias("col")))
    if marked is not None:
        parts = parts.unionByName(marked.select("sheet", "row", "col"))
    if boxes is not None:
        parts = parts.unionByName(boxes.select("sheet", corners))
    return parts.groupBy("sheet").agg(
        F.min("row").alias("r1"), F.min("col").alias("c1"), F.max("row").alias("r2"), F.max("col").alias("c2")
    )


def expand_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Adds ``end_row, end_col`` (top-left of a merge) and ``covered`` (hidden under one).

    Merges are spread over their rows only and joined on the row; the column test is left.
    """
    by_row = explode_span(merges, "r1", "r2", "__row").withColumnRenamed("sheet", "__sheet")
    inside = (
        (F.col("sheet") == F.col("__sheet")) & (F.col("row") == F.col("__row"))
        & (F.col("col") >= F.col("c1")) & (F.col("col") <= F.col("c2"))
    )
    head = (F.col("row") == F.col("r1")) & (F.col("col") == F.col("c1"))
    return cells.join(by_row, inside, "left").select(
        *cells.columns,
        F.when(head, F.col("r2")).otherwise(F.col("row")).alias("end_row"),
        F.when(head, F.col("c2")).otherwise(F.col("col")).alias("end_col"),
        F.coalesce(~head, F.lit(False)).alias("covered"),
    )


def printed_sheets(sheets: DataFrame, scope: str = "all") -> DataFrame:
    """Sheets to print: all visible ones, or the active one (else the first visible) per workbook."""
    visible = sheets.filter("NOT hidden")
    if scope == "all":
        return visible
    picks = sheets.groupBy("workbook").agg(
        F.min(F.when(F.col("active"), F.struct("sheet", "hidden"))).alias("a"), F.min(F.when(~F.col("hidden"), F.col("sheet"))).alias("v")
    )
    chosen = F.when(F.col("a").isNotNull() & ~F.col("a.hidden"), F.col("a.sheet")).otherwise(F.col("v"))
    return visible.join(picks.select("workbook", chosen.alias("sheet")), ["workbook", "sheet"], "left_semi")


def visible(cells: DataFrame, axis: DataFrame, sheets: DataFrame, scope: str = "all") -> DataFrame:
    """Cells of printed sheets outside hidden rows and columns."""
    shown = attach(cells, printed_sheets(sheets, scope).select("sheet"), ["sheet"], bucket_of("row"), "inner")
    hidden = axis.filter("hidden")
    rows = hidden.filter("dim = 'row'").select("sheet", F.col("idx").alias("row"))
    cols = hidden.filter("dim = 'col'").select("sheet", F.col("idx").alias("col"), F.lit(True).alias("__gone"))
    left = shown.join(rows, ["sheet", "row"], "left_anti")
    return attach(left, cols, ["sheet", "col"], bucket_of("row"), buckets_from=cells).filter("__gone IS NULL").drop("__gone")


# -- page layout -------------------------------------------------------------------------------


def sheet_scale(
    axis: DataFrame, mode: str, print_w: float, print_h: float, fit_w: int = 0, fit_h: int = 0, percent: float = 100.0
) -> DataFrame:
    """``sheet, scale`` for ``fit-width``, ``fit-page``, ``fit`` (``fit_w`` × ``fit_h`` pages) or ``fixed``."""
    total = axis.groupBy("sheet").agg(
        F.sum(F.when(F.col("dim") == "col", shown_size())).alias("w"), F.sum(F.when(F.col("dim") == "row", shown_size())).alias("h")
    )

    def ratio(room: float, size: str) -> Column:
        return F.when(F.col(size) > 0, F.lit(room) / F.col(size)).otherwise(F.lit(1.0))

    one = F.lit(1.0)
    scale = {
        "fit-width": F.least(one, ratio(print_w, "w")),
        "fit-page": F.least(one, ratio(print_w, "w"), ratio(print_h, "h")),
        "fit": F.least(one, *([ratio(fit_w * print_w, "w")] if fit_w else []), *([ratio(fit_h * print_h, "h")] if fit_h else []))
        if fit_w or fit_h else one,
        "fixed": F.lit(percent / 100.0),
    }[mode]
    return total.select("sheet", F.greatest(F.lit(0.1), F.least(F.lit(4.0), scale)).alias("scale"))


def grid_segments(
    axis: DataFrame, scale: DataFrame, print_w: float, print_h: float,
    breaks: DataFrame | None = None, titles: DataFrame | None = None,
) -> DataFrame:
    """Rows and columns cut into page-sized segments: ``sheet, dim, seg_no, first_idx, last_idx``.

    Repeated title rows and columns take their size off the room of every page.
    """
    items = axis.withColumn("size", shown_size())
    caps = scale.select(
        "sheet",
        F.inline(
            F.array(
                F.struct(F.lit("row").alias("dim"), (F.lit(print_h) / F.col("scale")).alias("cap")),
                F.struct(F.lit("col").alias("dim"), (F.lit(print_w) / F.col("scale")).alias("cap")),
            )
        ),
    )
    # Title bands and breaks are marks on single rows and columns: both are put on in one join, and what it gives is kept.
    marks = None
    if titles is not None:
        bands = titles.select(
            "sheet",
            F.inline(
                F.array(
                    F.struct(F.lit("row").alias("dim"), F.col("tr1").alias("t1"), F.col("tr2").alias("t2")),
                    F.struct(F.lit("col").alias("dim"), F.col("tc1").alias("t1"), F.col("tc2").alias("t2")),
                )
            ),
        ).filter("t1 IS NOT NULL")
        marks = explode_span(bands, "t1", "t2", "idx").select("sheet", "dim", "idx", F.lit(1).alias("__n"), F.lit(False).alias("brk"))
    if breaks is not None:
        stops = breaks.select("sheet", "dim", "idx", F.lit(0).alias("__n"), F.lit(True).alias("brk"))
        marks = stops if marks is None else marks.unionByName(stops)
    items = items.select("sheet", "dim", "idx", "size")
    if marks is not None:
        marks = marks.groupBy("sheet", "dim", "idx").agg(F.sum("__n").alias("__n"), F.bool_or("brk").alias("brk"))
        items = stage(items.join(marks.hint("merge"), ["sheet", "dim", "idx"], "left"), "marked")
    if titles is not None:
        taken = items.filter("__n > 0").groupBy("sheet", "dim").agg(F.sum(F.col("size") * F.col("__n")).alias("taken"))
        caps = caps.join(taken, ["sheet", "dim"], "left").withColumn("cap", F.col("cap") - F.coalesce("taken", F.lit(0.0))).drop("taken")
    packed = pack_pages(
        attach(items, caps, ["sheet", "dim"], bucket_of("idx"), "inner"), ["sheet", "dim"], "idx", "size", "cap", "brk" if marks is not None else None
    )
    segments = page_segments(packed, ["sheet", "dim"]).select(
        "sheet", "dim", F.col("page_no").alias("seg_no"), "first_idx", "last_idx"
    )
    # Layout steps read the segments several times; one row per page edge is cheap to keep.
    return stage(segments, "segments")


def segment_index(segments: DataFrame, dim: str) -> DataFrame:
    """``sheet, <dim>, <dim>_seg``: the segment of every row or column."""
    return explode_span(segments.filter(F.col("dim") == dim), "first_idx", "last_idx", dim).select(
        "sheet", dim, F.col("seg_no").alias(f"{dim}_seg")
    )


def drawn_regions(boxes: DataFrame, segments: DataFrame, offsets: DataFrame) -> DataFrame:
    """``sheet, row_seg, col_seg`` that a drawing rectangle overlaps.

    Each side of a rectangle becomes a range of segments by two as-of searches among the segment starts; only the
    segments inside both ranges are listed.
    """
    # Offsets have a row per row of a sheet and are stored in a few bytes each: merged, never sent to the driver.
    edge = offsets.select("sheet", "dim", "idx", "offset", (F.col("offset") + F.col("size")).alias("__hi")).hint("merge")
    starts = segments.join(edge.select("sheet", "dim", F.col("idx").alias("first_idx"), F.col("offset").alias("__at")), ["sheet", "dim", "first_idx"])
    starts = starts.join(edge.select("sheet", "dim", F.col("idx").alias("last_idx"), "__hi"), ["sheet", "dim", "last_idx"])
    steps = starts.select("sheet", "dim", "__at", F.struct(F.col("seg_no").alias("seg"), F.col("__hi").alias("hi")).alias("__step"))
    sides = boxes.select(
        "sheet", "anchor_id",
        F.inline(
            F.array(
                F.struct(F.lit("row").alias("dim"), F.col("y").alias("__lo"), (F.col("y") + F.col("height")).alias("__up")),
                F.struct(F.lit("col").alias("dim"), F.col("x").alias("__lo"), (F.col("x") + F.col("width")).alias("__up")),
            )
        ),
    )
    found = last_before(sides, steps, ["sheet", "dim"], "__lo", "__at", "__step")
    first = F.when(F.col("__step").isNull(), F.lit(1).cast("long")).when(F.col("__lo") < F.col("__step.hi"), F.col("__step.seg")).otherwise(F.col("__step.seg") + 1)
    found = last_before(found.withColumn("__first", first).drop("__step"), steps, ["sheet", "dim"], "__up", "__at", "__step", strict=True)
    found = found.withColumn("__to", F.col("__step.seg")).filter("__first <= __to")
    rows, cols = (
        found.filter(F.col("dim") == d).select("sheet", "anchor_id", F.col("__first").alias(f"__{d}1"), F.col("__to").alias(f"__{d}2")) for d in ("row", "col")
    )
    spans = rows.join(cols, ["sheet", "anchor_id"])
    return explode_span(explode_span(spans, "__row1", "__row2", "row_seg"), "__col1", "__col2", "col_seg").select("sheet", "row_seg", "col_seg").distinct()


def touched_regions(
    cells: DataFrame, segments: DataFrame, merges: DataFrame | None = None, marked: DataFrame | None = None,
    boxes: DataFrame | None = None, offsets: DataFrame | None = None,
) -> DataFrame:
    """Distinct ``sheet, row_seg, col_seg`` that hold a valued or ``marked`` cell or meet a valued merge or a drawing.

    Empty page rectangles are never formed: pages come from the content, not from a product of
    row and column segments.
    """
    rows, cols = segment_index(segments, "row"), segment_index(segments, "col")
    held = cells.select("sheet", "row", "col")
    if marked is not None:
        held = held.unionByName(marked.select("sheet", "row", "col"))
    # Columns per sheet are few and rows many, so rows are reduced to segments first.
    placed = held.join(rows, ["sheet", "row"]).groupBy("sheet", "row_seg", "col").agg(F.count(F.lit(1)).alias("n"))
    hit = placed.join(cols, ["sheet", "col"]).select("sheet", "row_seg", "col_seg")
    if merges is not None:
        m = valued_merges(cells, merges)
        by_row = explode_span(m, "r1", "r2", "row").join(rows, ["sheet", "row"]).select("sheet", "r1", "c1", "c2", "row_seg").distinct()
        by_col = explode_span(by_row, "c1", "c2", "col").select("sheet", "row_seg", "col").distinct()
        hit = hit.unionByName(by_col.join(cols, ["sheet", "col"]).select("sheet", "row_seg", "col_seg"))
    if boxes is not None:
        hit = hit.unionByName(drawn_regions(boxes, segments, offsets))
    return hit.distinct()


def nonempty_regions(
    regions: DataFrame, cells: DataFrame, segments: DataFrame, merges: DataFrame | None = None, marked: DataFrame | None = None,
    boxes: DataFrame | None = None, offsets: DataFrame | None = None,
) -> DataFrame:
    """Given page rectangles (``sheet, row_seg, col_seg``) that have something to print."""
    return regions.join(touched_regions(cells, segments, merges, marked, boxes, offsets), ["sheet", "row_seg", "col_seg"], "left_semi")


def paginate_grid(
    cells: DataFrame, segments: DataFrame, merges: DataFrame | None = None, order: str = "downThenOver", marked: DataFrame | None = None,
    boxes: DataFrame | None = None, offsets: DataFrame | None = None,
) -> DataFrame:
    """Pages per sheet in print order: ``sheet, page_no, row_seg, col_seg, r1, r2, c1, c2``."""
    pages = stage(touched_regions(cells, segments, merges, marked, boxes, offsets), "regions")
    major, minor = ("col_seg", "row_seg") if order == "downThenOver" else ("row_seg", "col_seg")
    # Bucket numbers grow along (major, minor): at most 1,024 buckets of the minor axis per major.
    bucket = F.col(major) * 1_048_576 + bucket_of(minor, 1024)
    numbered = ordered_scan(pages, ["sheet"], [major, minor], bucket, row_number="page_no")

    # A stored table of segments is a few compressed bytes per row: its size on disk is no measure for a broadcast.
    def span(dim: str, lo: str, hi: str) -> DataFrame:
        return segments.filter(F.col("dim") == dim).select(
            "sheet", F.col("seg_no").alias(f"{dim}_seg"), F.col("first_idx").alias(lo), F.col("last_idx").alias(hi)
        ).hint("merge")

    out = numbered.join(span("row", "r1", "r2"), ["sheet", "row_seg"])
    out = attach(out, span("col", "c1", "c2"), ["sheet", "col_seg"], bucket_of("row_seg", 1024), "inner", buckets_from=pages)
    return out.select("sheet", "page_no", "row_seg", "col_seg", "r1", "r2", "c1", "c2")


def repeat_titles(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """Panes of every page: the body and, after the title band, the repeated rows and columns.

    ``titles``: ``sheet, tr1, tr2, tc1, tc2`` (null = none). Output: ``sheet, page_no, pane, r1, r2, c1, c2``.
    """
    out = attach(pages, titles, ["sheet"], bucket_of("page_no"))
    rows = F.coalesce(F.col("r1") > F.col("tr2"), F.lit(False))
    cols = F.coalesce(F.col("c1") > F.col("tc2"), F.lit(False))

    def pane(name: str, r1: str, r2: str, c1: str, c2: str) -> Column:
        return F.struct(
            F.lit(name).alias("pane"), F.col(r1).alias("p_r1"), F.col(r2).alias("p_r2"), F.col(c1).alias("p_c1"), F.col(c2).alias("p_c2")
        )

    panes = F.array_compact(
        F.array(
            F.when(rows & cols, pane("corner", "tr1", "tr2", "tc1", "tc2")),
            F.when(rows, pane("rows", "tr1", "tr2", "c1", "c2")),
            F.when(cols, pane("cols", "r1", "r2", "tc1", "tc2")),
            pane("body", "r1", "r2", "c1", "c2"),
        )
    )
    return out.select("sheet", "page_no", F.inline(panes)).withColumnsRenamed(
        {"p_r1": "r1", "p_r2": "r2", "p_c1": "c1", "p_c2": "c2"}
    )
