"""Text overflow over whole rows, against a cell-by-cell walk."""

import io
import random
import re
from contextlib import redirect_stdout

from docframe.operators import grid as G
from docframe.operators import text as X
from docframe.plans import queries_grid as Q
from docframe.plans.scan import last_before
from docframe.plans.stage import stage
from docframe.sources.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


def walk(cells, sizes, default):
    """``(sheet, row, col) -> end_col``, one column at a time."""
    filled = {c[:3] for c in cells}
    out = {}
    for sheet, row, col, text, spills in cells:
        need = max(map(len, text.split("\n"))) * 10.0 + 4
        end, used = col, sizes.get((sheet, col), default)
        while spills and used < need and end < col + 50 and (sheet, row, end + 1) not in filled:
            end += 1
            used += sizes.get((sheet, end), default)
        out[sheet, row, col] = end
    return out


def test_overflow_goes_on_with_the_default_width(spark):
    sizes = {(1, 2): 30.0, (1, 4): 0.0, (1, 9): 200.0}
    cells = [
        (1, 1, 1, "x" * 40, True), (1, 2, 3, "x" * 60, True), (1, 3, 1, "x" * 40, True), (1, 3, 4, "7", False),
        (1, 4, 20, "x" * 30, True), (1, 5, 1, "x" * 900, True), (2, 1, 2, "x\n" + "y" * 25, True), (2, 2, 1, "x" * 50, False),
    ]
    got = G.overflow_extent(
        spark.createDataFrame(cells, "sheet long, row long, col long, text string, spills boolean"),
        spark.createDataFrame([(*k, v) for k, v in sizes.items()], "sheet long, col long, size double"), 10.0, 50.0,
    )
    assert {(r.sheet, r.row, r.col): r.end_col for r in got.collect()} == walk(cells, sizes, 50.0)


def test_overflow_queries_judge_all_cells(spark):
    f = Fixtures(spark, SF)
    want = {(r.sheet, r.row, r.col) for r in Q._written(f).collect()}
    assert {(r.sheet, r.row, r.col) for r in Q._overflow(f).collect()} == want


def test_as_of_search_against_a_scan_of_all_steps(spark):
    rng = random.Random(5)
    steps = [(k, float(rng.randrange(60)), f"{k}-{i}") for k in range(3) for i in range(25)]
    steps = list({(k, at): (k, at, v) for k, at, v in steps}.values()) + [(9, 2.0, "one")]
    points = [(rng.randrange(4), rng.choice([float(rng.randrange(-5, 70)), None, 7.5])) for _ in range(300)] + [(9, 1e9), (9, 2.0)]
    left = spark.createDataFrame(points, "k long, x double")
    right = spark.createDataFrame(steps, "k long, at double, v string")
    for strict in (False, True):
        for band in (4.0, 1e6):
            got = sorted((r.k, str(r.x), str(r.v)) for r in last_before(left, right, ["k"], "x", "at", "v", strict=strict, band=band).collect())
            want = []
            for k, x in points:
                below = [(at, v) for j, at, v in steps if j == k and x is not None and (at < x or at == x and not strict)]
                want.append((k, str(x), str(max(below)[1] if below else None)))
            assert got == sorted(want)


def sheet_offsets(spark, sizes):
    rows = [(1, dim, i + 1, float(s), s == 0) for dim, some in sizes.items() for i, s in enumerate(some)]
    return G.axis_offsets(spark.createDataFrame(rows, "sheet long, dim string, idx long, size double, hidden boolean"))


def test_drawings_reach_segments_and_cells(spark):
    """Boxes on edges, over hidden rows, past the axis, and one over everything."""
    sizes = {"row": [10, 0, 10, 10, 0, 20, 10], "col": [30, 30, 0, 30]}
    offsets = sheet_offsets(spark, sizes)
    segments = [(1, "row", 1, 1, 3), (1, "row", 2, 4, 5), (1, "row", 3, 6, 7), (1, "col", 1, 1, 1), (1, "col", 2, 2, 4)]
    edges = {("row", 1): (0, 20), ("row", 2): (20, 30), ("row", 3): (30, 60), ("col", 1): (0, 30), ("col", 2): (30, 90)}
    rng = random.Random(2)
    boxes = [(1, k, float(rng.randrange(0, 100)), float(rng.randrange(0, 70)), float(rng.choice([1, 10, 30, 200])), float(rng.choice([1, 10, 25, 200]))) for k in range(120)]
    df = spark.createDataFrame(boxes, "sheet long, anchor_id long, x double, y double, width double, height double")
    for _, k, x, y, w, h in boxes[:6]:
        one = df.filter(f"anchor_id = {k}")
        want = {(r, c) for (d, r), (y1, y2) in edges.items() if d == "row" for (e, c), (x1, x2) in edges.items() if e == "col" and x < x2 and x + w > x1 and y < y2 and y + h > y1}
        got = G.drawn_regions(one, spark.createDataFrame(segments, "sheet long, dim string, seg_no long, first_idx long, last_idx long"), offsets)
        assert {(r.row_seg, r.col_seg) for r in got.collect()} == want
    ends = {d: [sum(s[:i]) for i in range(len(s) + 1)] for d, s in sizes.items()}

    def at(dim, pos):
        i = 1
        while i <= len(sizes[dim]) and ends[dim][i] <= max(0, pos):
            i += 1
        return i

    got = {r.anchor_id: (r.r1, r.c1, r.r2, r.c2) for r in G.box_cells(df, offsets).collect()}
    assert got == {k: (at("row", y), at("col", x), at("row", y + h - 1), at("col", x + w - 1)) for _, k, x, y, w, h in boxes}


def test_styles_and_drawings_alone_make_a_range(spark):
    cells = spark.createDataFrame([(1, 4, 2, "", 1), (1, 9, 3, None, 0), (2, 1, 1, "v", 0), (3, 1, 1, "", None), (4, 2, 2, "", 7)], "sheet long, row long, col long, text string, style long")
    styles = spark.createDataFrame([(0, None, None, None, None, None), (1, False, None, True, None, None), (7, True, None, None, None, None)], "style long, fill boolean, b_left boolean, b_right boolean, b_top boolean, b_bottom boolean")
    marked = G.printed_cells(cells, styles)
    assert sorted((r.sheet, r.row, r.col) for r in marked.collect()) == [(1, 4, 2), (2, 1, 1), (4, 2, 2)]
    boxes = spark.createDataFrame([(5, 1, 2, 3, 4, 6)], "sheet long, anchor_id long, r1 long, c1 long, r2 long, c2 long")
    merges = spark.createDataFrame([], "sheet long, r1 long, c1 long, r2 long, c2 long")
    got = G.used_range(cells.filter("text <> ''"), merges, marked=marked, boxes=boxes)
    assert {r.sheet: tuple(r)[1:] for r in got.collect()} == {1: (4, 2, 4, 2), 2: (1, 1, 1, 1), 4: (2, 2, 2, 2), 5: (2, 3, 4, 6)}


def test_sizes_past_the_axis(spark):
    offsets = sheet_offsets(spark, {"row": [10, 0, 10]})
    ranges = spark.createDataFrame([(1, 2, 3), (1, 3, 9), (1, 7, 9), (2, 1, 2)], "sheet long, r1 long, r2 long")
    got = G.span_size(offsets, ranges, "row", "r1", "r2", "height")
    assert sorted((r.sheet, r.r1, r.height) for r in got.collect()) == [(1, 2, 10.0), (1, 3, 10.0), (1, 7, 0.0), (2, 1, 0.0)]


def plan_of(df, mode="extended"):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_references_of_links_are_parsed_once(spark):
    links = spark.createDataFrame([(1, 1, "$E$2:D2", "r"), (1, 2, "S!B3", "r"), (1, 3, "?", "r")], "sheet long, ord long, ref string, rel_id string")
    rels = spark.createDataFrame([(1, "r", "https://a.example", True)], "sheet long, rel_id string, target string, external boolean")
    cells = spark.createDataFrame([(1, 2, 4), (1, 3, 2), (1, 1, 1)], "sheet long, row long, col long")
    got = X.cell_links(cells, links, rels)
    assert sorted((r.row, r.col) for r in got.collect()) == [(2, 4), (3, 2)]
    assert plan_of(got).split("Optimized Logical Plan")[1].split("Physical Plan")[0].count("^.*!") == 1


def test_column_spans_are_settled_before_columns_are_listed(spark):
    rng = random.Random(3)
    spans = [(s, k, a, a + rng.choice([0, 1, 5, 300, 9_000]), f"w{k}") for s in (1, 2) for k in range(12) for a in [rng.choice([1, 2, 255, 256, 257, 600, 16_380, 17_000])]]
    got = G.expand_col_spans(spark.createDataFrame(spans, "sheet long, ord long, min long, max long, name string"))
    want = {}
    for s, _, lo, hi, name in sorted(spans, key=lambda x: x[1]):
        want.update({(s, i): name for i in range(lo, min(hi, lo + G.COL_SPAN_LIMIT, 16_384) + 1)})
    assert {(r.sheet, r.idx): r.name for r in got.collect()} == want
    assert "Aggregate [sheet#" in plan_of(got) and not re.search(r"Aggregate \[sheet#\d+L?, idx#", plan_of(got))


def test_running_widths_are_made_once_per_column(spark):
    cells = [(s, r, c, "x" * (s * r * c % 90), (r + c) % 3 > 0) for s in (1, 2) for r in range(1, 9) for c in (1, 2, 9, 250, 257, 300) if (r * c) % 4]
    sizes = {(1, c): float(c % 7 * 20) for c in (*range(1, 12), *range(251, 262))}
    got = G.overflow_extent(
        spark.createDataFrame(cells, "sheet long, row long, col long, text string, spills boolean"),
        spark.createDataFrame([(*k, v) for k, v in sizes.items()], "sheet long, col long, size double"), 10.0, 50.0,
    )
    assert "explode" not in plan_of(got)
    assert {(r.sheet, r.row, r.col): r.end_col for r in got.collect()} == walk(cells, sizes, 50.0)


def test_styles_go_to_the_cells(spark):
    """Five styles of all cells would be five tasks."""
    cells = spark.range(50).selectExpr("id AS sheet", "1L AS row", "1L AS col", "'' AS text", "id % 5 AS style")
    looks = spark.createDataFrame([(1, True, None, None, None, None)], "style long, fill boolean, b_left boolean, b_right boolean, b_top boolean, b_bottom boolean")
    printed = G.printed_cells(cells, looks)
    assert "hashpartitioning(style" not in plan_of(printed)
    assert printed.count() == 10


def test_segments_and_offsets_are_never_broadcast(spark):
    """A few bytes on disk that stand for a row per row of a sheet."""
    segments = stage(spark.createDataFrame([(1, "row", 1, 1, 90_000), (1, "row", 2, 90_001, 90_400), (1, "col", 1, 1, 3)], "sheet long, dim string, seg_no long, first_idx long, last_idx long"))
    offsets = stage(spark.range(1, 90_401).selectExpr("1L AS sheet", "'row' AS dim", "id AS idx", "1D AS size", "CAST(id - 1 AS DOUBLE) AS offset"))
    cells = stage(spark.range(1, 90_401, 30_000).selectExpr("id % 1 + 1 AS sheet", "id AS row", "id % 1 + 2 AS col", "'x' AS text"))
    touched = G.touched_regions(cells, segments)
    assert "Broadcast" not in plan_of(touched).split("Physical Plan")[1]
    assert sorted(tuple(r) for r in touched.collect()) == [(1, 1, 1), (1, 2, 1)]
    anchors = Q._drawings(Fixtures(spark, SF))
    met = [s for s in plan_of(G.anchor_boxes(anchors, offsets)).split("Physical Plan")[1].splitlines() if "Broadcast" in s]
    assert not any("idx" in s for s in met)


def test_locate_is_one_search(spark):
    rng = random.Random(5)
    axis = [(s, d, i, float(rng.choice([5, 20, 900_000])), rng.random() < 0.3 or s == 3) for s in (1, 2, 3) for d in ("row", "col") for i in range(1, 30)]
    points = [(s, d, p) for s in (1, 2, 3, 4) for d in ("row", "col") for p in [None, -3.0, 0.0, 1e9, *[float(rng.randrange(9_000_000)) for _ in range(40)], 5.0, 20.0, 25.0]]

    def brute(s, d, p):
        at, mine = 0.0, [a for a in axis if a[:2] == (s, d)]
        for _, _, i, size, hidden in mine:
            if not hidden and at <= max(0.0, p or 0.0) < at + size:
                return i
            at += 0 if hidden else size
        return mine[-1][2] + 1 if mine else None

    df = spark.createDataFrame(points, "sheet long, dim string, pos double")
    found = G.locate(df, G.axis_offsets(spark.createDataFrame(axis, "sheet long, dim string, idx long, size double, hidden boolean")))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(((*p, brute(*p)) for p in points), key=key)
    # Into the bands and back to the points; the running sums of the axes are not made again for every use.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_repeated_breaks_and_overlapping_titles_on_segments(spark):
    axis = spark.createDataFrame([(1, d, i, 20.0, i == 4) for d in ("row", "col") for i in range(1, 11)], "sheet long, dim string, idx long, size double, hidden boolean")
    scale = spark.createDataFrame([(1, 1.0)], "sheet long, scale double")
    breaks = spark.createDataFrame([(1, "row", 3), (1, "row", 3), (1, "row", 99)], "sheet long, dim string, idx long")
    titles = spark.createDataFrame([(1, 1, 2, None, None)], "sheet long, tr1 long, tr2 long, tc1 long, tc2 long")
    got = G.grid_segments(axis, scale, 100.0, 120.0, breaks, titles)
    # Rows: 120 - 2 x 20 of room, a break behind row 3; columns: 100 of room, column 4 is hidden.
    assert sorted(map(tuple, got.collect())) == [(1, "col", 1, 1, 6), (1, "col", 2, 7, 10), (1, "row", 1, 1, 3), (1, "row", 2, 4, 8), (1, "row", 3, 9, 10)]


def test_styles_of_far_rows_and_columns(spark):
    rng = random.Random(11)
    cells = [(s, r, c, rng.choice([None, None, 3])) for s in (1, 2, 3) for r, c in {(rng.choice([1, 255, 256, 257, 5_000, rng.randrange(1, 9_000)]), rng.choice([1, 256, 511, 16_384, rng.randrange(1, 600)])) for _ in range(150)}]
    rows = {(s, r): rng.randrange(1, 9) for s in (1, 2) for r in (1, 255, 257, 5_000, 8_999)}
    cols = {(s, c): rng.randrange(1, 9) for s in (1, 3) for c in (1, 256, 300, 511, 16_384)}
    listed = [(*k, v) for k, v in rows.items()] + [(1, 1, rows[1, 1]), (2, 256, None)]  # a row listed twice, one without a style
    got = G.resolve_style(
        spark.createDataFrame(cells, "sheet long, row long, col int, style long"), spark.createDataFrame(listed, "sheet long, row long, style long"),
        spark.createDataFrame([(*k, v) for k, v in cols.items()], "sheet long, col int, style long"),
        spark.createDataFrame([(i, i) for i in range(9)], "style long, fmt_id long"), spark.createDataFrame([(3, "custom")], "fmt_id long, code string"),
    ).select("sheet", "row", "col", "style", "format")
    style = lambda s, r, c, own: own or rows.get((s, r)) or cols.get((s, c)) or 0
    want = [(s, r, c, v := style(s, r, c, own), "custom" if v == 3 else G.BUILTIN_FORMATS[v]) for s, r, c, own in cells]
    assert sorted(map(tuple, got.collect())) == sorted(want)
