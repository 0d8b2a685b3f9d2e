"""Selections, packing and page algebra on small fixtures and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from docframe.operators import pages as P
from docframe.plans.packing import pack_pages, page_segments


def parse(spark, sel, count, limit=20):
    s = spark.createDataFrame([(1, sel)], "doc_id long, sel string")
    c = spark.createDataFrame([(1, count)], "doc_id long, page_count long")
    r = P.parse_ranges(s, c, limit).first()
    return r.error if r.error else [(x["first"], x["last"]) for x in r.ranges]


@pytest.mark.parametrize(
    "sel, count, want",
    [
        ("1", 5, [(1, 1)]),
        (" 2 - 4 , 1", 5, [(2, 4), (1, 1)]),
        ("", 5, "invalid-selection"),
        ("  ", 5, "invalid-selection"),
        ("1,,2", 5, "invalid-selection"),
        ("0", 5, "invalid-selection"),
        ("3-1", 5, "invalid-selection"),
        ("a", 5, "invalid-selection"),
        ("99999999999999999999", 5, "invalid-selection"),
        ("9,x", 5, "page-out-of-range"),
        ("x,9", 5, "invalid-selection"),
        ("1-3,3", 5, "overlapping-ranges"),
        ("3,1-3", 5, "overlapping-ranges"),
        (",".join(str(i) for i in range(1, 21)), 30, [(i, i) for i in range(1, 21)]),
        (",".join(str(i) for i in range(1, 22)), 30, "too-many-ranges"),
        (",".join(["x"] * 21), 30, "too-many-ranges"),
    ],
)
def test_parse_ranges(spark, sel, count, want):
    assert parse(spark, sel, count) == want


def brute_pack(sizes, cap, breaks):
    pages, page, used, start = [], 1, 0.0, True
    for i, s in enumerate(sizes):
        if not start and used + s > cap + 0.5:
            page, used, start = page + 1, 0.0, True
        pages.append(page)
        used, start = used + s, False
        if i in breaks:
            page, used, start = page + 1, 0.0, True
    return pages


@pytest.mark.parametrize("bucket_rows", [3, 7, 65_536])
def test_pack_pages_matches_sequential_walk(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    rows, want = [], {}
    for key in range(12):
        n = rng.randint(1, 60)
        sizes = [float(rng.choice([0, 1, 2, 5, 9, 30])) for _ in range(n)]
        breaks = {i for i in range(n) if rng.random() < 0.06}
        rows += [(key, i + 1, s, i in breaks) for i, s in enumerate(sizes)]
        want[key] = brute_pack(sizes, 20, breaks)
    items = spark.createDataFrame(rows, "k long, idx long, size double, brk boolean")
    got = pack_pages(items, ["k"], "idx", "size", 20.0, "brk", bucket_rows).orderBy("k", "idx").collect()
    assert {k: [r.page_seq for r in got if r.k == k] for k in want} == want


def test_packing_tolerance_and_empty_pages(spark):
    def segs(sizes, brk=()):
        items = spark.createDataFrame([(0, i + 1, float(s), i in brk) for i, s in enumerate(sizes)], "k long, idx long, size double, brk boolean")
        out = page_segments(pack_pages(items, ["k"], "idx", "size", 10.0, "brk"), ["k"]).orderBy("page_no").collect()
        return [(r.first_idx, r.last_idx) for r in out]

    assert segs([5, 5]) == [(1, 2)]
    assert segs([5, 5.5]) == [(1, 2)]
    assert segs([5, 5.51]) == [(1, 1), (2, 2)]
    assert segs([30, 1]) == [(1, 1), (2, 2)]
    assert segs([5, 5], brk={1}) == [(1, 2)]
    assert segs([0, 0, 5], brk={1}) == [(3, 3)]
    assert segs([0, 0]) == []


def make_pages(spark, doc, n):
    return spark.createDataFrame([(doc, i, 0, f"t{i}", 100.0, 200.0) for i in range(1, n + 1)], "doc_id long, page_no int, rotation int, text string, width double, height double")


def test_number_pages_bound(spark):
    pages = make_pages(spark, 1, 3)
    ok = P.number_pages(pages, 999_998, "of").orderBy("page_no").collect()
    assert [r.label for r in ok] == ["999998 of 1000000", "999999 of 1000000", "1000000 of 1000000"]
    assert {r.error for r in P.number_pages(pages, 999_999, "page").collect()} == {"invalid-edit"}
    assert {r.error for r in P.number_pages(pages, 0, "page").collect()} == {"invalid-edit"}


def test_split_then_merge_is_identity(spark):
    pages = make_pages(spark, 1, 7)
    parsed = P.parse_ranges(spark.createDataFrame([(1, "1-3,4,5-7")], "doc_id long, sel string"), P.page_counts(pages))
    parts = P.split_pages(pages, parsed)
    as_docs = parts.select(F.col("range_no").cast("long").alias("doc_id"), F.row_number().over(
        __import__("pyspark").sql.Window.partitionBy("range_no").orderBy("page_no")).alias("page_no"), "text")
    order = spark.createDataFrame([("b", 1, 1), ("b", 2, 2), ("b", 3, 3)], "batch string, ord long, doc_id long")
    merged = P.merge_docs(as_docs, order).orderBy("merged_no").collect()
    assert [r.text for r in merged] == [f"t{i}" for i in range(1, 8)]
    assert [r.merged_no for r in merged] == list(range(1, 8))


def test_organize_rejects_bad_orders(spark):
    pages = make_pages(spark, 1, 2).unionByName(make_pages(spark, 2, 2)).unionByName(make_pages(spark, 3, 2)).unionByName(make_pages(spark, 4, 2))
    order = spark.createDataFrame(
        [(1, 1, 2, 90), (1, 2, 1, 270), (2, 1, 1, 0), (2, 2, 1, 0), (3, 1, 3, 0)], "doc_id long, pos long, page_no long, rotation int"
    )
    out = P.organize_pages(pages, order, P.page_counts(pages)).collect()
    assert sorted((r.doc_id, r.out_no, r.page_no, r.rotation) for r in out if r.error is None) == [(1, 1, 2, 90), (1, 2, 1, 270)]
    assert sorted(r.doc_id for r in out if r.error == "invalid-page-order") == [2, 3, 4]


def test_header_footer_codes(spark):
    row = spark.range(1).select(
        P.header_sections(
            F.lit('plain&&more&L&"Arial,Bold"&12left &P&Rright &N &KFF00FFred &Xend&Q&'), F.lit("3"), F.lit("9"), F.lit("a&Lb.xlsx"), F.lit("S"), F.lit("D"), F.lit("T")
        ).alias("s")
    ).first().s
    assert (row.l, row.c, row.r) == ("left 3", "plain&more", "right 9 red endQ")


@pytest.mark.parametrize("bucket_rows", [3, 64, 65_536])
def test_pack_pages_adds_fractions_exactly(spark, bucket_rows):
    items = spark.range(2000).selectExpr("'k' AS k", "id AS idx", "CASE WHEN id % 7 = 0 THEN 0.05 ELSE 19.9 END AS size")
    got = [r.page_seq for r in pack_pages(items, ["k"], "idx", "size", 596.5, None, bucket_rows).orderBy("idx").collect()]
    want, page, fill = [], 0, None
    for i in range(2000):
        size = 5 if i % 7 == 0 else 1990
        if fill is None or fill + size > 59_700:
            page, fill = page + 1, 0
        fill += size
        want.append(page)
    assert got == want
