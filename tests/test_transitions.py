"""Transition tables: composition against following both, and one key of a thousand buckets against a walk."""

import random

import numpy as np
import pytest

from docframe.plans import packing as P
from docframe.plans import transitions as R
from docframe.plans.stage import stage


def walk(sizes, breaks, cap, fill):
    """Pages started and the fill at the end, item by item; -1: the next item starts a page."""
    pages = 0
    for s, b in zip(sizes, breaks):
        if fill < 0 or fill + s > cap:
            pages, fill = pages + 1, 0
        fill = -1 if b else fill + s
    return pages, -1 if fill > cap else fill


def random_bucket(rng):
    n = rng.randint(1, 12)
    return [rng.choice([0, 0, 1, 2, 3, 8, 25]) for _ in range(n)], [rng.random() < rng.choice([0, 0.1, 0.5]) for _ in range(n)]


def test_tables_follow_and_compose():
    rng, cap = random.Random(7), 20
    for _ in range(400):
        buckets = [random_bucket(rng) for _ in range(rng.randint(1, 6))]
        tables = [P._summarise(np.array(s, dtype=np.int64), np.array(b), cap) for s, b in buckets]
        for (s, b), t in zip(buckets, tables):
            for fill in range(-1, cap + 1):
                assert R.followed(t, fill, cap) == walk(s, b, cap, fill), (s, b, fill)
        whole = tables[0]
        for t in tables[1:]:
            whole = R.composed(whole, t, cap)
        assert len(whole["fills"]) <= cap + 2
        sizes, breaks = [x for s, _ in buckets for x in s], [x for _, b in buckets for x in b]
        for fill in range(-1, cap + 1):
            assert R.followed(whole, fill, cap) == walk(sizes, breaks, cap, fill), (sizes, breaks, fill)


def test_composition_does_not_depend_on_the_order_of_composing():
    rng, cap = random.Random(8), 20
    for _ in range(100):
        a, b, c = (P._summarise(np.array(s, dtype=np.int64), np.array(k), cap) for s, k in (random_bucket(rng) for _ in range(3)))
        left, right = R.composed(R.composed(a, b, cap), c, cap), R.composed(a, R.composed(b, c, cap), cap)
        assert all(R.followed(left, f, cap) == R.followed(right, f, cap) for f in range(-1, cap + 1))


@pytest.mark.parametrize("first", [0, -900])
def test_one_key_of_a_thousand_buckets(spark, first):
    rng = random.Random(9)
    n = 3_000
    sizes, breaks = [float(rng.choice([0, 1, 2, 5, 30])) for _ in range(n)], [rng.random() < 0.01 for _ in range(n)]
    rows = [("a", first + i, s, b) for i, (s, b) in enumerate(zip(sizes, breaks))] + [("b", i, 7.0, False) for i in range(40)] + [("c", 0, 1.0, False)]
    items = spark.createDataFrame(rows, "k string, idx long, size double, brk boolean")
    got = P.pack_pages(items, ["k"], "idx", "size", 20.0, "brk", bucket_rows=3).collect()
    assert len(got) == len(rows)
    want, page, fill = [], 0, -1.0
    for s, b in zip(sizes, breaks):
        if fill < 0 or fill + s > 20.5:
            page, fill = page + 1, 0.0
        want.append(page)
        fill = -1.0 if b else fill + s
    assert [r.page_seq for r in sorted(got, key=lambda r: r.idx) if r.k == "a"] == want
    assert [r.page_seq for r in sorted(got, key=lambda r: r.idx) if r.k == "b"] == [1 + i // 2 for i in range(40)]


def test_states_through_three_levels(spark):
    """500 tables with a fan of 8."""
    cap = 10
    sizes = [random.Random(i).randint(0, 6) for i in range(1_500)]
    rows, state, want = [], -1, {}
    for b in range(500):
        t = P._summarise(np.array(sizes[3 * b : 3 * b + 3], dtype=np.int64), np.zeros(3, dtype=bool), cap)
        rows.append((1, b, t["fills"], t["pages"], t["ends"], t["total"], t["cap"]))
        want[b] = (state, want[b - 1][1] + started if b else 0)
        started, state = walk(sizes[3 * b : 3 * b + 3], [False] * 3, cap, state)
    tables = spark.createDataFrame(rows, "k long, __bucket long, fills array<long>, pages array<long>, ends array<long>, total long, cap long")
    got = {r["__bucket"]: (r.fill, r.done) for r in R.entry_states(tables, ["k"], fan=8).collect()}
    assert got == want
    assert R.entry_states(tables.limit(0), ["k"]) is None


def test_groups_stay_whole_where_adaptive_execution_changes_the_join(spark):
    """Files look too large for a broadcast; their buckets turn out to be few, so the join of a staged table changes once it runs."""
    keys, width = 20, 640
    rows = spark.range(400_000).selectExpr(f"id % {keys} AS k", f"CAST(floor(id / {keys}) AS BIGINT) AS i", "CAST(1 + pmod(hash(id), 50) AS DOUBLE) AS size")
    items = stage(rows.repartition(6), "items")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "250KB")
    try:
        got = {(r.k, r.idx): r.page_seq for r in P.pack_pages(items, ["k"], "i", "size", 200.0, bucket_rows=width).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want, last = {}, {}
    for k, i, s in sorted((r.k, r.i, r["size"]) for r in items.collect()):
        page, fill = last.get(k, (0, 1e9))
        last[k] = (page + 1, s) if fill + s > 200.5 else (page, fill + s)
        want[k, i] = last[k][0]
    assert got == want


def test_states_are_walked_without_a_task_step_per_key(spark):
    rows = [(f"k{k}", i, 7.0) for k in range(300) for i in range(k % 40)]
    items = spark.createDataFrame(rows, "k string, idx long, size double")
    tables = P.pack_pages(items, ["k"], "idx", "size", 20.0, bucket_rows=3)
    got = {(r.k, r.idx): r.page_seq for r in tables.collect()}
    assert got == {(k, i): i // 2 + 1 for k, i, _ in rows}
    plan = tables._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "GroupsInPandas" not in plan
