"""Bounded scans, admission, block packing and numbering against brute force; plan shapes."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docframe.functions.numbering import auto_number, counter_text
from docframe.operators import admission as A
from docframe.operators import outline as O
from docframe.operators import series as S
from docframe.operators.blocks import pack_blocks
from docframe.plans.scan import attach, bucket_of, explode_span, ordered_scan
from docframe.plans.transitions import followed
from docframe.sources import files as FS
from docframe.plans.stage import fresh_path


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_ordered_scan_matches_plain_window_on_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 4), i, rng.randint(0, 9), None if rng.random() < 0.6 else i) for i in range(700)]
    df = spark.createDataFrame(rows, "k long, o long, v long, c long")
    got = ordered_scan(
        df, ["k"], ["o"], bucket_of("o", 16), row_number="rn", running={"run": F.col("v")}, before={"pre": F.col("v")},
        total={"tot": F.col("v")}, carry={"last": F.col("c")}, first={"f": F.col("c")}, lag={"lg": F.col("c")}, lead={"ld": F.col("c")},
    )
    w = Window.partitionBy("k").orderBy("o")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*", F.row_number().over(w).cast("long").alias("rn"), F.sum("v").over(up).alias("run"), (F.sum("v").over(up) - F.col("v")).alias("pre"),
        F.sum("v").over(Window.partitionBy("k")).alias("tot"), F.last("c", True).over(up).alias("last"), F.first("c").over(up).alias("f"),
        F.lag("c").over(w).alias("lg"), F.lead("c").over(w).alias("ld"),
    )
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_attach_and_explode_span(spark):
    df = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(40)], "k long, o long")
    per = spark.createDataFrame([(1, "a")], "k long, name string")
    assert attach(df, per, ["k"], bucket_of("o", 8)).filter("name = 'a'").count() == 40
    assert attach(df, per, ["k"], bucket_of("o", 8), "inner").count() == 40
    spans = spark.createDataFrame([(3, 12), (5, 4)], "a long, b long")
    assert [r.x for r in explode_span(spans, "a", "b", "x", 4).orderBy("x").collect()] == list(range(3, 13))


def brute_greedy(files, caps):
    out, n, used, stopped = {}, 0, 0, False
    for ord_, name, size in files:
        if stopped:
            out[ord_] = "not-considered"
        elif not name.lower().endswith(".pdf"):
            out[ord_] = "wrong-type"
        elif size == 0:
            out[ord_] = "empty-file"
        elif size > caps.file_bytes:
            out[ord_] = "input-too-large"
        elif n >= caps.max_files:
            out[ord_], stopped = "too-many-files", True
        elif used + size > caps.total_bytes:
            out[ord_] = "total-input-too-large"
        else:
            out[ord_], n, used = "accepted", n + 1, used + size
    return out


def test_admit_greedy_matches_sequential_walk(spark):
    rng = random.Random(3)
    caps = A.Caps(max_files=4, total_bytes=60, file_bytes=40)
    rows, want = [], {}
    for b in range(10):
        files = [(i, rng.choice(["a.pdf", "b.PDF", "c.pdf", "d.txt"]), rng.choice([0, 1, 5, 20, 30, 39, 50] if b % 2 else [1, 2])) for i in range(rng.randint(1, 50))]
        rows += [(b, *f) for f in files]
        want.update({(b, o): s for o, s in brute_greedy(files, caps).items()})
    df = spark.createDataFrame(rows, "batch long, ord long, name string, size long")
    got = {(r.batch, r.ord): r.status for r in A.admit_greedy(df, caps, bucket_rows=4).collect()}
    assert got == want and {"too-many-files", "total-input-too-large", "not-considered"} <= set(got.values())


def test_admit_batch_edges(spark):
    caps = A.Caps(max_files=20, total_bytes=100, total_pages=10)
    rows = [("20", i, "a.pdf", 5, 0) for i in range(20)] + [("21", i, "a.pdf", 1, 0) for i in range(21)] + [("1", 0, "a.pdf", 1, 1)]
    rows += [("over", 0, "a.pdf", 100, 1), ("over", 1, "a.pdf", 1, 1), ("mix", 0, "a.pdf", 101, 1), ("mix", 1, "b.txt", 1, 1), ("pages", 0, "a.pdf", 1, 10), ("pages", 1, "a.pdf", 1, 1)]
    got = {r.batch: (r.error, r.at_ord) for r in A.admit_batch(spark.createDataFrame(rows, "batch string, ord long, name string, size long, pages long"), caps).collect()}
    assert got == {
        "20": (None, None), "21": ("too-many-files", None), "1": ("not-enough-files", None),
        "over": ("total-input-too-large", 1), "mix": ("total-input-too-large", 0), "pages": ("too-many-pages", 1),
    }


def brute_blocks(blocks, cap):
    """Lay everything on one page, find the first block past the limit, move the tail, repeat; heights row by row."""
    page, out = 1, []
    current = [dict(ord=o, kind=k, a=1, n=n, h=h, head=hd, rep=0, lines=ln, whole=w, fl=1, ll=ln) for o, k, n, h, hd, ln, w in blocks]
    while current:
        y, moved = 0.0, None
        for i, b in enumerate(current):
            rows = [(None, b["h"])] * b["rep"] + [(u, b["h"] * (b["lines"] - (b["fl"] - 1 if u == b["a"] else 0)) / b["lines"]) for u in range(b["a"], b["n"] + 1)]
            if sum(r[1] for r in rows) <= 0 or y + sum(r[1] for r in rows) <= cap + 0.5:
                y += sum(r[1] for r in rows)
                continue
            kept, tail, first = None, None, i == 0
            if b["kind"] in ("para", "heading"):
                fits = int((cap + 0.5 - y) // b["h"])
                if fits >= (1 if first else 2):
                    kept, tail = dict(b, n=b["a"] + fits - 1), dict(b, a=b["a"] + fits)
            elif b["kind"] == "table":
                held = b["head"] if (b["a"], b["fl"]) == (1, 1) else b["rep"]
                top, k = y, 0
                while top + rows[k][1] <= cap + 0.5:
                    top, k = top + rows[k][1], k + 1
                unit = rows[k][0]
                if unit is not None and not b["whole"] and b["lines"] > 1 and k >= held and top <= cap - 12:
                    line = start = b["fl"] if unit == b["a"] else 1
                    while top + b["h"] / b["lines"] * (line - start + 1) <= cap + 0.5:
                        line += 1
                    if line > start:
                        kept, tail = dict(b, n=unit, ll=line - 1), dict(b, a=unit, fl=line, rep=b["head"])
                if kept is None:
                    if k <= held:
                        k = max(held + 1, 1) if first else 0
                    if 0 < k < len(rows):
                        last = b["a"] + k - 1 - b["rep"]
                        kept, tail = dict(b, n=last), dict(b, a=last + 1, fl=1, rep=b["head"])
            if kept is not None:
                moved = current[:i] + [kept], [tail] + current[i + 1:]
            elif first:
                moved = current[:1], current[1:]
            else:
                j = i
                while j > 0 and current[j - 1]["kind"] == "heading" and j - 1 > 0:
                    j -= 1
                moved = current[:j], current[j:]
            break
        done, current = moved if moved else (current, [])
        out += [(b["ord"], page, b["a"], b["n"], b["rep"], b["fl"], b["ll"]) for b in done]
        page += 1
    return out


BLOCKS = "doc_id long, section int, ord long, kind string, units long, unit_height double, header_rows long, row_lines long, cant_split boolean"


def random_blocks(rng, n):
    for o in range(n):
        kind = rng.choice(["para", "para", "heading", "heading", "table", "table", "other"])
        lines = rng.choice([1, 1, 2, 3, 5]) if kind == "table" else 1
        units = rng.choice([1, 1, 2]) if kind == "heading" else rng.randint(0 if kind == "other" else 1, 9)
        yield (o, kind, units, 10.0 * lines if rng.random() < 0.8 else 6.0 * lines, rng.randint(0, 2) if kind == "table" else 0, lines, rng.random() < 0.3)


@pytest.mark.parametrize("bucket", [1, 4, 16_384])
def test_pack_blocks_matches_page_by_page_walk(spark, bucket):
    rng = random.Random(11 + bucket)
    rows, want = [], []
    for doc in range(60):
        blocks = list(random_blocks(rng, rng.randint(1, 60)))
        if doc % 10 == 0:
            blocks = [(o, "heading" if 5 < o < 25 else k, *rest) for o, k, *rest in blocks]
        rows += [(doc, 0, *b) for b in blocks]
        want += [(doc, 0, *r) for r in brute_blocks(blocks, 55.0)]
    df = spark.createDataFrame(rows, BLOCKS)
    assert sorted(map(tuple, pack_blocks(df, 55.0, bucket_blocks=bucket).collect())) == sorted(want)


def test_block_tables_compose_to_the_walk():
    """Every bucket's table, entered with any fill, gives the pages and the fill of the walk."""
    from docframe.operators import blocks as B

    rng, limit = random.Random(3), 55_500_000
    for _ in range(60):
        some = [(o, k, u, round(h * 10**6), hd, ln, w) for o, k, u, h, hd, ln, w in random_blocks(rng, rng.randint(1, 12))]
        table = B.transitions(some, limit)
        assert len(table["fills"]) <= 400
        for fill in [-1, 0, limit, *[rng.randrange(0, 56) * 10**6 for _ in range(20)], *[f for f in table["fills"] if f >= 0]]:
            page, pages = B.lay_page(some, limit, (0, 1, 1, 0), fill), 0 if fill >= 0 else 1
            while page.following is not None and page.following[0] < len(some):
                page, pages = B.lay_page(some, limit, page.following), pages + 1
            assert followed(table, fill, limit) == (pages, -1 if page.following is not None else page.fill)


def test_pack_blocks_one_section_of_many_buckets(spark):
    """A single section of 30,000 blocks: no task sees more than a bucket of them."""
    n = 30_000
    df = spark.range(n).selectExpr(
        "1L AS doc_id", "0 AS section", "id AS ord", "IF(id % 7 = 0, 'heading', 'para') AS kind", "1 + id % 3 AS units", "10D AS unit_height", "0L AS header_rows"
    )
    got = pack_blocks(df, 300.0, bucket_blocks=500).orderBy("ord", "first_unit").collect()
    want = brute_pages([("heading" if o % 7 == 0 else "para", 1 + o % 3) for o in range(n)], 30)
    assert [(r.ord, r.page_no, r.first_unit, r.last_unit) for r in got] == want


def brute_pages(blocks, lines):
    """Blocks of lines of height one: a plain walk with one page in memory."""
    out, page, used, held, queue = [], 1, 0, [], [(o, k, 1, n) for o, (k, n) in enumerate(blocks)][::-1]
    while queue:
        o, k, a, n = queue.pop()
        if used + n - a + 1 <= lines:
            if k == "heading" and used and a == 1:
                held.append((o, k, a, n))
            else:
                held = []
            out.append((o, page, a, n))
            used += n - a + 1
            continue
        fits = lines - used
        if fits >= (2 if used else 1):
            out.append((o, page, a, a + fits - 1))
            queue.append((o, k, a + fits, n))
        else:
            queue.append((o, k, a, n))
            queue += held[::-1]
            out = out[: len(out) - len(held)]
        page, used, held = page + 1, 0, []
    return out


def test_counters(spark):
    rows = [(3999, "romanUcPeriod"), (4000, "romanLcPlain"), (26, "alphaLcParenR"), (27, "alphaUcParenBoth"), (702, "alphaLcPlain"), (703, "alphaLcPlain"), (5, "arabicPeriod")]
    df = spark.createDataFrame(rows, "n long, k string").select(auto_number(F.col("k"), F.col("n")).alias("m"))
    assert [r.m for r in df.collect()] == ["MMMCMXCIX.", "mmmm", "z)", "(AA)", "zz", "aaa", "5."]
    styled = spark.createDataFrame([(3999, "lower-roman"), (4000, "lower-roman"), (0, "upper-alpha"), (7, "decimal-leading-zero"), (1, "none")], "n long, s string")
    assert [r.m for r in styled.select(counter_text(F.col("n"), F.col("s")).alias("m")).collect()] == ["mmmcmxcix", "4000", "0", "07", ""]


def test_outline_rules(spark):
    def run(paras, strict=True):
        rows = [(1, i, lv, k, "arabicPlain", st, tx) for i, (lv, k, st, tx) in enumerate(paras)]
        df = spark.createDataFrame(rows, "doc_id long, ord long, level int, kind string, auto_type string, start_at long, text string")
        return [r.number for r in O.outline_numbers(df, strict=strict).orderBy("ord").collect()]

    auto = lambda lv=0, st=1, tx="x": (lv, "auto", st, tx)
    assert run([auto(), auto(), (0, "char", 1, "x"), auto()]) == [1, 2, None, 1]
    assert run([auto(), auto(1), auto(tx=""), auto(1), auto()]) == [1, 1, None, 1, 2]
    assert run([auto(st=5), auto(st=5)]) == [5, 6]
    assert run([auto(st=0), auto(st=0), auto(st=3), auto(st=0)]) == [0, 0, 3, 4]


def test_nice_scale(spark):
    cases = {(0.0, 0.0): (0, 1, 0.2), (-7.0, 0.0): (-8, 0, 2), (0.0, 0.0003): (0, 0.0003, 0.0001), (0.0, 1e9): (0, 1e9, 2e8), (5.0, 5.0): (0, 5, 1)}
    df = spark.createDataFrame(list(cases), "lo double, hi double")
    for r in df.select("lo", "hi", S.nice_scale("lo", "hi").alias("s")).collect():
        want = cases[(r.lo, r.hi)]
        assert all(abs(a - b) <= 1e-9 * max(1, abs(b)) for a, b in zip((r.s.min, r.s.max, r.s.step), want)), r


def test_shares_sum_to_one(spark):
    pts = spark.createDataFrame([("c", i, v) for i, v in enumerate([3.0, -1.0, None, 5.0, 0.0])] + [("z", 0, 0.0)], "chart string, idx long, value double")
    got = S.shares(pts).collect()
    assert abs(sum(r.share for r in got) - 1) < 1e-12 and {r.chart for r in got} == {"c"} and len(got) == 2


def test_read_delimited(spark, tmp_path):
    cases = {
        "a.csv": "x;1\n\"q;\"\"z\"\"\nk\";2\n".encode(), "b.tsv": "\ufeffx\t1\ny\t2\n".encode(), "c.csv": "café€|1\n".encode("cp1252"),
        "d.csv": b"\xff\xfe" + "u,1\n".encode("utf-16-le"),
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    df = FS.read_delimited_auto(spark, [str(tmp_path / n) for n in cases], columns=["a", "b"])
    assert sorted((r.a, r.b) for r in df.collect()) == sorted([("x", "1"), ('q;"z"\nk', "2"), ("x", "1"), ("y", "2"), ("café€", "1"), ("u", "1")])


def test_no_nested_loops_and_no_global_windows(spark):
    from docframe.plans import all_queries

    registered, _ = all_queries()
    for name in ("compare_docs", "stamp_range", "redact", "expand_merges", "locate", "merge_docs", "job_status", "attach_error", "coverage_join", "outline_numbers"):
        plan = plan_of(registered[name](spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
        assert "windowspecdefinition(ord" not in plan, name
    scan = plan_of(registered["sample_every"](spark, "/root/testdata/sf0.001"))
    assert "l_tax" not in scan and "l_shipdate" not in scan


def test_write_outputs(spark):
    out = fresh_path(spark, "w")
    FS.write_outputs(spark.createDataFrame([("a", 1), ("b", 2)], "output_name string, v int"), out)
    assert sorted(map(tuple, spark.read.parquet(out).select("output_name", "v").collect())) == [("a", 1), ("b", 2)]


def test_admit_greedy_with_falling_sizes(spark):
    """Every file is smaller than all before it, so none can be ruled out early."""
    n = 3_000
    files = [(o, "a.pdf", 10 * n - 7 * o) for o in range(n)]
    caps = A.Caps(max_files=5, total_bytes=45_000)
    df = spark.createDataFrame([("b", *f) for f in files] + [("c", *f) for f in files[::3]], "batch string, ord long, name string, size long")
    got = {(r.batch, r.ord): r.status for r in A.admit_greedy(df, caps, bucket_rows=50).collect()}
    assert got == {(b, o): s for b, some in (("b", files), ("c", files[::3])) for o, s in brute_greedy(some, caps).items()}
