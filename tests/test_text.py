"""Text rules: Unicode, receipts, names, markup, passwords and error codes."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.operators import text as X


def one(spark, value, col, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first().r


def test_normalize_text(spark):
    nfd, nfc = "e\u0301te\u0301", "\u00e9t\u00e9"
    assert one(spark, f"  {nfd}\ufeff\n x  ", X.normalize_text("t")) == f"{nfc} x"
    assert one(spark, "a\u000bb", X.normalize_text("t")) == "a b"


def test_compare_edges(spark):
    schema = "doc_id long, page_no int, text string, width double, height double, pixels array<int>"
    base = [10, 10, 10, 255] * 1000
    a = spark.createDataFrame([(1, 1, "same  text", 100.0, 100.0, base), (1, 2, "x", 100.0, 100.0, base), (1, 3, "s", 100.0, 100.0, base), (1, 4, "gone", 1.0, 1.0, base)], schema)
    two = [99, 10, 10, 255] * 2 + base[8:]
    one_px = [99, 10, 10, 255] + base[4:]
    b = spark.createDataFrame([(1, 1, " same text ", 100.4, 100.0, one_px), (1, 2, "x", 100.0, 100.0, two), (1, 3, "s", 101.0, 100.0, base), (1, 5, "new", 1.0, 1.0, base)], schema)
    got = {r.page_no: (r.kind, r.text_changed, r.visual_pct) for r in X.compare_docs(a, b).collect()}
    assert got == {2: ("changed", False, 0.2), 3: ("changed", False, 100.0), 4: ("removed", True, None), 5: ("added", True, None)}
    assert X.compare_docs(a, a).count() == 0


def test_array_diff(spark):
    df = spark.createDataFrame([([0, 0, 0, 9], [20, 0, 0, 99]), ([0, 0, 0, 9], [21, 0, 0, 9]), ([], [])], "a array<int>, b array<int>")
    assert [r.p for r in df.select(X.array_diff_pct("a", "b").alias("p")).collect()] == [0.0, 100.0, 100.0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("RECEIPT\nBlue Shop\nJan 5, 2024\nSubtotal 9.00\nTotal  €1,234.50\nTax 1.00", ("Blue Shop", "Jan 5, 2024", "€1,234.50")),
        ("Shop\n12/31/24\nSubtotal: 7.10", ("Shop", "12/31/24", "7.10")),
        ("123\n2024-1-2 x\npaid 3.00 of 4.00", ("2024-1-2 x", "2024-1-2", "4.00")),
        ("", ("", "", "")),
        ("invoice\n\ntotal none", ("total none", "", "")),
    ],
)
def test_receipts(spark, text, want):
    r = one(spark, text, X.extract_receipt("t"))
    assert (r.merchant, r.date, r.total) == want
    assert r.merchant_conf == ("candidate" if want[0] else "review")


def test_suggest_name(spark):
    rows = [
        (1, "Scan 1\nA: b/c*? Café..", "in.PDF"), (2, "", "x y.tiff"), (3, "\n..\n", "...png"), (4, "ab\n" + "z" * 91 + "\nok line", "n"), (5, "Pagefile notes", "q.a.b"),
    ]
    got = {r.i: r.suggested for r in X.suggest_name(spark.createDataFrame(rows, "i int, text string, file_name string"), number="i").collect()}
    assert got[1] == "A b c Cafe.PDF"
    assert got[2] == "x y.tiff" and got[3] == "scan-3.png"
    assert got[4] == "ok line" and got[5] == "Pagefile notes.b"


def test_sanitize_html(spark):
    html = '<!-- c --><P style="color:red" onclick=x>a<br/>b</P><table><td>c &amp; d</td></table><a HREF=\'javascript:x\'>e</a><a href="HTTPS://x/y">f</a><span style="background:url(x)">g</span><script>if (1<2) "</p>"</script>h'
    assert one(spark, html, X.sanitize_html("t")) == '<p style="color:red">a<br>b</p>c &amp; d<a>e</a><a href="HTTPS://x/y">f</a><span>g</span>h'
    assert one(spark, "<script>a<b</script>", X.sanitize_html("t", drop_script=False)) == "a&lt;b"


def test_passwords(spark):
    lens = [0, 7, 8, 128, 129]
    df = spark.createDataFrame([(n, "secret", "p" * n) for n in lens], "n int, text string, pw string")
    locked = X.lock_column(df, "text", F.col("pw"), F.col("pw"))
    assert {r.n: r.error for r in locked.collect()} == {0: "password-required", 7: "password-too-short", 8: None, 128: None, 129: "password-too-long"}
    back = X.unlock_column(locked.filter("error IS NULL"), "locked", F.col("pw"))
    assert {r.text for r in back.collect()} == {"secret"}
    wrong = X.unlock_column(locked.filter("error IS NULL"), "locked", F.lit("other pass"))
    assert {(r.text, r.error) for r in wrong.collect()} == {(None, "wrong-password")}


def test_redact_leaves_nothing_under_a_box(spark):
    pages = spark.createDataFrame([(1, 1, "alpha beta gamma\n\n  delta"), (2, 1, "free text")], "doc_id long, page_no int, text string")
    boxes = spark.createDataFrame([(1, 1, 0.9, 0.3, 0.4, -1.0), (1, 1, 0.0, 0.9, 0.003, 1.0), (1, 1, 0.0, 0.7, 0.2, 1.0)], "doc_id long, page_no int, x1 double, y1 double, x2 double, y2 double")
    got = {r.doc_id: (r.text, r.n_masked) for r in X.redact(pages, boxes).collect()}
    assert got == {1: ("alpha ████ █████\n\n█████", 3), 2: ("free text", 0)}


def test_redact_equals_a_plain_walk(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(X, "LINES_AT_ONCE", 3)
    for _ in range(200):
        lines = ["".join(rng.choice("ab\u00e9 \u00a0\t") for _ in range(rng.randrange(14))) for _ in range(rng.randrange(1, 9))]
        boxes = [(*sorted(rng.choices([0, 0.25, 0.5, rng.random(), 1], k=2)), *sorted(rng.choices([0, 0.25, 0.5, rng.random(), 1], k=2))) for _ in range(rng.randrange(1, 6))]
        boxes = [b for b in boxes if b[1] - b[0] >= 0.004 and b[3] - b[2] >= 0.004] or [(0.0, 0.1, 0.0, 0.1)]
        n, width, want, total = len(lines), max(1, *map(len, lines)), [], 0
        for i, s in enumerate(lines, 1):
            words = []
            for m in re.finditer(r"[^ \t\u00a0]+", s):
                hit = any(le * width < m.end() and r * width > m.start() and t < i / n and b > (i - 1) / n for le, r, t, b in boxes)
                total += hit
                words.append("#" * len(m.group()) if hit else m.group())
            want.append(" ".join(words))
        left, right, top, bottom = (np.array(x, float) for x in zip(*boxes))
        assert X._masked("\n".join(lines), left, top, right, bottom, "#") == ("\n".join(want), total)


def test_many_boxes_on_one_page(spark):
    """10,000 boxes over 3,000 lines of one page, and a page without boxes, without text and of an unknown document."""
    pages = spark.createDataFrame([(1, 1, "\n".join(["some words of a line"] * 3_000)), (2, 1, "a  b\n c"), (3, 1, None), (4, 1, "")], "doc_id long, page_no int, text string")
    boxes = spark.range(10_000).selectExpr("1L AS doc_id", "1 AS page_no", "0.0D AS x1", "id / 10000 * 0.99 AS y1", "0.2D AS x2", "id / 10000 * 0.99 + 0.005 AS y2")
    other = spark.sql("SELECT 9L AS doc_id, 1 AS page_no, 0D AS x1, 0D AS y1, 1D AS x2, 1D AS y2")
    got = {r.doc_id: (r.text, r.n_masked) for r in X.redact(pages, boxes.unionByName(other)).collect()}
    assert got[2] == ("a b\nc", 0) and got[4] == ("", 0) and set(got) == {1, 2, 4}
    text, n = got[1]
    assert text.split("\n")[0] == "████ words of a line" and n == sum(s.startswith("█") for s in text.split("\n")) > 2_900


def test_classify_error_order(spark):
    assert one(spark, "total-input-too-large", X.classify_error("t", "pages")) == "total-input-too-large"
    assert one(spark, "total-input-too-large", X.classify_error("t", "pages", strict=True)) == "input-too-large"
    assert one(spark, "Heap out of MEMORY", X.classify_error("t", "render")) == "memory"
    assert one(spark, "odd", X.classify_error("t", "render")) == "odd"
    assert one(spark, "image-too-large", X.classify_error("t", "image")) == "image-too-large"


def test_script_profile_and_ranges(spark):
    assert tuple(one(spark, "abc ا", X.script_profile("t", [(32, 126)]))) == (True, False)
    assert tuple(one(spark, "a\u200db", X.script_profile("t", [(0, 0x10FFFF)]))) == (True, True)
    faces = spark.createDataFrame([("a", "U+41-43, u+1F600"), ("b", None)], "face string, spec string")
    assert sorted(map(tuple, X.parse_unicode_ranges(faces).collect())) == [("a", 65, 67), ("a", 0x1F600, 0x1F600), ("b", 0, 0x10FFFF)]
    docs = spark.createDataFrame([(1, "xyz"), (2, "\U0001f600")], "doc_id long, text string")
    hit = X.coverage_join(X.code_points(docs), X.parse_unicode_ranges(faces))
    assert sorted(map(tuple, hit.collect())) == [(1, "b"), (2, "a"), (2, "b")]


def test_links_of_cells(spark):
    cells = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 1), (2, 1, 1)], "sheet int, row long, col long")
    links = spark.createDataFrame(
        [(1, 1, "A1", "a"), (1, 2, "$B$2:C9", "b"), (1, 3, "A1", "c"), (1, 4, "A1", "d"), (1, 5, "Q9", "a"), (1, 6, "A3", "e"), (1, 7, "?", "a"),
         (2, 1, "A1", "a"), (2, 2, None, "a")],
        "sheet int, ord int, ref string, rel_id string",
    )
    rels = spark.createDataFrame(
        [(1, "a", "https://one", True), (1, "b", "MailTo:x@y", True), (1, "c", "http://two", True), (1, "d", "javascript:1", True), (1, "e", "https://in", False)],
        "sheet int, rel_id string, target string, external boolean",
    )
    got = sorted(tuple(r) for r in X.cell_links(cells, links, rels).collect())
    assert got == [(1, 1, 1, "http://two"), (1, 2, 2, "MailTo:x@y")]


def test_tokens_of_many_pages_at_once(spark, monkeypatch):
    rng = random.Random(3)
    alphabet = ["a", "bc", "é", "😀", " ", "\t", " ", "﻿", " ", "\n", "\r", "\x1c", "\u0085"]
    texts = ["", "\n", "\n\n x", "a\n", None, *["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(200)]]
    want = [
        (d, d % 3, n, len(t.split("\n")), max(1, *map(len, t.split("\n"))), k, m.start(), m[0])
        for d, t in enumerate(texts) if t is not None
        for n, line in enumerate(t.split("\n"), 1) for k, m in enumerate(X._WORD.finditer(line), 1)
    ]
    for at_once in (1, 500, 1 << 20):
        monkeypatch.setattr(X, "TEXT_AT_ONCE", at_once)
        pages = spark.createDataFrame([(d, d % 3, t) for d, t in enumerate(texts)], "doc_id long, page_no int, text string")
        got = X.tokens(pages).select("doc_id", "page_no", "line_no", "n_lines", "n_cols", "tok_no", "x", "token")
        assert sorted(map(tuple, got.collect())) == sorted(want)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Exchange" not in plan and "lambdafunction" not in plan  # no interpreted step per word
