"""Cutoffs of the quality rules: exact tails, the guarantee on simulated strata, and the verdict on planted documents."""

import math
import random

import numpy as np
import pytest

from docframe.llm import pii, quality_rules
from docframe.llm.queries import QUERIES
from docframe.plans.ship import ship

SF = "/root/testdata/sf0.001"


def test_binomial_tail_is_exact():
    for n, p in ((10, 0.3), (400, 0.04), (3000, 0.5), (50, 0.999)):
        for k in {0, 1, n // 3, int(n * p), n - 1}:
            plain = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
            assert quality_rules.binomial_tail(k, n, p) == pytest.approx(plain, rel=1e-9)
    # Far more terms than a short sum would hold: a normal law by then, with continuity correction.
    n, p, k = 10**9, 0.04, 10**9 // 25 - 20_000
    z = (k + 0.5 - n * p) / math.sqrt(n * p * (1 - p))
    assert quality_rules.binomial_tail(k, n, p) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=1e-3)


def test_cutoffs_keep_their_promise():
    """The true share of rejected good documents is above the risk in no more than ``level`` of all draws."""
    rng = np.random.default_rng(6)
    for shape in (rng.dirichlet(np.ones(40)), np.array([0.95] + [0.05 / 39] * 39), np.array([0.5] + [0.0] * 38 + [0.5])):
        tail = np.cumsum(shape[::-1])[::-1]
        wrong = 0
        for _ in range(400):
            cutoff = quality_rules.safe_cutoff(rng.multinomial(300, shape), 0.04, 0.05)
            wrong += cutoff < 40 and tail[cutoff] > 0.04
        assert wrong <= 400 * 0.05 + 3 * math.sqrt(400 * 0.05 * 0.95)
    assert quality_rules.safe_cutoff(np.array([200.0, 0, 0]), 0.04, 0.01) == 1
    assert quality_rules.safe_cutoff(np.array([100.0, 0, 0]), 0.04, 0.01) == 3


def test_verdict_rejects_planted_documents_and_spares_good_ones(spark):
    ship(spark)
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(3_000):
        low, lang = rng.random() < 0.2, rng.choice(["en", "de", None])
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(40)]
        if low:
            words = [w.upper() + rng.choice(["#", "!!", "|", ""]) for w in words]
        rows.append((i, " ".join(words), lang, low))
        if i % 2:
            labels.append((i, 0 if low else 1, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, low boolean")
    got = {r.doc_id: r for r in quality_rules.judge(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert sum(got[i].kept for i, _, _, low in rows if low) == 0 and not any(r.base_failed for r in got.values())
    for lang in ("en", "de", None):
        good = [got[i].kept for i, _, of, low in rows if not low and of == lang]
        assert sum(good) >= 0.96 * len(good)
    none = quality_rules.judge(df, spark.createDataFrame(labels[:40], "doc_id long, quality int, toxic int")).collect()
    assert all(r.kept for r in none)  # too few held-out labels for any rejection


def test_query_counts_of_personal_data_by_kind(spark):
    """The query's four counts are those of its own base spans, kind by kind, and of a plain walk."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total = [0, 0, 0, 0]
    for r in QUERIES["op2_personal_data"](spark, SF).collect():
        base = [m[0] for m in pii.matches(docs[r.doc_id] or "") if m[3] == 1]
        counts = [base.count(k) for k in range(4)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        total = [a + b for a, b in zip(total, counts)]
    assert len(set(total)) > 1 and min(total) > 0
