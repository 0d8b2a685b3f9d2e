"""Every training word has its own emissions, and long texts are not cut."""

from pathlib import Path

import numpy as np

from pyspark.sql import functions as F

from docframe.llm import hmm
from docframe.plans.stage import stage


def test_rare_words_keep_their_own_emissions(spark):
    # More words than any fixed number of classes; all end in the same byte and are equally frequent.
    left, right = [[f"{side}{i}x" for i in range(6_000)] for side in "lr"]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.permutation(side)[:3_000]) for side in (left, right) for _ in range(8)]
    held = [" ".join(left[:40]), " ".join(x for pair in zip(left[:20], right[:20]) for x in pair)]
    docs = spark.createDataFrame(list(enumerate(texts + held)), "doc_id long, text string")
    rows = {r.doc_id: r for r in hmm.score_texts(docs, F.col("doc_id") >= len(texts), states=2, rounds=12).collect()}
    one, both = rows[len(texts)], rows[len(texts) + 1]
    # Words of one side follow each other: a text that changes sides at every word is far less likely.
    assert one.score - one.base_score > both.score - both.base_score + 10


def test_spans_hand_their_messages_on(monkeypatch):
    rng = np.random.default_rng(1)
    model = hmm.Model.from_counts(rng.random(3), rng.random((3, 3)), rng.random((5, 3)))
    flat = np.where(np.arange(30) < np.array([30, 17, 1, 8])[:, None], rng.integers(0, 5, (4, 30)), -1)
    want = model.expected(flat)
    monkeypatch.setattr(hmm, "SPAN", 8)
    assert all(np.allclose(a, b) for a, b in zip(model.expected(flat), want))


def test_rounds_store_narrow_rows(spark, monkeypatch):
    # One row per word and round: 8 bytes of hash and 8 numbers of single precision.
    sizes = []

    def staged(df, label="stage", **more):
        out = stage(df, label, **more)
        if label in ("weights", "expected"):
            sizes.append(sum(x.stat().st_size for x in Path(out.staged_at.removeprefix("file:")).glob("*.parquet")))
        return out

    monkeypatch.setattr(hmm, "stage", staged)
    texts = [" ".join(f"w{i * 3_000 + j}" for j in range(6_000)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert hmm.score_texts(docs, F.lit(False), rounds=2).count() == 20
    assert len(sizes) == 2 and max(sizes) < 56 * 63_000


def test_rounds_in_parts_give_the_same_scores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 200) % 5_000) for _ in range(120)] + ["", "new words only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6, "doc_id")

    def scores():
        return {r.doc_id: r.score for r in hmm.score_texts(docs, F.col("doc_id") % 7 == 2, states=4).collect()}

    whole = scores()
    monkeypatch.setattr(hmm, "PART_BLOCKS", 2)
    parts = scores()
    assert len(whole) == len(texts) and max(abs(whole[i] - parts[i]) for i in whole) < 1e-3
