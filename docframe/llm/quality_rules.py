"""Quality rules with risk-controlled cutoffs.

Method: every document gets metrics that grow with badness, each put in one of ``BINS`` bins. Labelled documents
are split by a hash of their id. The fitting half orders documents: a score adds up, per metric, the log odds of
low against good quality in the document's bin. The held-out half sets one cutoff of that score per stratum:
cutoffs are tried from the worst score downwards, and rejecting from a cutoff on is allowed while the exact
binomial tail ``P(Bin(n, risk) <= k)``, for k of n good held-out documents rejected, is at most ``delta``
divided by the number of strata. The scan stops at the first failure (fixed-sequence testing), so neither the
cutoffs nor the metrics divide ``risk``. With probability ``1 - delta`` no stratum loses more than ``risk`` of its
good documents to the cutoffs, whatever the fitted order is worth; good documents lost to the fixed rules
come on top and are not part of the guarantee. Scores at or below 0 speak for the document and are never rejected.

Fixed rules come first: fewer than 20 words, or over 30 % of words in repeated 8-word windows, always fail.

Edge cases: null and empty texts have no words and fail; a null stratum is a stratum; labels that are null
or have a null id are not used, and several labels of one id count as good only if all are; strata without enough
held-out labels reject nothing by cutoffs; empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.arrays import SPACE, WORD_BASES, mix, owners, text_slices, windows
from docframe.plans.stage import stage

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
BINS = 64
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_bars")
STEPS, STEPS_PER_UNIT = 256, 16
"""Bins of the score above 0, and how many make up one unit of log odds."""
METRICS = ("symbols", "duplicate lines", "repeats", "capitals", "marks", "bars", "short words", "long words")
_MEMBER = {b: np.isin(np.arange(256), np.frombuffer(b, np.uint8)) for b in (SYMBOLS, bytes(range(65, 91)), b"!", b"|")}


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.sort(keys)
    several = np.unique(order[1:][order[1:] == order[:-1]])
    if len(several) == 0:
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(several, keys), len(several) - 1)
    return several[at] == keys


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text; see ``COUNTS``."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS}
    for _, _, t in text_slices(texts):
        starts, ends, first = t.words()
        word = ~SPACE[t.data]
        rows = {"n_words": np.diff(first), "word_chars": _per_text(word & ((t.data & 0xC0) != 0x80), t.offsets)}
        for name, chars in (("n_symbols", SYMBOLS), ("n_capitals", bytes(range(65, 91))), ("n_marks", b"!"), ("n_bars", b"|")):
            rows[name] = _per_text(_MEMBER[chars][t.data], t.offsets)
        a, b, line_first = t.pieces(t.data != 10)
        seen = np.concatenate(([0], np.cumsum(word, dtype=np.int64)))
        full = seen[b] > seen[a]
        owner = owners(line_first)[full]
        key = mix(t.hashes(a[full], b[full]) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at = np.unique(key, return_index=True)
        rows["n_lines"] = np.bincount(owner, minlength=len(t))
        rows["n_dup_lines"] = rows["n_lines"] - np.bincount(owner[at], minlength=len(t))
        begin, hashed, window_first = windows(t.hashes(starts, ends), first, WINDOW, WORD_BASES[0])
        again = begin[repeated(mix(hashed + owners(window_first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
        step = np.zeros(len(starts) + 1, dtype=np.int64)
        np.add.at(step, again, 1)
        np.add.at(step, again + WINDOW, -1)
        rows["n_repeat_words"] = _per_text(np.cumsum(step)[:-1] > 0, first)
        for c in COUNTS:
            parts[c].append(rows[c])
    return {c: np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64) for c, p in parts.items()}


_COUNTS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


@F.arrow_udf(_COUNTS_TYPE)
def _counts(texts: pa.Array) -> pa.Array:
    found = text_counts(texts)
    return pa.StructArray.from_arrays([pa.array(found[c]) for c in COUNTS], names=list(COUNTS))


def metric_bins() -> dict[str, object]:
    """Column expressions of the metrics' bins, from the counts."""

    def ratio(a, b, scale):
        share = F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
        return F.least(F.lit(BINS - 1), F.floor(share * F.lit(scale) * BINS)).cast("int")

    mean = F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(F.lit(0.0))
    return {
        "symbols": ratio("n_symbols", "word_chars", 2.0),
        "duplicate lines": ratio("n_dup_lines", "n_lines", 1.0),
        "repeats": ratio("n_repeat_words", "n_words", 1.0),
        "capitals": ratio("n_capitals", "word_chars", 1.0),
        "marks": ratio("n_marks", "word_chars", 2.0),
        "bars": ratio("n_bars", "n_words", 1.0),
        "short words": F.least(F.lit(BINS - 1), F.floor(F.lit(2.0 * BINS) / (F.lit(2.0) + mean * 2))).cast("int"),
        "long words": F.least(F.lit(BINS - 1), F.floor(mean * 3)).cast("int"),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k): all terms from the largest on, until they no longer change the sum."""
    if n <= 0 or k >= n:
        return 1.0
    top = min(k, int((n + 1) * p))
    peak = math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1) + top * math.log(p) + (n - top) * math.log1p(-p)
    odds, terms = p / (1 - p), [1.0]
    term, i = 1.0, top
    while i > 0 and term > 1e-20:
        term *= i / ((n - i + 1) * odds)
        i -= 1
        terms.append(term)
    term, i = 1.0, top
    while i < k and term > 1e-20:
        term *= (n - i) * odds / (i + 1)
        i += 1
        terms.append(term)
    return min(1.0, math.exp(peak) * math.fsum(terms))


def safe_cutoff(good: np.ndarray, risk: float, level: float) -> int:
    """Smallest cutoff that fixed-sequence testing allows; ``good[b]`` good documents have score bin b."""
    n, k, cutoff = int(good.sum()), 0, len(good)
    for b in range(len(good) - 1, -1, -1):
        k += int(good[b])
        if k > risk * n or binomial_tail(k, n, risk) > level:
            break
        cutoff = b
    return cutoff


def log_odds(good: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Log odds of low against good quality per (metric, bin), from counts; 0 where either kind is missing."""
    if not good.any() or not low.any():
        return np.zeros(good.shape)
    share = lambda n: (n + 0.5) / (n.sum(axis=1, keepdims=True) + 0.5 * BINS)
    return np.log(share(low)) - np.log(share(good))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    risk: float = 0.04,
    delta: float = 0.05,
    min_words: int = 20,
    max_repeat_pct: int = 30,
) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every document.

    The counts are written once in the shared folder; labelled rows meet them by id and are summed to one
    histogram per stratum and metric before anything is decided.
    """
    counted = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(stratum).cast("string").alias("__s"), _counts(F.coalesce(F.col(text), F.lit(""))).alias("__c"))
    counted = stage(counted.select(doc_id, "__s", "__c.*"), "quality")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    rows = counted.withColumn("base_failed", failed).withColumns({f"__m{i}": metric_bins()[m] for i, m in enumerate(METRICS)})

    judged = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    judged = judged.groupBy(F.col("doc_id").cast("long").alias(doc_id)).agg(F.min("quality").alias("__q"))
    fitting = F.pmod(F.xxhash64(doc_id, F.lit("fit")), F.lit(2)) == 0
    known = stage(rows.filter(~F.col("base_failed")).join(judged, doc_id).select("__s", "__q", fitting.alias("__fit"), *[f"__m{i}" for i in range(len(METRICS))]), "labelled")
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(f"__m{i}").alias("b")) for i in range(len(METRICS))]))
    counts = np.zeros((2, len(METRICS), BINS))
    for r in known.filter("__fit").select((F.col("__q") == 1).cast("int").alias("q"), bins.alias("x")).groupBy("q", "x.m", "x.b").count().collect():
        counts[r["q"], r["m"], r["b"]] = r["count"]
    odds = log_odds(counts[1], counts[0])
    score = F.lit(0.0)
    for i in range(len(METRICS)):
        score = score + F.get(F.array(*[F.lit(float(x)) for x in odds[i]]), F.col(f"__m{i}"))
    # Only scores above 0 can be rejected: bin 0 starts there, and lower ones are bin -1.
    step = F.least(F.lit(STEPS - 1), F.floor(score * STEPS_PER_UNIT)).cast("int")
    score_bin = F.when(score > 0, step).otherwise(F.lit(-1))
    held = known.filter("NOT __fit AND __q = 1").select("__s", score_bin.alias("b")).groupBy("__s", "b").agg(F.count(F.lit(1)).alias("n"))
    level = delta / max(1, counted.select("__s").distinct().count())

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.bincount(pdf["b"] + 1, weights=pdf["n"], minlength=STEPS + 1)
        return pd.DataFrame({"__k": [pdf["__s"].iloc[0]], "__cut": [max(0, safe_cutoff(own, risk, level) - 1)]})

    cutoffs = held.groupBy("__s").applyInPandas(decide, "__k string, __cut int")
    out = rows.withColumn("__b", score_bin).join(cutoffs, F.col("__s").eqNullSafe(F.col("__k")), "left")
    beyond = F.col("__b") >= F.coalesce("__cut", F.lit(STEPS))
    return out.select(doc_id, F.col("__s").alias(stratum), *COUNTS, "base_failed", (~F.col("base_failed") & ~beyond).alias("kept"))
