"""Substring deduplication on windows of a fixed number of words.

Method: every window of ``width`` consecutive words gets a Rabin-Karp hash. Windows are counted in Spark in
two steps. Each window has an *anchor*, the smallest hash of the ``gram``-word runs inside it; equal windows
have equal anchors, and consecutive windows with one anchor form a *run* with one hash over all its words.
First the runs are counted: a run that also occurs in a smaller document is covered whole, and a run whose
anchor occurs with one content only cannot have other repeats. Only where an anchor has several contents are
the single windows of each content's first document hashed and counted. So a passage that half of all
documents share is one row per task before the shuffle, and windows that occur once are never shuffled.
Covered positions merge into maximal intervals. Windows are judged on the input, not on what is left.

Keys are 128 bits (anchor and run, or anchor and window). Lookups are equi-joins with one row per key on
one side, which split where a key is hot.

Edge cases: null and empty texts have no words; documents with fewer than ``width`` words keep all of them;
a null id comes last; of rows with one id none is smaller; rows equal in id and text get the same result;
an empty table gives an empty table; input columns named like output columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.arrays import WORD_BASES, Texts, owners, rolling, signed, text_slices, window_starts
from docframe.llm.keys import KEY, keyed, with_key
from docframe.plans.stage import stage


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    done, m = 1, x
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    rest = width - done
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchored(t: Texts, width: int, gram: int):
    """Word hashes, first word of every text, and of every window: its first word, text and anchor."""
    starts, ends, first = t.words()
    words = t.hashes(starts, ends)
    begin, per_text = window_starts(first, width)
    if len(begin) == 0:
        return words, first, begin, owners(per_text), np.zeros(0, np.uint64)
    at = np.arange(len(words) - gram + 1)
    low = _sliding_min(rolling(words, at, at + gram, WORD_BASES[1]), width - gram + 1)
    return words, first, begin, owners(per_text), low[begin]


def window_runs(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """``__id, __th, anchor, run, pos, n``: runs of windows with one anchor; ``docs`` is keyed."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in (*KEY, "anchor", "run")] + [T.StructField(c, T.IntegerType()) for c in ("pos", "n")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for i, _, t in text_slices(batch.column(2)):
                words, first, begin, owner, anchor = anchored(t, width, gram)
                if len(begin) == 0:
                    continue
                change = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))
                at = np.flatnonzero(change)
                n = np.diff(np.append(at, len(begin)))
                run = rolling(words, begin[at], begin[at] + n + width - 1, WORD_BASES[0])
                who = owner[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i + who]), pa.array(ths[i + who]), pa.array(signed(anchor[at])), pa.array(signed(run)),
                        pa.array((begin[at] - first[who]).astype(np.int32)), pa.array(n.astype(np.int32)),
                    ],
                    names=schema.names,
                )

    return docs.select(*KEY, "__text").mapInArrow(find, schema)


def asked_windows(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """``__id, __th, anchor, window, pos``: the windows of the runs in ``__asks`` (array of pos, n)."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in (*KEY, "anchor", "window")] + [T.StructField("pos", T.IntegerType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            asks = batch.column(3)
            for i, j, t in text_slices(batch.column(2)):
                words, first, begin, owner, anchor = anchored(t, width, gram)
                own = asks.slice(i, j - i)
                flat = own.flatten()
                counts = np.diff(own.offsets.to_numpy(zero_copy_only=False))
                of = np.repeat(np.arange(j - i), counts)
                n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                base = first[of] + flat.field("pos").to_numpy(zero_copy_only=False)
                at = np.repeat(base - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)
                k = np.searchsorted(begin, at)
                hashed = rolling(words, at, at + width, WORD_BASES[0])
                who = owner[k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i + who]), pa.array(ths[i + who]), pa.array(signed(anchor[k])), pa.array(signed(hashed)), pa.array((at - first[who]).astype(np.int32))],
                    names=schema.names,
                )

    return docs.select(*KEY, "__text", "__asks").mapInArrow(find, schema)


_CUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


@F.arrow_udf(_CUT)
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Words, removed words and the kept words of every text; spans are (first, behind the last) words."""
    n_words, n_removed, kept = [], [], []
    for text, own in zip(texts, spans):
        words = (text.as_py() or "").encode().split()
        gone = 0
        if own.is_valid and len(own):
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            flat = own.values
            np.add.at(cover, flat.field("a").to_numpy(zero_copy_only=False), 1)
            np.add.at(cover, flat.field("b").to_numpy(zero_copy_only=False), -1)
            stay = np.cumsum(cover)[:-1] == 0
            gone = len(words) - int(stay.sum())
            kept.append(b" ".join(compress(words, stay.tolist())).decode())
        else:
            kept.append(b" ".join(words).decode())
        n_words.append(len(words))
        n_removed.append(gone)
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=_CUT.names
    )


def removal_spans(rows: DataFrame, width: int = 50, gram: int = 12) -> DataFrame:
    """``__id, __th, __spans``: the word ranges of every document that a smaller one also holds."""
    runs = stage(window_runs(rows, width, gram), "runs")
    contents = runs.groupBy("anchor", "run").agg(F.min("__id").alias("lo"), F.max("__id").alias("hi"))
    contents = stage(contents, "contents")
    several = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("lo").alias("alo"), F.max("hi").alias("ahi"))
    several = several.filter((F.col("c") > 1) & (F.col("alo") < F.col("ahi"))).select("anchor", F.lit(True).alias("several"))
    news = contents.join(several, "anchor", "left").filter((F.col("lo") < F.col("hi")) | F.col("several"))
    hits = runs.join(news.select("anchor", "run", "lo", "several"), ["anchor", "run"])
    whole = F.col("lo") < F.col("__id")
    hits = hits.filter(whole | F.col("several")).withColumn("whole", whole)
    spot = F.struct("pos", "n")
    hits = stage(
        hits.groupBy(*KEY).agg(
            F.collect_list(F.when(F.col("whole"), spot)).alias("wholes"), F.collect_list(F.when(~F.col("whole"), spot)).alias("__asks")
        ),
        "hits",
    )
    asked = rows.join(hits.filter(F.size("__asks") > 0).select(*KEY, "__asks"), KEY)
    asked = stage(asked_windows(asked, width, gram), "windows")
    firsts = asked.groupBy("anchor", "window").agg(F.min("__id").alias("lo"), F.max("__id").alias("hi")).filter("lo < hi")
    late = asked.join(firsts.select("anchor", "window", "lo"), ["anchor", "window"]).filter(F.col("lo") < F.col("__id"))
    span = F.struct(F.col("pos").alias("a"), (F.col("pos") + F.col("n") + (width - 1)).cast("int").alias("b"))
    covered = hits.select(*KEY, F.explode("wholes").alias("x")).select(*KEY, "x.pos", "x.n")
    covered = covered.unionByName(late.select(*KEY, "pos", F.lit(1).alias("n")))
    return covered.groupBy(*KEY).agg(F.collect_list(span).alias("__spans"))


def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 50, gram: int = 12) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``text`` as its kept words joined by single spaces.

    A word goes if a window of ``width`` words over it also starts in a document with a smaller id.
    """
    spans = removal_spans(keyed(docs, doc_id, text), width, gram)
    rows = with_key(docs, doc_id, text).join(spans, KEY, "left")
    rows = rows.withColumn("__c", _cut(F.coalesce(F.col(text), F.lit("")), F.col("__spans")))
    return rows.withColumns({"n_words": F.col("__c.n_words"), "n_removed": F.col("__c.n_removed"), text: F.col("__c.kept")}).drop(*KEY, "__spans", "__c")
