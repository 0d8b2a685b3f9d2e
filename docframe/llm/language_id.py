"""Language identification by words first, backing off to shorter character n-grams.

Method: a known word adds its log frequency in every language. An unseen word adds the mean log frequency
of its known character 4-grams (with word boundaries); where none is known, of its 3-grams, then 2-grams,
then 1-grams. The language with the highest sum wins, ties by name; the score is its softmax share.

The classifier is fitted on a bounded sample of labelled rows: ``fit_rows`` per language, picked by a hash
of the text. Words rarer than ``MIN_SHARE`` of a language are left to the n-grams, which also bounds the
tables sent to the workers (at most 1 / ``MIN_SHARE`` entries per language and order).

Edge cases: a text that is null or has no letter is ``und`` with score 0, as is everything if nothing was
learned; rows with a null language or text are not learned from; empty tables give empty results; an input
column named ``lang_pred`` or ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.arrays import owners, rolling, signed, windows

ORDERS = (4, 3, 2, 1)
MIN_SHARE = 2e-6
SLICE_CHARS = 250_000
"""Characters computed at a time; bounds a worker's memory, results do not depend on it."""
UNDETERMINED = "und"
_BASE = 0xA24BAED4963EE407
_EDGE = 1
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def word_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, starts and ends of their runs of letters, first run of each text."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in lowered]))).astype(np.int64)
    inside = _letters()[points]
    cut = np.zeros(len(points) + 1, dtype=bool)
    cut[offsets] = True
    before, after = np.zeros(len(points), dtype=bool), np.zeros(len(points), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return points, starts, ends, np.searchsorted(starts, offsets)


def slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > SLICE_CHARS:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


def grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of words with boundary marks, and the word of each."""
    lengths = ends - starts + 2
    first = np.concatenate(([0], np.cumsum(lengths)))
    padded = np.full(first[-1], _EDGE, dtype=np.uint64)
    inner = np.arange(int((lengths - 2).sum())) + np.repeat(2 * np.arange(len(starts)) + 1, lengths - 2)
    source = np.arange(len(inner)) + np.repeat(starts - np.concatenate(([0], np.cumsum(lengths - 2)[:-1])), lengths - 2) if len(starts) else inner
    padded[inner] = points[source].astype(np.uint64) + np.uint64(2)
    _, hashed, per_word = windows(padded, first, order, _BASE)
    return hashed, owners(per_word)


def _table(order: np.ndarray, hashed: np.ndarray, count: np.ndarray):
    keys, at = np.unique(np.stack([order.astype(np.uint64), hashed]), axis=1, return_inverse=True)
    return keys[0].astype(np.int64), keys[1], np.bincount(at.ravel(), weights=count).astype(np.int64)


def learned_counts(train: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, ord, h, n``: counts of words (order 0) and of the n-grams of distinct words, summed per task."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for name in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == name]
                for _, part in slices(own):
                    points, starts, ends, _ = word_runs(part)
                    values = points.astype(np.uint64) + np.uint64(2)
                    hashed, at, n = np.unique(rolling(values, starts, ends, _BASE), return_index=True, return_counts=True)
                    rows = [(0, hashed, n)]
                    for order in ORDERS:
                        rows.append((order, *np.unique(grams(points, starts[at], ends[at], order)[0], return_counts=True)))
                    for order, h, n in rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(h), pa.string()), pa.array(np.full(len(h), order), pa.int32()), pa.array(signed(h)), pa.array(n.astype(np.int64))],
                            names=schema.names,
                        )

    return train.select(text, lang).mapInArrow(count, schema).groupBy("lang", "ord", "h").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies per language of words and n-grams, as sorted arrays."""

    def __init__(self, langs: list[str], rows: pd.DataFrame, totals: dict[tuple[str, int], tuple[int, int]]):
        self.langs, self.tables = langs, {}
        column = {name: i for i, name in enumerate(langs)}
        for order in (0, *ORDERS):
            own = rows[rows["ord"] == order]
            keys, at = np.unique(own["h"].to_numpy(dtype=np.int64).view(np.uint64), return_inverse=True)
            logs = np.zeros((len(keys), len(langs)), dtype=np.float32)
            for i, name in enumerate(langs):
                n, kinds = totals.get((name, order), (0, 0))
                logs[:, i] = np.log(0.5 / (n + 0.5 * kinds + 1))
            n_of = own["lang"].map(lambda x: totals[(x, order)][0]).to_numpy(dtype=float)
            kinds_of = own["lang"].map(lambda x: totals[(x, order)][1]).to_numpy(dtype=float)
            logs[at, own["lang"].map(column).to_numpy(dtype=int)] = np.log((own["n"].to_numpy(dtype=float) + 0.5) / (n_of + 0.5 * kinds_of + 1))
            self.tables[order] = (keys, logs)

    def _find(self, order: int, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, logs = self.tables[order]
        if len(keys) == 0:
            return np.zeros(len(hashed), dtype=bool), np.zeros(len(hashed), dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
        return keys[at] == hashed, at

    def totals(self, texts: list[str]) -> np.ndarray:
        """Summed log frequencies, one row per text and one column per language."""
        points, starts, ends, first = word_runs(texts)
        hashed, sample, at = np.unique(rolling(points.astype(np.uint64) + np.uint64(2), starts, ends, _BASE), return_index=True, return_inverse=True)
        scores = np.zeros((len(hashed), len(self.langs)))
        known, where = self._find(0, hashed)
        scores[known] = self.tables[0][1][where[known]]
        left = np.flatnonzero(~known)
        for order in ORDERS:
            if len(left) == 0:
                break
            h, word = grams(points, starts[sample[left]], ends[sample[left]], order)
            hit, where = self._find(order, h)
            n = np.bincount(word[hit], minlength=len(left))
            logs = self.tables[order][1][where[hit]]
            for i in range(len(self.langs)):
                scores[left, i] += np.bincount(word[hit], weights=logs[:, i], minlength=len(left)) / np.maximum(n, 1)
            left = left[n == 0]
        out = np.zeros((len(texts), len(self.langs)))
        word_scores = scores[at]
        for i in range(len(self.langs)):
            sums = np.concatenate(([0.0], np.cumsum(word_scores[:, i])))
            out[:, i] = sums[first[1:]] - sums[first[:-1]]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for _, part in slices([t or "" for t in texts]):
            totals = self.totals(part) if self.langs else None
            for i, t in enumerate(part):
                if totals is None or not any(map(str.isalpha, t)):
                    out.append((UNDETERMINED, 0.0))
                    continue
                row = np.exp(totals[i] - totals[i].max())
                best = int(np.argmax(row))
                out.append((self.langs[best], float(row[best] / row.sum())))
        return out


def fit(train: DataFrame, text: str = "text", lang: str = "lang", fit_rows: int = 10_000) -> Model:
    """Learn from labelled rows: all, or a hash sample of about ``fit_rows`` of a language that has more."""
    rows = train.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], pd.DataFrame({"lang": [], "ord": [], "h": [], "n": []}), {})
    share = F.create_map(*[F.lit(x) for name, n in sorted(sizes.items()) for x in (name, min(1.0, fit_rows / n))])
    draw = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    from docframe.plans.stage import stage

    counts = stage(learned_counts(rows.filter(draw < share[F.col("lang")]), "text", "lang"), "language")
    totals = {(r["lang"], r["ord"]): (r["n"], r["k"]) for r in counts.groupBy("lang", "ord").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
    least = F.create_map(*[F.lit(x) for (name, order), (n, _) in sorted(totals.items()) for x in (f"{order} {name}", float(max(2, MIN_SHARE * n)) if order == 0 else MIN_SHARE * n)])
    kept = counts.filter(F.col("n") >= least[F.concat_ws(" ", F.col("ord").cast("string"), "lang")])
    return Model(sorted(sizes), kept.toPandas(), totals)


def predict_languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(sent.value.predict(texts.tolist()), columns=["lang_pred", "score"])

    return docs.withColumn("__p", predict(F.col(text))).withColumns({"lang_pred": F.col("__p.lang_pred"), "score": F.col("__p.score")}).drop("__p")
