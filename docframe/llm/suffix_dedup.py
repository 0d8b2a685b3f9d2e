"""Removal of repeated byte strings with a sorted table of suffixes that is never gathered in one place.

Method: a string of ``width`` bytes that also starts in a document with a smaller id is removed. Suffixes are
compared by their leading tokens, 64-bit hashes of consecutive pieces, so their order is any fixed one.
A sample of suffixes gives splitters, which range-partition all suffixes by (tokens, id) into buckets of
bounded size; every bucket sorts its suffixes with a multikey quicksort (token by token, going on only inside
groups that are still equal), after which equal strings lie next to each other with the smallest id first. A
group can only cross into other buckets where a splitter has its tokens: of such groups every bucket hands on
the rows that are smallest in it, and these are compared across the boundaries in Spark. A group of any size
is therefore spread over as many buckets as it fills.

Not every suffix is sorted. Each window of ``width`` bytes has an *anchor*, the start of its ``gram`` bytes
with the smallest hash, so equal windows have the same anchor, and consecutive windows with one anchor form a
*run*. First one suffix per run is sorted, with the gram and the whole run as tokens: a run that occurs in a
smaller document is covered, and a run whose gram occurs in one document, or always inside the same run,
repeats nowhere else. Only for the first document of every run whose gram has several runs around it (at
the borders of copied passages) are the single windows sorted, with the two halves as tokens. Nothing is left
out by this: a window that occurs in a smaller document is in one of the two sorts.

Buckets hold about ``bucket_rows`` suffixes until there are ``MOST_BUCKETS`` of them; the driver holds the splitters
and a sample of at most about eight suffixes per bucket, never less than ``SAMPLE``.

Edge cases: null texts are empty; texts shorter than ``width`` keep all bytes; matches end with their document;
a null id comes last; of rows with one id none is smaller; rows equal in id and text get the same result;
an empty table gives an empty table; input columns named like output columns are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.llm.arrays import mix, owners, signed, text_slices
from docframe.llm.keys import id_of
from docframe.plans.stage import release, stage

BUCKET_ROWS = 1 << 17
MOST_BUCKETS = 1 << 18
SAMPLE = 200_000
THIN = 8
"""Of a sampled document every so many suffixes enter the sample."""
_LOW = np.uint64(0xFFFFFFFF)
SLICE_BYTES = 250_000
BLOCK = 150_000
"""Suffixes that a task holds before it deals them out, a row per bucket."""
NAMES = ["t1", "t2", "id", "tag", "at"]
SUFFIXES = ", ".join(f"{x} long" for x in NAMES)
Part = tuple[np.ndarray, ...]
Find = Callable[[Iterator[pa.RecordBatch]], Iterator[Part]]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(t, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, last window, both tokens of the suffix."""
    none = np.zeros(0, np.int64)
    if len(t.data) < width:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    at = np.arange(len(t.data) - gram + 1)
    grams = t.hashes(at, at + gram)
    low = sliding_min((grams & ~_LOW) | at.astype(np.uint64), width - gram + 1)
    own = owners(t.offsets)
    windows = np.flatnonzero(own[: len(low)] == own[width - 1 : width - 1 + len(low)])
    if len(windows) == 0:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    anchor = (low[windows] & _LOW).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]))))
    first, last, anchor = windows[begin], windows[np.append(begin[1:], len(windows)) - 1], anchor[begin]
    return first, last, grams[anchor], mix(t.hashes(first, last + width) + (anchor - first).astype(np.uint64))


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Row order by all tokens: sorted by one token at a time, going on only in groups that are still equal."""
    order = np.argsort(tokens[0], kind="quicksort")
    if len(order) == 0:
        return order
    same = np.concatenate(([False], tokens[0][order][1:] == tokens[0][order][:-1]))
    for token in tokens[1:]:
        open_ = same.copy()
        open_[:-1] |= same[1:]
        places = np.flatnonzero(open_)
        if len(places) == 0:
            break
        group = np.cumsum(~same)[places]
        rows = order[places]
        inner = np.lexsort((token[rows], group))
        order[places] = rows[inner]
        sorted_token = token[order[places]]
        same[places] &= np.concatenate(([False], sorted_token[1:] == sorted_token[:-1]))
    return order


class Splitters:
    """Borders of the buckets: sorted (t1, t2, id); bucket k holds what is not below border k and below the next."""

    def __init__(self, t1: np.ndarray, t2: np.ndarray, ids: np.ndarray):
        self.t1, self.t2, self.ids = t1, t2, ids

    def bucket(self, t1: np.ndarray, t2: np.ndarray, ids: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.t1, t1, "left"), np.searchsorted(self.t1, t1, "right")
        tied = np.flatnonzero(low < high)
        if len(tied):
            # Borders and rows with one first token in one order, borders first among equals.
            some = np.unique(np.concatenate([np.arange(a, b) for a, b in {(int(low[i]), int(high[i])) for i in tied}]))
            kind = np.concatenate((np.zeros(len(some), np.int8), np.ones(len(tied), np.int8)))
            keys = [np.concatenate((mine[some], theirs[tied])) for mine, theirs in ((self.t1, t1), (self.t2, t2), (self.ids, ids))]
            order = np.lexsort((kind, keys[2], keys[1], keys[0]))
            seen = np.empty(len(order), np.int64)
            seen[order] = np.cumsum(kind[order] == 0)
            passed = seen[len(some) :]
            low[tied] = np.where(passed > 0, some[np.maximum(passed, 1) - 1] + 1, low[tied])
            low[tied] = np.maximum(low[tied], np.searchsorted(self.t1, t1[tied], "left"))
        return low


def sampled_splitters(sample: DataFrame, n_buckets: int) -> Splitters:
    """Borders that cut the sampled suffixes into equal parts."""
    drawn = sample.select("t1", "t2", "id").toPandas()
    t1, t2, ids = (drawn[c].to_numpy(np.int64) for c in ("t1", "t2", "id"))
    order = np.lexsort((ids, t2, t1))
    cut = np.unique((np.arange(1, n_buckets) * len(order)) // max(1, n_buckets)) if len(order) else np.zeros(0, np.int64)
    return Splitters(t1[order][cut], t2[order][cut], ids[order][cut])


def dealt(parts: Iterator[Part], borders: Splitters) -> Iterator[pa.RecordBatch]:
    """Suffixes as one row per block and bucket, whose binary holds the columns one after the other."""
    held: list[Part] = []

    def flush() -> pa.RecordBatch:
        columns = np.stack([np.concatenate(x) for x in zip(*held)])
        held.clear()
        bucket = borders.bucket(*columns[:3])
        order = np.argsort(bucket, kind="stable")
        some, first = np.unique(bucket[order], return_index=True)
        blocks = [columns[:, rows].tobytes() for rows in np.split(order, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    for part in parts:
        held.append(part)
        if sum(len(x[0]) for x in held) >= BLOCK:
            yield flush()
    if sum(len(x[0]) for x in held):
        yield flush()


def listed(parts: Iterator[Part]) -> Iterator[pa.RecordBatch]:
    """Suffixes as plain rows."""
    for part in parts:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=NAMES)


def _sorter(sent, with_open: bool):
    """Sorts a bucket and tells of every suffix that matters whether it is late, open or has to be compared across a border."""

    def sort(table: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(x.as_buffer(), np.int64).reshape(len(NAMES), -1) for x in table.column("block")]
        t1, t2, ids, tags, at = np.concatenate(blocks, axis=1)
        order = multikey_order([t1, t2, ids])
        t1, t2, ids, tags, at = t1[order], t2[order], ids[order], tags[order], at[order]
        new1 = np.concatenate(([True], t1[1:] != t1[:-1]))
        new2 = new1 | np.concatenate(([True], t2[1:] != t2[:-1]))
        group = np.cumsum(new2) - 1
        late = ids > ids[new2][group]
        borders = sent.value
        place = np.minimum(np.searchsorted(borders.t1, t1), max(0, len(borders.t1) - 1))
        across = ~late & (borders.t1[place] == t1) if len(borders.t1) else np.zeros(len(t1), bool)
        # Outside the borders: groups of one first token whose first rows differ in content and document.
        open_ = np.zeros(len(t1), bool)
        if with_open:
            start = np.flatnonzero(new1)
            contents = np.add.reduceat(new2.astype(np.int64), start)
            low = np.minimum.reduceat(ids, start)
            high = np.maximum.reduceat(np.where(late, low[np.cumsum(new1) - 1], ids), start)
            open_ = ~late & ~across & ((contents > 1) & (low < high))[np.cumsum(new1) - 1]
        kind = np.where(late, 0, np.where(across, 2, 1)).astype(np.int8)
        keep = late | across | open_
        t1, t2 = np.where(across, t1, 0), np.where(across, t2, 0)  # only compared across borders
        return pa.table({c: pa.array(v[keep]) for c, v in (("kind", kind), ("t1", t1), ("t2", t2), ("id", ids), ("tag", tags), ("at", at))})

    return sort


def late_suffixes(rows: DataFrame, find: Find, splitters: Splitters, with_open: bool) -> tuple[DataFrame, DataFrame]:
    """``id, tag, at, open`` of suffixes whose tokens occur in a smaller document, and of those that stay open.

    Open are first documents of a content whose first token also begins other contents of other documents. Also
    returned: the staged table that the result reads.
    """
    sent = rows.sparkSession.sparkContext.broadcast(splitters)
    blocks = rows.mapInArrow(lambda batches: dealt(find(batches), sent.value), "bucket int, block binary")
    found = stage(blocks.groupBy("bucket").applyInArrow(_sorter(sent, with_open), "kind byte, " + SUFFIXES), "sorted-suffixes")
    edge = found.filter("kind = 2")
    least = edge.groupBy("t1", "t2").agg(F.min("id").alias("first"))
    compared = edge.join(least, ["t1", "t2"])
    late = compared.filter("id > first").select("id", "tag", "at", F.lit(False).alias("open"))
    out = found.filter("kind < 2").select("id", "tag", "at", (F.col("kind") == 1).alias("open")).unionByName(late)
    if with_open:
        contents = least.groupBy("t1").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("low"), F.max("first").alias("high"))
        mixed = contents.filter("n > 1 AND low < high").select("t1")
        still = compared.filter("id = first").join(mixed, "t1", "left_semi").select("id", "tag", "at", F.lit(True).alias("open"))
        out = out.unionByName(still)
    return out, found


def run_suffixes(width: int, gram: int, thin: int = 1) -> Find:
    """One suffix per run of every text; ``at`` packs the first window and the number of further ones."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, _, t in text_slices(batch.column(2), SLICE_BYTES):
                first, last, t1, t2 = (x[::thin] for x in runs(t, width, gram))
                who = np.searchsorted(t.offsets, first, "right") - 1
                at = (first - t.offsets[who]) * 64 + (last - first)
                yield signed(np.ascontiguousarray(t1)), signed(np.ascontiguousarray(t2)), ids[i + who], tags[i + who], at

    return find


def _covered(packed: np.ndarray, width: int, length: int) -> np.ndarray:
    """Which of ``length`` bytes lie in a window of one of the packed runs."""
    edge = np.zeros(length + 1, np.int32)
    first, more = packed >> 6, packed & 63
    np.add.at(edge, first, 1)
    np.add.at(edge, first + more + width, -1)
    return np.cumsum(edge[:-1]) > 0


def window_suffixes(width: int, thin: int = 1) -> Find:
    """The single windows of the runs in column ``runs``; ``at`` packs the window alone."""
    half = width // 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
        for batch in batches:
            ids, tags, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            packed, ends = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            for i, j, t in text_slices(batch.column(2), SLICE_BYTES):
                some = packed[ends[i] : ends[j]]
                who = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                n = (some & 63) + 1
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at, who = (np.repeat(some >> 6, n) + within)[::thin], np.repeat(who, n)[::thin]
                start = t.offsets[who] + at
                t1, t2 = t.hashes(start, start + half), t.hashes(start + half, start + width)
                yield signed(t1), signed(t2), ids[i + who], tags[i + who], at * 64

    return find


def _cut(width: int):
    """Removes covered bytes; the text and the list of covered runs become lengths, span count and what is left."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("__text")
            texts, lists = batch.column(at).cast(pa.binary()), batch.column(at + 1)
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, found in zip(texts, lists):
                data = text.as_buffer()
                n_bytes.append(len(data))
                if not found.is_valid or not len(found.values):
                    n_removed.append(0)
                    n_spans.append(0)
                    kept.append(text.as_py())
                    continue
                gone = _covered(found.values.to_numpy(), width, len(data))
                n_removed.append(int(gone.sum()))
                n_spans.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            made = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *made], names=[*batch.schema.names[:at], "n_bytes", "n_removed", "n_spans", "kept"])

    return cut


def _few(rows: DataFrame, share: float) -> DataFrame:
    """About this share of the documents, the same ones in every run."""
    return rows.filter(F.pmod(F.xxhash64("id", "tag", F.lit("sample")), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20)) + 1)


def dedup_bytes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 50, gram: int = 24, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Columns of ``docs`` but ``text``, with ``n_bytes, n_removed, n_spans`` and ``kept``, the bytes that are left."""
    if not 1 <= width - gram + 1 <= 64:
        raise ValueError("between 1 and 64 grams in a window")
    body = F.coalesce(F.col(text), F.lit("")).alias("text")
    by_id = docs.groupBy(id_of(doc_id)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("size"))
    about = by_id.agg(F.max("n").alias("n"), F.sum("size").alias("size")).first()
    n_bytes = about["size"] or 0
    tag = F.lit(0).cast("long") if (about["n"] or 0) <= 1 else F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(id_of(doc_id).alias("id"), tag.alias("tag"), body)

    def splitters(part: DataFrame, find: Callable[[int], Find], n: int) -> Splitters:
        thin = THIN if n > n_sampled(n) else 1
        sample = part.mapInArrow(lambda batches: listed(find(thin)(batches)), SUFFIXES)
        return sampled_splitters(sample, n_buckets(n))

    def n_buckets(n: int) -> int:
        return int(min(max(1, n // bucket_rows), MOST_BUCKETS))

    def n_sampled(n: int) -> int:
        return max(SAMPLE, 8 * n_buckets(n)) * THIN

    n_runs = 2 * n_bytes // (width - gram + 2)
    few = _few(rows, n_sampled(n_runs) / max(1, n_runs))
    borders = splitters(few, lambda thin: run_suffixes(width, gram, thin), n_runs)
    found, sorted_runs = late_suffixes(rows, run_suffixes(width, gram), borders, True)

    still = found.filter("open").groupBy(F.col("id").alias("of"), F.col("tag").alias("of_tag")).agg(F.collect_list("at").alias("runs"))
    still = stage(still, "open-runs")
    n_windows = still.agg(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda s, a: s + F.pmod(a, F.lit(64)) + 1)).alias("n")).first()["n"] or 0

    def with_runs(part: DataFrame) -> DataFrame:
        return part.join(still, (F.col("id") == F.col("of")) & (F.col("tag") == F.col("of_tag"))).select("id", "tag", "text", "runs")

    few = with_runs(_few(rows, n_sampled(n_windows) / max(1, n_windows)))
    borders = splitters(few, lambda thin: window_suffixes(width, thin), n_windows)
    single, sorted_windows = late_suffixes(with_runs(rows), window_suffixes(width), borders, False)

    covered = found.filter("NOT open").select("id", "tag", "at").unionByName(single.select("id", "tag", "at"))
    covered = stage(covered.groupBy(F.col("id").alias("__of"), F.col("tag").alias("__of_tag")).agg(F.collect_list("at").alias("__runs")), "covered")
    release(sorted_runs, sorted_windows, still)
    others = [c for c in docs.columns if c not in (text, "n_bytes", "n_removed", "n_spans", "kept")]
    whole = docs.select(*others, id_of(doc_id).alias("__id"), tag.alias("__tag"), body.alias("__text"))
    met = whole.join(covered, (F.col("__id") == F.col("__of")) & (F.col("__tag") == F.col("__of_tag")), "left")
    met = met.select(*[whole[c] for c in others], "__text", "__runs")
    counts = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([*[docs.schema[c] for c in others], *counts, T.StructField("kept", T.BinaryType())])
    return met.mapInArrow(_cut(width), schema)

