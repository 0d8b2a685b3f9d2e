"""Hidden Markov language model: Baum-Welch in Spark, exact likelihoods by the scaled forward recursion.

Tokens are lower-cased words, then one end. Every training word has an emission probability of its own in
every state, whatever the size of the vocabulary; all unseen words together are one more symbol. Emissions
are smoothed by one count per word, dealt evenly over the states.

Steps: (1) one pass over the texts cuts them into blocks of bounded size and writes, per block, its distinct
words with their training counts and every text as numbers into that list; the words of all blocks are cut
into slices of their hashes; (2) counts are summed by slice; (3) every Baum-Welch round gives the blocks the
emission weights of their words from all slices, takes whole texts through the forward and backward recursions and sums the expected counts
per word in Spark; only start, transitions, the end and the states' totals return to the driver; (4) all
texts are scored the same way. Long texts are computed in spans of ``SPAN`` tokens that hand their forward
and backward messages on, so nothing is cut. All counts cover all training rows.

What crosses between tasks, a binary row per block and slice, sets the disk that a round takes. It holds numbers of
single precision; sums and probabilities are computed in double precision, and the states' totals are those of the
stored weights, so the emissions of a state still add up to one. A round over many blocks takes them in up to
``PARTS`` parts, one after the other, each summed by word before the next.

Edge cases: null and empty texts are one end token; rows with a null id are trained on as the caller says;
repeated rows count each; an empty table gives an empty table; without training rows every probability is
that of the starting point and the base score is 0; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.arrays import text_slices
from docframe.plans.stage import release, stage

SPAN = 1_024
PLACES = 262_144
BLOCK_BYTES = 32_000_000
PARTS = 4
PART_BLOCKS = 12
SLICES = 8
SLICE_WORDS = 500_000

_BLOCKS = "block long, id long, held boolean, seq binary, h binary, at binary, c binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds per block: texts as numbers of local words, and one row with the local words, by hash, and their training counts."""
    held_rows: list[tuple] = []
    size = 0
    block = TaskContext.get().partitionId() << 32

    def flush():
        hashed = np.concatenate([w for w, _, _, _ in held_rows])
        lengths = np.concatenate([n for _, n, _, _ in held_rows])
        ids = pa.concat_arrays([x for _, _, x, _ in held_rows])
        held = np.concatenate([x for _, _, _, x in held_rows])
        words, number, n = np.unique(hashed, return_inverse=True, return_counts=True)
        train = np.bincount(number, weights=np.repeat(~held, lengths), minlength=len(words)).astype(np.int64)
        # Frequent words get small numbers, which compress well.
        rank = np.empty(len(words), dtype=np.uint32)
        order = np.argsort(-n, kind="stable")
        rank[order] = np.arange(len(words), dtype=np.uint32)
        numbers, ends = rank[number], np.concatenate(([0], np.cumsum(lengths)))
        seq = np.empty(4 * len(numbers), dtype=np.uint8)
        for i, j in zip(ends[:-1], ends[1:]):  # byte by byte: the high ones are mostly zero
            seq[4 * i : 4 * j] = numbers[i:j].view(np.uint8).reshape(-1, 4).T.ravel()
        rows = len(lengths)
        texts = pa.RecordBatch.from_arrays(
            [
                pa.array([block] * rows, pa.int64()), ids, pa.array(held),
                pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(seq)]),
                *[pa.nulls(rows, pa.binary())] * 3,
            ],
            names=["block", "id", "held", "seq", "h", "at", "c"],
        )
        vocabulary = pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()),
                *[pa.array([x.tobytes()], pa.binary()) for x in (words, rank, train)],
            ],
            names=texts.schema.names,
        )
        held_rows.clear()
        return texts, vocabulary

    for batch in batches:
        flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j, t in text_slices(batch.column(2)):
            t = t.lower()
            starts, ends, first = t.words()
            held_rows.append((t.hashes(starts, ends), np.diff(first), batch.column(0).slice(i, j - i), flags[i:j]))
            size += len(t.data)
            if size >= BLOCK_BYTES:
                yield from flush()
                size = 0
                block += 1
    if held_rows:
        yield from flush()


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit
        self.table = np.vstack([emit, np.ones(len(start))])  # a padded place (-1) says nothing

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        start, move, emit = start + 1.0, move + 1.0, emit + 0.1
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def expected(self, flat: np.ndarray, emit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts of whole texts; ``flat`` is (texts, length), padded with -1 at the end.

        Emission counts are added to ``emit`` (states, symbols), if given, and returned as (symbols, states).
        """
        spans = [flat[:, i : i + SPAN].T for i in range(0, flat.shape[1], SPAN)]
        borders: list[np.ndarray | None] = [None]
        for span in spans[:-1]:
            borders.append(self._forward(self._seen(span), borders[-1])[0][-1].copy())
        move, emit = np.zeros_like(self.move), np.zeros(self.emit.T.shape) if emit is None else emit
        beta = np.ones((len(self.start), len(flat)))
        for span, before in zip(reversed(spans), reversed(borders)):
            start, beta = self._backward(span, self._seen(span), before, beta, move, emit)
        return start, move * self.move, emit.T

    def _seen(self, span: np.ndarray) -> np.ndarray:
        """Emission probabilities of a span as (places, states, texts): texts last, so that steps run along them."""
        return np.ascontiguousarray(self.table[span].transpose(0, 2, 1))

    def _forward(self, seen: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward probabilities of a span and their scales, from those of the place before it."""
        alpha, scale = np.empty_like(seen), np.empty((len(seen), seen.shape[2]))
        ahead = np.ascontiguousarray(self.move.T)
        for t in range(len(seen)):
            before = alpha[t - 1] if t else before
            now = alpha[t]
            np.multiply(self.start[:, None] if before is None else ahead @ before, seen[t], out=now)
            np.sum(now, axis=0, out=scale[t])
            now /= scale[t]
        return alpha, scale

    def _backward(
        self, span: np.ndarray, seen: np.ndarray, before: np.ndarray | None, beta: np.ndarray, move: np.ndarray, emit: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Adds a span's counts to ``move`` and ``emit``; start counts and the message to the span before."""
        alpha, scale = self._forward(seen, before)
        real = span >= 0
        whole = real.all(axis=1)
        for t in range(len(span) - 1, -1, -1):
            ahead = seen[t]
            ahead *= beta
            ahead /= scale[t]
            alpha[t] *= beta  # from here on the probabilities of the states given the whole text
            before_t = alpha[t - 1] if t else before
            if before_t is not None:
                move += (before_t if whole[t] else before_t * real[t]) @ ahead.T
            beta = self.move @ ahead
        symbols = emit.shape[1]
        places = np.where(real, span, symbols).ravel()
        for k in range(len(self.start)):
            emit[k] += np.bincount(places, weights=alpha[:, k].ravel(), minlength=symbols + 1)[:-1]
        return (alpha[0] * real[0]).sum(axis=1), beta

    def log_likelihood(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of every class sequence ``flat[first[i]:first[i + 1]]``, all of it."""
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = first[:-1][order], lengths[order]
        total = np.zeros(len(order))
        if len(order) == 0 or lengths[0] == 0:
            return total
        active = int((lengths > 0).sum())
        now = self.start * self.emit[flat[begin[:active]]]
        t = 0
        while True:
            scale = now.sum(axis=1)
            total[:active] += np.log(scale)
            t += 1
            left = int(np.searchsorted(-lengths, -t, side="left"))
            if left == 0:
                break
            now = ((now[:left] / scale[:left, None]) @ self.move) * self.emit[flat[begin[:left] + t]]
            active = left
        out = np.empty(len(order))
        out[order] = total
        return out


def _numbers(table: pa.Table, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a block as local word numbers, each closed by ``end``, and where they start."""
    parts = []
    for seq in table.column("seq"):
        bytes_ = np.frombuffer(seq.as_buffer(), dtype=np.uint8) if seq.as_buffer() is not None else np.zeros(0, np.uint8)
        own = np.ascontiguousarray(bytes_.reshape(4, -1).T).view(np.uint32).ravel()
        parts.append(np.append(own.astype(np.int64), end))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return flat, np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def _padded(flat: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """Whole texts of similar length as (texts, length) arrays of about ``PLACES`` places per span."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    i = 0
    while i < len(order):
        longest = int(lengths[order[i]])
        some = order[i : i + max(1, min(PLACES // min(longest, SPAN), 8 * PLACES // longest))]
        place = np.arange(longest)
        inside = place < lengths[some][:, None]
        yield np.where(inside, flat[np.minimum(first[some][:, None] + place, len(flat) - 1)], -1)
        i += len(some)


def _noise(h: np.ndarray, states: int, seed: int) -> np.ndarray:
    """Normal numbers that depend on word and state only."""

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53

    step = np.uint64(0x9E3779B97F4A7C15)
    x = h.astype(np.int64).view(np.uint64)[:, None] + step * np.arange(1 + seed, 1 + seed + 2 * states, dtype=np.uint64)
    u, v = mix(x[:, :states]), mix(x[:, states:])
    return np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v)


class Shared:
    """What every worker needs: start, transitions, the end's emission weight and the states' weight sums."""

    def __init__(self, start: np.ndarray, move: np.ndarray, end: np.ndarray, words: np.ndarray):
        self.start, self.move, self.end, self.unseen = start, move, end, 1 / len(start)
        self.total = words + end + self.unseen

    def model(self, weights: np.ndarray) -> Model:
        """Model of a block: the emissions of its own words (0 = unseen), then the end."""
        return Model(self.start, self.move, np.vstack([weights + self.unseen, self.end]) / self.total)


_INDEX = "of long, slice int, held boolean, h binary, at binary, c binary"
_WEIGHTS = "slice int, h binary, w binary, rest array<double>"


def _column(table: pa.Table | pa.RecordBatch, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=kind) for x in table.column(name)]


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def _together(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _cut(slices: int):
    """A block's words in slices of the hashes, those without training counts apart (``held``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, h, at, c in zip(batch.column(0).to_pylist(), _column(batch, "h", np.uint64), _column(batch, "at", np.uint32), _column(batch, "c", np.int64)):
                for held in (False, True):
                    some = np.flatnonzero((c > 0) != held)
                    number = ((h[some] >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
                    ends = np.flatnonzero(np.diff(number)) + 1
                    own = np.split(some, ends) if len(some) else []
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block] * len(own), pa.int64()), pa.array([int(number[i]) for i in [0, *ends][: len(own)]], pa.int32()),
                            pa.array([held] * len(own), pa.bool_()), *[_binary([x[i] for i in own]) for x in (h, at, c)],
                        ],
                        names=["of", "slice", "held", "h", "at", "c"],
                    )

    return cut


def _count_words(table: pa.Table) -> pa.Table:
    """Training counts of the words of a slice."""
    h, number = np.unique(np.concatenate(_column(table, "h", np.uint64)), return_inverse=True)
    c = np.bincount(number, weights=np.concatenate(_column(table, "c", np.int64))).astype(np.int64)
    return pa.table(
        {"slice": table.column("slice").slice(0, 1), "h": _binary([h]), "c": _binary([c]), "n": pa.array([int(c.sum())]), "v": pa.array([len(h)])}
    )


def _attach(states: int):
    """Weights, and training counts if given, of the words that every block has in a slice."""

    def attach(left: pa.Table, right: pa.Table) -> pa.Table:
        h, w = _together(_column(right, "h", np.uint64), np.uint64), _together(_column(right, "w", np.float32), np.float32)
        c = _together(_column(right, "c", np.int64), np.int64) if "c" in right.schema.names else np.zeros(len(h), np.int64)
        w, c = np.vstack([w.reshape(-1, states), np.zeros((1, states), np.float32)]), np.append(c, 0)
        own = _column(left, "h", np.uint64)
        places = []
        for x in own:
            at = np.searchsorted(h, x)
            places.append(np.where(np.append(h, np.uint64(0))[at] == x, at, len(h)) if len(h) else at)
        out = {"of": left.column("of"), "slice": left.column("slice"), "h": left.column("h"), "at": left.column("at"), "w": _binary([w[i] for i in places])}
        if "c" in right.schema.names:
            out["c"] = _binary([c[i] for i in places])
        return pa.table(out)

    return attach


def _local(table: pa.Table, states: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Emission weights of a block's words in the order of their numbers, and the numbers by slice."""
    numbers = _column(table, "at", np.uint32)
    at = _together(numbers, np.uint32)
    out = np.zeros((int(at.max()) + 1 if len(at) else 0, states))
    if len(at):
        out[at] = np.concatenate(_column(table, "w", np.float32)).reshape(-1, states)
    return out, numbers


def _sums(weights: DataFrame, states: int) -> np.ndarray:
    return np.array([x or 0.0 for x in weights.agg(*[F.sum(F.col("rest")[k]).alias(f"s{k}") for k in range(states)]).first()])


def _counter(sent, states: int):
    """Expected counts of a block's texts by slice; slice -1: the start, the end and the transitions."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        local, numbers = _local(right, states)
        model = sent.value.model(local)
        start, move, counts = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.T.shape)
        for some in _padded(*_numbers(left, len(local))):
            a, b, _ = model.expected(some, counts)
            start, move = start + a, move + b
        emit = counts.T.astype(np.float32)
        rest = np.vstack([start, counts[:, -1], move]).ravel().tolist()
        return pa.table(
            {
                "slice": pa.array([*right.column("slice").to_pylist(), -1], pa.int32()), "h": pa.array([*right.column("h").to_pylist(), None], pa.binary()),
                "w": pa.array([*[emit[i].tobytes() for i in numbers], None], pa.binary()),
                "rest": pa.array([None] * len(numbers) + [rest], pa.list_(pa.float64())),
            }
        )

    return count


def _summed(states: int):
    """Sums of a slice by word; ``rest`` holds those of the weights by state."""

    def add(table: pa.Table) -> pa.Table:
        if table.column("slice")[0].as_py() < 0:
            rest = np.sum(table.column("rest").to_pylist(), axis=0)
            return pa.table({"slice": pa.array([-1], pa.int32()), "h": pa.nulls(1, pa.binary()), "w": pa.nulls(1, pa.binary()), "rest": pa.array([rest.tolist()])})
        h, number = np.unique(np.concatenate(_column(table, "h", np.uint64)), return_inverse=True)
        found = np.concatenate(_column(table, "w", np.float32)).reshape(-1, states)
        w = np.stack([np.bincount(number, weights=found[:, k], minlength=len(h)) for k in range(states)], axis=1)
        return _weight_row(table.column("slice")[0].as_py(), h, w)

    return add


def _weight_row(number: int, h: np.ndarray, w: np.ndarray) -> pa.Table:
    """Weights of a slice, kept without the 1 / states that every word has on top, and their sums with it."""
    w = w.astype(np.float32)
    rest = w.sum(axis=0, dtype=np.float64) + len(h) / w.shape[1]
    return pa.table({"slice": pa.array([number], pa.int32()), "h": _binary([h]), "w": _binary([w]), "rest": pa.array([rest.tolist()])})


def train(texts: DataFrame, index: DataFrame, counts: DataFrame, n_texts: int, n_blocks: int, states: int, rounds: int, seed: int) -> tuple[DataFrame, Shared]:
    """Baum-Welch over ``texts`` (``block, seq``): the emission weights (``slice, h, w``) and the rest of the model.

    ``index``: the training words of every block by slice; ``counts``: those of all blocks.
    """
    spark = texts.sparkSession
    n_parts = min(PARTS, max(1, n_blocks // PART_BLOCKS))

    def part(name: str, p: int) -> Column:
        # A block's number is its task's, then its own within the task: 32 bits each.
        return F.pmod(F.shiftright(name, 32) + F.col(name), F.lit(n_parts)) == p

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slightly different copies of the word frequencies."""
        for batch in batches:
            for number, h, c in zip(batch.column(0).to_pylist(), _column(batch, "h", np.uint64), _column(batch, "c", np.int64)):
                w = ((c + 1) / states)[:, None] * np.exp(0.5 * _noise(h.view(np.int64), states, seed)) - 1 / states
                yield from _weight_row(number, h, w).to_batches()

    def summed(found: DataFrame) -> DataFrame:
        return stage(found.groupBy("slice").applyInArrow(_summed(states), _WEIGHTS), "expected")

    weights = counts.select("slice", "h", "c").mapInArrow(first, _WEIGHTS)
    held: list[DataFrame] = []
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    end = (n_texts + 1) / states * np.exp(np.random.default_rng(seed).normal(0, 0.5, states))
    shared = Shared(np.full(states, 1 / states), move, end, _sums(weights, states))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(shared)
        parts = []
        for p in range(n_parts):
            own = index.filter(part("of", p)).groupBy("slice").cogroup(weights.groupBy("slice"))
            met = own.applyInArrow(_attach(states), "of long, slice int, h binary, at binary, w binary")
            found = texts.filter(part("block", p)).groupBy("block").cogroup(met.groupBy("of"))
            parts.append(summed(found.applyInArrow(_counter(sent, states), _WEIGHTS)))
        release(*held)  # the table of the round before
        held = parts
        if n_parts > 1:
            held = [summed(reduce(DataFrame.unionAll, parts))]
            release(*parts)
        start, end, move = np.zeros(states), np.zeros(states), np.zeros((states, states))
        for r in held[0].filter("slice < 0").select("rest").collect():
            start, end, *move = np.array(r["rest"]).reshape(-1, states)
        weights = held[0].filter("slice >= 0")
        start, move = start + 1.0, np.array(move) + 1.0
        shared = Shared(start / start.sum(), move / move.sum(axis=1, keepdims=True), end + 1 / states, _sums(weights, states))
    return weights, shared


_SCORED = "id long, held boolean, n_tokens long, n_known long, base double, score double"


def score_texts(
    docs: DataFrame,
    held_out: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    states: int = 8,
    rounds: int = 4,
    seed: int = 11,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Rows where ``held_out`` is not true train the model. Scores are log10 probabilities of whole texts.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = stage(rows.mapInArrow(_blocks, _BLOCKS), "blocks", compression="zstd")
    texts = blocks.filter("seq IS NOT NULL").select("block", "id", "held", "seq")
    words = blocks.filter("h IS NOT NULL").select("block", "h", "at", "c")
    n_words = words.agg(F.coalesce(F.sum(F.length("h") / 8), F.lit(0))).first()[0]
    slices = max(SLICES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(n_words) // SLICE_WORDS)
    index = stage(words.mapInArrow(_cut(slices), _INDEX), "index", compression="zstd")
    learned = index.filter("NOT held").select("of", "slice", "h", "at", "c")
    counts = stage(learned.groupBy("slice").applyInArrow(_count_words, "slice int, h binary, c binary, n long, v long"), "counts")
    trained = texts.filter("NOT held")
    ends, n_blocks = trained.agg(F.count(F.lit(1)), F.countDistinct("block")).first()
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    tokens, kinds = row["n"] + ends, row["v"] + (1 if ends else 0)
    weights, shared = train(trained.select("block", "seq"), learned.select("of", "slice", "h", "at"), counts, ends, n_blocks, states, rounds, seed)
    sent = docs.sparkSession.sparkContext.broadcast(shared)

    def likelihood(left: pa.Table, right: pa.Table) -> pa.Table:
        local, numbers = _local(right, states)
        seen = np.zeros(len(local) + 1)
        for at, c in zip(numbers, _column(right, "c", np.int64)):
            seen[at] = c
        seen[-1] = ends
        flat, first = _numbers(left, len(local))
        total = lambda x: np.add.reduceat(x[flat], first[:-1]) if len(flat) else np.zeros(0)
        return pa.table(
            {
                "id": left.column("id"), "held": left.column("held"), "n_tokens": pa.array(np.diff(first)),
                "n_known": pa.array(total((seen > 0).astype(np.int64)).astype(np.int64)), "base": pa.array(total(np.log10((seen + 1) / (tokens + kinds + 1)))),
                "score": pa.array(sent.value.model(local).log_likelihood(flat, first) / np.log(10)),
            }
        )

    known = counts.select("slice", "h", "c").join(weights.select("slice", "w"), "slice")
    met = index.select("of", "slice", "h", "at").groupBy("slice").cogroup(known.groupBy("slice"))
    met = met.applyInArrow(_attach(states), "of long, slice int, h binary, at binary, w binary, c binary").select("of", "at", "w", "c")
    scored = texts.groupBy("block").cogroup(met.groupBy("of")).applyInArrow(likelihood, _SCORED)
    return scored.select(
        F.col("id").alias(doc_id), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
    )
