"""Greedy sequential packing, split across tasks inside one key.

Where a page starts depends on everything before it, so the obvious plan folds a key in one
task. Inside a bucket, however, only the fill of the page that is open at its start is unknown,
and only the first page turn depends on it. Each bucket is therefore reduced to a small table
"fill at its start -> pages started, fill at the end", the tables are composed in a tree
(:mod:`docframe.plans.transitions`), and every bucket is then placed on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.plans.scan import BUCKET_ROWS, bucket_of, gathered, ordered_scan, whole_groups
from docframe.plans.stage import stage
from docframe.plans.transitions import FRESH, NEVER, as_table, entry_states, table_fields

SLACK = 0.5
UNITS = 1_000_000
"""Sizes and capacities are rounded to millionths and added as whole numbers, so sums are exact and the
placement does not depend on where a bucket starts."""
_B = "__bucket"


def _turns(size: np.ndarray, brk: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and, for a page starting at i, the item that starts the following page."""
    n = len(size)
    cum = np.concatenate(([0], np.cumsum(size)))
    full = np.searchsorted(cum, cum[:-1] + limit, side="right") - 1
    nxt = np.maximum(full, np.arange(1, n + 1))
    forced = np.where(brk, np.arange(1, n + 1), n + 1)
    return cum, np.minimum(nxt, np.minimum.accumulate(forced[::-1])[::-1])


def _first_turn(cum: np.ndarray, brk: np.ndarray, limit: int, fill: int) -> int:
    """First item of the bucket that starts a page, given the fill of the open page."""
    if fill < 0:
        return 0
    turn = int(np.searchsorted(cum[1:], limit - fill, side="right"))
    marks = np.flatnonzero(brk)
    return min(turn, int(marks[0]) + 1) if len(marks) else turn


def _summarise(size: np.ndarray, brk: np.ndarray, limit: int) -> dict:
    """The bucket's transition table. An open page with fill f turns at the first item whose prefix sum is above
    ``limit - f``, so every item that can be the first to turn has one greatest fill."""
    n = len(size)
    cum, nxt = _turns(size, brk, limit)
    turn_from, pages = [0] * n, [0] * n
    hops = nxt.tolist()
    for i in range(n - 1, -1, -1):
        j = hops[i]
        turn_from[i], pages[i] = (i, 1) if j >= n else (turn_from[j], pages[j] + 1)

    def end(p: int) -> int:
        fill = int(cum[n] - cum[turn_from[p]])
        return FRESH if brk[-1] or fill > limit else fill

    first = _first_turn(cum, brk, limit, 0)
    steps = [(limit - int(cum[p]), pages[p], end(p)) for p in range(min(first, n - 1), -1, -1)]
    whole, marked = int(cum[n]), bool(brk.any())
    if marked and first == n and whole <= limit:  # the only mark is on the last item
        steps.insert(0, (limit - whole, 0, FRESH))
    return as_table(steps, (pages[0], end(0)), NEVER if marked else min(whole, limit + 1), limit)


def pack_pages(
    items: DataFrame,
    keys: Sequence[str],
    idx: str,
    size: str,
    capacity: float | str,
    break_after: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Assign items to pages greedily: ``keys, idx, size, page_seq`` (1-based).

    A new page starts when the open page already holds an item and the next one would pass
    ``capacity + 0.5``, and after every item flagged ``break_after``. ``capacity`` is a number or a
    column that is constant per key. Pages whose items all have size 0 keep their number here and
    are dropped by :func:`page_segments`.
    """
    keys = list(keys)
    cap = F.col(capacity) if isinstance(capacity, str) else F.lit(float(capacity))
    brk = F.coalesce(F.col(break_after), F.lit(False)) if break_after else F.lit(False)
    base = items.select(
        *keys,
        F.col(idx).cast("long").alias("idx"),
        F.col(size).cast("double").alias("size"),
        F.round(F.col(size).cast("double") * UNITS).cast("long").alias("units"),
        brk.alias("brk"),
        F.round((cap.cast("double") + SLACK) * UNITS).cast("long").alias("cap"),
        bucket_of(F.col(idx), bucket_rows).alias(_B),
    )
    # Read for the keys of several buckets, for their tables and for the placement: what is below is done once.
    base = stage(base, "items")
    key_fields = [base.schema[k] for k in keys]

    # Keys that fit in one bucket need no table: their first page starts with the bucket.
    ends = base.groupBy(*keys).agg(F.min(_B).alias("__lo"), F.max(_B).alias("__hi")).filter("__lo < __hi")
    several = base.join(stage(ends.select(*keys), "several"), keys, "left_semi")

    summary_schema = T.StructType([*key_fields, T.StructField(_B, T.LongType()), *table_fields()])

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in whole_groups(batches, [*keys, _B]):
            size, brk = pdf["units"].to_numpy(dtype=np.int64), pdf["brk"].to_numpy(dtype=bool)
            cap = pdf["cap"].to_numpy(dtype=np.int64)
            rows = [_summarise(size[i:j], brk[i:j], int(cap[i])) for i, j in zip(cuts[:-1], cuts[1:])]
            heads = pdf[[*keys, _B]].iloc[cuts[:-1]].reset_index(drop=True)
            yield pd.concat([heads, pd.DataFrame(rows)], axis=1)[summary_schema.names]

    summaries = gathered(several, [*keys, _B], ["idx"]).mapInPandas(summarise, summary_schema)

    entries = entry_states(summaries, keys)

    placed_schema = T.StructType(
        [
            *key_fields,
            T.StructField("idx", T.LongType()),
            T.StructField("size", T.DoubleType()),
            T.StructField("page_seq", T.LongType()),
        ]
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in whole_groups(batches, [*keys, _B]):
            size = pdf["units"].to_numpy(dtype=np.int64)
            brk = pdf["brk"].to_numpy(dtype=bool)
            cap = pdf["cap"].to_numpy(dtype=np.int64)
            done = pdf["done"].to_numpy()
            entry = done >= 0
            seq = np.zeros(len(pdf), dtype=np.int64)
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                fill, base_seq = FRESH, 0
                if entry[i]:
                    fill, base_seq = int(size[i]), int(done[i])
                    i += 1
                cum, nxt = _turns(size[i:j], brk[i:j], int(cap[i]))
                starts = np.zeros(j - i, dtype=np.int64)
                at = _first_turn(cum, brk[i:j], int(cap[i]), fill)
                hops = nxt.tolist()
                while at < j - i:
                    starts[at] = 1
                    at = hops[at]
                seq[i:j] = base_seq + np.cumsum(starts)
            yield pdf[[*keys, "idx", "size"]].assign(page_seq=seq)[~entry]

    # A bucket's entry state travels as one extra row sorted before its items.
    marked = base.withColumn("done", F.lit(-1).cast("long")).withColumn("__first", F.lit(1))
    if entries is not None:
        states = entries.select(
            *keys, F.lit(0).cast("long").alias("idx"), F.lit(0.0).alias("size"), F.col("fill").alias("units"),
            F.lit(False).alias("brk"), F.lit(0).cast("long").alias("cap"), _B, "done", F.lit(0).alias("__first"),
        )
        marked = marked.unionByName(states)
    return gathered(marked, [*keys, _B], ["__first", "idx"]).mapInPandas(place, placed_schema)


def page_segments(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, page_no, first_idx, last_idx, used``: pages with a non-zero item, renumbered."""
    keys = list(keys)
    segments = (
        packed.groupBy(*keys, "page_seq")
        .agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.sum("size").alias("used"))
        .filter("used > 0")
    )
    # One row per page; numbering reads them twice, and the packing behind them should run once.
    numbered = ordered_scan(stage(segments, "pages"), keys, ["page_seq"], bucket_of("page_seq"), row_number="page_no")
    return numbered.select(*keys, "page_seq", "page_no", "first_idx", "last_idx", "used")
