"""Ordered scans, lookups and range expansion that never gather a whole key in one task.

A plain window over ``PARTITION BY doc_id`` sorts a document in one task, which stalls when a
single document holds a third of the corpus. The helpers here cut every key into buckets of a
bounded ordinal range, work inside ``(key, bucket)``, and run the only per-key window over the
bucket summaries (one row per bucket). Key columns must not be null.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 65_536
"""Default width of a bucket on an integer ordinal; a bucket holds at most this many rows."""

_B = "__bucket"


def bucket_of(ordinal: str | Column, width: int = BUCKET_ROWS) -> Column:
    """Bucket number of an integer ordinal."""
    col = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.floor(col / F.lit(width)).cast("long")


def time_bucket(ts: str | Column, seconds: int = 3600) -> Column:
    """Bucket number of a timestamp."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(col.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    *,
    row_number: str | None = None,
    running: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    carry: Mapping[str, Column] | None = None,
    first: Mapping[str, Column] | None = None,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running values per key, in ``order``, with bounded tasks.

    ``bucket`` must not decrease along ``order``. ``running``/``before`` are inclusive/exclusive
    sums (nulls count as zero), ``total`` is the key's sum, ``carry`` the latest non-null value at
    or before the row, ``first`` the key's first value, ``lag``/``lead`` the neighbouring value.
    """
    keys, order = list(keys), list(order)
    running, before, total = dict(running or {}), dict(before or {}), dict(total or {})
    carry, first = dict(carry or {}), dict(first or {})
    lag, lead = dict(lag or {}), dict(lead or {})

    pos = F.struct(*[F.col(c) for c in order])
    rows = df.withColumn(_B, bucket)

    # One summary row per (key, bucket); partial aggregation happens before the shuffle.
    aggs = [F.count(F.lit(1)).alias("__n")]
    for name, col in {**running, **before, **total}.items():
        aggs.append(F.coalesce(F.sum(col), F.lit(0)).alias(f"__s_{name}"))
    for name, col in carry.items():
        seen = F.when(col.isNotNull(), pos)
        aggs.append(F.max_by(col, seen).alias(f"__c_{name}"))
    for name, col in {**first, **lead}.items():
        aggs.append(F.min_by(F.struct(col.alias("v")), pos).alias(f"__f_{name}"))
    for name, col in lag.items():
        aggs.append(F.max_by(F.struct(col.alias("v")), pos).alias(f"__l_{name}"))
    summary = rows.groupBy(*keys, _B).agg(*aggs)

    along = Window.partitionBy(*keys).orderBy(_B)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    picks: list[Column] = [F.col(k) for k in keys] + [F.col(_B)]
    if row_number:
        picks.append(F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base_n"))
    for name in {**running, **before}:
        picks.append(F.coalesce(F.sum(f"__s_{name}").over(earlier), F.lit(0)).alias(f"__b_{name}"))
    for name in total:
        picks.append(F.sum(f"__s_{name}").over(whole).alias(name))
    for name in carry:
        picks.append(F.last(f"__c_{name}", ignorenulls=True).over(earlier).alias(f"__c_{name}"))
    for name in first:
        picks.append(
            F.first(f"__f_{name}").over(along.rowsBetween(Window.unboundedPreceding, 0))["v"].alias(name)
        )
    for name in lag:
        picks.append(F.lag(f"__l_{name}").over(along)["v"].alias(f"__l_{name}"))
    for name in lead:
        picks.append(F.lead(f"__f_{name}").over(along)["v"].alias(f"__f_{name}"))
    bases = summary.select(*picks)

    inside = Window.partitionBy(*keys, _B).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    local: dict[str, Column] = {}
    if row_number:
        local["__rn"] = F.row_number().over(inside).cast("long")
    for name, col in running.items():
        local[f"__r_{name}"] = F.coalesce(F.sum(col).over(upto), F.lit(0))
    for name, col in before.items():
        local[f"__r_{name}"] = F.coalesce(F.sum(col).over(prior), F.lit(0))
    for name, col in carry.items():
        local[f"__k_{name}"] = F.last(col, ignorenulls=True).over(upto)
    if lag or lead:
        local["__edge"] = F.row_number().over(inside)
    for name, col in lag.items():
        local[f"__g_{name}"] = F.lag(F.struct(col.alias("v"))).over(inside)
    for name, col in lead.items():
        local[f"__d_{name}"] = F.lead(F.struct(col.alias("v"))).over(inside)
    joined = (rows.withColumns(local) if local else rows).join(bases, [*keys, _B])

    out: dict[str, Column] = {}
    if row_number:
        out[row_number] = F.col("__base_n") + F.col("__rn")
    for name in {**running, **before}:
        out[name] = F.col(f"__b_{name}") + F.col(f"__r_{name}")
    for name in carry:
        out[name] = F.coalesce(F.col(f"__k_{name}"), F.col(f"__c_{name}"))
    for name in lag:
        near = F.col(f"__g_{name}")
        out[name] = F.when(near.isNull(), F.col(f"__l_{name}")).otherwise(near["v"])
    for name in lead:
        near = F.col(f"__d_{name}")
        out[name] = F.when(near.isNull(), F.col(f"__f_{name}")).otherwise(near["v"])
    if out:
        joined = joined.withColumns(out)
    keep = [*df.columns, *[c for c in [row_number] if c]]
    keep += [n for group in (running, before, total, carry, first, lag, lead) for n in group]
    return joined.select(*dict.fromkeys(keep))


def attach(
    df: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    how: str = "left",
    buckets_from: DataFrame | None = None,
) -> DataFrame:
    """Join one row per key onto ``df`` without sending a hot key to one task.

    The key's row is first spread over the buckets the key really has (rows / bucket width of
    them), so the large side is hashed by ``(key, bucket)`` instead of by the key alone. The buckets
    are read from ``df``, or from ``buckets_from``: a cheaper table with at least the same ones.
    """
    keys = list(keys)
    spread = (df if buckets_from is None else buckets_from).select(*keys, bucket.alias(_B)).distinct().join(per_key, keys, how)
    return df.withColumn(_B, bucket).join(spread, [*keys, _B]).drop(_B)


def last_before(
    points: DataFrame, steps: DataFrame, keys: Sequence[str], pos: str, at: str, value: str, *, strict: bool = False, band: float = 65_536.0
) -> DataFrame:
    """As-of search: adds ``value`` of the step with the greatest ``at`` that is not above ``pos`` (``strict``: below it).

    Distinct positions and steps are put in one order, cut into ranges of ``band``, and the latest step is carried
    along; nothing is repeated for long steps, and many points at one place are looked up once. Null without a step.
    """
    keys = list(keys)
    ours, theirs = (0, 1) if strict else (1, 0)  # who comes first at one place
    asked = points.select(*keys, F.col(pos).alias("__x")).distinct().filter("__x IS NOT NULL")
    band_of = lambda x: F.floor(F.col(x) / F.lit(band)).cast("long").alias(_B)
    # What a band enters with comes from the steps alone; the positions only say which bands are asked for.
    latest = steps.groupBy(*keys, band_of(at)).agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(at))).alias("__v"))
    bands = latest.unionByName(points.filter(F.col(pos).isNotNull()).select(*keys, band_of(pos)).distinct(), allowMissingColumns=True)
    earlier = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    entered = bands.groupBy(*keys, _B).agg(F.first("__v", ignorenulls=True).alias("__v")).select(*keys, _B, F.last("__v", ignorenulls=True).over(earlier).alias("__e"))
    line = steps.select(*keys, F.col(at).alias("__x"), F.lit(theirs).alias("__kind"), F.col(value).alias("__v"))
    line = line.unionByName(asked.withColumn("__kind", F.lit(ours)), allowMissingColumns=True).withColumn(_B, band_of("__x"))
    inside = Window.partitionBy(*keys, _B).orderBy("__x", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("__near", F.last("__v", ignorenulls=True).over(inside)).filter(F.col("__kind") == ours).join(entered, [*keys, _B])
    found = found.withColumn("__found", F.coalesce("__near", "__e"))
    found = found.select(*keys, F.col("__x").alias(pos), F.col("__found").alias(value))
    return points.join(found, [*keys, pos], "left")


def explode_span(df: DataFrame, first: str, last: str, name: str, width: int = BUCKET_ROWS) -> DataFrame:
    """One row per integer in ``first..last``; no array is longer than ``width`` elements.

    Empty spans (last < first) give no row. The optimizer takes the rows for as few as the spans, so a join that follows is
    told to merge: it would send all of them through the driver as a broadcast.
    """
    lo, hi = F.col(first).cast("long"), F.col(last).cast("long")
    blocks = F.when(hi >= lo, F.sequence(F.lit(0).cast("long"), F.floor((hi - lo) / F.lit(width)).cast("long")))
    start = lo + F.col("__blk") * F.lit(width)
    return (
        df.withColumn("__blk", F.explode(blocks))
        .withColumn(name, F.explode(F.sequence(start, F.least(hi, start + F.lit(width - 1)))))
        .drop("__blk")
        .hint("merge")
    )


def gathered(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole groups of ``by`` in one partition each, sorted by group and ``order``, for partition-wise steps.

    Groups are dealt by a hash column of their own. A plain repartition by the columns of a join or grouping below is dropped
    from the plan as already done, and adaptive execution may then deal the rows of that join otherwise and cut groups.
    """
    return df.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order)


def whole_groups(batches: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Regroup sorted batches so that no group is cut: ``(frame, offsets of its groups)``.

    At most one group is held back between batches.
    """
    by, rest = list(by), None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if len(pdf) == 0:
            continue
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for c in by:
            values = pdf[c].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(change)
        cut = int(starts[-1])
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True), np.append(starts[:-1], cut)
        rest = pdf.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])
