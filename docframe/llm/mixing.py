"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Method: the mix is to hold ``share`` of all sizes, split by weight; a source's target stops at
``max_epochs`` times its size and the excess is shared again by weight among the others. In order of
(cap / weight) the clamped sources are a prefix, so the level is found with running sums over one row per
source. Inside a source every document is taken floor(target / size) times; the rest of the target is
filled by documents in the order of a seeded hash, so the taken size is off by at most half a document.

DataFrame functions only. Per-source order is kept by 4,096 hash ranges: sums per (source, range) are
combined before the shuffle and added up over at most 4,096 rows of a source, and documents are ordered
inside their own range only, so one hot source never meets in one task.

Edge cases: a null source is a source and comes last; null or negative sizes count as 0; documents of
size 0 take nothing; rows equal in id are ordered by size; an empty table gives an empty table; input
columns named ``source_size``, ``target`` or ``taken`` are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
RANGE_DIGITS = 3
"""Leading hex digits of the hash that make a range: 16**3 = 4,096 ranges per source."""


def n_words(text: str) -> Column:
    """Number of words; 0 for null."""
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """``__source, source_size, target``: one row per source. Weights repeat over sources in code-point
    order, null last. The windows run over one row per source, already summed."""
    per = sizes.groupBy(F.col(source).alias("__source")).agg(F.sum(size).cast("long").alias("source_size"))
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1
    per = per.withColumn("__w", F.get(cycle, rank % len(weights)))
    per = per.withColumn("__cap", max_epochs * F.col("source_size")).withColumn("__goal", share * F.sum("source_size").over(everything))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__goal") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    open_weight = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    per = per.withColumn("__level", left / open_weight).withColumn("__k", F.row_number().over(order))
    # The first source that stays under its cap sets the level of all that follow.
    level = F.min(F.when(F.col("__cap") > F.col("__level") * F.col("__w"), F.struct("__k", "__level"))).over(everything)
    target = F.least(F.col("__cap"), F.coalesce(level["__level"] * F.col("__w"), F.col("__cap")))
    return per.select("__source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    size: str = "size",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` (of the source) and ``taken`` (size taken, repeats counted).

    ``docs`` is read three times; pass a written table. Equal input gives equal output.
    """
    amount = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    rows = docs.withColumn("__size", amount).withColumn("__source", F.col(source))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    rows = rows.withColumn("__hash", digest).withColumn("__range", F.substring("__hash", 1, RANGE_DIGITS))
    targets = source_targets(rows, "__source", "__size", weights, share, max_epochs)

    ranges = rows.groupBy("__source", "__range").agg(F.sum("__size").alias("__sum"))
    earlier = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("__source", "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    same = bases["__source"].eqNullSafe(targets["__source"])
    bases = bases.join(targets, same).select(bases["__source"].alias("__s"), bases["__range"].alias("__r"), "__base", "source_size", "target")

    inside = Window.partitionBy("__source", "__range").orderBy("__hash", F.col(doc_id), "__size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.drop("source_size", "target", "taken").withColumn("__before", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    rows = rows.join(bases, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    extra = (F.col("__base") + F.col("__before")) * 2 + F.col("__size") <= rest * 2
    times = whole + F.when(extra, F.lit(1)).otherwise(F.lit(0))
    drop = [c for c in ("__size", "__source", "__hash", "__range", "__before", "__s", "__r", "__base")]
    return rows.withColumn("taken", (times * F.col("__size")).cast("long")).drop(*drop)


def mix_sql(weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> str:
    """The same mix over ``documents`` as SQL for DuckDB, by repeated clamping."""
    values = ", ".join(str(float(w)) for w in weights)
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([{values}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}) + 1]::DOUBLE AS w,
         ({max_epochs} * sum(size))::DOUBLE AS cap
  FROM sized GROUP BY source),
goal AS (SELECT ({share} * sum(source_size))::DOUBLE AS total FROM per),
rounds AS (
  SELECT 0 AS round, (SELECT total FROM goal) / (SELECT sum(w) FROM per) AS level
  UNION ALL
  SELECT round + 1, ((SELECT total FROM goal) - coalesce((SELECT sum(cap) FROM per WHERE cap <= level * w), 0.0))
                    / (SELECT sum(w) FROM per WHERE cap > level * w)
  FROM rounds WHERE round < (SELECT count(*) FROM per) AND (SELECT count(*) FROM per WHERE cap > level * w) > 0),
targets AS (SELECT source, source_size, least(cap, w * (SELECT max(level) FROM rounds)) AS target FROM per),
placed AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END
        + CASE WHEN before * 2 + size <= 2 * (target - CASE WHEN source_size > 0 THEN floor(target / source_size) * source_size ELSE 0 END)
               THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed"""
