"""Chart-data operators: dense series, pivots, stacking, value ranges, axis scales and shares.

Points are ``chart, series_idx, series, idx, category, value`` (``idx`` counts categories from 0).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions.js import js_round, let
from docframe.plans.scan import attach, bucket_of, explode_span, ordered_scan


def finite(c: Column | str) -> Column:
    """The value, or null when it is not a finite number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def densify_series(points: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """One row per series and index ``0..n-1`` with null gaps: ``chart, series_idx, series, idx, value``.

    ``n`` is the larger of the declared count (``chart, series_idx, n``) and the last index + 1.
    A series without a name is called ``Series <n>``.
    """
    heads = points.groupBy("chart", "series_idx").agg(
        F.max("idx").alias("last"), F.max("series").alias("series")
    )
    if declared is not None:
        heads = heads.join(declared, ["chart", "series_idx"], "full_outer").withColumn(
            "last", F.greatest("last", F.col("n") - 1)
        )
    name = F.coalesce(F.nullif("series", F.lit("")), F.concat(F.lit("Series "), (F.col("series_idx") + 1).cast("string")))
    grid = explode_span(
        heads.select("chart", "series_idx", name.alias("series"), F.lit(0).alias("zero"), "last"), "zero", "last", "idx"
    ).select("chart", "series_idx", "series", "idx")
    values = points.select("chart", "series_idx", F.col("idx").cast("long").alias("idx"), finite("value").alias("value"))
    return grid.join(values, ["chart", "series_idx", "idx"], "left")


def category_names(points: DataFrame, categories: DataFrame) -> DataFrame:
    """``chart, idx, category``: given names, or 1, 2, 3 … for charts that name none."""
    named = categories.select("chart").distinct()
    lengths = points.groupBy("chart").agg(F.max("idx").alias("last")).join(named, "chart", "left_anti")
    counted = explode_span(lengths.withColumn("zero", F.lit(0)), "zero", "last", "idx").select(
        "chart", "idx", (F.col("idx") + 1).cast("string").alias("category")
    )
    return categories.select("chart", F.col("idx").cast("long").alias("idx"), "category").unionByName(counted)


def pivot_series(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """Category rows by series columns; the series names are given, so nothing is collected."""
    return points.groupBy("chart", "idx", "category").pivot("series", list(names)).agg(F.first("value"))


def unpivot_series(grid: DataFrame, names: Sequence[str]) -> DataFrame:
    """Back from one column per series to one row per point; gaps stay null."""
    return grid.unpivot(["chart", "idx", "category"], list(names), "series", "value")


def stack(points: DataFrame, mode: str = "stacked", bars: bool = True) -> DataFrame:
    """Adds ``stack_from, stack_to`` per point, accumulated in series order within a category.

    ``mode``: ``clustered``, ``stacked`` or ``percentStacked``. Bars accumulate positive and
    negative values apart; lines and areas accumulate jointly.
    """
    if mode == "clustered":
        return points.withColumn("stack_from", F.when(F.col("value").isNotNull(), F.lit(0.0))).withColumn("stack_to", F.col("value"))
    v = F.col("value")
    up = F.when(v >= 0, v) if bars else v
    # Percentages are a constant factor within a category, so one scan of the raw values is enough.
    scanned = ordered_scan(
        points, ["chart", "idx"], ["series_idx"], bucket_of("series_idx"),
        running={"__up": up, "__down": F.when(v < 0, v)}, total={"__abs": F.abs(v)},
    )
    factor = F.lit(1.0)
    if mode == "percentStacked":
        factor = F.lit(100.0) / F.when(F.col("__abs") == 0, F.lit(1.0)).otherwise(F.col("__abs"))
    end = F.when(v >= 0, F.col("__up")).otherwise(F.col("__down")) if bars else F.col("__up")
    end = F.when(v.isNotNull(), end * factor)
    base = end - v * factor if bars else F.when(v.isNotNull(), F.lit(0.0))
    return scanned.withColumn("stack_to", end).withColumn("stack_from", base).drop("__up", "__down", "__abs")


def value_domain(points: DataFrame, mode: str = "clustered") -> DataFrame:
    """``chart, min, max``, always including 0; stacked modes use category totals per sign."""
    v = F.coalesce("value", F.lit(0.0))
    if mode == "clustered":
        return points.groupBy("chart").agg(
            F.least(F.lit(0.0), F.min("value")).alias("min"), F.greatest(F.lit(0.0), F.max("value")).alias("max")
        )
    per_cat = points.groupBy("chart", "idx").agg(
        F.sum(F.when(v >= 0, v).otherwise(0.0)).alias("up"), F.sum(F.when(v < 0, v).otherwise(0.0)).alias("down")
    )
    if mode == "percentStacked":
        whole = F.col("up") - F.col("down")
        whole = F.when(whole == 0, F.lit(1.0)).otherwise(whole)
        per_cat = per_cat.select("chart", "idx", (F.col("up") / whole * 100).alias("up"), (F.col("down") / whole * 100).alias("down"))
    return per_cat.groupBy("chart").agg(
        F.least(F.lit(0.0), F.min("down")).alias("min"), F.greatest(F.lit(0.0), F.max("up")).alias("max")
    )


def chart_domain(points: DataFrame, groups: DataFrame) -> DataFrame:
    """``chart, min, max, percent`` over all groups of a chart, e.g. stacked columns under a line.

    ``points`` also name their group (``chart, grp, idx, value``); ``groups`` holds ``chart, grp, grouping``
    (``clustered``, ``stacked`` or ``percentStacked``; a group that is not listed is clustered). Every group
    is measured by its own grouping and the chart takes the widest range, always with 0. ``percent`` is true
    if any group is stacked to 100 percent.
    """
    v = finite("value")
    per_cat = points.groupBy("chart", "grp", "idx").agg(
        F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.sum(F.when(v >= 0, v).otherwise(0.0)).alias("up"), F.sum(F.when(v < 0, v).otherwise(0.0)).alias("down"),
    )
    whole = F.when(F.col("up") > F.col("down"), F.col("up") - F.col("down")).otherwise(1.0)
    percent, stacked = F.col("grouping") == "percentStacked", F.col("grouping") == "stacked"
    known = groups.select("chart", "grp", "grouping").distinct()
    low = F.when(percent, F.col("down") / whole * 100).when(stacked, F.col("down")).otherwise(F.col("lo"))
    high = F.when(percent, F.col("up") / whole * 100).when(stacked, F.col("up")).otherwise(F.col("hi"))
    return (
        per_cat.join(known, ["chart", "grp"], "left")
        .groupBy("chart")
        .agg(
            F.least(F.lit(0.0), F.min(low)).alias("min"), F.greatest(F.lit(0.0), F.max(high)).alias("max"),
            F.coalesce(F.bool_or(percent), F.lit(False)).alias("percent"),
        )
    )


def chart_scale(points: DataFrame, groups: DataFrame, ticks: int = 5) -> DataFrame:
    """``chart, scale`` of a chart's value axis: the fixed one for percentages, else a round one."""
    domain = chart_domain(points, groups)
    return domain.select("chart", F.when(F.col("percent"), percent_scale()).otherwise(nice_scale("min", "max", ticks)).alias("scale"))


def x_domain(points: DataFrame, x: str = "x") -> DataFrame:
    """Scatter range per chart: x values with 0 included below, or ``0..n`` when there is none."""
    agg = points.groupBy("chart").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), (F.max("idx") + 1).alias("n"))
    return agg.select(
        "chart",
        F.when(F.col("lo").isNull(), F.lit(0.0)).otherwise(F.least(F.lit(0.0), "lo")).alias("min"),
        F.when(F.col("hi").isNull(), F.col("n").cast("double")).otherwise(F.col("hi")).alias("max"),
    )


def nice_scale(low: Column | str, high: Column | str, ticks: Column | int = 5) -> Column:
    """``struct(min, max, step, ticks array<double>)`` with a step of 1, 2, 5 or 10 times 10^k."""
    low = F.col(low) if isinstance(low, str) else low
    high = F.col(high) if isinstance(high, str) else high
    ticks = F.lit(ticks) if isinstance(ticks, int) else ticks
    flat = low == high
    lo = F.when(flat & (low > 0), F.lit(0.0)).otherwise(low).cast("double")
    hi = F.when(flat & (low == 0), F.lit(1.0)).when(flat & (low < 0), F.lit(0.0)).otherwise(high).cast("double")

    def build(s: Column) -> Column:
        rough = (s["hi"] - s["lo"]) / ticks
        # log10 can land just below a whole power; rounding the last bits keeps 1000 at 10^3.
        magnitude = F.pow(F.lit(10.0), F.floor(F.round(F.log10(rough), 12)))
        residual = F.round(rough / magnitude, 12)
        factor = F.when(residual > 5, 10.0).when(residual > 2, 5.0).when(residual > 1, 2.0).otherwise(1.0)
        return let(
            F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), (factor * magnitude).alias("step")),
            lambda t: F.struct(
                (F.floor(F.round(t["lo"] / t["step"], 9)) * t["step"]).alias("min"),
                (F.ceil(F.round(t["hi"] / t["step"], 9)) * t["step"]).alias("max"),
                t["step"].alias("step"),
                F.transform(
                    F.sequence(
                        F.floor(F.round(t["lo"] / t["step"], 9)).cast("int"), F.ceil(F.round(t["hi"] / t["step"], 9)).cast("int")
                    ),
                    lambda i: i * t["step"],
                ).alias("ticks"),
            ),
        )

    return let(F.struct(lo.alias("lo"), hi.alias("hi")), build)


def percent_scale() -> Column:
    """The fixed scale of percent-stacked charts."""
    return F.struct(
        F.lit(0.0).alias("min"), F.lit(100.0).alias("max"), F.lit(20.0).alias("step"),
        F.array(*[F.lit(float(v)) for v in range(0, 101, 20)]).alias("ticks"),
    )


def rescale(value: Column, low: Column, high: Column) -> Column:
    """Position of ``value`` on ``low..high`` as 0..1."""
    return (value - low) / (high - low)


def shares(points: DataFrame, first_angle: float = 0.0) -> DataFrame:
    """Pie shares per chart in ``idx`` order: adds ``share, angle_from, angle_to, label``.

    Negative and missing values count as 0; zero slices and charts without a total give no row.
    Angles are radians, starting at ``first_angle`` degrees from the top.
    """
    v = F.greatest(F.lit(0.0), F.coalesce("value", F.lit(0.0)))
    scanned = ordered_scan(
        points.withColumn("__v", v), ["chart"], ["idx"], bucket_of("idx"),
        before={"__b": F.col("__v")}, total={"__t": F.col("__v")},
    ).filter((F.col("__t") > 0) & (F.col("__v") > 0))
    start = F.lit((first_angle - 90.0) * math.pi / 180.0)
    turn = F.lit(2 * math.pi)
    return (
        scanned.withColumn("share", F.col("__v") / F.col("__t"))
        .withColumn("angle_from", start + F.col("__b") / F.col("__t") * turn)
        .withColumn("angle_to", start + (F.col("__b") + F.col("__v")) / F.col("__t") * turn)
        .withColumn("label", F.concat(js_round(F.col("share") * 100).cast("string"), F.lit("%")))
        .drop("__v", "__b", "__t")
    )


def sample_every(points: DataFrame, step: int | Column) -> DataFrame:
    """Every ``step``-th category, starting with the first."""
    step = F.greatest(F.lit(1), F.lit(step) if isinstance(step, int) else step)
    return points.filter(F.col("idx") % step == 0)


def with_scale(points: DataFrame, domain: DataFrame, ticks: int = 5) -> DataFrame:
    """Position every value on its chart's axis: adds ``pos``."""
    scale = domain.select("chart", nice_scale("min", "max", ticks).alias("s")).select(
        "chart", F.col("s.min").alias("__lo"), F.col("s.max").alias("__hi")
    )
    return attach(points, scale, ["chart"], bucket_of("idx")).withColumn(
        "pos", rescale(F.col("value"), F.col("__lo"), F.col("__hi"))
    ).drop("__lo", "__hi")
