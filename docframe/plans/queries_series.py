"""Chart-data queries over revenue by region, year and nation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from docframe.operators import series as S
from docframe.plans.registry import query
from docframe.sources.fixtures import Fixtures

_DENSE = """
dense AS (
  SELECT h.chart, h.series_idx, h.series, g.idx, p.value
  FROM (SELECT chart, series_idx, max(series) AS series, greatest(max(idx), 7) AS last FROM chart_points GROUP BY 1, 2) h,
       LATERAL (SELECT unnest(range(0, h.last + 1)) AS idx) g
  LEFT JOIN chart_points p ON p.chart = h.chart AND p.series_idx = h.series_idx AND p.idx = g.idx)
"""


@query("densify_series", "SELECT * FROM dense", _DENSE)
def _densify(f: Fixtures):
    points = f.chart_points()
    declared = points.select("chart", "series_idx").distinct().withColumn("n", F.lit(8))
    return S.densify_series(points, declared)


_MONTHLY = """
monthly AS (SELECT p_brand AS chart, p_partkey AS series_idx, p_name AS series,
    CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS BIGINT) AS idx, CAST(sum(l_quantity) AS DOUBLE) AS value
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
"""


@query(
    "densify_monthly",
    """SELECT h.chart, h.series_idx, h.series, g.idx, m.value
       FROM (SELECT chart, series_idx, series, max(idx) AS last FROM monthly GROUP BY ALL) h, LATERAL (SELECT unnest(range(0, h.last + 1)) AS idx) g
       LEFT JOIN monthly m ON m.series_idx = h.series_idx AND m.idx = g.idx""",
    _MONTHLY,
)
def _densify_monthly(f: Fixtures):
    """Quantities by part and month; most parts sell in some months only, so most series have inner gaps."""
    sold = f.t("lineitem").groupBy(
        F.col("l_partkey").alias("p_partkey"), ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("long").alias("idx")
    ).agg(F.sum("l_quantity").cast("double").alias("value"))
    points = sold.join(f.t("part"), "p_partkey").select(
        F.col("p_brand").alias("chart"), F.col("p_partkey").alias("series_idx"), F.col("p_name").alias("series"), "idx", "value"
    )
    return S.densify_series(points)


_NAMED = "named AS (SELECT DISTINCT chart, idx, category FROM chart_points WHERE chart < 'B')"


@query(
    "category_names",
    """SELECT chart, CAST(idx AS BIGINT) AS idx, category FROM named
       UNION ALL SELECT c.chart, g.idx, CAST(g.idx + 1 AS VARCHAR)
       FROM (SELECT chart, max(idx) AS last FROM chart_points WHERE chart >= 'B' GROUP BY chart) c, LATERAL (SELECT unnest(range(0, c.last + 1)) AS idx) g""",
    _NAMED,
)
def _category_names(f: Fixtures):
    """The charts of three regions name their years, those of the others name nothing."""
    points = f.chart_points()
    return S.category_names(points, points.filter("chart < 'B'").select("chart", "idx", "category").distinct())


_STATUSES = ["F", "O", "P"]


def _status_points(f: Fixtures):
    return f.t("orders").groupBy(
        F.col("o_orderpriority").alias("chart"),
        (F.year("o_orderdate") - 1995).alias("idx"),
        F.year("o_orderdate").cast("string").alias("category"),
        F.col("o_orderstatus").alias("series"),
    ).agg(F.count(F.lit(1)).alias("value"))


_STATUS_SQL = """status AS (SELECT o_orderpriority AS chart, CAST(year(o_orderdate) - 1995 AS INTEGER) AS idx,
  CAST(year(o_orderdate) AS VARCHAR) AS category, o_orderstatus AS series, count(*) AS value FROM orders GROUP BY 1, 2, 3, 4)"""


@query(
    "pivot_series",
    """SELECT chart, idx, category, max(value) FILTER (WHERE series = 'F') AS "F", max(value) FILTER (WHERE series = 'O') AS "O",
              max(value) FILTER (WHERE series = 'P') AS "P" FROM status GROUP BY 1, 2, 3""",
    _STATUS_SQL,
)
def _pivot(f: Fixtures):
    return S.pivot_series(_status_points(f), _STATUSES)


@query(
    "unpivot_series",
    """SELECT c.chart, c.idx, c.category, s.series, v.value FROM (SELECT DISTINCT chart, idx, category FROM status) c
       CROSS JOIN (VALUES ('F'), ('O'), ('P')) s(series)
       LEFT JOIN status v ON v.chart = c.chart AND v.idx = c.idx AND v.series = s.series""",
    _STATUS_SQL,
)
def _unpivot(f: Fixtures):
    return S.unpivot_series(S.pivot_series(_status_points(f), _STATUSES), _STATUSES)


_STACK_COLS = "chart, idx, series_idx, round(stack_from, 4) AS stack_from, round(stack_to, 4) AS stack_to"


def _rounded(df):
    return df.select(
        "chart", "idx", "series_idx", F.round("stack_from", 4).alias("stack_from"), F.round("stack_to", 4).alias("stack_to")
    )


_RUN = "PARTITION BY chart, idx ORDER BY series_idx ROWS UNBOUNDED PRECEDING"


@query(
    "stack_bars",
    f"""SELECT {_STACK_COLS} FROM (SELECT *, CASE WHEN value >= 0
          THEN sum(CASE WHEN value >= 0 THEN value END) OVER ({_RUN}) ELSE sum(CASE WHEN value < 0 THEN value END) OVER ({_RUN}) END AS stack_to,
          stack_to - value AS stack_from FROM chart_points)""",
)
def _stack(f: Fixtures):
    return _rounded(S.stack(f.chart_points(), "stacked"))


@query(
    "stack_percent",
    f"""SELECT {_STACK_COLS} FROM (SELECT *, CASE WHEN v >= 0
          THEN sum(CASE WHEN v >= 0 THEN v END) OVER ({_RUN}) ELSE sum(CASE WHEN v < 0 THEN v END) OVER ({_RUN}) END AS stack_to,
          stack_to - v AS stack_from
        FROM (SELECT *, value / sum(abs(value)) OVER (PARTITION BY chart, idx) * 100 AS v FROM chart_points))""",
)
def _stack_percent(f: Fixtures):
    return _rounded(S.stack(f.chart_points(), "percentStacked"))


@query(
    "stack_lines",
    f"""SELECT chart, idx, series_idx, 0.0::DOUBLE AS stack_from, round(sum(value) OVER ({_RUN}), 4) AS stack_to FROM chart_points""",
)
def _stack_lines(f: Fixtures):
    return _rounded(S.stack(f.chart_points(), "stacked", bars=False))


_CAT = "cat AS (SELECT chart, idx, sum(CASE WHEN value >= 0 THEN value ELSE 0 END) AS up, sum(CASE WHEN value < 0 THEN value ELSE 0 END) AS down FROM chart_points GROUP BY 1, 2)"


@query(
    "value_domain",
    """SELECT 'clustered' AS mode, chart, round(least(0, min(value)), 2) AS "min", round(greatest(0, max(value)), 2) AS "max" FROM chart_points GROUP BY chart
       UNION ALL SELECT 'stacked', chart, round(least(0, min(down)), 2), round(greatest(0, max(up)), 2) FROM cat GROUP BY chart
       UNION ALL SELECT 'percentStacked', chart, round(least(0, min(down / (up - down) * 100)), 2), round(greatest(0, max(up / (up - down) * 100)), 2)
       FROM cat GROUP BY chart""",
    _CAT,
)
def _domain(f: Fixtures):
    parts = [
        S.value_domain(f.chart_points(), mode).select(
            F.lit(mode).alias("mode"), "chart", F.round("min", 2).alias("min"), F.round("max", 2).alias("max")
        )
        for mode in ("clustered", "stacked", "percentStacked")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_GROUPED = """
grouped AS (SELECT *, series_idx % 3 AS grp, CASE WHEN series_idx % 3 = 0 THEN 'stacked' WHEN series_idx % 3 = 2 AND chart > 'B' THEN 'percentStacked'
    WHEN series_idx % 3 = 2 THEN 'stacked' ELSE 'clustered' END AS grouping FROM chart_points),
grouped_cat AS (SELECT chart, grp, grouping, idx, min(value) AS lo, max(value) AS hi, sum(CASE WHEN value >= 0 THEN value ELSE 0 END) AS up,
    sum(CASE WHEN value < 0 THEN value ELSE 0 END) AS down FROM grouped GROUP BY ALL),
whole_chart AS (SELECT chart, least(0, min(CASE grouping WHEN 'clustered' THEN lo WHEN 'stacked' THEN down ELSE down / (up - down) * 100 END)) AS lo,
    greatest(0, max(CASE grouping WHEN 'clustered' THEN hi WHEN 'stacked' THEN up ELSE up / (up - down) * 100 END)) AS hi,
    bool_or(grouping = 'percentStacked') AS percent FROM grouped_cat GROUP BY chart)
"""


def _groups(f: Fixtures):
    """Nations dealt to stacked columns, a line and areas; the areas of two regions are stacked to 100 percent."""
    points = f.chart_points().withColumn("grp", F.col("series_idx") % 3)
    grouping = F.when(F.col("grp") == 0, "stacked").when(F.col("grp") == 1, "clustered")
    grouping = grouping.when(F.col("chart") > "B", "percentStacked").otherwise("stacked")
    return points, points.select("chart", "grp", grouping.alias("grouping")).distinct()


@query(
    "chart_domain",
    """SELECT chart, round(lo, 2) AS "min", round(hi, 2) AS "max", percent FROM whole_chart""",
    _GROUPED,
)
def _chart_domain(f: Fixtures):
    return S.chart_domain(*_groups(f)).select("chart", F.round("min", 2).alias("min"), F.round("max", 2).alias("max"), "percent")


@query(
    "chart_scale",
    """SELECT chart, CASE WHEN percent THEN 0 ELSE floor(lo / step) * step END AS "min", CASE WHEN percent THEN 100 ELSE ceil(hi / step) * step END AS "max",
              CASE WHEN percent THEN 20 ELSE step END AS step, CASE WHEN percent THEN 6 ELSE CAST(ceil(hi / step) - floor(lo / step) + 1 AS BIGINT) END AS n_ticks
       FROM (SELECT *, CASE WHEN r / m > 5 THEN 10 WHEN r / m > 2 THEN 5 WHEN r / m > 1 THEN 2 ELSE 1 END * m AS step
             FROM (SELECT *, (hi - lo) / 5 AS r, pow(10.0, floor(log10((hi - lo) / 5))) AS m FROM whole_chart))""",
    _GROUPED,
)
def _chart_scale(f: Fixtures):
    return S.chart_scale(*_groups(f)).select(
        "chart", "scale.min", "scale.max", "scale.step", F.size("scale.ticks").cast("long").alias("n_ticks")
    )


@query(
    "x_domain",
    """SELECT chart, round(least(0, coalesce(min(x), 0)), 4) AS "min", round(coalesce(max(x), max(c_custkey) + 1), 4) AS "max" FROM (
         SELECT c_mktsegment AS chart, c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' AND c_acctbal <> 0 THEN CAST(c_acctbal AS DOUBLE) END AS x FROM customer) GROUP BY chart""",
)
def _x_domain(f: Fixtures):
    """Customers as points of a scatter chart per segment; one segment gives no x values."""
    x = F.when((F.col("c_mktsegment") != "BUILDING") & (F.col("c_acctbal") != 0), F.col("c_acctbal").cast("double"))
    points = f.t("customer").select(F.col("c_mktsegment").alias("chart"), F.col("c_custkey").alias("idx"), x.alias("x"))
    return S.x_domain(points).select("chart", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"))


_NICE = """
bounds AS (SELECT chart, least(0, min(value)) AS lo, greatest(0, max(value)) AS hi FROM chart_points GROUP BY chart),
rough AS (SELECT *, (hi - lo) / 5 AS r FROM bounds),
stepped AS (SELECT *, pow(10.0, floor(log10(r))) AS m, CASE WHEN r / m > 5 THEN 10 WHEN r / m > 2 THEN 5 WHEN r / m > 1 THEN 2 ELSE 1 END * m AS step FROM rough)
"""


@query(
    "nice_scale",
    """SELECT chart, floor(lo / step) * step AS "min", ceil(hi / step) * step AS "max", step,
              CAST(ceil(hi / step) - floor(lo / step) + 1 AS BIGINT) AS n_ticks FROM stepped""",
    _NICE,
)
def _nice(f: Fixtures):
    domain = S.value_domain(f.chart_points())
    return domain.select("chart", S.nice_scale("min", "max").alias("s")).select(
        "chart", "s.min", "s.max", "s.step", F.size("s.ticks").cast("long").alias("n_ticks")
    )


@query(
    "axis_position",
    """SELECT chart, series_idx, idx, round((value - floor(lo / step) * step) / (ceil(hi / step) * step - floor(lo / step) * step), 6) AS pos
       FROM chart_points JOIN stepped USING (chart)""",
    _NICE,
)
def _position(f: Fixtures):
    placed = S.with_scale(f.chart_points(), S.value_domain(f.chart_points()))
    return placed.select("chart", "series_idx", "idx", F.round("pos", 6).alias("pos"))


_PIE = "pie AS (SELECT chart, CAST(series_idx AS BIGINT) AS idx, sum(value) AS value FROM chart_points GROUP BY 1, 2)"


@query(
    "shares",
    f"""SELECT chart, idx, round(v / t, 6) AS share, round({math.pi!r} * ((30.0 - 90.0) / 180 + 2 * (run - v) / t), 5) AS angle_from,
               round({math.pi!r} * ((30.0 - 90.0) / 180 + 2 * run / t), 5) AS angle_to, concat(CAST(floor(v / t * 100 + 0.5) AS BIGINT), '%') AS label
        FROM (SELECT *, sum(v) OVER (PARTITION BY chart) AS t, sum(v) OVER (PARTITION BY chart ORDER BY idx) AS run
              FROM (SELECT chart, idx, greatest(0, value) AS v FROM pie)) WHERE t > 0 AND v > 0""",
    _PIE,
)
def _shares(f: Fixtures):
    pie = f.chart_points().groupBy("chart", F.col("series_idx").cast("long").alias("idx")).agg(F.sum("value").alias("value"))
    return S.shares(pie, 30.0).select(
        "chart", "idx", F.round("share", 6).alias("share"), F.round("angle_from", 5).alias("angle_from"),
        F.round("angle_to", 5).alias("angle_to"), "label",
    )


@query("sample_every", "SELECT chart, series, idx, category, round(value, 2) AS value FROM chart_points WHERE idx % 3 = 0")
def _sample(f: Fixtures):
    return S.sample_every(f.chart_points(), 3).select("chart", "series", "idx", "category", F.round("value", 2).alias("value"))


@query(
    "revenue_percent_stack",
    f"""SELECT chart, series, idx, round(CASE WHEN value >= 0 THEN sum(CASE WHEN v >= 0 THEN v END) OVER ({_RUN})
          WHEN value < 0 THEN sum(CASE WHEN v < 0 THEN v END) OVER ({_RUN}) END, 4) AS stack_to
        FROM (SELECT *, value / sum(abs(value)) OVER (PARTITION BY chart, idx) * 100 AS v FROM dense)""",
    _DENSE.replace("greatest(max(idx), 7)", "max(idx)"),
)
def _headline(f: Fixtures):
    """Revenue by nation and year: densified, then stacked to 100 percent."""
    dense = S.densify_series(f.chart_points())
    return S.stack(dense, "percentStacked").select("chart", "series", "idx", F.round("stack_to", 4).alias("stack_to"))
