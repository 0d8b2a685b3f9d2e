"""Chart ranges over several groups, on small literals."""

from docframe.operators import series as S


def test_groups_share_one_range(spark):
    points = spark.createDataFrame(
        [("a", 0, 0, 4.0), ("a", 0, 0, 6.0), ("a", 0, 1, -3.0), ("a", 1, 0, 9.0), ("a", 1, 1, None), ("b", 0, 0, 5.0), ("b", 1, 0, 30.0),
         ("b", 1, 0, -10.0), ("c", 0, 0, None), ("d", 0, 0, float("nan")), ("d", 0, 1, 2.0)],
        "chart string, grp int, idx int, value double",
    )
    groups = spark.createDataFrame(
        [("a", 0, "stacked"), ("a", 1, "clustered"), ("b", 0, "clustered"), ("b", 1, "percentStacked"), ("c", 0, "percentStacked")],
        "chart string, grp int, grouping string",
    )
    got = {r.chart: tuple(r)[1:] for r in S.chart_domain(points, groups).collect()}
    assert got == {"a": (-3.0, 10.0, False), "b": (-25.0, 75.0, True), "c": (0.0, 0.0, True), "d": (0.0, 2.0, False)}
    scales = {r.chart: r.scale for r in S.chart_scale(points, groups).collect()}
    assert scales["b"].ticks == [0, 20, 40, 60, 80, 100] and (scales["a"].min, scales["a"].max, scales["a"].step) == (-5, 10, 5)
    assert S.chart_domain(points.limit(0), groups).count() == 0


def test_x_range_and_names(spark):
    points = spark.createDataFrame([("a", 0, 3.0), ("a", 1, 8.0), ("b", 0, None), ("b", 3, None), ("c", 0, -2.0)], "chart string, idx int, x double")
    assert {r.chart: (r["min"], r["max"]) for r in S.x_domain(points).collect()} == {"a": (0, 8), "b": (0, 4), "c": (-2, -2)}
    names = spark.createDataFrame([("a", 0, "north"), ("a", 1, "south")], "chart string, idx int, category string")
    got = sorted(tuple(r) for r in S.category_names(points, names).collect())
    assert got == [("a", 0, "north"), ("a", 1, "south"), *[("b", i, str(i + 1)) for i in range(4)], ("c", 0, "1")]


def test_inner_gaps_become_nulls(spark):
    points = spark.createDataFrame([("a", 0, "", 1, 5.0), ("a", 0, "", 4, float("inf"))], "chart string, series_idx int, series string, idx int, value double")
    got = sorted((r.idx, r.series, r.value) for r in S.densify_series(points).collect())
    assert got == [(0, "Series 1", None), (1, "Series 1", 5.0), (2, "Series 1", None), (3, "Series 1", None), (4, "Series 1", None)]
