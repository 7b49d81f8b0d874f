import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow import labels as L
from curbflow.functions.columns import cut, hour_window, null_safe_join, rate_change
from curbflow.functions.quantiles import exact_quantiles
from curbflow.functions.scores import BOUNDS, guarded_minmax, with_bounds


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(7)
    rows = []
    # one group holds most of the rows; values span sub-second and equal cells
    for key, n in (("hot", 5000), ("few", 3), ("one", 1), (None, 40)):
        values = rng.integers(0, 240 * 60_000_000, n)
        values[: n // 3] = values[0] + rng.integers(0, 50, n // 3)
        rows += [(key, int(v)) for v in values]
    rows += [("empty", None)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = {
        r.k: (r.p50, r.p90, r.p0, r.p100)
        for r in exact_quantiles(
            df, ["k"], "v", {"p50": 0.5, "p90": 0.9, "p0": 0.0, "p100": 1.0}
        ).collect()
    }
    assert set(got) == {"hot", "few", "one", None}
    for key, result in got.items():
        values = np.array([v for k, v in rows if k == key], dtype=float)
        assert result == pytest.approx(tuple(np.quantile(values, [0.5, 0.9, 0.0, 1.0])))


def test_quantile_plan_has_no_group_buffer(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    plan = exact_quantiles(df, ["k"], "v", {"q": 0.9})._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list" not in plan


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame(
        [(x,) for x in (0.0, 0.5, 2.0, 2.1, 8.0, 8.1, None)], "v double"
    )
    assert [r[0] for r in df.select(cut("v", L.DISTANCE_CUTS)).collect()] == [
        None, "short", "short", "medium", "medium", "long", None,
    ]
    hours = spark.createDataFrame([(h,) for h in (0, 5, 6, 9, 10, 14, 16, 20, 23)], "h int")
    names = [r[0] for r in hours.select(cut("h", L.DASHBOARD_WINDOW_CUTS)).collect()]
    assert [L.DASHBOARD_WINDOW_CUTS[1].index(n) for n in names] == [0, 0, 1, 1, 2, 3, 3, 4, 5]


def test_hour_window_wraps_and_handles_null(spark):
    df = spark.createDataFrame([(22,), (8,), (None,)], "h int")
    assert [r[0] for r in df.select(hour_window("h")).collect()] == [
        "22:00-02:00", "08:00-12:00", L.NO_HOUR,
    ]


def test_rate_change_guards_zero(spark):
    df = spark.createDataFrame([(3.0, 2.0), (3.0, 0.0), (3.0, None)], "post double, pre double")
    assert [r[0] for r in df.select(rate_change("post", "pre")).collect()] == [0.5, None, None]


def test_null_keys_join_null_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, y int")
    rows = {r.x: r.y for r in null_safe_join(left, right, ["k"]).collect()}
    assert rows == {1: 10, 2: 20}


@pytest.mark.parametrize(
    "values, expected",
    [([1.0, 3.0, 2.0], [0.0, 1.0, 0.5]), ([4.0, 4.0], [0.5, 0.5]), ([0.0, 0.0], [0.0, 0.0])],
)
def test_guarded_minmax(spark, values, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    scored = with_bounds(df, {"m": F.col("v")}).withColumn("s", guarded_minmax(F.col("v"), "m"))
    assert [r.s for r in scored.drop(BOUNDS).orderBy("i").collect()] == expected
