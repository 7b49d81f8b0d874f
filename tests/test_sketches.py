import numpy as np

from curbflow.operators import marts, sketches


def trips(spark, n=60_000, hot=0.6):
    """Response times of a few zones and days; most trips are of one zone."""
    pick = np.random.default_rng(1)
    zone = np.where(pick.random(n) < hot, 0, pick.integers(1, 5, n))
    value = pick.gamma(2.0, 4.0, n).round(2)
    rows = zip(
        [f"Z{z}" if z < 4 else None for z in zone.tolist()], pick.integers(0, 6, n).tolist(),
        pick.integers(0, 3, n).tolist(), [None if k % 11 == 0 else v for k, v in enumerate(value.tolist())],
        zone.tolist(), pick.integers(0, 40, n).tolist(), range(n),
    )
    return spark.createDataFrame(
        list(rows),
        "pickup_zone string, d int, trip_hour int, response_time_min double, "
        "pickup_location_id int, dropoff_location_id int, trip_id long",
    ).selectExpr("* EXCEPT (d)", "date_add(DATE '2024-01-30', d) AS trip_date")


def test_merged_quantiles_are_within_the_rank_error_at_every_grain(spark):
    dwd = trips(spark)
    stored = sketches.response_sketches(dwd).cache()
    assert stored.count() <= 5 * 6 * 3
    for keys in (["pickup_zone", "hour"], ["pickup_zone"], ["trip_date"], []):
        merged = sketches.merged_responses(stored, keys)
        rows = marts.answered(dwd)
        if keys:
            errors = sketches.rank_errors(rows, merged, keys, "response_time_min", sketches.QUANTILES)
            found = errors.collect()
            assert len(found) == merged.count()
            assert all(r[n] <= sketches.RANK_ERROR for r in found for n in sketches.QUANTILES)
        else:
            r = merged.first()
            values = np.array([x.response_time_min for x in rows.collect()])
            assert r.order_count == len(values)
            assert abs(r.avg_response_time_min - values.mean()) < 1e-9
            assert abs(r.slow_response_rate - (values > 10).mean()) < 1e-12
            assert abs((values < r.p90_response_time_min).mean() - 0.9) <= sketches.RANK_ERROR


def test_rank_error_tells_a_wrong_estimate(spark):
    rows = spark.createDataFrame([(1, float(x)) for x in range(100)], "g int, v double")
    wrong = spark.createDataFrame([(1, 70.0)], "g int, m double")
    (row,) = sketches.rank_errors(rows, wrong, ["g"], "v", {"m": 0.5}).collect()
    assert abs(row.m - 0.2) < 1e-12


def test_equal_values_have_no_rank_error(spark):
    rows = spark.createDataFrame([(None, 5.0)] * 100, "g int, v double")
    same = spark.createDataFrame([(None, 5.0)], "g int, m double")
    assert sketches.rank_errors(rows, same, ["g"], "v", {"m": 0.9}).first().m == 0


def test_distinct_counts_of_days_merge(spark):
    dwd = trips(spark)
    days = sketches.distinct_sketches(dwd)
    for keys in ([], ["trip_date"]):
        exact = {tuple(r[: len(keys)]): r for r in sketches.exact_distincts(dwd, *keys).collect()}
        merged = sketches.merged_distincts(days, *keys).collect()
        assert len(merged) == len(exact)
        for r in merged:
            want = exact[tuple(r[: len(keys)])]
            for n in sketches.COUNTED:
                assert abs(r[n] - want[n]) <= sketches.DISTINCT_ERROR * want[n]


def test_empty_tables(spark):
    none = trips(spark, 10).limit(0)
    assert sketches.merged_responses(sketches.response_sketches(none), ["pickup_zone"]).count() == 0
    assert sketches.merged_distincts(sketches.distinct_sketches(none), "trip_date").count() == 0
