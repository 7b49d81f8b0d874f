import datetime as dt

import pytest
from pyspark.sql import functions as F

from curbflow.operators import cleaning, features, marts, quality
from curbflow.sources import adapters
from curbflow.spec import NYC_CONGESTION_PRICING, TripRules, load_spec

RAW = (
    "request_datetime timestamp_ntz, on_scene_datetime timestamp_ntz, "
    "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, PULocationID int, "
    "DOLocationID int, trip_miles double, base_passenger_fare double, driver_pay double, "
    "tolls double, tips double, shared_match_flag string, wav_request_flag string, "
    "source_trip_id bigint"
)
T0 = dt.datetime(2025, 1, 5, 8, 0)


def trip(i, minutes=10.0, miles=1.0, fare=5.0, pu=1, do=2, start=T0, scene=2.0, pay=4.0):
    end = None if minutes is None else start + dt.timedelta(minutes=minutes)
    there = None if scene is None else start - dt.timedelta(minutes=5 - scene)
    return (
        start - dt.timedelta(minutes=5), there, start, end, pu, do, miles, fare, pay, 0.0, 0.0,
        "N", "N", i,
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, RAW)


def reasons(spark, rows):
    out = cleaning.standard_trips(frame(spark, rows), cleaning.RIDE_HAILING)
    # rows keep their order within one small partition
    return [r.invalid_reason for r in out.collect()]


def test_first_matching_rule_wins(spark):
    rows = [
        trip(0),
        trip(1, minutes=None, miles=0.0),
        trip(2, minutes=0.0, miles=0.0),
        trip(3, minutes=481.0, miles=300.0),
        trip(4, minutes=480.0),
        trip(5, miles=0.01),
        trip(6, miles=None),
        trip(7, miles=200.0),
        trip(8, miles=200.5, do=None),
        trip(9, do=None, fare=-1.0),
        trip(10, fare=-0.5),
        trip(11, fare=1000.5),
        trip(12, fare=None),
    ]
    assert reasons(spark, rows) == [
        None, "missing_time", "non_positive_duration", "duration_over_8h", None,
        "non_positive_distance", "non_positive_distance", None, "distance_over_200",
        "missing_zone", "negative_fare", "total_amount_over_1000", None,
    ]


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    rows = [trip(0, miles=nan), trip(1, fare=nan)]
    assert reasons(spark, rows) == ["non_positive_distance", None]
    assert cleaning.policy_trips(frame(spark, rows), cleaning.RIDE_HAILING).count() == 0


def test_weekday_starts_on_monday_and_durations_keep_fractions(spark):
    sunday = dt.datetime(2025, 1, 5, 23, 59, 59, 500000)
    out = cleaning.standard_trips(
        frame(spark, [trip(0, minutes=0.005, start=sunday), trip(1, start=T0 + dt.timedelta(1))]),
        cleaning.RIDE_HAILING,
    ).collect()
    assert [r.pickup_weekday for r in out] == [6, 0]
    assert out[0].trip_duration_min == pytest.approx(0.005)
    assert out[0].is_valid_trip


def test_policy_bounds_are_inclusive(spark):
    rows = [
        trip(0, minutes=1.0), trip(1, minutes=0.99), trip(2, minutes=480.0),
        trip(3, minutes=480.01), trip(4, miles=0.01), trip(5, miles=200.0), trip(6, fare=0.0),
        trip(7, fare=-0.01),
    ]
    kept = cleaning.policy_trips(frame(spark, rows), cleaning.RIDE_HAILING)
    assert sorted(r.source_trip_id for r in kept.collect()) == [0, 2, 4, 5, 6]


def test_response_proxies_drop_impossible_values(spark):
    rows = [trip(0, scene=0.0), trip(1, scene=-1.0), trip(2, scene=240.0),
            trip(3, scene=240.1), trip(4, scene=None), trip(5, scene=10.0), trip(6, scene=10.1)]
    out = {
        r.source_trip_id: r
        for r in cleaning.policy_trips(frame(spark, rows), cleaning.RIDE_HAILING).collect()
    }
    assert out[0].response_time_min == 0.0
    assert out[1].response_time_min is None and out[3].response_time_min is None
    assert out[2].response_time_min == 240.0
    assert [out[i].slow_response_flag for i in (4, 5, 6)] == [False, False, True]


def test_missing_columns_default(spark):
    raw = frame(spark, [trip(0)])
    row = cleaning.policy_trips(raw, cleaning.RIDE_HAILING).first()
    assert row.cbd_congestion_fee == 0.0 and row.airport_fee == 0.0
    text = raw.withColumn("base_passenger_fare", F.lit("not a number"))
    assert cleaning.standard_trips(text, cleaning.RIDE_HAILING).first().fare_amount is None


def test_policy_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "raw")
    frame(spark, [trip(0), trip(1, miles=500.0)]).write.parquet(path)
    trips = cleaning.policy_trips(spark.read.parquet(path), cleaning.RIDE_HAILING)
    plan = trips.select("trip_miles")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(trip_miles,0.01)" in pushed
    assert "LessThanOrEqual(trip_miles,200.0)" in pushed
    assert "tolls" not in pushed
    assert trips.count() == 1


def test_union_of_services_and_reason_partition(chain):
    total = chain.standard_all.count()
    valid = chain.standard_all.where("is_valid_trip").count()
    bad = marts.invalid_reason_summary(chain.standard_all).agg(F.sum("record_count")).first()[0]
    assert valid + bad == total


def test_unknown_zone_and_floors(spark):
    zones = spark.createDataFrame(
        [(1, "NATION_0", "A"), (20, "NATION_20", "B")], "zone_id int, zone_name string, borough string"
    )
    rows = [trip(0, pu=1, do=99, fare=0.0, miles=0.01, minutes=1.0), trip(1, pu=20, do=1)]
    trips = cleaning.policy_trips(frame(spark, rows), cleaning.RIDE_HAILING)
    out = {
        r.source_trip_id: r
        for r in features.policy_features(trips, zones, adapters.ADAPTER_SPEC).collect()
    }
    assert out[0].dropoff_zone_group == "other" and out[0].dropoff_zone_name is None
    assert out[0].is_cross_treated_trip and not out[0].is_airport_trip
    assert out[0].driver_pay_to_fare_ratio == pytest.approx(4.0 / 0.01)
    assert out[1].is_airport_trip


def test_profile_and_strict_filter(spark):
    raw = frame(spark, [trip(0), trip(1, minutes=None), trip(2, miles=0.0), trip(3, pay=-1.0)])
    row = quality.quality_profile(raw, cleaning.RIDE_HAILING).first()
    assert (row.sample_rows, row.null_dropoff_time, row.non_positive_distance) == (4, 1, 1)
    assert row.negative_total_or_pay == 1
    assert cleaning.strict_filter(raw).count() == 1


def test_spec_file(tmp_path):
    path = tmp_path / "policy.yaml"
    path.write_text(
        "policy:\n  start_date: '2025-02-01'\n  event_window_weeks_before: 3\n"
        "zone_groups:\n  treated_zones: [A, B]\nairport_zone_names: [C]\n"
        "quality_rules:\n  max_trip_hours: 4\n"
    )
    spec = load_spec(str(path))
    assert spec.start_iso == "2025-02-01" and spec.weeks_before == 3
    assert spec.zone_groups == {"treated_zones": ("A", "B")}
    assert spec.rules == TripRules(max_trip_hours=4)
    assert len(NYC_CONGESTION_PRICING.zone_groups["treated_zones"]) == 18
