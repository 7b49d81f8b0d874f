import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow import labels as L
from curbflow.operators import causal, compare, forecast, timeseries
from curbflow.spec import PolicySpec

SPEC = PolicySpec("p", dt.date(2025, 1, 5), {}, (), weeks_before=8, weeks_after=12)
PANEL = (
    "zone_id int, zone_name string, zone_group string, trip_date date, hour int, weekday int, "
    "is_weekend boolean, post_policy boolean, order_count bigint"
)


def cell(zone, day, hour, orders, group="treated_zones", name="z"):
    date = SPEC.start_date + dt.timedelta(days=day)
    return (
        zone, name, group, date, hour, date.weekday(), date.weekday() >= 5,
        date >= SPEC.start_date, orders,
    )


def test_pre_post_fills_and_keeps_null_keys(spark):
    df = spark.createDataFrame(
        [("a", False, 2.0), ("a", False, 4.0), ("b", True, 6.0), (None, True, None)],
        "k string, post_policy boolean, x double",
    )
    rows = {r.k: r for r in compare.pre_post(df, ["k"], means={"x": "x"}, counts=["n"]).collect()}
    assert (rows["a"].n_pre, rows["a"].n_post, rows["a"].x_pre, rows["a"].x_post) == (2, 0, 3.0, 0.0)
    assert (rows["b"].n_pre, rows["b"].x_post) == (0, 6.0)
    assert (rows[None].n_post, rows[None].x_post) == (1, 0.0)


def test_heterogeneity_covers_every_trip_in_each_dimension(chain):
    total = chain.features.count()
    rows = compare.heterogeneity(chain.features).groupBy("dimension").agg(
        F.sum("pre_order_count") + F.sum("post_order_count")
    )
    assert {r[0]: r[1] for r in rows.collect()} == dict.fromkeys(
        ["hour_group", "day_type", "distance_group", "pickup_zone_group", "airport_flag"], total
    )


def test_panel_totals_equal_trip_totals(chain):
    row = chain.panel.agg(
        F.sum("order_count"), F.sum("valid_response_count"),
        F.sum(F.col("short_trip_count") + F.col("medium_trip_count") + F.col("long_trip_count")),
    ).first()
    trips = chain.features.agg(F.count(F.lit(1)), F.count("response_time_min")).first()
    assert row[0] == trips[0] == row[2] and row[1] == trips[1]


def test_shares_sum_to_one_hundred(chain):
    monthly = timeseries.monthly_group_share(chain.panel).groupBy("month").agg(
        F.sum("monthly_share").alias("s")
    )
    assert all(r.s == pytest.approx(100) for r in monthly.collect())
    weekly = timeseries.weekday_window_share(chain.panel).collect()
    assert len(weekly) == 7
    assert all(
        sum(r[f"share_{i}"] for i in range(6)) == pytest.approx(100) or
        sum(r[f"share_{i}"] for i in range(6)) == 0
        for r in weekly
    )


def test_service_efficiency_needs_its_fields(spark):
    with pytest.raises(ValueError, match="response_time_p90"):
        compare.service_efficiency(spark.createDataFrame([], PANEL))


def test_lags_count_rows_not_hours(spark):
    rows = [cell(1, 0, 3, 5), cell(1, 0, 9, 7), cell(1, 4, 1, 9), cell(2, 0, 0, 1)]
    panel = spark.createDataFrame(rows, PANEL)
    out = timeseries.rolling_means(timeseries.demand_lags(panel, ("a", "b", "c")))
    got = {(r.zone_id, r.trip_date.day, r.hour): r for r in out.collect()}
    last = got[(1, 9, 1)]
    assert (last.a, last.b, last.c) == (7, 7, 7)
    assert last.rolling_3_hour_order_count == 6.0
    assert got[(2, 5, 0)].a is None and got[(2, 5, 0)].rolling_24_hour_order_count is None
    assert forecast.baseline_features(panel).where("zone_id = 2").count() == 0


def test_peak_hour_prefers_the_earlier_hour(spark):
    rows = [cell(1, 0, 9, 5), cell(1, 1, 7, 5), cell(1, 2, 8, 4)]
    got = timeseries.peak_hour(spark.createDataFrame(rows, PANEL), ["zone_id"]).first()
    assert (got.hour, got.peak_orders) == (7, 5)


def test_event_week_floors_and_clips(spark):
    days = [-1, -7, -8, 0, 6, 7, -1000, 1000]
    df = spark.createDataFrame(
        [(SPEC.start_date + dt.timedelta(days=d),) for d in days], "trip_date date"
    )
    week = causal.event_week("trip_date", SPEC.start_date, 8, 12)
    assert [r[0] for r in df.select(week).collect()] == [-1, -1, -2, 0, 0, 1, -8, 12]


def test_event_study_falls_back_to_the_first_week(spark):
    rows = [
        (*cell(1, d, 0, 1, g), y)
        for d, g, y in [
            (0, "treated_zones", 5.0), (0, "control_zones", 2.0),
            (7, "treated_zones", 9.0), (7, "control_zones", 1.0),
            (14, "treated_zones", 4.0),
        ]
    ]
    panel = spark.createDataFrame(rows, PANEL + ", log_order_count double")
    got = {
        r.event_week: r
        for r in causal.event_study(panel, SPEC, ["log_order_count"]).collect()
    }
    assert got[0].estimated_effect == 0.0 and got[1].estimated_effect == 5.0
    assert got[2].estimated_effect is None and got[2].std_error == 0.0
    assert got[1].std_error == pytest.approx(np.std([9, 1], ddof=1) / np.sqrt(2))
    assert got[1].ci_high == pytest.approx(5 + 1.96 * got[1].std_error)


def dense_fit(rows):
    """Textbook least squares with HC1 errors on the full dummy design."""
    zone = np.array([r[0] for r in rows])
    treated = np.array([r[2] == "treated_zones" for r in rows], float)
    hour, weekday = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    post, y = np.array([r[7] for r in rows], float), np.array([r[9] for r in rows])
    columns = [treated * post, post, treated, np.ones(len(rows))]
    for values in (zone, hour, weekday):
        columns += [(values == level).astype(float) for level in np.unique(values)[1:]]
    x = np.stack(columns, axis=1)
    inverse = np.linalg.pinv(x.T @ x, rcond=1e-12)
    beta = inverse @ x.T @ y
    residual = y - x @ beta
    rank = np.linalg.matrix_rank(x)
    meat = (x.T * residual**2) @ x
    cov = inverse @ meat @ inverse * len(y) / (len(y) - rank)
    return beta[0], np.sqrt(cov[0, 0])


def test_did_matches_a_dense_fit(spark):
    rng = np.random.default_rng(3)
    rows = []
    for zone in range(6):
        group = "treated_zones" if zone < 3 else "control_zones"
        for day in range(-14, 14):
            for hour in (7, 8, 18):
                if rng.random() < 0.2:
                    continue
                for _ in range(rng.integers(1, 3)):
                    base = cell(zone, day, hour, 1, group)
                    effect = 0.7 if zone < 3 and day >= 0 else 0.0
                    y = zone + 0.1 * hour + 0.05 * base[5] + effect + rng.normal() * (1 + zone)
                    rows.append((*base, float(y)))
    panel = spark.createDataFrame(rows, PANEL + ", log_order_count double")
    got = causal.did_fixed_effects(panel, ["log_order_count", "absent_metric"]).collect()
    assert len(got) == 1
    coef, error = dense_fit(rows)
    assert got[0].coef_treated_post == pytest.approx(coef, abs=1e-9)
    assert got[0].std_error == pytest.approx(error, rel=1e-9)
    assert got[0].n_observations == len(rows) and got[0].not_identified is None
    half = 1.959963984540054 * error
    assert got[0].confidence_interval_high - coef == pytest.approx(half)


def test_did_skips_thin_metrics(spark):
    rows = [(*cell(z, d, 1, 1, g), 1.0 * z)
            for z, g in ((1, "treated_zones"), (2, "control_zones")) for d in (-1, 1)]
    panel = spark.createDataFrame(rows, PANEL + ", log_order_count double")
    assert causal.did_fixed_effects(panel, ["log_order_count"]).count() == 0


@pytest.mark.parametrize(
    "groups, days, reason",
    [
        (("treated_zones",), (-3, -2, 2, 3), L.DID_COLLINEAR),
        (("control_zones",), (-3, -2, 2, 3), L.DID_NO_VARIATION),
        (("treated_zones", "control_zones"), (-5, -4, -3, -2), L.DID_NO_VARIATION),
    ],
)
def test_did_names_what_it_cannot_identify(spark, groups, days, reason):
    rng = np.random.default_rng(5)
    rows = [
        (*cell(z, d, h, 1, groups[z % len(groups)]), float(rng.normal() + 2 * (d >= 0)))
        for z in range(4) for d in days for h in (1, 7, 9)
    ]
    panel = spark.createDataFrame(rows, PANEL + ", log_order_count double")
    got = causal.did_fixed_effects(panel, ["log_order_count"]).first()
    assert got.not_identified == reason and got.n_observations == len(rows)
    assert got.coef_treated_post is None and got.p_value is None
    assert causal.did_intervals(causal.did_fixed_effects(panel, ["log_order_count"])).count() == 1


def test_chrono_cutoff_is_the_row_quantile(spark):
    days = [0] * 5 + [1] * 3 + [2] * 1 + [3] * 2
    panel = spark.createDataFrame([cell(1, d, i, 1) for i, d in enumerate(days)], PANEL)
    split = forecast.chrono_split(panel)
    cutoff = np.quantile(days, 0.8)
    assert split.where("is_train").count() == sum(d <= cutoff for d in days)


def test_error_metrics(spark):
    rows = [(True, 1, 0.0), (False, 4, 3.0), (False, 0, -1.0), (False, 2, 4.0)]
    df = spark.createDataFrame(rows, "is_train boolean, order_count int, p double").withColumn(
        "trip_date", F.lit(SPEC.start_date)
    )
    row = forecast.error_metrics(forecast.with_errors(df, "order_count", "p")).first()
    y, e = np.array([4, 0, 2.0]), np.array([1.0, 0.0, -2.0])
    assert row.mae == pytest.approx(abs(e).mean())
    assert row.rmse == pytest.approx(np.sqrt((e**2).mean()))
    assert row.mape == pytest.approx((abs(e) / np.maximum(y, 1)).mean())
    assert row.r2_score == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())


def test_training_is_reproducible_and_beats_the_mean(spark):
    rows = [
        cell(z, d, h, 1 + z + (5 if h in (8, 18) else 0))
        for z in range(3) for d in range(-20, 10) for h in (2, 8, 13, 18)
    ]
    wide = spark.createDataFrame(rows, PANEL)
    for name in ("avg_trip_miles", "avg_fare_per_mile", "avg_driver_pay_per_minute",
                 "avg_response_time_min"):
        wide = wide.withColumn(name, F.lit(1.0))
    forest = forecast.ForestSettings(trees=5, max_depth=5)
    first = forecast.forecast_metrics(
        forecast.fit_forecast(wide, "random_forest", forest), "rf"
    ).first()
    again = forecast.forecast_metrics(
        forecast.fit_forecast(wide, "random_forest", forest), "rf"
    ).first()
    assert first == again and first.r2_score > 0.5
    boost = forecast.BoostSettings(rounds=5, max_depth=3)
    result = forecast.fit_counterfactual(wide, boost)
    assert result.predictions.where("predicted_counterfactual_order_count < 0").count() == 0
    assert result.predictions.count() == 3 * 10 * 4
    assert dict(result.predictions.dtypes)["zone_id"] == "int"
    importance = forecast.fit_forecast(wide, "gradient_boosting", forest, boost).importance
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        forecast.fit_counterfactual(wide.where("post_policy"), boost)
