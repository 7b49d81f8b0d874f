"""Every query by name: its plan over the given tables and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow import labels as L
from curbflow.functions.columns import cut_rank, hour_window, null_safe_join
from curbflow.operators import (
    boosting, causal, cleaning, compare, features, forecast, incremental, marts, panels, quality,
    recommend, reports, sketches, timeseries,
)
from curbflow.plans import oracle
from curbflow.plans.canonical import canonical, canonical_sql
from curbflow.plans.pipeline import Chain
from curbflow.session import materialize, scratch_path, use_utc
from curbflow.sinks import upsert, warehouse, writers
from curbflow.sources import adapters, inventory, readers, sampling
from curbflow.streaming import hourly


@dataclass(frozen=True)
class Job:
    """What a query may use: the chain, and the session and folder for file jobs."""

    spark: SparkSession
    folder: str
    chain: Chain


@dataclass(frozen=True)
class Query:
    plan: Callable[[Job], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(plan: Callable[[Job], DataFrame]):
        QUERIES[name] = Query(plan, sql)
        return plan

    return add


def simple(name: str, sql: str | None, plan: Callable[[Chain], DataFrame]) -> None:
    QUERIES[name] = Query(lambda job: plan(job.chain), sql)


def _once(chain: Chain, name: str, make: Callable):
    """What ``make`` returns, kept with the chain."""
    kept = chain.__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


# --- cleaning and quality -------------------------------------------------------

simple("clean_trips_standard", "SELECT * FROM std_hv", lambda c: c.standard)
simple("clean_trips_yellow", "SELECT * FROM std_yellow", lambda c: c.standard_yellow)
simple(
    "clean_trips_union",
    "SELECT service_type, is_valid_trip, pickup_month, count(*) AS trips, "
    "sum(fare_amount) AS fare_sum, count(driver_pay) AS paid_trips FROM std_all GROUP BY ALL",
    lambda c: c.standard_all.groupBy("service_type", "is_valid_trip", "pickup_month").agg(
        F.count(F.lit(1)).alias("trips"),
        F.sum("fare_amount").alias("fare_sum"),
        F.count("driver_pay").alias("paid_trips"),
    ),
)
simple(
    "invalid_reason_summary",
    "SELECT service_type, invalid_reason, count(*) AS record_count FROM std_all "
    "WHERE NOT is_valid_trip GROUP BY ALL",
    lambda c: marts.invalid_reason_summary(c.standard_all),
)


def _profile_sql(source: str, service: str, miles: str, fare: str, total: str) -> str:
    minutes = oracle._minutes("pickup_datetime", "dropoff_datetime")
    return f"""
SELECT '{service}' AS service, count(*) AS sample_rows,
  count(*) FILTER (pickup_datetime IS NULL) AS null_pickup_time,
  count(*) FILTER (dropoff_datetime IS NULL) AS null_dropoff_time,
  count(*) FILTER ({minutes} <= 0) AS negative_or_zero_duration,
  count(*) FILTER ({minutes} > 480) AS duration_over_8h,
  count(*) FILTER (pu_zone IS NULL) AS missing_pickup_zone,
  count(*) FILTER (do_zone IS NULL) AS missing_dropoff_zone,
  count(*) FILTER ({miles} <= 0) AS non_positive_distance,
  count(*) FILTER ({miles} > 200) AS distance_over_200,
  count(*) FILTER ({fare} < 0) AS negative_fare,
  count(*) FILTER ({total} < 0) AS negative_total_or_pay FROM {source}"""


simple(
    "quality_profile",
    _profile_sql("raw_hv", "high_volume_fhv", "trip_miles", "base_passenger_fare", "driver_pay"),
    lambda c: quality.quality_profile(c.raw, cleaning.RIDE_HAILING, c.spec.rules),
)
simple(
    "quality_profile_yellow",
    _profile_sql("raw_yellow", "yellow_taxi", "trip_distance", "fare_amount", "total_amount"),
    lambda c: quality.quality_profile(c.raw_taxi, cleaning.YELLOW, c.spec.rules),
)
simple(
    "drop_summary",
    f"""SELECT 'policy trips' AS source_table, raw_count, valid_count,
  raw_count - valid_count AS dropped_count,
  (raw_count - valid_count)::DOUBLE / raw_count AS drop_rate, '{L.DROP_REASON}' AS drop_reason
FROM (SELECT (SELECT count(*) FROM raw_hv) AS raw_count,
  (SELECT count(*) FROM trips) AS valid_count)""",
    lambda c: quality.drop_summary(c.raw, c.trips, "policy trips"),
)


def _observed(job: Job) -> tuple[DataFrame, DataFrame]:
    """Profile and drop summary, counted while the trips are written."""

    def make() -> tuple[DataFrame, DataFrame]:
        c = job.chain
        profiled, profile = quality.profiling(c.raw, cleaning.RIDE_HAILING, c.spec.rules)
        kept, rows = quality.counting(
            cleaning.policy_trips(profiled, cleaning.RIDE_HAILING, c.spec.rules)
        )
        writers.write_parquet(kept, scratch_path(job.spark, "observed-trips"))
        raw_rows = profile.values["sample_rows"]
        return (
            quality.profile_row(job.spark, cleaning.RIDE_HAILING, profile, raw_rows),
            quality.drop_row(job.spark, raw_rows, rows.values["rows"], "policy trips"),
        )

    return _once(job.chain, "observed", make)


QUERIES["quality_profile_observed"] = Query(
    lambda job: _observed(job)[0], QUERIES["quality_profile"].sql
)
QUERIES["drop_summary_observed"] = Query(
    lambda job: _observed(job)[1], QUERIES["drop_summary"].sql
)
simple(
    "policy_trips_filtered",
    "SELECT * FROM trips",
    lambda c: c.trips.drop("response_us"),
)
simple(
    "policy_trips_yellow",
    "SELECT * FROM trips_yellow",
    lambda c: c.trips_yellow.drop(
        "response_us", "request_datetime", "on_scene_datetime", "pickup_wait_proxy_min"
    ),
)
simple(
    "dwd_filter_strict",
    """SELECT source_trip_id, pickup_datetime, trip_miles, base_passenger_fare, driver_pay,
  CASE WHEN CAST(pickup_datetime AS DATE) >= DATE '2024-01-16' THEN '政策后' ELSE '政策前' END
    AS policy_period FROM raw_hv
WHERE trip_miles > 0 AND base_passenger_fare > 0 AND driver_pay >= 0
  AND dropoff_datetime > pickup_datetime""",
    lambda c: cleaning.strict_filter(c.raw).select(
        "source_trip_id", "pickup_datetime", "trip_miles", "base_passenger_fare", "driver_pay",
        F.when(F.to_date("pickup_datetime") >= F.lit(c.spec.start_date), L.POST)
        .otherwise(L.PRE)
        .alias("policy_period"),
    ),
)

# --- trip features --------------------------------------------------------------

simple(
    "trip_policy_features", "SELECT * FROM features", lambda c: c.features.drop("response_us")
)


def _columns(name: str, source: str, plan: Callable[[Chain], DataFrame], columns: list[str]):
    simple(
        name, f"SELECT {', '.join(columns)} FROM {source}", lambda c: plan(c).select(*columns)
    )


_columns(
    "response_proxies", "trips", lambda c: c.trips,
    ["source_trip_id", "response_time_min", "pickup_wait_proxy_min", "slow_response_flag"],
)
_columns(
    "unit_economics", "features", lambda c: c.features,
    ["source_trip_id", "fare_per_mile", "fare_per_minute", "driver_pay_per_mile",
     "driver_pay_per_minute", "tip_rate", "driver_pay_to_fare_ratio", "toll_burden_rate",
     "policy_fee_burden_rate"],
)
_columns(
    "zone_group_flags", "features", lambda c: c.features,
    ["source_trip_id", "pickup_zone_group", "dropoff_zone_group", "is_pickup_treated",
     "is_dropoff_treated", "is_pickup_spillover", "is_dropoff_spillover", "is_pickup_control",
     "is_dropoff_control", "is_cross_treated_trip", "is_airport_trip", "post_policy"],
)
simple("dwd_trip", "SELECT * FROM dwd", lambda c: c.dwd)
_ID_ORDER_SQL = ", ".join(f"{c} NULLS FIRST" for c in features.ID_ORDER)
simple(
    "dwd_trip_ids",
    f"""SELECT * REPLACE (row_number() OVER (ORDER BY {_ID_ORDER_SQL}, trip_id) AS trip_id)
FROM dwd""",
    lambda c: features.numbered_trips(c.dwd),
)
simple(
    "dwd_trip_ids_key",
    """SELECT 'yellow_taxi' AS service_type, count(*) AS trips, count(*) AS ids,
  CASE WHEN count(*) > 0 THEN 1 END AS first_id, nullif(count(*), 0) AS last_id FROM trips_yellow""",
    lambda c: features.numbered_trips(
        features.dwd_trips(features.policy_features(c.trips_yellow, c.zones, c.spec))
    ).agg(
        F.lit("yellow_taxi").alias("service_type"), F.count(F.lit(1)).alias("trips"),
        F.count_distinct("trip_id").alias("ids"), F.min("trip_id").alias("first_id"),
        F.max("trip_id").alias("last_id"),
    ),
)
simple(
    "trip_bins",
    f"""SELECT hour_group, time_window, segment_hour, dashboard_window, distance_group,
  count(*) AS trips FROM (SELECT
  {oracle._cut('trip_hour', *L.MART_HOUR_CUTS)} AS hour_group, {oracle.WINDOWS} AS time_window,
  {oracle._cut('trip_hour', *L.SEGMENT_HOUR_CUTS)} AS segment_hour,
  {oracle._cut('trip_hour', *L.DASHBOARD_WINDOW_CUTS)} AS dashboard_window,
  {oracle._cut('trip_miles', *L.DISTANCE_CUTS)} AS distance_group FROM features) GROUP BY ALL""",
    lambda c: c.features.select(
        compare.cut("trip_hour", L.MART_HOUR_CUTS).alias("hour_group"),
        compare.cut("trip_hour", L.REPORT_WINDOW_CUTS).alias("time_window"),
        compare.cut("trip_hour", L.SEGMENT_HOUR_CUTS).alias("segment_hour"),
        compare.cut("trip_hour", L.DASHBOARD_WINDOW_CUTS).alias("dashboard_window"),
        compare.cut("trip_miles", L.DISTANCE_CUTS).alias("distance_group"),
    )
    .groupBy("hour_group", "time_window", "segment_hour", "dashboard_window", "distance_group")
    .agg(F.count(F.lit(1)).alias("trips")),
)

# --- panels ---------------------------------------------------------------------

simple("zone_hour_panel", "SELECT * FROM panel", lambda c: c.panel)
simple("od_hour_panel", "SELECT * FROM od_panel", lambda c: c.od_panel)


@query(
    "panel_grain_check",
    """SELECT 'zone_hour' AS panel, count(*) AS cells,
  count(*) - count(DISTINCT (zone_id, trip_date, hour)) AS duplicate_keys FROM panel
UNION ALL SELECT 'od_hour', count(*),
  count(*) - count(DISTINCT (pickup_location_id, dropoff_location_id, trip_date, hour))
FROM od_panel""",
)
def _grain(job: Job) -> DataFrame:
    def check(name, panel, keys):
        duplicates = panels.panel_duplicates(panel, keys).agg(F.count(F.lit(1)).alias("n"))
        return panel.agg(F.count(F.lit(1)).alias("cells")).select(
            F.lit(name).alias("panel"), "cells", duplicates.scalar().alias("duplicate_keys")
        )

    c = job.chain
    return check("zone_hour", c.panel, ["zone_id", "trip_date", "hour"]).unionByName(
        check(
            "od_hour", c.od_panel,
            ["pickup_location_id", "dropoff_location_id", "trip_date", "hour"],
        )
    )


simple(
    "panel_preview",
    "SELECT * FROM panel ORDER BY zone_id, trip_date, hour LIMIT 5000",
    lambda c: panels.panel_preview(c.stored_panel, ["zone_id", "trip_date", "hour"]),
)
simple(
    "panel_totals",
    """SELECT post_policy, zone_group, sum(order_count) AS orders,
  sum(short_trip_count + medium_trip_count + long_trip_count) AS by_distance,
  sum(airport_trip_count) AS airport, sum(treated_dropoff_count) AS to_treated
FROM panel GROUP BY ALL""",
    lambda c: c.stored_panel.groupBy("post_policy", "zone_group").agg(
        F.sum("order_count").alias("orders"),
        F.sum(
            F.col("short_trip_count") + F.col("medium_trip_count") + F.col("long_trip_count")
        ).alias("by_distance"),
        F.sum("airport_trip_count").alias("airport"),
        F.sum("treated_dropoff_count").alias("to_treated"),
    ),
)

# --- metric tables --------------------------------------------------------------

simple("hourly_demand", "SELECT * FROM hourly", lambda c: marts.hourly_demand(c.standard_all))
simple(
    "zone_hourly_demand",
    "SELECT * FROM zone_hourly",
    lambda c: marts.zone_hourly_demand(c.standard_all, c.zones),
)
simple(
    "od_flows_top",
    """SELECT * FROM flows ORDER BY trip_count DESC, service_type,
  pickup_location_id NULLS FIRST, dropoff_location_id NULLS FIRST LIMIT 5000""",
    lambda c: marts.top_od_flows(c.standard_all),
)
simple(
    "top_hourly_demand",
    """SELECT * FROM hourly ORDER BY trip_count DESC, service_type, pickup_date, pickup_hour,
  pickup_weekday, pickup_month LIMIT 100""",
    lambda c: marts.top_k(
        marts.hourly_demand(c.standard_all), "trip_count", marts.HOURLY_KEYS, 100
    ),
)
simple(
    "top_zone_hourly_demand",
    """SELECT * FROM zone_hourly ORDER BY trip_count DESC, service_type, pickup_date, pickup_hour,
  pickup_location_id LIMIT 100""",
    lambda c: marts.top_k(
        marts.zone_hourly_demand(c.standard_all, c.zones), "trip_count",
        marts.ZONE_HOURLY_KEYS, 100,
    ),
)
simple(
    "time_demand_metrics",
    "SELECT * FROM time_metrics",
    lambda c: marts.time_demand_metrics(c.dwd),
)
simple(
    "zone_demand_metrics",
    """SELECT p.*, d.* FROM pickup_metrics p FULL JOIN dropoff_counts d
  ON p.pickup_zone IS NOT DISTINCT FROM d.dropoff_zone
  AND p.pickup_borough IS NOT DISTINCT FROM d.dropoff_borough""",
    lambda c: marts.zone_demand_metrics(c.dwd),
)
simple(
    "top_pickup_zones",
    """SELECT * FROM pickup_metrics ORDER BY pickup_order_count DESC, pickup_zone NULLS FIRST,
  pickup_borough NULLS FIRST LIMIT 20""",
    lambda c: marts.top_k(
        marts.pickup_zone_metrics(c.dwd), "pickup_order_count",
        ["pickup_zone", "pickup_borough"], 20,
    ),
)
simple(
    "top_dropoff_zones",
    """SELECT * FROM dropoff_counts ORDER BY dropoff_order_count DESC, dropoff_zone NULLS FIRST,
  dropoff_borough NULLS FIRST LIMIT 20""",
    lambda c: marts.top_k(
        marts.dropoff_zone_counts(c.dwd), "dropoff_order_count",
        ["dropoff_zone", "dropoff_borough"], 20,
    ),
)
ROUTE_ORDER_SQL = (
    "order_count DESC, pickup_zone NULLS FIRST, dropoff_zone NULLS FIRST, "
    "pickup_borough NULLS FIRST, dropoff_borough NULLS FIRST"
)
simple(
    "od_route_metrics", "SELECT * FROM route_metrics", lambda c: marts.od_route_metrics(c.dwd)
)
simple(
    "top_od_routes",
    f"SELECT *, pickup_zone || ' → ' || dropoff_zone AS route FROM route_metrics "
    f"ORDER BY {ROUTE_ORDER_SQL} LIMIT 30",
    lambda c: reports.with_route_label(
        marts.top_k(marts.od_route_metrics(c.dwd), "order_count", marts.ROUTE_KEYS, 30),
        "pickup_zone", "dropoff_zone",
    ),
)
simple(
    "price_driver_metrics",
    "SELECT * FROM price_metrics WHERE trip_distance_group IS NOT NULL AND hour_group IS NOT NULL",
    lambda c: marts.price_driver_metrics(c.dwd),
)
simple(
    "price_driver_by_distance",
    """SELECT CASE WHEN trip_miles <= 2 THEN '短途(0-2英里)' WHEN trip_miles <= 8
    THEN '中途(2-8英里)' ELSE '长途(8+英里)' END AS trip_distance_group, policy_period,
  count(*) AS order_count, avg(fare_per_mile) AS avg_fare_per_mile,
  avg(fare_per_minute) AS avg_fare_per_minute, avg(tolls) AS avg_tolls,
  avg(cbd_congestion_fee) AS avg_cbd_congestion_fee,
  avg(driver_pay_per_mile) AS avg_driver_pay_per_mile,
  avg(driver_pay_per_minute) AS avg_driver_pay_per_minute,
  avg(driver_pay / nullif(base_passenger_fare, 0)) AS driver_pay_to_fare_ratio
FROM dwd GROUP BY ALL""",
    lambda c: marts.price_driver_by_distance(c.dwd),
)
simple("response_metrics", "SELECT * FROM response", lambda c: marts.response_metrics(c.dwd))


def _sketched_responses(c: Chain) -> DataFrame:
    return _once(c, "response_sketches", lambda: materialize(
        sketches.response_sketches(c.dwd), "response-sketches"
    ))


def _approx(c: Chain, keys: list[str]) -> DataFrame:
    """Metrics from stored sketches; instead of the quantiles, whether their ranks among the
    trips are within the stated error."""
    merged = sketches.merged_responses(_sketched_responses(c), keys)
    errors = sketches.rank_errors(
        marts.answered(c.dwd), merged, keys, "response_time_min", sketches.QUANTILES
    )
    within = errors.select(
        *keys,
        *[(F.col(n) <= sketches.RANK_ERROR).alias(f"{n}_within") for n in sketches.QUANTILES],
    )
    exact = merged.drop(*sketches.QUANTILES)
    return null_safe_join(exact, within, keys)


def _approx_sql(keys: str, group: str) -> str:
    return f"""SELECT {keys}, count(*) AS order_count,
  avg(response_time_min) AS avg_response_time_min,
  avg(CASE WHEN response_time_min > 10 THEN 1e0 ELSE 0e0 END) AS slow_response_rate,
  true AS p50_response_time_min_within, true AS p90_response_time_min_within
FROM dwd WHERE response_time_min IS NOT NULL GROUP BY {group}"""


simple(
    "response_metrics_approx",
    _approx_sql("pickup_zone, trip_hour AS hour", "pickup_zone, trip_hour"),
    lambda c: _approx(c, ["pickup_zone", "hour"]),
)
simple(
    "response_metrics_approx_daily",
    _approx_sql("trip_date", "trip_date"),
    lambda c: _approx(c, ["trip_date"]),
)


@query(
    "distinct_counts_sketched",
    """SELECT strftime(trip_date, '%Y-%m') AS month, count(*) AS orders,
  count(DISTINCT pickup_location_id) AS pickup_zones,
  count(DISTINCT CASE WHEN pickup_location_id IS NOT NULL AND dropoff_location_id IS NOT NULL
    THEN (pickup_location_id, dropoff_location_id) END) AS routes,
  count(DISTINCT trip_id) AS trips, true AS pickup_zones_within, true AS routes_within,
  true AS trips_within
FROM dwd GROUP BY GROUPING SETS ((strftime(trip_date, '%Y-%m')), ())""",
)
def _distincts(job: Job) -> DataFrame:
    """Exact distinct ids by month and over all months, and whether the estimates from the
    days' stored sketches are within the stated error of them."""
    dwd = job.chain.dwd
    days = materialize(sketches.distinct_sketches(dwd), "distinct-sketches")
    month = F.date_format("trip_date", "yyyy-MM").alias("month")
    none = F.lit(None).cast("string").alias("month")
    merged = sketches.merged_distincts(days, month).unionByName(
        sketches.merged_distincts(days, none)
    )
    exact = sketches.exact_distincts(dwd, month).unionByName(sketches.exact_distincts(dwd, none))
    names = list(sketches.COUNTED)
    both = null_safe_join(exact, merged.withColumnsRenamed({n: f"_{n}" for n in names}), ["month"])
    return both.select(
        "month", "orders", *names,
        *[
            (F.abs(F.col(f"_{n}") - F.col(n)) <= sketches.DISTINCT_ERROR * F.col(n))
            .alias(f"{n}_within")
            for n in names
        ],
    )


# --- before/after comparisons ---------------------------------------------------

simple(
    "demand_shift",
    f"""SELECT *, order_count_post - order_count_pre AS absolute_change,
  {oracle._rate('order_count')} AS change_rate,
  CASE WHEN zone_group = 'spillover_zones' THEN '{L.INTERPRET_SPILLOVER_SHIFT}'
    ELSE '{L.INTERPRET_OTHER_SHIFT}' END AS business_interpretation FROM (
SELECT pickup_zone_group AS zone_group, {oracle._pre_post(order_count='count(*)')}
FROM features GROUP BY ALL)""",
    lambda c: compare.demand_shift(c.features),
)
simple(
    "daily_orders",
    "SELECT trip_date, post_policy, count(*) AS order_count FROM features GROUP BY ALL",
    lambda c: compare.daily_orders(c.features),
)
simple(
    "hourly_pattern", "SELECT * FROM hour_pattern", lambda c: compare.hourly_pattern(c.features)
)
simple(
    "hourly_pattern_rollup",
    """SELECT hour, sum(order_count_pre) AS order_count_pre,
  sum(order_count_post) AS order_count_post FROM hour_pattern GROUP BY ALL""",
    lambda c: compare.hour_rollup(compare.hourly_pattern(c.features)),
)
simple(
    "time_window_pattern",
    f"""SELECT *, {oracle._rate('order_count')} AS change_rate FROM (
SELECT {oracle.WINDOWS} AS time_window, is_weekend, {oracle._pre_post(order_count='count(*)')}
FROM features GROUP BY ALL)""",
    lambda c: compare.time_window_pattern(c.features),
)
simple("od_flow_change", "SELECT * FROM od_change", lambda c: compare.od_flow_change(c.features))
simple(
    "top_od_pairs",
    """SELECT * FROM od_change ORDER BY orders_post DESC, pickup_zone_name NULLS FIRST,
  dropoff_zone_name NULLS FIRST, is_airport_trip, is_cross_treated_trip LIMIT 50""",
    lambda c: marts.top_k(
        compare.od_flow_change(c.features), "orders_post", compare.OD_CHANGE_KEYS, 50
    ),
)
simple(
    "pricing_pressure",
    f"""SELECT *, coalesce(fare_per_mile_change_rate > 0, false) AND orders_post < orders_pre
    AS passenger_discount_signal, '{L.INTERPRET_PRICE}' AS business_interpretation FROM (
SELECT *, {oracle._rate('fare_per_mile')} AS fare_per_mile_change_rate,
  {oracle._rate('policy_fee_burden')} AS policy_fee_burden_change_rate FROM (
SELECT {oracle._cut('trip_miles', *L.DISTANCE_SEGMENT_CUTS)} AS distance_segment,
  {oracle._pre_post(fare_per_mile='avg(fare_per_mile)',
                    policy_fee_burden='avg(policy_fee_burden_rate)', orders='count(*)')}
FROM features GROUP BY ALL))""",
    lambda c: compare.pricing_pressure(c.features),
)
simple("driver_pressure", "SELECT * FROM pressure", lambda c: compare.driver_pressure(c.features))
simple(
    "top_driver_pressure",
    """SELECT pickup_zone_name || ' → ' || dropoff_zone_name AS route, is_airport_trip,
  driver_pressure_score FROM pressure ORDER BY driver_pressure_score DESC,
  pickup_zone_name NULLS FIRST, dropoff_zone_name NULLS FIRST, is_airport_trip LIMIT 15""",
    lambda c: reports.with_route_label(
        marts.top_k(
            compare.driver_pressure(c.features), "driver_pressure_score",
            ["pickup_zone_name", "dropoff_zone_name", "is_airport_trip"], 15,
        ),
        "pickup_zone_name", "dropoff_zone_name",
    ).select("route", "is_airport_trip", "driver_pressure_score"),
)
_AIRPORT = "CASE " + " ".join(
    f"WHEN contains(coalesce(pickup_zone_name, ''), '{token}') "
    f"OR contains(coalesce(dropoff_zone_name, ''), '{token}') THEN '{label}'"
    for token, label in adapters.ADAPTER_SPEC.airport_labels
) + " ELSE 'Other airport' END"
simple(
    "airport_routes",
    f"""SELECT *, CASE WHEN driver_pay_per_minute_change_rate < 0 OR
    response_time_p90_change_rate > 0 THEN '{L.AIRPORT_ACT}' ELSE '{L.AIRPORT_WATCH}' END
    AS recommended_strategy, '{L.INTERPRET_AIRPORT}' AS business_interpretation FROM (
SELECT *, {oracle._rate('orders')} AS orders_change_rate,
  {oracle._rate('fare_per_mile')} AS fare_per_mile_change_rate,
  {oracle._rate('driver_pay_per_minute')} AS driver_pay_per_minute_change_rate,
  {oracle._rate('response_time_p90')} AS response_time_p90_change_rate FROM (
SELECT {_AIRPORT} AS airport_name, CASE WHEN pickup_zone_group = 'treated_zones'
    OR dropoff_zone_group = 'treated_zones' THEN '{L.AREA_CORE}' ELSE '{L.AREA_OTHER}' END
    AS target_area, {oracle._pre_post(
        orders='count(*)', fare_per_mile='avg(fare_per_mile)',
        driver_pay_per_minute='avg(driver_pay_per_minute)',
        response_time_p90='quantile_cont(response_time_min, 0.9)')}
FROM features WHERE is_airport_trip GROUP BY ALL))""",
    lambda c: compare.airport_routes(c.features, c.spec),
)
simple(
    "response_time_windows",
    "SELECT * FROM windows",
    lambda c: compare.response_time_windows(c.features),
)
simple(
    "service_efficiency",
    "SELECT * FROM efficiency",
    lambda c: compare.service_efficiency(c.stored_panel),
)
simple(
    "service_efficiency_long",
    f"""SELECT zone_group, '{L.PRE}' AS period, response_time_p90_pre AS response_time_p90
FROM efficiency UNION ALL SELECT zone_group, '{L.POST}', response_time_p90_post FROM efficiency""",
    lambda c: compare.efficiency_long(compare.service_efficiency(c.stored_panel)),
)
simple(
    "route_period_metrics",
    """SELECT pickup_zone_name, dropoff_zone_name, is_cross_treated_trip, is_airport_trip,
  post_policy, count(*) AS trip_count, avg(fare_per_mile) AS fare_per_mile,
  avg(fare_per_minute) AS fare_per_minute, avg(driver_pay_per_mile) AS driver_pay_per_mile,
  avg(driver_pay_per_minute) AS driver_pay_per_minute, avg(tolls) AS tolls_per_trip,
  avg(tip_rate) AS tip_rate, avg(driver_pay_to_fare_ratio) AS driver_pay_to_fare_ratio
FROM features WHERE pickup_zone_name IS NOT NULL AND dropoff_zone_name IS NOT NULL GROUP BY ALL""",
    lambda c: compare.route_period_metrics(c.features),
)
simple("pricing_driver_impact", "SELECT * FROM pricing", lambda c: c.pricing)
simple("heterogeneity", "SELECT * FROM segments", lambda c: compare.heterogeneity(c.features))
simple("spillover_ranking", "SELECT * FROM spill", lambda c: c.spillover)
simple(
    "top_spillover_zones",
    """SELECT * FROM spill WHERE zone_group = 'spillover_zones'
ORDER BY spillover_score DESC, zone_id LIMIT 15""",
    lambda c: compare.top_spillover(c.spillover),
)

# --- time series ----------------------------------------------------------------

simple(
    "demand_lags",
    "SELECT zone_id, trip_date, hour, order_count, lag_1, lag_24, lag_7_day FROM lags",
    lambda c: timeseries.demand_lags(c.stored_panel, ("lag_1", "lag_24", "lag_7_day")).select(
        "zone_id", "trip_date", "hour", "order_count", "lag_1", "lag_24", "lag_7_day"
    ),
)
simple(
    "rolling_demand",
    """SELECT zone_id, trip_date, hour, roll3 AS rolling_3_hour_order_count,
  roll24 AS rolling_24_hour_order_count FROM lags""",
    lambda c: timeseries.rolling_means(c.stored_panel).select(
        "zone_id", "trip_date", "hour", "rolling_3_hour_order_count",
        "rolling_24_hour_order_count",
    ),
)
simple(
    "forecast_features",
    "SELECT * EXCLUDE (zone_name, post_policy) FROM fc",
    lambda c: forecast.forecast_features(c.stored_panel).select(
        *forecast.FORECAST_FEATURES, "trip_date", "order_count"
    ),
)
simple(
    "peak_hour",
    "SELECT * FROM peak",
    lambda c: timeseries.peak_hour(
        c.stored_panel.where("post_policy").dropna(subset=compare.ZONE_KEYS), compare.ZONE_KEYS
    ),
)
_GROUP_LABEL = "CASE zone_group " + " ".join(
    f"WHEN '{code}' THEN '{label}'" for code, label in L.ZONE_GROUP_LABELS.items()
) + " ELSE zone_group END"
simple(
    "monthly_group_share",
    f"""SELECT month, {_GROUP_LABEL} AS zone_group, order_count,
  order_count / sum(order_count) OVER (PARTITION BY month) * 100 AS monthly_share FROM (
SELECT strftime(trip_date, '%Y-%m') AS month, zone_group, sum(order_count) AS order_count
FROM panel GROUP BY ALL)""",
    lambda c: timeseries.monthly_group_share(c.stored_panel),
)
_DAY_LABEL = "CASE weekday " + " ".join(
    f"WHEN {i} THEN '{label}'" for i, label in enumerate(L.WEEKDAY_LABELS)
) + " END"
simple(
    "weekday_window_share",
    f"""SELECT weekday, {_DAY_LABEL} AS weekday_label, {', '.join(
        f"coalesce(sum(order_count) FILTER (win = '{name}')::DOUBLE / sum(order_count), 0) * 100"
        f" AS share_{i}" for i, name in enumerate(L.DASHBOARD_WINDOW_CUTS[1]))}
FROM (SELECT d.weekday::INTEGER AS weekday, order_count,
  {oracle._cut('hour', *L.DASHBOARD_WINDOW_CUTS)} AS win
FROM (SELECT unnest(range(7)) AS weekday) d LEFT JOIN panel p ON d.weekday = p.weekday)
GROUP BY weekday""",
    lambda c: timeseries.weekday_window_share(c.stored_panel),
)

# --- causal ---------------------------------------------------------------------

_EVENT = """SELECT greatest(least(floor(date_diff('day', DATE '2024-01-16', trip_date) / 7.0), 2), -2)
  ::INTEGER AS event_week, zone_group, '{m}' AS metric_name, {m}::DOUBLE AS y FROM panel
WHERE zone_group IN ('treated_zones', 'control_zones')"""
_EVENT_SQL = f"""SELECT event_week, metric_name, gap - ref AS estimated_effect, std_error,
  gap - ref - 1.96e0 * std_error AS ci_low, gap - ref + 1.96e0 * std_error AS ci_high,
  gap_std_error FROM (
SELECT *, coalesce(max(gap) FILTER (event_week = -1) OVER (PARTITION BY metric_name),
  first_value(gap) OVER (PARTITION BY metric_name ORDER BY event_week)) AS ref FROM (
SELECT metric_name, event_week,
  avg(y) FILTER (zone_group = 'treated_zones') - avg(y) FILTER (zone_group = 'control_zones')
    AS gap, coalesce(stddev_samp(y) / sqrt(count(y)), 0) AS std_error,
  sqrt(var_samp(y) FILTER (zone_group = 'treated_zones')
      / count(y) FILTER (zone_group = 'treated_zones')
    + var_samp(y) FILTER (zone_group = 'control_zones')
      / count(y) FILTER (zone_group = 'control_zones')) AS gap_std_error
FROM ({' UNION ALL '.join(_EVENT.format(m=m) for m in causal.EVENT_METRICS)})
WHERE y IS NOT NULL GROUP BY ALL))"""
simple("event_study", _EVENT_SQL, lambda c: causal.event_study(c.stored_panel, c.spec))
simple(
    "event_study_demand_series",
    f"SELECT * FROM ({_EVENT_SQL}) WHERE metric_name = 'log_order_count'",
    lambda c: reports.event_series(causal.event_study(c.stored_panel, c.spec), "log_order_count"),
)


def _mean_sql(name: str, group: str, post: str) -> str:
    return f"avg(y) FILTER (zone_group = '{group}' AND {post}) AS {name}"


_DID_ROWS = " UNION ALL ".join(
    f"SELECT '{m}' AS metric_name, zone_id, hour, weekday, zone_group, post_policy, "
    f"{m}::DOUBLE AS y FROM panel WHERE zone_group IN ('treated_zones', 'control_zones') "
    f"AND {m} IS NOT NULL"
    for m in causal.DID_METRICS
)
simple(
    "did_cell_means",
    f"""SELECT *, (treated_post - treated_pre) - (control_post - control_pre) AS unadjusted_effect
FROM (SELECT metric_name, count(*) AS n_observations,
  {_mean_sql('treated_post', 'treated_zones', 'post_policy')},
  {_mean_sql('treated_pre', 'treated_zones', 'NOT post_policy')},
  {_mean_sql('control_post', 'control_zones', 'post_policy')},
  {_mean_sql('control_pre', 'control_zones', 'NOT post_policy')}
FROM ({_DID_ROWS}) GROUP BY metric_name)""",
    lambda c: causal.did_cell_means(c.stored_panel),
)
simple(
    "did_fixed_effects",
    f"""SELECT *, CASE WHEN metric_name = 'log_order_count' THEN '{L.DID_DEMAND}'
  ELSE '{L.DID_OTHER}' END AS business_interpretation,
  CAST(NULL AS VARCHAR) AS not_identified FROM did_fit""",
    lambda c: causal.did_fixed_effects(c.stored_panel),
)
_METRIC_LABEL = "CASE metric_name " + " ".join(
    f"WHEN '{code}' THEN '{label}'" for code, label in L.METRIC_LABELS.items()
) + " ELSE metric_name END"
simple(
    "did_intervals",
    f"""SELECT metric_name, {_METRIC_LABEL} AS metric_label, coef_treated_post,
  1.96e0 * std_error AS error_arm, confidence_interval_high - coef_treated_post AS arm_high,
  coef_treated_post - confidence_interval_low AS arm_low FROM did_fit""",
    lambda c: causal.did_intervals(causal.did_fixed_effects(c.stored_panel)),
)

# --- forecasts ------------------------------------------------------------------

simple(
    "chrono_split_stats",
    """SELECT is_train, count(*) AS row_count, min(trip_date) AS first_date,
  max(trip_date) AS last_date, sum(order_count) AS orders FROM split GROUP BY ALL""",
    lambda c: forecast.split_stats(
        forecast.chrono_split(forecast.forecast_features(c.stored_panel))
    ),
)
simple(
    "forecast_metrics",
    """SELECT avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
  avg(abs(e / greatest(order_count, 1))) AS mape,
  1 - sum(e * e) / (var_pop(order_count) * count(*)) AS r2_score,
  (SELECT min(trip_date) FROM split WHERE is_train) AS train_start_date,
  (SELECT max(trip_date) FROM split WHERE is_train) AS train_end_date,
  min(trip_date) AS test_start_date, max(trip_date) AS test_end_date
FROM (SELECT *, order_count - greatest(lag_1_hour_order_count, 0) AS e FROM split
WHERE NOT is_train)""",
    lambda c: forecast.error_metrics(forecast.naive_forecast(c.stored_panel)),
)
simple(
    "naive_forecast_errors",
    """SELECT trip_date AS date, hour, zone_name AS pickup_zone, order_count AS actual_order_count,
  lag_1_hour_order_count AS predicted_order_count,
  order_count - lag_1_hour_order_count AS prediction_error,
  abs(order_count - lag_1_hour_order_count) AS abs_prediction_error
FROM split WHERE NOT is_train""",
    lambda c: forecast.forecast_predictions(
        forecast.Forecast(forecast.naive_forecast(c.stored_panel), None)
    ),
)


simple(
    "forecast_rf", None, lambda c: forecast.forecast_metrics(c.forest, "random_forest")
)
simple(
    "forecast_gbt", None, lambda c: forecast.forecast_metrics(c.boosted, "gradient_boosting")
)
simple("forecast_predictions", None, lambda c: forecast.forecast_predictions(c.boosted))
simple("feature_importance", None, lambda c: c.boosted.importance)
simple("counterfactual_gap", None, lambda c: c.counterfactual.predictions)
simple("counterfactual_metrics", None, lambda c: c.counterfactual.metrics)
simple(
    "legacy_demand_rf",
    None,
    lambda c: forecast.fit_legacy_demand(marts.zone_hourly_demand(c.standard, c.zones)),
)
simple(
    "legacy_split_stats",
    """SELECT is_train, count(*) AS row_count, sum(trip_count) AS trips, min(pickup_date) AS first_date,
  max(pickup_date) AS last_date FROM (
SELECT *, ('0x' || substr(md5(strftime(pickup_date, '%Y-%m-%d') || '|' || pickup_hour || '|'
  || pickup_location_id || '|42'), 1, 8))::BIGINT % 1000000 >= 200000 AS is_train FROM zone_hourly
WHERE service_type = 'high_volume_fhv' AND pickup_borough IS NOT NULL
  AND pickup_location_id IS NOT NULL) GROUP BY is_train""",
    lambda c: forecast.legacy_split(
        forecast.legacy_features(marts.zone_hourly_demand(c.standard, c.zones))
    )
    .groupBy("is_train")
    .agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("trip_count").alias("trips"),
        F.min("trip_date").alias("first_date"), F.max("trip_date").alias("last_date"),
    ),
)
_STUMPS = boosting.BoostSettings(
    rounds=2, max_depth=1, step=0.5, penalty=1.0, row_share=1.0, column_share=1.0
)


def _stump_sql(round_: int, rows: str, gradient: str) -> str:
    """The best split of hour and weekday over all rows, by trying every one."""
    cells = " UNION ALL ".join(
        f"SELECT {k} AS k, '{f}' AS feature, {f}::DOUBLE AS v, sum({gradient}) AS g, "
        f"count(*) AS n FROM {rows} GROUP BY {f}"
        for k, f in enumerate(("hour", "weekday"))
    )
    return f"""s{round_} AS (
SELECT *, -0.5e0 * gl / (nl + 1) AS left_value, -0.5e0 * (gt - gl) / (nt - nl + 1) AS right_value,
  gl * gl / (nl + 1) + (gt - gl) * (gt - gl) / (nt - nl + 1) - gt * gt / (nt + 1) AS gain FROM (
SELECT k, feature, v, lead(v) OVER w AS nxt, sum(g) OVER w AS gl, sum(n) OVER w AS nl,
  sum(g) OVER (PARTITION BY k) AS gt, sum(n) OVER (PARTITION BY k) AS nt
FROM ({cells}) WINDOW w AS (PARTITION BY k ORDER BY v)) WHERE nxt IS NOT NULL
ORDER BY gain DESC, k, v LIMIT 1)"""


_STUMP_SQL = f"""SELECT * FROM (WITH t AS (SELECT hour, weekday, order_count::DOUBLE AS y,
  avg(order_count) OVER () AS p FROM panel),
{_stump_sql(1, 't', 'p - y')},
t2 AS (SELECT t.* EXCLUDE (p), p + CASE WHEN (CASE feature WHEN 'hour' THEN hour ELSE weekday END) <= v
  THEN left_value ELSE right_value END AS p FROM t, s1),
{_stump_sql(2, 't2', 'p - y')}
SELECT 1 AS round, feature, (v + nxt) / 2 AS split_at, left_value, right_value, gain FROM s1
UNION ALL SELECT 2, feature, (v + nxt) / 2, left_value, right_value, gain FROM s2)"""


def _stumps(c: Chain) -> boosting.Boosted:
    return _once(c, "stumps", lambda: boosting.fit_boosted(
        c.stored_panel, ("hour", "weekday"), "order_count", _STUMPS
    ))


simple(
    "boosted_stumps",
    f"SELECT round, feature, split_at, left_value, right_value FROM ({_STUMP_SQL})",
    lambda c: boosting.splits_table(c.spark, _stumps(c)).select(
        "round", "feature", "split_at", "left_value", "right_value"
    ),
)
simple(
    "boosted_stumps_importance",
    f"""SELECT f.feature, coalesce(sum(gain), 0) / (SELECT sum(gain) FROM ({_STUMP_SQL})) AS importance
FROM (SELECT unnest(['hour', 'weekday']) AS feature) f
LEFT JOIN ({_STUMP_SQL}) s ON s.feature = f.feature GROUP BY f.feature""",
    lambda c: c.spark.createDataFrame(
        list(zip(_stumps(c).features, _stumps(c).importance)), "feature string, importance double"
    ),
)
simple(
    "best_model_dates",
    """SELECT count(*) FILTER (is_train) > 0 AS trained, true AS beats_lag,
  min(trip_date) FILTER (is_train) AS train_start_date,
  max(trip_date) FILTER (is_train) AS train_end_date,
  min(trip_date) FILTER (NOT is_train) AS test_start_date,
  max(trip_date) FILTER (NOT is_train) AS test_end_date FROM split""",
    lambda c: _best(c).select(
        F.col("train_start_date").isNotNull().alias("trained"),
        (F.col("model_name") != "naive_lag_1").alias("beats_lag"),
        "train_start_date", "train_end_date", "test_start_date", "test_end_date",
    ),
)
_HOLDOUT_SQL = """SELECT '{m}' AS model_name, count(*) AS rows,
  avg(abs(order_count - greatest(lag_1_hour_order_count, 0))) AS yardstick_mae,
  true AS better, true AS not_negative FROM split WHERE NOT is_train"""
for _model, _fitted in (("random_forest", "forest"), ("gradient_boosting", "boosted")):
    simple(
        f"{_model}_quality",
        _HOLDOUT_SQL.format(m=_model),
        lambda c, model=_model, fitted=_fitted: forecast.beats_yardstick(
            getattr(c, fitted).scored, ~F.col("is_train"), "order_count", "lag_1_hour_order_count"
        ).select(F.lit(model).alias("model_name"), "*"),
    )
simple(
    "counterfactual_quality",
    """SELECT count(*) AS rows, avg(abs(order_count - greatest(lag_7_day, 0))) AS yardstick_mae,
  true AS better, true AS not_negative FROM lags WHERE lag_1 IS NOT NULL AND NOT post_policy""",
    lambda c: forecast.beats_yardstick(
        c.counterfactual.scored.withColumn("prediction", F.greatest("prediction", F.lit(0.0))),
        ~F.col("post_policy"), "order_count", "lag_7_day", "prediction",
    ),
)
simple("seasonal_naive_gap", "SELECT * FROM gap", lambda c: c.naive_gap)


def _best(chain: Chain) -> DataFrame:
    """Holdout metrics of the naive yardstick, the forest and the boosted trees; the best RMSE."""
    naive = forecast.error_metrics(forecast.naive_forecast(chain.stored_panel)).select(
        F.lit("naive_lag_1").alias("model_name"), "*"
    )
    forest = forecast.forecast_metrics(chain.forest, "random_forest")
    boosted = forecast.forecast_metrics(chain.boosted, "gradient_boosting")
    return forecast.best_model(naive.unionByName(forest).unionByName(boosted))


simple("model_comparison", None, _best)


def _checked(predictions: DataFrame) -> DataFrame:
    """Keys and actuals of predictions, and whether prediction and errors fit together."""
    gap = F.col("actual_order_count") - F.col("predicted_order_count")
    return predictions.select(
        "date",
        "hour",
        "pickup_zone",
        "actual_order_count",
        (F.col("predicted_order_count") >= 0).alias("not_negative"),
        (
            (F.abs(F.col("prediction_error") - gap) < 1e-9)
            & (F.abs(F.col("abs_prediction_error") - F.abs(gap)) < 1e-9)
        ).alias("errors_fit"),
    )


_PREDICTION_KEYS = """SELECT trip_date AS date, hour, zone_name AS pickup_zone,
  order_count AS actual_order_count, true AS not_negative, true AS errors_fit
FROM split WHERE NOT is_train"""
simple(
    "forecast_rf_rows", _PREDICTION_KEYS, lambda c: _checked(forecast.forecast_predictions(c.forest))
)
simple(
    "forecast_gbt_rows",
    _PREDICTION_KEYS,
    lambda c: _checked(forecast.forecast_predictions(c.boosted)),
)
simple(
    "counterfactual_rows",
    """SELECT zone_id, zone_name, date, hour, actual_order_count, true AS not_negative,
  true AS gap_fits FROM gap""",
    lambda c: c.counterfactual.predictions.select(
        "zone_id",
        "zone_name",
        "date",
        "hour",
        "actual_order_count",
        (F.col("predicted_counterfactual_order_count") >= 0).alias("not_negative"),
        (
            F.abs(
                F.col("predicted_counterfactual_order_count")
                - F.col("actual_order_count")
                - F.col("demand_gap")
            )
            < 1e-9
        ).alias("gap_fits"),
    ),
)
simple(
    "feature_importance_sum",
    "SELECT 'gradient_boosting' AS model_name, 14 AS features, true AS adds_up",
    lambda c: c.boosted.importance.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("features"),
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("adds_up"),
    ),
)


# --- scores and recommendations -------------------------------------------------

simple("zone_context", "SELECT * FROM context", lambda c: recommend.zone_context(c.stored_panel))
simple(
    "mean_demand_gap", "SELECT * FROM mean_gap", lambda c: recommend.mean_demand_gap(c.naive_gap)
)
simple("zone_scores", "SELECT * FROM zscores", lambda c: c.zone_scores)
simple("route_scores", "SELECT * FROM rscores", lambda c: c.route_scores)
simple(
    "supply_reallocation",
    f"""SELECT *, '{L.SUPPLY_ACTION}' AS recommended_action,
  {oracle.HOUR_WINDOW} AS target_time_window, '{L.SUPPLY_IMPACT}' AS expected_business_impact
FROM supply""",
    lambda c: recommend.supply_reallocation(c.stored_zone_scores),
)
simple(
    "route_incentives",
    f"""SELECT *, pickup_zone_name || ' -> ' || dropoff_zone_name AS target_od_pair,
  '{L.INCENTIVE_ACTION}' AS recommended_action,
  '{L.INCENTIVE_IMPACT}' AS expected_business_impact FROM incentives""",
    lambda c: recommend.route_incentives(c.stored_route_scores),
)
simple(
    "passenger_discounts",
    f"""SELECT *, '{L.DISCOUNT_ACTION}' AS recommended_action,
  {oracle.HOUR_WINDOW} AS target_time_window, '{L.DISCOUNT_IMPACT}' AS expected_business_impact
FROM discounts""",
    lambda c: recommend.passenger_discounts(c.stored_zone_scores),
)
simple(
    "low_value_supply",
    f"SELECT *, {oracle.HOUR_WINDOW} AS target_time_window FROM weak",
    lambda c: recommend.low_value_supply(c.stored_zone_scores).withColumn(
        "target_time_window", hour_window("hour")
    ),
)
simple(
    "strategy_cards",
    "SELECT * EXCLUDE (evidence_text) FROM cards",
    lambda c: c.cards.drop("evidence_metric"),
)
simple(
    "card_evidence_text",
    "SELECT strategy_id, evidence_text FROM cards",
    lambda c: c.cards.select(
        "strategy_id", recommend.evidence_text("evidence_metric").alias("evidence_text")
    ),
)
simple(
    "card_ranking",
    """SELECT strategy_id, strategy_type, priority, final_action_score,
  CASE priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END AS priority_rank FROM cards
WHERE strategy_type = 'driver_supply_reallocation'""",
    lambda c: recommend.rank_cards(c.cards, "driver_supply_reallocation").select(
        "strategy_id", "strategy_type", "priority", "final_action_score", "priority_rank"
    ),
)
simple(
    "card_counts",
    """SELECT count(*) AS cards, count(*) FILTER (priority = 'High') AS high_priority,
  count(DISTINCT strategy_type) AS strategy_types FROM cards""",
    lambda c: recommend.card_counts(c.cards),
)
simple(
    "policy_cards",
    f"""SELECT coalesce(strategy_id, 'route_' || (row_number() OVER (ORDER BY branch, place)))
    AS strategy_id, * EXCLUDE (branch, place, strategy_id) FROM (
(SELECT 1 AS branch, row_number() OVER (ORDER BY spillover_score DESC, zone_id) AS place,
  'boundary_' || zone_id AS strategy_id, 'boundary_zone_strategy' AS strategy_type,
  zone_name AS target_zone, CAST(NULL AS VARCHAR) AS target_od_pair,
  'Monitor by hour' AS target_time_window, '{L.BOUNDARY_PROBLEM_EN}' AS problem_detected,
  printf('spillover_score=%.3f; post orders=%d', spillover_score, post_order_count::BIGINT)
    AS evidence_metric, '{L.BOUNDARY_ACTION_EN}' AS recommended_action,
  '{L.BOUNDARY_IMPACT_EN}' AS expected_business_impact, 'high' AS priority
FROM spill WHERE zone_group = 'spillover_zones' ORDER BY place LIMIT 3)
UNION ALL (SELECT 2, row_number() OVER (ORDER BY demand_change DESC, pickup_zone_name,
    dropoff_zone_name, is_airport_trip, is_cross_treated_trip) AS place, NULL,
  'route_level_incentive', NULL, pickup_zone_name || ' -> ' || dropoff_zone_name,
  'Policy-period route', '{L.ROUTE_PROBLEM_EN}',
  printf('fare/mile change=%.2f; driver-pay/min change=%.2f', fare_per_mile_change,
    driver_pay_per_minute_change), '{L.ROUTE_ACTION_EN}', '{L.ROUTE_IMPACT_EN}', 'high'
FROM pricing WHERE subsidy_signal ORDER BY place LIMIT 3)
UNION ALL (SELECT 3, 1, 'peak_hour_1', 'peak_hour_operation', 'treated zones', NULL, segment,
  '{L.HOUR_PROBLEM_EN}', printf('relative demand change=%.1f%%', relative_change * 100),
  '{L.HOUR_ACTION_EN}', '{L.HOUR_IMPACT_EN}', 'medium'
FROM segments WHERE dimension = 'hour_group' ORDER BY relative_change, segment LIMIT 1))""",
    lambda c: recommend.policy_cards(
        c.spillover, c.pricing, compare.heterogeneity(c.features)
    ),
)


def _rec_sql(source: str, order: str, kind: str, target: str, evidence: str, wording) -> str:
    return f"""(SELECT '{kind}' AS recommendation_type, {target} AS target_zone_or_route,
  {evidence} AS evidence_metric, '{wording[0]}' AS recommended_action,
  '{wording[1]}' AS business_value, '{wording[2]}' AS confidence_level
FROM {source} ORDER BY {order} LIMIT 4)"""


_ENDS = ROUTE_ORDER_SQL.removeprefix("order_count DESC, ")
_BUSIEST = f"(SELECT * FROM route_metrics ORDER BY {ROUTE_ORDER_SQL} LIMIT 20)"
_ROUTE = "pickup_zone || ' → ' || dropoff_zone"
simple(
    "business_recommendations",
    " UNION ALL ".join(
        [
            _rec_sql(
                "pickup_metrics",
                "avg_response_time_min DESC NULLS LAST, pickup_zone NULLS FIRST, "
                "pickup_borough NULLS FIRST",
                "driver_supply_reallocation", "pickup_zone",
                "'平均响应代理 ' || round(avg_response_time_min, 2)::VARCHAR || ' 分钟'",
                L.REC_SUPPLY,
            ),
            _rec_sql(
                "route_metrics", ROUTE_ORDER_SQL, "route_priority", _ROUTE,
                "'订单量 ' || order_count::VARCHAR", L.REC_ROUTE,
            ),
            _rec_sql(
                _BUSIEST, f"avg_driver_pay_per_minute NULLS LAST, {_ENDS}", "driver_incentive",
                _ROUTE, "'司机每分钟收益 ' || round(avg_driver_pay_per_minute, 2)::VARCHAR",
                L.REC_DRIVER,
            ),
            _rec_sql(
                _BUSIEST, f"avg_fare_per_mile DESC NULLS LAST, {_ENDS}", "passenger_discount",
                _ROUTE, "'每英里票价 ' || round(avg_fare_per_mile, 2)::VARCHAR", L.REC_DISCOUNT,
            ),
        ]
    ),
    lambda c: recommend.business_recommendations(
        marts.pickup_zone_metrics(c.dwd), marts.od_route_metrics(c.dwd)
    ),
)

# --- report datasets ------------------------------------------------------------

simple(
    "daily_totals",
    "SELECT date, sum(order_count) AS order_count FROM time_metrics GROUP BY ALL",
    lambda c: reports.daily_totals(marts.time_demand_metrics(c.dwd)),
)
simple(
    "hourly_totals",
    "SELECT hour, sum(order_count) AS order_count FROM time_metrics GROUP BY ALL",
    lambda c: reports.hourly_totals(marts.time_demand_metrics(c.dwd)),
)
simple(
    "weekday_totals",
    f"""SELECT weekday, {_DAY_LABEL} AS weekday_label, order_count FROM (
SELECT d.weekday::INTEGER AS weekday, coalesce(sum(order_count), 0) AS order_count
FROM (SELECT unnest(range(7)) AS weekday) d LEFT JOIN time_metrics t ON d.weekday = t.weekday
GROUP BY d.weekday)""",
    lambda c: reports.weekday_totals(marts.time_demand_metrics(c.dwd)),
)
simple(
    "price_group_means",
    """SELECT 'fare_per_mile' AS series, trip_distance_group AS segment,
  avg(avg_fare_per_mile) AS mean_value FROM price_metrics GROUP BY ALL
UNION ALL SELECT 'driver_pay_per_minute', hour_group, avg(avg_driver_pay_per_minute)
FROM price_metrics GROUP BY ALL
UNION ALL SELECT 'response_time', hour::VARCHAR, avg(avg_response_time_min)
FROM response GROUP BY ALL""",
    lambda c: reports.price_group_means(
        marts.price_driver_metrics(c.dwd), marts.response_metrics(c.dwd)
    ),
)
_KPI_SQL = """SELECT sum(trip_count) AS total_trips, sum(fare_sum) / sum(trip_count) AS avg_fare,
  sum(distance_sum) / sum(trip_count) AS avg_distance,
  sum(duration_sum) / sum(trip_count) AS avg_duration,
  (SELECT pickup_hour FROM hourly GROUP BY pickup_hour
   ORDER BY sum(trip_count) DESC, pickup_hour LIMIT 1) AS peak_hour,
  (SELECT pickup_weekday FROM hourly GROUP BY pickup_weekday
   ORDER BY sum(trip_count) DESC, pickup_weekday LIMIT 1) AS peak_weekday,
  (SELECT pickup_borough FROM zone_hourly WHERE pickup_borough IS NOT NULL
   GROUP BY pickup_borough ORDER BY sum(trip_count) DESC, pickup_borough LIMIT 1) AS top_borough
FROM hourly"""


def _kpis(c: Chain) -> DataFrame:
    return reports.executive_kpis(marts.calendar_demand(c.standard_all, c.zones))


simple("executive_kpis", _KPI_SQL, _kpis)
simple(
    "executive_kpi_text",
    f"""SELECT format('{{:,}}', total_trips::BIGINT) AS total_trips,
  '$' || format('{{:,.2f}}', avg_fare) AS avg_fare, format('{{:,.2f}}', avg_distance)
  AS avg_distance, format('{{:,.1f}}', avg_duration) AS avg_duration, top_borough
FROM ({_KPI_SQL})""",
    lambda c: reports.kpi_text(_kpis(c)),
)
simple(
    "top_zones_exec",
    """SELECT pickup_borough, pickup_zone, sum(trip_count) AS trip_count FROM zone_hourly
GROUP BY ALL ORDER BY trip_count DESC, pickup_borough NULLS FIRST, pickup_zone NULLS FIRST
LIMIT 10""",
    lambda c: reports.executive_top_zones(marts.zone_hourly_demand(c.standard_all, c.zones)),
)
simple(
    "top_od_exec",
    """SELECT * FROM flows ORDER BY trip_count DESC, service_type, pickup_location_id NULLS FIRST,
  dropoff_location_id NULLS FIRST LIMIT 10""",
    lambda c: marts.top_od_flows(c.standard_all, 10),
)
simple(
    "zone_group_response",
    f"""SELECT {_GROUP_LABEL} AS zone_group, CASE WHEN post_policy THEN '{L.POST}'
    ELSE '{L.PRE}' END AS policy_period, response_time_p90, valid_response_count FROM (
SELECT zone_group, post_policy, avg(response_time_p90) AS response_time_p90,
  sum(valid_response_count) AS valid_response_count FROM panel GROUP BY ALL)
WHERE valid_response_count > 0""",
    lambda c: reports.zone_group_response(c.stored_panel),
)
simple(
    "response_group_chart",
    """SELECT zone_group, avg(response_time_p90_pre) AS response_time_p90_pre,
  avg(response_time_p90_post) AS response_time_p90_post, CASE zone_group
  WHEN 'control_zones' THEN '对照区' WHEN 'other' THEN '其他区域'
  WHEN 'spillover_zones' THEN '外溢区' ELSE '收费核心区' END AS zone_label
FROM windows GROUP BY zone_group""",
    lambda c: compare.response_group_chart(compare.response_time_windows(c.features)),
)
simple(
    "demand_gap_ranking",
    """SELECT zone_id, zone_name, avg(demand_gap) AS mean_demand_gap,
  avg(demand_gap_rate) AS mean_demand_gap_rate, sum(actual_order_count) AS actual_orders
FROM gap WHERE zone_name IS NOT NULL GROUP BY ALL ORDER BY mean_demand_gap DESC, zone_id LIMIT 15""",
    lambda c: reports.demand_gap_ranking(c.naive_gap),
)
_DAILY_SQL = """SELECT date, sum(actual_order_count)::DOUBLE AS actual_order_count,
  sum(predicted_counterfactual_order_count) AS predicted_counterfactual_order_count
FROM gap GROUP BY date"""
simple("actual_vs_predicted", _DAILY_SQL, lambda c: reports.actual_vs_predicted(c.naive_gap))
simple(
    "actual_vs_predicted_long",
    f"""SELECT date, 'actual_order_count' AS series, actual_order_count AS orders
FROM ({_DAILY_SQL}) UNION ALL SELECT date, 'predicted_counterfactual_order_count',
  predicted_counterfactual_order_count FROM ({_DAILY_SQL})""",
    lambda c: reports.actual_vs_predicted_long(c.naive_gap),
)
simple(
    "pay_change_histogram",
    """SELECT bin, lo + bin * w AS bin_start, lo + (bin + 1) * w AS bin_end, count(*) AS routes
FROM (SELECT *, least(floor((v - lo) / w), 29)::INTEGER AS bin FROM (
SELECT v, min(v) OVER () AS lo, (max(v) OVER () - min(v) OVER ()) / 30 AS w FROM (
SELECT driver_pay_per_minute_change_rate AS v FROM pressure
WHERE driver_pay_per_minute_change_rate IS NOT NULL))) GROUP BY bin, lo, w""",
    lambda c: reports.pay_change_histogram(compare.driver_pressure(c.features)),
)
simple(
    "report_estimates",
    """SELECT 'did' AS section, metric_name AS name, coef_treated_post AS value, p_value FROM did_fit
UNION ALL SELECT 'model', 'naive_lag_1', sqrt(avg((order_count
  - greatest(lag_1_hour_order_count, 0)) ** 2)), NULL FROM split WHERE NOT is_train""",
    lambda c: reports.report_estimates(
        causal.did_fixed_effects(c.stored_panel),
        forecast.error_metrics(forecast.naive_forecast(c.stored_panel)).withColumn(
            "model_name", F.lit("naive_lag_1")
        ),
    ),
)
simple(
    "report_scalars",
    f"""SELECT (SELECT count(*) FROM raw_hv) AS raw_count, (SELECT count(*) FROM trips)
    AS valid_count,
  1 - (SELECT count(*) FROM trips)::DOUBLE / (SELECT count(*) FROM raw_hv) AS drop_rate,
  (SELECT pickup_zone FROM pickup_metrics ORDER BY pickup_order_count DESC,
   pickup_zone NULLS FIRST LIMIT 1) AS top_pickup_zone,
  (SELECT max(pickup_order_count) FROM pickup_metrics) AS top_pickup_orders,
  (SELECT {_ROUTE} FROM route_metrics ORDER BY {ROUTE_ORDER_SQL} LIMIT 1) AS top_route,
  (SELECT max(order_count) FROM route_metrics) AS top_route_orders,
  (SELECT pickup_zone FROM response ORDER BY p90_response_time_min DESC NULLS LAST,
   pickup_zone NULLS FIRST, hour LIMIT 1) AS slowest_zone,
  (SELECT hour FROM response ORDER BY p90_response_time_min DESC NULLS LAST,
   pickup_zone NULLS FIRST, hour LIMIT 1) AS slowest_hour,
  (SELECT max(p90_response_time_min) FROM response) AS slowest_p90,
  (SELECT count(*) FROM windows WHERE supply_reallocation_signal) AS reallocation_signals""",
    lambda c: reports.report_scalars(
        quality.drop_summary(c.raw, c.stored_features, "policy trips"),
        marts.pickup_zone_metrics(c.stored_dwd),
        marts.od_route_metrics(c.stored_dwd),
        marts.response_metrics(c.stored_dwd),
        compare.response_time_windows(c.stored_features),
    ),
)
simple(
    "active_incentives",
    """SELECT pickup_zone_name, dropoff_zone_name, fare_per_mile_change,
  driver_pay_per_minute_change, trip_count_post FROM pricing WHERE subsidy_signal
ORDER BY demand_change DESC, pickup_zone_name, dropoff_zone_name, is_airport_trip,
  is_cross_treated_trip LIMIT 20""",
    lambda c: reports.active_incentives(c.pricing),
)
simple(
    "fare_change_scatter",
    """SELECT pickup_zone_name, dropoff_zone_name, fare_per_mile_change,
  driver_pay_per_minute_change, greatest(trip_count_post, 1) AS bubble_size FROM pricing
ORDER BY fare_per_mile_change DESC, pickup_zone_name, dropoff_zone_name, is_airport_trip,
  is_cross_treated_trip LIMIT 20""",
    lambda c: reports.fare_change_scatter(c.pricing),
)
simple(
    "headline_counts",
    """SELECT count(DISTINCT zone_id) AS zones, min(trip_date) AS first_date,
  max(trip_date) AS last_date, sum(order_count) AS orders FROM panel""",
    lambda c: reports.headline_counts(c.stored_panel),
)
simple(
    "output_catalogue",
    " UNION ALL ".join(
        f"SELECT '{name}' AS result, count(*) AS available_rows FROM {source}"
        for name, source in (
            ("driver_supply_reallocation", "supply"),
            ("route_incentive_recommendation", "incentives"),
            ("passenger_discount_recommendation", "discounts"),
            ("operation_strategy_cards", "cards"),
            ("counterfactual_predictions", "gap"),
        )
    ),
    lambda c: reports.output_catalogue(
        {
            "driver_supply_reallocation": recommend.supply_reallocation(c.stored_zone_scores),
            "route_incentive_recommendation": recommend.route_incentives(c.stored_route_scores),
            "passenger_discount_recommendation": recommend.passenger_discounts(c.stored_zone_scores),
            "operation_strategy_cards": c.cards,
            "counterfactual_predictions": c.naive_gap,
        }
    ),
)
simple(
    "ordered_windows",
    f"""SELECT *, CASE time_window {' '.join(
        f"WHEN '{label}' THEN {i}" for i, label in enumerate(L.REPORT_WINDOW_CUTS[1], 1))} END
  AS window_rank FROM (SELECT {oracle.WINDOWS} AS time_window, count(*) AS orders
FROM features GROUP BY ALL)""",
    lambda c: c.features.groupBy(
        compare.cut("trip_hour", L.REPORT_WINDOW_CUTS).alias("time_window")
    )
    .agg(F.count(F.lit(1)).alias("orders"))
    .withColumn("window_rank", cut_rank("time_window", L.REPORT_WINDOW_CUTS)),
)

# --- samples and files ----------------------------------------------------------


_TIME_SAMPLE_SQL = """
WITH placed AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n
  FROM events),
sliced AS (SELECT * EXCLUDE (i, n), i * 12 // n AS slice FROM placed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY slice
  ORDER BY md5(event_id || '|' || (42 + slice)), event_id) AS place FROM sliced)
SELECT * EXCLUDE (slice, place) FROM ranked WHERE place <= 100
ORDER BY md5(event_id || '|42'), event_id LIMIT 1200"""


@query("bounded_time_sample", _TIME_SAMPLE_SQL)
def _time_sample(job: Job) -> DataFrame:
    """Time-spread sample of the event file: 12 slices, 1,200 rows per file."""
    events = adapters.table(job.spark, job.folder, "events")
    return sampling.time_spread_sample(events, ["event_id"], 1200)


@query(
    "uniform_capped_sample",
    "SELECT * FROM trips ORDER BY md5(source_trip_id || '|42'), source_trip_id LIMIT 1000",
)
def _uniform(job: Job) -> DataFrame:
    return sampling.uniform_sample(job.chain.trips, ["source_trip_id"], 1000).drop("response_us")


_GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query(
    "file_inventory",
    " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) AS rows FROM {t}" for t in _GIVEN),
)
def _inventory(job: Job) -> DataFrame:
    """Rows of every file of the folder; a table folder counts under its own name."""
    paths = [f"{job.folder}/{name}.parquet" for name in _GIVEN]
    table = F.regexp_extract("path", r"/(\w+\.parquet)(/[^/]*)?$", 1)
    files = inventory.file_inventory(job.spark, paths)
    return files.groupBy(table.alias("file")).agg(F.sum("rows").alias("rows"))


_DRIFT = (
    {"PULocationID": "bigint", "DOLocationID": "double"},
    {"PULocationID": "int", "DOLocationID": "bigint"},
    {"PULocationID": "double", "DOLocationID": "int"},
)


def _staged(chain: Chain, service: str, raw: DataFrame, start: str) -> DataFrame:
    """Raw trips with the place of their month, stored: the months are cut from one read."""
    month = F.coalesce(F.month(start), F.lit(1)) % len(_DRIFT)
    return _once(chain, f"staged_{service}", lambda: materialize(
        raw.withColumn("_place", month), f"raw-{service}", rebalance=False
    ))


def _write_months(chain: Chain, root: str, wanted: tuple[int, ...] = (0, 1, 2)) -> None:
    """Month files of both services, whose types and columns drift."""
    for service, raw, start in (
        ("fhvhv", chain.raw, "pickup_datetime"),
        ("yellow", chain.raw_taxi, "tpep_pickup_datetime"),
    ):
        for k in wanted:
            part = _staged(chain, service, raw, start).where(F.col("_place") == k).drop("_place")
            part = part.withColumns(
                {name: F.col(name).cast(kind) for name, kind in _DRIFT[k].items()}
            )
            part = part.drop("airport_fee") if k == 0 else part
            part.write.parquet(f"{root}/{service}/{service}_tripdata_2024-{k + 1:02d}.parquet")


@query("month_files_chain", "SELECT * FROM zone_hourly")
def _month_files(job: Job) -> DataFrame:
    """Month files whose types and columns drift, and the zone CSV, read as raw folders are."""
    root = scratch_path(job.spark, "raw")
    _write_months(job.chain, root)
    zones = job.chain.zones.selectExpr(
        "zone_id AS LocationID", "borough AS Borough", "zone_name AS Zone", "'N/A' AS service_zone"
    )
    zones.write.csv(f"{root}/zones", header=True)
    months = [f"2024-{k + 1:02d}" for k in range(len(_DRIFT))]
    standard = [
        cleaning.standard_trips(
            readers.read_trips(
                job.spark, readers.service_files(job.spark, root, service), months
            ),
            source,
            job.chain.spec.rules,
        )
        for service, source in (("fhvhv", cleaning.RIDE_HAILING), ("yellow", cleaning.YELLOW))
    ]
    return marts.zone_hourly_demand(
        cleaning.union_services(*standard), readers.read_zones(job.spark, f"{root}/zones")
    ).drop("pickup_service_zone")


def _incremental_state(job: Job) -> str:
    """A state of the marts after three updates: two months, a third one, and nothing new."""

    def make() -> str:
        root, state = scratch_path(job.spark, "raw"), scratch_path(job.spark, "mart-state")
        sources = {
            cleaning.RIDE_HAILING: f"{root}/{readers.SERVICE_PATTERNS['fhvhv']}",
            cleaning.YELLOW: f"{root}/{readers.SERVICE_PATTERNS['yellow']}",
        }
        for months in ((0, 1), (2,), ()):
            _write_months(job.chain, root, months)
            incremental.update(job.spark, state, sources, job.chain.spec.rules)
        return state

    return _once(job.chain, "mart_state", make)


for _mart, _sql in (
    ("hourly_demand", "SELECT * FROM hourly"),
    ("zone_hourly_demand", "SELECT * FROM zone_hourly"),
    ("od_flows", "SELECT * FROM flows"),
    ("invalid_trip_summary", "SELECT service_type, invalid_reason, count(*) AS record_count "
     "FROM std_all WHERE NOT is_valid_trip GROUP BY ALL"),
):
    QUERIES[f"incremental_{_mart}"] = Query(
        lambda job, name=_mart: incremental.mart(
            job.spark, _incremental_state(job), name, job.chain.zones
        ),
        _sql,
    )


_MONTH_ROWS = " UNION ALL ".join(
    f"""SELECT '{service}_tripdata_2024-{k + 1:02d}.parquet' AS file, count(*) FILTER (
  coalesce(month(pickup_datetime), 1) % 3 = {k}) AS rows, '{kinds['PULocationID']}' AS pickup_type,
  '{kinds['DOLocationID']}' AS dropoff_type, {'false' if k == 0 or service == 'yellow' else 'true'}
  AS has_airport_fee FROM {source}"""
    for service, source in (("fhvhv", "raw_hv"), ("yellow", "raw_yellow"))
    for k, kinds in enumerate(_DRIFT)
)


@query(
    "schema_report_months",
    f"""SELECT file, sum(rows) AS rows, pickup_type, dropoff_type, has_airport_fee
FROM ({_MONTH_ROWS}) GROUP BY ALL""",
)
def _schemas(job: Job) -> DataFrame:
    """Rows of the month files and the types of the columns that drift, as their footers say."""
    root = scratch_path(job.spark, "raw")
    _write_months(job.chain, root)
    report = inventory.schema_report(job.spark, f"{root}/*/*.parquet")
    table = F.regexp_extract("path", r"/([^/]+\.parquet)/[^/]+$", 1)

    def kind(column: str):
        return F.max(F.when(F.col("column") == column, F.col("type")))

    files = report.groupBy("path").agg(
        F.max("rows").alias("rows"), kind("PULocationID").alias("pickup_type"),
        kind("DOLocationID").alias("dropoff_type"),
        F.bool_or(F.col("column") == "airport_fee").alias("has_airport_fee"),
    )
    types = ["pickup_type", "dropoff_type", "has_airport_fee"]
    return files.groupBy(table.alias("file"), *types).agg(F.sum("rows").alias("rows"))


@query(
    "zone_hour_panel_stream",
    """SELECT zone_id, trip_date, hour, order_count, valid_response_count, airport_trip_count,
  avg_trip_miles, avg_trip_time, avg_base_fare, avg_driver_pay, avg_tolls, avg_response_time_min,
  slow_response_rate FROM panel
WHERE trip_date + to_hours(hour + 1) <= (SELECT max(pickup_datetime) FROM trips) - INTERVAL 1 DAY""",
)
def _stream(job: Job) -> DataFrame:
    """Trips arrive as a file for each ten days, in two runs of the stream; the hours that the
    watermark has closed."""
    root, chain = scratch_path(job.spark, "stream"), job.chain
    raw = chain.raw
    days = F.dayofmonth("pickup_datetime")
    for low, high in ((0, 10), (10, 20), (20, 31)):
        part = raw.where((days > low) & (days <= high)).coalesce(1)
        part.write.mode("append").parquet(f"{root}/in")
        if low != 10:  # the second and third file come in one run
            arriving = hourly.trip_stream(job.spark, f"{root}/in", raw.schema, 1)
            hours = hourly.hourly_panel(arriving, chain.zones, chain.spec)
            hourly.write_hours(hours, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return hourly.panel_means(job.spark.read.parquet(f"{root}/out"))


@query(
    "panel_upsert_rerun",
    """SELECT zone_id, trip_date, hour, order_count, avg_base_fare, zone_group FROM panel""",
)
def _upsert(job: Job) -> DataFrame:
    """A first write that lacks zones and has wrong counts for late days; then the late rows."""
    path, keys = scratch_path(job.spark, "late-panel"), ["trip_date", "zone_id", "hour"]
    panel = job.chain.stored_panel.select(
        "zone_id", "trip_date", "hour", "order_count", "avg_base_fare", "zone_group"
    )
    late = F.dayofmonth("trip_date") >= 20
    early = panel.withColumn(
        "order_count", F.when(late, F.col("order_count") + 1).otherwise(F.col("order_count"))
    )
    upsert.upsert(early.where(~late | (F.col("zone_id") % 3 > 0)), path, keys, ["trip_date"])
    upsert.upsert(panel.where(late), path, keys, ["trip_date"])
    return job.spark.read.parquet(path)


def _bucketed_panel(chain: Chain) -> DataFrame:
    def make() -> DataFrame:
        name, path = "curbflow_check_bucketed_panel", scratch_path(chain.spark, "bucketed-panel")
        chain.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return warehouse.create_bucketed(
            chain.panel, name, path, ["zone_id"], 8, ["zone_id", "trip_date", "hour"]
        )

    return _once(chain, "bucketed_panel", make)


simple(
    "demand_lags_bucketed",
    "SELECT zone_id, trip_date, hour, order_count, lag_1, lag_24, lag_7_day FROM lags",
    lambda c: timeseries.demand_lags(
        _bucketed_panel(c), ("lag_1", "lag_24", "lag_7_day")
    ).select("zone_id", "trip_date", "hour", "order_count", "lag_1", "lag_24", "lag_7_day"),
)
simple(
    "zone_context_bucketed", "SELECT * FROM context",
    lambda c: recommend.zone_context(_bucketed_panel(c)),
)


@query(
    "policy_calendar_slice",
    """SELECT pickup_month, count(*) AS trips, sum(fare_amount) AS fare_sum FROM std_yellow
WHERE pickup_month IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders
  GROUP BY ALL HAVING count(*) > (SELECT avg(n) FROM (SELECT count(*) AS n FROM orders
    GROUP BY strftime(o_orderdate, '%Y-%m')))) GROUP BY pickup_month""",
)
def _calendar(job: Job) -> DataFrame:
    """Only the months with more orders than the mean month, from a written calendar."""
    path = scratch_path(job.spark, "months")
    writers.write_partitioned(job.chain.standard_yellow, path, "pickup_month")
    orders = adapters.table(job.spark, job.folder, "orders")
    months = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("pickup_month")).agg(
        F.count(F.lit(1)).alias("n")
    )
    mean = months.agg(F.avg("n")).scalar()
    calendar = materialize(months.withColumn("busy", F.col("n") > mean), "calendar")
    trips = job.spark.read.schema(job.chain.standard_yellow.schema).parquet(path)
    return (
        readers.calendar_slice(trips, calendar.where("busy"))
        .groupBy("pickup_month")
        .agg(F.count(F.lit(1)).alias("trips"), F.sum("fare_amount").alias("fare_sum"))
    )


_SUMMARY = (
    "SELECT pickup_month, is_valid_trip, count(*) AS trips, sum(fare_amount) AS fare_sum "
    "FROM std_hv GROUP BY ALL"
)


def _month_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("pickup_month", "is_valid_trip").agg(
        F.count(F.lit(1)).alias("trips"), F.sum("fare_amount").alias("fare_sum")
    )


@query("partitioned_write_roundtrip", _SUMMARY)
def _partitioned(job: Job) -> DataFrame:
    """Write by month, rerun one month in place, read back with pruned folders."""
    path = scratch_path(job.spark, "months")
    trips = job.chain.standard
    writers.write_partitioned(trips, path, "pickup_month")
    rerun = readers.month_slice(trips, ["2024-01"])
    writers.write_partitioned(rerun, path, "pickup_month")
    return _month_summary(job.spark.read.schema(trips.schema).parquet(path))


@query("csv_json_roundtrip", "SELECT * FROM spill")
def _text_files(job: Job) -> DataFrame:
    """Ranking written as CSV and as JSON; rows must agree in both."""
    ranking = job.chain.spillover
    csv_path, json_path = scratch_path(job.spark, "csv"), scratch_path(job.spark, "json")
    writers.write_csv(ranking, csv_path, single_file=True)
    writers.write_json(ranking, json_path, single_file=True)
    from_csv = job.spark.read.schema(ranking.schema).csv(csv_path, header=True)
    return from_csv.intersect(job.spark.read.schema(ranking.schema).json(json_path))


@query("external_table_roundtrip", _SUMMARY)
def _external(job: Job) -> DataFrame:
    """Files, then a partitioned table over them, then partition discovery."""
    root = scratch_path(job.spark, "warehouse")
    trips = job.chain.standard
    writers.write_partitioned(
        trips, warehouse.table_path(root, "dwd_clean_trips"), "pickup_month"
    )
    columns = ", ".join(f"{name} {kind}" for name, kind in trips.dtypes)
    job.spark.sql("DROP TABLE IF EXISTS curbflow_check_dwd_clean_trips")
    name = warehouse.register_layer(
        job.spark, root, {"dwd_clean_trips": columns}, prefix="curbflow_check_"
    )[0]
    return _month_summary(job.spark.table(name))


@query("ctas_insert_overwrite", "SELECT * FROM time_metrics")
def _catalog(job: Job) -> DataFrame:
    """Create a metric table as select, then overwrite it with the same query."""
    metrics = marts.time_demand_metrics(job.chain.dwd)
    path = scratch_path(job.spark, "ctas")
    name = "curbflow_check_time_metrics"
    job.spark.sql(f"DROP TABLE IF EXISTS {name}")
    warehouse.create_as_select(metrics, name, path)
    warehouse.insert_overwrite(metrics, name)
    return job.spark.table(name)


# One chain per session and folder serves all queries: stored tables and models are shared.
_CHAINS: WeakKeyDictionary[SparkSession, dict[str, Chain]] = WeakKeyDictionary()


def _chain(spark: SparkSession, folder: str) -> Chain:
    known = _CHAINS.setdefault(spark, {})
    if folder not in known:
        known[folder] = Chain.over_tables(spark, folder)
    return known[folder]


def plans() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query with the typed, unrounded columns of its operators."""

    def runner(plan):
        def call(spark: SparkSession, folder: str) -> DataFrame:
            use_utc(spark)
            return plan(Job(spark, folder, _chain(spark, folder)))

        return call

    return {name: runner(entry.plan) for name, entry in QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query in the value format that the oracle comparison uses."""

    def formatted(plan):
        return lambda spark, folder: canonical(plan(spark, folder))

    return {name: formatted(plan) for name, plan in plans().items()}


def oracle_sql() -> dict[str, str]:
    return {
        name: canonical_sql(oracle.build(entry.sql))
        for name, entry in QUERIES.items()
        if entry.sql is not None
    }
