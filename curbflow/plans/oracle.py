"""Oracle SQL: the same results written independently for DuckDB.

``CTES`` holds the shared relations in dependency order; each oracle body names the
ones it needs and ``build`` pulls in what those depend on.
"""

from __future__ import annotations

import re

MINUTE = "6e7"


def _minutes(start: str, end: str) -> str:
    return f"(epoch_us({end}) - epoch_us({start})) / {MINUTE}"


def _cut(value: str, edges, labels) -> str:
    """CASE for right-closed intervals."""
    parts = [f"WHEN {value} <= {edges[0]} THEN NULL"]
    for upper, label in zip(edges[1:], labels):
        test = f"{value} IS NOT NULL" if upper is None else f"{value} <= {upper}"
        parts.append(f"WHEN {test} THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


def _pre_post(**measures: str) -> str:
    """``name='avg(x)'`` becomes zero-filled name_pre and name_post."""
    out = []
    for name, call in measures.items():
        for period, test in (("pre", "NOT post_policy"), ("post", "post_policy")):
            out.append(f"coalesce({call} FILTER (WHERE {test}), 0) AS {name}_{period}")
    return ", ".join(out)


def _rate(name: str, post: str | None = None, pre: str | None = None) -> str:
    post, pre = post or f"{name}_post", pre or f"{name}_pre"
    return f"({post} - {pre})::DOUBLE / nullif({pre}, 0)"


COUNT = "count(*)"
WINDOWS = _cut(
    "trip_hour", (-1, 5, 10, 14, 20, 24), ("凌晨", "早高峰", "午间", "晚高峰", "夜间")
)
RULES = """CASE
  WHEN pickup_datetime IS NULL OR dropoff_datetime IS NULL THEN 'missing_time'
  WHEN trip_duration_min <= 0 THEN 'non_positive_duration'
  WHEN trip_duration_min > 480 THEN 'duration_over_8h'
  WHEN trip_distance IS NULL OR trip_distance <= 0.01e0 THEN 'non_positive_distance'
  WHEN trip_distance > 200 THEN 'distance_over_200'
  WHEN pickup_location_id IS NULL OR dropoff_location_id IS NULL THEN 'missing_zone'
  WHEN fare_amount < 0 THEN 'negative_fare'
  WHEN total_amount > 1000 THEN 'total_amount_over_1000' END"""
STANDARD = """service_type, pickup_datetime, dropoff_datetime, pickup_date, pickup_hour, pickup_weekday,
  pickup_month, pickup_location_id, dropoff_location_id, trip_distance, trip_duration_min,
  fare_amount, total_amount, driver_pay, tips, payment_type, shared_match_flag, wav_request_flag"""
CALENDAR = """CAST(pickup_datetime AS DATE) AS pickup_date,
  CAST(hour(pickup_datetime) AS INTEGER) AS pickup_hour,
  CAST(isodow(pickup_datetime) - 1 AS INTEGER) AS pickup_weekday,
  strftime(pickup_datetime, '%Y-%m') AS pickup_month"""
PANEL_MEANS = """avg(trip_miles) AS avg_trip_miles, avg(trip_time) AS avg_trip_time,
  avg(base_passenger_fare) AS avg_base_fare, avg(driver_pay) AS avg_driver_pay,
  avg(tolls) AS avg_tolls, avg(cbd_congestion_fee) AS avg_cbd_congestion_fee,
  avg(congestion_surcharge) AS avg_congestion_surcharge,
  avg(policy_fee_burden_rate) AS avg_policy_fee_burden_rate,
  avg(fare_per_mile) AS avg_fare_per_mile,
  avg(driver_pay_per_minute) AS avg_driver_pay_per_minute,
  avg(response_time_min) AS avg_response_time_min,
  avg(CASE WHEN slow_response_flag THEN 1e0 ELSE 0e0 END) AS slow_response_rate,
  count(response_time_min) AS valid_response_count"""
SUMS = """count(*) AS trip_count, coalesce(sum(trip_distance), 0) AS distance_sum,
  coalesce(sum(trip_duration_min), 0) AS duration_sum, coalesce(sum(fare_amount), 0) AS fare_sum"""
RATIOS = """distance_sum / trip_count AS avg_distance, duration_sum / trip_count AS avg_duration_min,
  fare_sum / trip_count AS avg_fare, fare_sum / nullif(distance_sum, 0) AS fare_per_mile"""
ZONE_KEYS = "zone_id, zone_name, zone_group"
OD = "pickup_zone_name, dropoff_zone_name"
GUARD = "abs({n}_lo - {n}_hi) <= 1e-8 + 1e-5 * abs({n}_hi)"


def _guarded(name: str) -> str:
    return (
        f"CASE WHEN {GUARD.format(n=name)} THEN CASE WHEN {name}_hi = 0 THEN 0e0 ELSE 0.5e0 END "
        f"ELSE ({name} - {name}_lo) / ({name}_hi - {name}_lo) END"
    )


def _bounds(*names: str) -> str:
    return ", ".join(f"min({n}) OVER () AS {n}_lo, max({n}) OVER () AS {n}_hi" for n in names)


CTES: dict[str, str] = {
    "zones": """
SELECT n_nationkey AS zone_id, n_name AS zone_name, r_name AS borough,
  CASE WHEN n_nationkey <= 5 THEN 'treated_zones' WHEN n_nationkey <= 9 THEN 'spillover_zones'
       WHEN n_nationkey <= 15 THEN 'control_zones' ELSE 'other' END AS zone_group,
  n_nationkey IN (20, 21, 22) AS is_airport
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "raw_hv": """
SELECT event_id AS source_trip_id, ts AS request_datetime,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 331 = 0 THEN ts + to_seconds(18000)
       ELSE ts + to_seconds((event_id * 13) % 900) END AS on_scene_datetime,
  ts + to_seconds(960) AS pickup_datetime,
  CASE WHEN event_id % 83 <> 0 THEN ts + to_seconds(960) + to_seconds(
    CASE WHEN event_id % 101 = 0 THEN -60 WHEN event_id % 103 = 0 THEN 32400
         ELSE 30 + (event_id * 37) % 5400 END) END AS dropoff_datetime,
  c_nationkey AS pu_zone,
  CASE WHEN event_id % 97 <> 0 THEN CAST((event_id * 7 + 3) % 27 AS INTEGER) END AS do_zone,
  CASE WHEN event_id % 211 = 0 THEN 250e0 WHEN event_id % 89 = 0 THEN 0e0
       ELSE value / 5e0 END AS trip_miles,
  CASE WHEN event_id % 79 = 0 THEN -1e0 WHEN event_id % 73 = 0 THEN 1500e0
       ELSE 2.5e0 + value * 1.5e0 END AS base_passenger_fare,
  (2.5e0 + value * 1.5e0) * (0.6e0 + 0.001e0 * (event_id % 200)) AS driver_pay,
  CASE WHEN event_id % 10 = 0 THEN 6.94e0 ELSE 0e0 END AS tolls,
  CASE WHEN event_type = 'purchase' THEN (2.5e0 + value * 1.5e0) * 0.15e0 ELSE 0e0 END AS tips,
  CASE WHEN c_nationkey <= 5 THEN 2.75e0 ELSE 0e0 END AS congestion_surcharge,
  CASE WHEN ts >= TIMESTAMP '2024-01-16' AND c_nationkey <= 5 THEN 1.5e0 ELSE 0e0 END
    AS cbd_congestion_fee,
  CASE WHEN c_nationkey IN (20, 21, 22) THEN 2.5e0 ELSE 0e0 END AS airport_fee,
  CASE WHEN event_id % 7 = 0 THEN 'Y' ELSE 'N' END AS shared_match_flag,
  CASE WHEN event_id % 11 = 0 THEN 'Y' ELSE 'N' END AS wav_request_flag
FROM events LEFT JOIN customer ON c_custkey = user_id""",
    "raw_yellow": """
SELECT o_orderdate + to_seconds((l_orderkey % 24) * 3600 + l_linenumber * 420) AS pickup_datetime,
  o_orderdate + to_seconds((l_orderkey % 24) * 3600 + l_linenumber * 420)
    + to_seconds(CAST(l_quantity * 60 AS BIGINT)) AS dropoff_datetime,
  c_nationkey AS pu_zone, s_nationkey AS do_zone, l_quantity / 3e0 AS trip_distance,
  l_extendedprice / 1000 AS fare_amount, l_extendedprice / 1000 * (1e0 + l_tax) AS total_amount,
  l_extendedprice / 1000 * l_discount AS tips, CAST(l_linenumber % 6 AS INTEGER) AS payment_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey""",
    "std_hv": f"""
SELECT {STANDARD}, {RULES} IS NULL AS is_valid_trip, {RULES} AS invalid_reason FROM (
SELECT 'high_volume_fhv' AS service_type, pickup_datetime, dropoff_datetime, {CALENDAR},
  pu_zone AS pickup_location_id, do_zone AS dropoff_location_id, trip_miles AS trip_distance,
  {_minutes('pickup_datetime', 'dropoff_datetime')} AS trip_duration_min,
  base_passenger_fare AS fare_amount, base_passenger_fare AS total_amount, driver_pay, tips,
  CAST(NULL AS INTEGER) AS payment_type, shared_match_flag, wav_request_flag FROM raw_hv)""",
    "std_yellow": f"""
SELECT {STANDARD}, {RULES} IS NULL AS is_valid_trip, {RULES} AS invalid_reason FROM (
SELECT 'yellow_taxi' AS service_type, pickup_datetime, dropoff_datetime, {CALENDAR},
  pu_zone AS pickup_location_id, do_zone AS dropoff_location_id, trip_distance,
  {_minutes('pickup_datetime', 'dropoff_datetime')} AS trip_duration_min,
  fare_amount, total_amount, CAST(NULL AS DOUBLE) AS driver_pay, tips, payment_type,
  CAST(NULL AS VARCHAR) AS shared_match_flag, CAST(NULL AS VARCHAR) AS wav_request_flag
FROM raw_yellow)""",
    "std_all": "SELECT * FROM std_hv UNION ALL SELECT * FROM std_yellow",
    "trips": f"""
SELECT *, response_time_min IS NOT NULL AND response_time_min > 10 AS slow_response_flag FROM (
SELECT *, CASE WHEN epoch_us(on_scene_datetime) - epoch_us(request_datetime)
    BETWEEN 0 AND 14400000000 THEN {_minutes('request_datetime', 'on_scene_datetime')} END
    AS response_time_min,
  CASE WHEN epoch_us(pickup_datetime) - epoch_us(request_datetime) BETWEEN 0 AND 14400000000
    THEN {_minutes('request_datetime', 'pickup_datetime')} END AS pickup_wait_proxy_min FROM (
SELECT 'high_volume_fhv' AS service_type, source_trip_id, request_datetime, on_scene_datetime,
  pickup_datetime, dropoff_datetime, pu_zone AS pickup_location_id,
  do_zone AS dropoff_location_id, trip_miles, base_passenger_fare,
  base_passenger_fare AS total_amount, driver_pay, tips, tolls, congestion_surcharge,
  cbd_congestion_fee, airport_fee, {_minutes('pickup_datetime', 'dropoff_datetime')} AS trip_time
FROM raw_hv)
WHERE pickup_datetime IS NOT NULL AND dropoff_datetime IS NOT NULL
  AND pickup_location_id IS NOT NULL AND dropoff_location_id IS NOT NULL
  AND trip_miles BETWEEN 0.01e0 AND 200 AND trip_time BETWEEN 1 AND 480
  AND base_passenger_fare >= 0)""",
    "trips_yellow": f"""
SELECT 'yellow_taxi' AS service_type, pickup_datetime, dropoff_datetime,
  pu_zone AS pickup_location_id, do_zone AS dropoff_location_id, trip_distance AS trip_miles,
  fare_amount AS base_passenger_fare, total_amount, CAST(NULL AS DOUBLE) AS driver_pay, tips,
  0e0 AS tolls, 0e0 AS congestion_surcharge, 0e0 AS cbd_congestion_fee, 0e0 AS airport_fee,
  {_minutes('pickup_datetime', 'dropoff_datetime')} AS trip_time,
  CAST(NULL AS DOUBLE) AS response_time_min, false AS slow_response_flag
FROM raw_yellow
WHERE pu_zone IS NOT NULL AND do_zone IS NOT NULL AND trip_distance BETWEEN 0.01e0 AND 200
  AND {_minutes('pickup_datetime', 'dropoff_datetime')} BETWEEN 1 AND 480 AND fare_amount >= 0""",
    "features": """
SELECT *, base_passenger_fare / greatest(trip_miles, 0.01e0) AS fare_per_mile,
  base_passenger_fare / greatest(trip_time, 1e0) AS fare_per_minute,
  driver_pay / greatest(trip_miles, 0.01e0) AS driver_pay_per_mile,
  driver_pay / greatest(trip_time, 1e0) AS driver_pay_per_minute,
  tips / greatest(base_passenger_fare, 0.01e0) AS tip_rate,
  driver_pay / greatest(base_passenger_fare, 0.01e0) AS driver_pay_to_fare_ratio,
  tolls / greatest(base_passenger_fare, 0.01e0) AS toll_burden_rate,
  (congestion_surcharge + cbd_congestion_fee) / greatest(base_passenger_fare, 0.01e0)
    AS policy_fee_burden_rate,
  pickup_zone_group = 'treated_zones' AS is_pickup_treated,
  dropoff_zone_group = 'treated_zones' AS is_dropoff_treated,
  pickup_zone_group = 'spillover_zones' AS is_pickup_spillover,
  dropoff_zone_group = 'spillover_zones' AS is_dropoff_spillover,
  pickup_zone_group = 'control_zones' AS is_pickup_control,
  dropoff_zone_group = 'control_zones' AS is_dropoff_control,
  (pickup_zone_group = 'treated_zones') <> (dropoff_zone_group = 'treated_zones')
    AS is_cross_treated_trip,
  DATE '2024-01-16' AS policy_date, trip_date >= DATE '2024-01-16' AS post_policy,
  weekday >= 5 AS is_weekend
FROM (SELECT t.*, p.zone_name AS pickup_zone_name, p.borough AS pickup_borough,
  d.zone_name AS dropoff_zone_name, d.borough AS dropoff_borough,
  coalesce(p.zone_group, 'other') AS pickup_zone_group,
  coalesce(d.zone_group, 'other') AS dropoff_zone_group,
  coalesce(p.is_airport, false) OR coalesce(d.is_airport, false) AS is_airport_trip,
  CAST(pickup_datetime AS DATE) AS trip_date,
  CAST(hour(pickup_datetime) AS INTEGER) AS trip_hour,
  CAST(isodow(pickup_datetime) - 1 AS INTEGER) AS weekday
FROM trips t LEFT JOIN zones p ON t.pickup_location_id = p.zone_id
  LEFT JOIN zones d ON t.dropoff_location_id = d.zone_id)""",
    "dwd": """
SELECT source_trip_id AS trip_id, request_datetime, on_scene_datetime, pickup_datetime,
  dropoff_datetime, trip_date, trip_hour, weekday, is_weekend, pickup_location_id,
  dropoff_location_id, pickup_zone_name AS pickup_zone, dropoff_zone_name AS dropoff_zone,
  pickup_borough, dropoff_borough, trip_miles, trip_time AS trip_time_min, base_passenger_fare,
  tolls, congestion_surcharge, cbd_congestion_fee, airport_fee, driver_pay, fare_per_mile,
  fare_per_minute, driver_pay_per_mile, driver_pay_per_minute, response_time_min,
  is_airport_trip, is_pickup_treated AS is_core_zone_trip,
  is_pickup_spillover AS is_boundary_zone_trip,
  CASE WHEN post_policy THEN '政策后' ELSE '政策前' END AS policy_period FROM features""",
    "panel": f"""
SELECT pickup_location_id AS zone_id, pickup_zone_name AS zone_name, pickup_borough,
  pickup_zone_group AS zone_group, trip_date, trip_hour AS hour, weekday, is_weekend, post_policy,
  count(*) AS order_count, {PANEL_MEANS}, avg(total_amount) AS avg_total_amount,
  quantile_cont(response_time_min, 0.5) AS response_time_p50,
  quantile_cont(response_time_min, 0.9) AS response_time_p90,
  count(*) FILTER (trip_miles <= 2) AS short_trip_count,
  count(*) FILTER (trip_miles > 2 AND trip_miles <= 8) AS medium_trip_count,
  count(*) FILTER (trip_miles > 8) AS long_trip_count,
  count(*) FILTER (is_airport_trip) AS airport_trip_count,
  count(*) FILTER (is_pickup_treated) AS treated_pickup_count,
  count(*) FILTER (is_dropoff_treated) AS treated_dropoff_count,
  count(*) FILTER (is_pickup_spillover) AS spillover_pickup_count,
  count(*) FILTER (is_pickup_control) AS control_pickup_count,
  pickup_zone_group = 'treated_zones' AS treated_zone, ln(count(*) + 1) AS log_order_count
FROM features GROUP BY ALL""",
    "od_panel": f"""
SELECT pickup_location_id, pickup_zone_name, dropoff_location_id, dropoff_zone_name, trip_date,
  trip_hour AS hour, post_policy, count(*) AS od_order_count, {PANEL_MEANS},
  quantile_cont(response_time_min, 0.9) AS response_time_p90,
  bool_or(is_cross_treated_trip) AS is_cross_treated_od, bool_or(is_airport_trip) AS is_airport_od
FROM features GROUP BY ALL""",
    "hourly": f"""
SELECT *, {RATIOS} FROM (SELECT service_type, pickup_date, pickup_hour, pickup_weekday,
  pickup_month, {SUMS}, coalesce(sum(tips), 0) AS tips_sum,
  coalesce(sum(driver_pay), 0) AS driver_pay_sum
FROM std_all WHERE is_valid_trip GROUP BY ALL)""",
    "zone_hourly": f"""
SELECT q.*, {RATIOS}, borough AS pickup_borough, zone_name AS pickup_zone FROM (
SELECT service_type, pickup_date, pickup_hour, pickup_location_id, {SUMS}
FROM std_all WHERE is_valid_trip GROUP BY ALL) q
LEFT JOIN zones ON pickup_location_id = zone_id""",
    "flows": f"""
SELECT *, {RATIOS} FROM (SELECT service_type, pickup_location_id, dropoff_location_id, {SUMS}
FROM std_all WHERE is_valid_trip GROUP BY ALL)""",
    "time_metrics": """
SELECT trip_date AS date, trip_hour AS hour, weekday, is_weekend, count(*) AS order_count,
  avg(trip_miles) AS avg_trip_miles, avg(base_passenger_fare) AS avg_base_passenger_fare,
  avg(driver_pay) AS avg_driver_pay FROM dwd GROUP BY ALL""",
    "pickup_metrics": """
SELECT pickup_zone, pickup_borough, count(*) AS pickup_order_count,
  avg(fare_per_mile) AS avg_fare_per_mile,
  avg(driver_pay_per_minute) AS avg_driver_pay_per_minute,
  avg(response_time_min) AS avg_response_time_min FROM dwd GROUP BY ALL""",
    "dropoff_counts": """
SELECT dropoff_zone, dropoff_borough, count(*) AS dropoff_order_count FROM dwd GROUP BY ALL""",
    "route_metrics": """
SELECT pickup_zone, dropoff_zone, pickup_borough, dropoff_borough, count(*) AS order_count,
  avg(trip_miles) AS avg_trip_miles, avg(trip_time_min) AS avg_trip_time_min,
  avg(base_passenger_fare) AS avg_base_passenger_fare, avg(fare_per_mile) AS avg_fare_per_mile,
  avg(driver_pay) AS avg_driver_pay, avg(driver_pay_per_minute) AS avg_driver_pay_per_minute,
  avg(response_time_min) AS avg_response_time_min FROM dwd GROUP BY ALL""",
    "price_metrics": f"""
SELECT {_cut('trip_miles', (0, 2, 8, None), ('短途(0-2英里)', '中途(2-8英里)', '长途(8+英里)'))}
    AS trip_distance_group,
  {_cut('trip_hour', (-1, 5, 9, 16, 20, 23), ('夜间', '早高峰', '日间', '晚高峰', '深夜'))}
    AS hour_group, policy_period, count(*) AS order_count,
  avg(fare_per_mile) AS avg_fare_per_mile, avg(fare_per_minute) AS avg_fare_per_minute,
  avg(tolls) AS avg_tolls, avg(cbd_congestion_fee) AS avg_cbd_congestion_fee,
  avg(driver_pay_per_mile) AS avg_driver_pay_per_mile,
  avg(driver_pay_per_minute) AS avg_driver_pay_per_minute,
  avg(driver_pay) / nullif(avg(base_passenger_fare), 0) AS driver_pay_to_fare_ratio,
  avg(driver_pay / nullif(base_passenger_fare, 0)) AS mean_trip_pay_to_fare_ratio
FROM dwd GROUP BY ALL""",
    "response": """
SELECT pickup_zone, trip_hour AS hour, count(*) AS order_count,
  avg(response_time_min) AS avg_response_time_min,
  quantile_cont(response_time_min, 0.5) AS p50_response_time_min,
  quantile_cont(response_time_min, 0.9) AS p90_response_time_min,
  avg(CASE WHEN response_time_min > 10 THEN 1e0 ELSE 0e0 END) AS slow_response_rate
FROM dwd WHERE response_time_min IS NOT NULL GROUP BY ALL""",
    "hour_pattern": f"""
SELECT *, {_rate('order_count')} AS change_rate FROM (
SELECT trip_hour AS hour, is_weekend, {_pre_post(order_count=COUNT)} FROM features GROUP BY ALL)""",
    "od_change": f"""
SELECT *, CASE WHEN is_airport_trip THEN 'airport_od'
  WHEN is_cross_treated_trip THEN 'cross_treated_od'
  WHEN avg_driver_pay_per_minute_change < 0 THEN 'driver_pressure_od'
  ELSE 'high_value_od' END AS route_type,
  'OD 路线用于判断需求变化是乘客侧价格问题还是司机收益压力问题。' AS business_interpretation FROM (
SELECT *, orders_post - orders_pre AS absolute_change, {_rate('orders')} AS change_rate,
  fare_per_mile_post - fare_per_mile_pre AS avg_fare_per_mile_change,
  driver_pay_per_minute_post - driver_pay_per_minute_pre AS avg_driver_pay_per_minute_change FROM (
SELECT {OD}, is_airport_trip, is_cross_treated_trip,
  {_pre_post(orders=COUNT, fare_per_mile='avg(fare_per_mile)',
             driver_pay_per_minute='avg(driver_pay_per_minute)')}
FROM features GROUP BY ALL))""",
    "pressure": f"""
SELECT * EXCLUDE (t, p), driver_pressure_score >= quantile_cont(driver_pressure_score, 0.9) OVER ()
    AND orders_post >= 10 AS driver_incentive_signal,
  '通行费压力上升且司机单位时间收益承压的高订单路线，优先进入司机激励试点。'
    AS business_interpretation FROM (
SELECT *, ((t - min(t) OVER ()) / greatest(max(t) OVER () - min(t) OVER (), 1e-9)
  + (max(p) OVER () - p) / greatest(max(p) OVER () - min(p) OVER (), 1e-9)) / 2
  AS driver_pressure_score FROM (
SELECT *, coalesce(tolls_change_rate, 0) AS t,
  coalesce(driver_pay_per_minute_change_rate, 0) AS p FROM (
SELECT *, {_rate('driver_pay_per_minute')} AS driver_pay_per_minute_change_rate,
  {_rate('tolls')} AS tolls_change_rate,
  pay_to_fare_post - pay_to_fare_pre AS driver_pay_to_fare_ratio_change FROM (
SELECT {OD}, is_airport_trip, {_pre_post(
    orders=COUNT, driver_pay_per_minute='avg(driver_pay_per_minute)', tolls='avg(tolls)',
    pay_to_fare='avg(driver_pay_to_fare_ratio)')}
FROM features GROUP BY ALL))))""",
    "windows": f"""
SELECT *, slow_response_rate_post - slow_response_rate_pre AS slow_response_rate_change,
  response_time_p90_post > response_time_p90_pre AND zone_group = 'spillover_zones'
    AS supply_reallocation_signal,
  '外溢区订单承接且 P90 响应时长变慢，说明司机供给可能未同步迁移。' AS business_interpretation FROM (
SELECT pickup_zone_group AS zone_group, {WINDOWS} AS time_window, {_pre_post(
    response_time_p50='quantile_cont(response_time_min, 0.5)',
    response_time_p90='quantile_cont(response_time_min, 0.9)',
    slow_response_rate='avg(CASE WHEN slow_response_flag THEN 1e0 ELSE 0e0 END)', orders=COUNT)}
FROM features WHERE response_time_min IS NOT NULL GROUP BY ALL)""",
    "efficiency": f"""
SELECT *, response_time_p90_post - response_time_p90_pre AS response_time_p90_change,
  slow_response_rate_post - slow_response_rate_pre AS slow_response_rate_change,
  valid_response_count_post / nullif(order_count_post, 0) AS response_coverage_rate FROM (
SELECT zone_group, {_pre_post(
    average_response_time_min='avg(avg_response_time_min)',
    response_time_p90='avg(response_time_p90)', slow_response_rate='avg(slow_response_rate)',
    valid_response_count='sum(valid_response_count)', order_count='sum(order_count)')}
FROM panel GROUP BY ALL)""",
    "pricing": f"""
SELECT *, fare_per_mile_change > 0 AND driver_pay_per_minute_change <= 0 AS subsidy_signal FROM (
SELECT *, fare_per_mile_post - fare_per_mile_pre AS fare_per_mile_change,
  driver_pay_per_minute_post - driver_pay_per_minute_pre AS driver_pay_per_minute_change,
  trip_count_post - trip_count_pre AS demand_change FROM (
SELECT {OD}, is_cross_treated_trip, is_airport_trip, {_pre_post(
    trip_count=COUNT, fare_per_mile='avg(fare_per_mile)',
    driver_pay_per_minute='avg(driver_pay_per_minute)', tolls_per_trip='avg(tolls)')}
FROM features WHERE pickup_zone_name IS NOT NULL AND dropoff_zone_name IS NOT NULL GROUP BY ALL))""",
    "segments": f"""
SELECT dimension, segment, pre_order_count, post_order_count,
  post_order_count - pre_order_count AS absolute_change,
  (post_order_count - pre_order_count)::DOUBLE / nullif(pre_order_count, 0) AS relative_change
FROM (SELECT dimension, segment, count(*) FILTER (NOT post_policy) AS pre_order_count,
  count(*) FILTER (post_policy) AS post_order_count FROM (
SELECT 'hour_group' AS dimension, {_cut('trip_hour', (-1, 6, 10, 16, 20, 24),
  ('night', 'morning_peak', 'noon', 'evening_peak', 'late_evening'))} AS segment, post_policy
FROM features
UNION ALL SELECT 'day_type', CASE WHEN is_weekend THEN 'weekend' ELSE 'weekday' END, post_policy
FROM features
UNION ALL SELECT 'distance_group', {_cut('trip_miles', (0, 2, 8, None),
  ('short', 'medium', 'long'))}, post_policy FROM features
UNION ALL SELECT 'pickup_zone_group', pickup_zone_group, post_policy FROM features
UNION ALL SELECT 'airport_flag', CASE WHEN is_airport_trip THEN 'airport' ELSE 'non_airport' END,
  post_policy FROM features) WHERE segment IS NOT NULL GROUP BY ALL)""",
    "spill": f"""
SELECT *, post_order_count - pre_order_count AS absolute_change,
  {_rate('', 'post_order_count', 'pre_order_count')} AS relative_change,
  coalesce({_rate('', 'post_order_count', 'pre_order_count')}, 0) * ln(1 + post_order_count)
    AS spillover_score FROM (
SELECT {ZONE_KEYS}, coalesce(sum(order_count) FILTER (NOT post_policy), 0) AS pre_order_count,
  coalesce(sum(order_count) FILTER (post_policy), 0) AS post_order_count
FROM panel WHERE zone_name IS NOT NULL GROUP BY ALL)""",
    "lags": """
SELECT *, CAST(month(trip_date) AS INTEGER) AS month,
  coalesce(b24, lag_1) AS lag_24, coalesce(b168, b24, lag_1) AS lag_7_day FROM (
SELECT *, lag(order_count, 1) OVER z AS lag_1, lag(order_count, 24) OVER z AS b24,
  lag(order_count, 168) OVER z AS b168,
  avg(order_count) OVER (z ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS roll3,
  avg(order_count) OVER (z ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS roll24
FROM panel WINDOW z AS (PARTITION BY zone_id ORDER BY trip_date, hour))""",
    "fc": """
SELECT zone_id, zone_name, trip_date, hour, weekday, is_weekend, post_policy, month, order_count,
  coalesce(avg_trip_miles, 0) AS avg_trip_miles, coalesce(avg_fare_per_mile, 0) AS avg_fare_per_mile,
  coalesce(avg_driver_pay_per_minute, 0) AS avg_driver_pay_per_minute,
  coalesce(avg_response_time_min, 0) AS avg_response_time_min,
  lag_1::DOUBLE AS lag_1_hour_order_count, lag_24::DOUBLE AS lag_24_hour_order_count,
  lag_7_day::DOUBLE AS lag_7_day_order_count, roll3 AS rolling_3_hour_order_count,
  roll24 AS rolling_24_hour_order_count FROM lags WHERE lag_1 IS NOT NULL""",
    "split": """
SELECT *, epoch(trip_date::TIMESTAMP)
  <= (SELECT quantile_cont(epoch(trip_date::TIMESTAMP), 0.8) FROM fc) AS is_train FROM fc""",
    "gap": """
SELECT zone_id, zone_name, trip_date AS date, hour, order_count AS actual_order_count,
  greatest(lag_7_day::DOUBLE, 0e0) AS predicted_counterfactual_order_count,
  greatest(lag_7_day::DOUBLE, 0e0) - order_count AS demand_gap,
  (greatest(lag_7_day::DOUBLE, 0e0) - order_count) / nullif(greatest(lag_7_day::DOUBLE, 0e0), 0)
    AS demand_gap_rate
FROM lags WHERE lag_1 IS NOT NULL AND post_policy""",
    "peak": f"""
SELECT {ZONE_KEYS}, hour, orders AS peak_orders FROM (
SELECT *, row_number() OVER (PARTITION BY {ZONE_KEYS} ORDER BY orders DESC, hour) AS place FROM (
SELECT {ZONE_KEYS}, hour, sum(order_count) AS orders FROM panel
WHERE post_policy AND zone_name IS NOT NULL GROUP BY ALL)) WHERE place = 1""",
    "context": f"""
SELECT {ZONE_KEYS}, {_pre_post(
    order_count='avg(order_count)', avg_fare_per_mile='avg(avg_fare_per_mile)',
    avg_driver_pay_per_minute='avg(avg_driver_pay_per_minute)', avg_tolls='avg(avg_tolls)',
    response_time_p90='avg(response_time_p90)', slow_response_rate='avg(slow_response_rate)')}
FROM panel WHERE zone_name IS NOT NULL GROUP BY ALL""",
    "mean_gap": """
SELECT zone_id, zone_name, avg(actual_order_count) AS actual_order_count,
  avg(predicted_counterfactual_order_count) AS predicted_counterfactual_order_count,
  avg(demand_gap) AS demand_gap, avg(demand_gap_rate) AS demand_gap_rate
FROM gap WHERE zone_name IS NOT NULL GROUP BY ALL""",
    "zscores": f"""
SELECT * EXCLUDE (g, t, p, f, s, g_lo, g_hi, t_lo, t_hi, p_lo, p_hi, f_lo, f_hi, s_lo, s_hi),
  0.35e0 * demand_gap_score + 0.25e0 * driver_pressure_score
  + 0.20e0 * passenger_price_pressure_score + 0.20e0 * spillover_score_normalized
  AS final_action_score FROM (
SELECT * REPLACE (coalesce(demand_gap_rate, 0) AS demand_gap_rate,
    coalesce(demand_gap, 0) AS demand_gap, coalesce(actual_order_count, 0) AS actual_order_count,
    coalesce(predicted_counterfactual_order_count, 0) AS predicted_counterfactual_order_count,
    coalesce(hour, 0) AS hour),
  {_guarded('g')} AS demand_gap_score,
  greatest(least(({_guarded('t')}) - ({_guarded('p')}), 1e0), 0e0) AS driver_pressure_score,
  {_guarded('f')} AS passenger_price_pressure_score,
  {_guarded('s')} AS spillover_score_normalized FROM (
SELECT *, {_bounds('g', 't', 'p', 'f', 's')} FROM (
SELECT *, greatest(coalesce(demand_gap_rate, 0), 0e0) AS g, tolls_change_rate AS t,
  driver_pay_per_minute_change_rate AS p, greatest(fare_per_mile_change_rate, 0e0) AS f,
  greatest(spillover_score, 0e0) AS s FROM (
SELECT c.*, k.hour, m.actual_order_count, m.predicted_counterfactual_order_count, m.demand_gap,
  m.demand_gap_rate, coalesce(v.spillover_score, 0) AS spillover_score,
  coalesce({_rate('avg_fare_per_mile')}, 0) AS fare_per_mile_change_rate,
  coalesce({_rate('avg_driver_pay_per_minute')}, 0) AS driver_pay_per_minute_change_rate,
  coalesce({_rate('avg_tolls')}, 0) AS tolls_change_rate,
  response_time_p90_post - response_time_p90_pre AS response_time_p90_change,
  slow_response_rate_post - slow_response_rate_pre AS slow_response_rate_change
FROM context c LEFT JOIN peak k ON c.zone_id = k.zone_id
  LEFT JOIN mean_gap m ON c.zone_id = m.zone_id LEFT JOIN spill v ON c.zone_id = v.zone_id))))""",
    "rscores": f"""
SELECT * EXCLUDE (g, t, p, f, s, g_lo, g_hi, t_lo, t_hi, p_lo, p_hi, f_lo, f_hi, s_lo, s_hi),
  0.35e0 * demand_gap_score + 0.25e0 * driver_pressure_score
  + 0.20e0 * passenger_price_pressure_score + 0.20e0 * spillover_score
  AS final_action_score FROM (
SELECT *, {_guarded('g')} AS demand_gap_score,
  greatest(least(({_guarded('t')}) - ({_guarded('p')}), 1e0), 0e0) AS driver_pressure_score,
  {_guarded('f')} AS passenger_price_pressure_score, {_guarded('s')} AS spillover_score FROM (
SELECT *, {_bounds('g', 't', 'p', 'f', 's')} FROM (
SELECT *, demand_gap_rate AS g, tolls_per_trip_change_rate AS t,
  driver_pay_per_minute_change_rate AS p, greatest(fare_per_mile_change_rate, 0e0) AS f,
  greatest(demand_change, 0)::DOUBLE AS s FROM (
SELECT *, coalesce({_rate('fare_per_mile')}, 0) AS fare_per_mile_change_rate,
  coalesce({_rate('driver_pay_per_minute')}, 0) AS driver_pay_per_minute_change_rate,
  coalesce({_rate('tolls_per_trip')}, 0) AS tolls_per_trip_change_rate,
  greatest(coalesce(-({_rate('trip_count')}), 0), 0e0) AS demand_gap_rate FROM pricing))))""",
}

# Fixed-effects regression, written independently of the Spark job: zone effects are
# removed by zone means, hour and weekday dummies by Gauss-Jordan elimination, and what is
# left of the interaction and of the outcome gives the coefficient and its HC1 error.
OTHERS = 1 + 23 + 6
CTES["did_rows"] = " UNION ALL ".join(
    f"SELECT '{m}' AS metric_name, zone_id, trip_date, hour, weekday, "
    f"(zone_group = 'treated_zones')::INTEGER AS treated, post_policy::INTEGER AS post, "
    f"{m}::DOUBLE AS y FROM panel WHERE zone_group IN ('treated_zones', 'control_zones') "
    f"AND {m} IS NOT NULL"
    for m in (
        "log_order_count", "avg_fare_per_mile", "avg_driver_pay_per_minute",
        "avg_response_time_min",
    )
)
CTES["did_long"] = f"""
SELECT metric_name, id, zone_id, k, v - avg(v) OVER (PARTITION BY metric_name, zone_id, k) AS v
FROM (SELECT metric_name, id, zone_id, unnest(range(1, {OTHERS + 3})) AS k, unnest(
  list_concat([post::DOUBLE], [(hour = h)::INTEGER::DOUBLE for h in range(1, 24)],
    [(weekday = d)::INTEGER::DOUBLE for d in range(1, 7)], [(treated * post)::DOUBLE, y])) AS v
FROM (SELECT *, row_number() OVER (ORDER BY metric_name, zone_id, trip_date, hour) AS id
  FROM did_rows))"""
CTES["did_gram"] = f"""
SELECT metric_name, list(line ORDER BY i) AS m FROM (
SELECT metric_name, i, list(v ORDER BY j) AS line FROM (
SELECT a.metric_name, a.k AS i, b.k AS j, sum(a.v * b.v) AS v
FROM did_long a JOIN did_long b ON a.id = b.id WHERE a.k <= {OTHERS} GROUP BY ALL)
GROUP BY metric_name, i) GROUP BY metric_name"""
CTES["did_sweep"] = f"""
SELECT metric_name, 1 AS k, m FROM did_gram
UNION ALL SELECT metric_name, k + 1, [CASE WHEN abs(m[k][k]) < 1e-9 THEN m[i]
  WHEN i = k THEN [x / m[k][k] for x in m[k]]
  ELSE [m[i][j] - m[i][k] * m[k][j] / m[k][k] for j in range(1, {OTHERS + 3})] END
  for i in range(1, {OTHERS + 1})]
FROM did_sweep WHERE k <= {OTHERS}"""
CTES["did_left"] = f"""
SELECT w.metric_name, w.zone_id,
  list_extract(w.vs, {OTHERS + 1}) - list_sum([w.vs[i] * s.m[i][{OTHERS + 1}]
    for i in range(1, {OTHERS + 1})]) AS x,
  list_extract(w.vs, {OTHERS + 2}) - list_sum([w.vs[i] * s.m[i][{OTHERS + 2}]
    for i in range(1, {OTHERS + 1})]) AS y
FROM (SELECT metric_name, id, zone_id, list(v ORDER BY k) AS vs FROM did_long GROUP BY ALL) w
JOIN did_sweep s ON s.metric_name = w.metric_name AND s.k = {OTHERS + 1}"""
CTES["did_fit"] = f"""
SELECT metric_name, b AS coef_treated_post, se AS std_error,
  CASE WHEN abs(b / se) > 6 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum([
    (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow(abs(b / se) / sqrt(2), 2 * n + 1)
    / (gamma(n + 1) * (2 * n + 1)) for n in range(0, 90)]) END AS p_value,
  b - 1.959963984540054e0 * se AS confidence_interval_low,
  b + 1.959963984540054e0 * se AS confidence_interval_high, rows AS n_observations FROM (
SELECT metric_name, any_value(b) AS b, count(*) AS rows,
  sqrt(sum(x * x * (y - b * x) ** 2) / sum(x * x) ** 2 * count(*)
    / (count(*) - count(DISTINCT zone_id) - {OTHERS} - 1)) AS se
FROM did_left JOIN (SELECT metric_name, sum(x * y) / sum(x * x) AS b FROM did_left
  GROUP BY metric_name) USING (metric_name) GROUP BY metric_name)"""

ROUTE_ORDER = (
    "final_action_score DESC, pickup_zone_name, dropoff_zone_name, is_airport_trip, "
    "is_cross_treated_trip"
)
HOUR_WINDOW = "printf('%02d:00-%02d:00', hour::INTEGER, ((hour + 4) % 24)::INTEGER)"
RULE_SUPPLY = "zone_group = 'spillover_zones' AND spillover_score > 0"
RULE_ROUTE = (
    "trip_count_post > 0 AND (is_airport_trip OR trip_count_post >= "
    "(SELECT quantile_cont(trip_count_post, 0.75) FROM rscores))"
)
RULE_DISCOUNT = "demand_gap_rate > 0 AND fare_per_mile_change_rate > 0"


def _pick(source, rule, order, k, spare_rule, spare_order, spare_k) -> str:
    return f"""
SELECT * FROM (SELECT * FROM {source} WHERE {rule} ORDER BY {order} LIMIT {k})
UNION ALL SELECT * FROM (SELECT * FROM {source} WHERE {spare_rule}
  AND NOT EXISTS (SELECT 1 FROM {source} WHERE {rule}) ORDER BY {spare_order} LIMIT {spare_k})"""


CTES["supply"] = _pick(
    "zscores", RULE_SUPPLY, "final_action_score DESC, zone_id", 8,
    "true", "spillover_score DESC, zone_id", 3,
)
CTES["incentives"] = _pick(
    "rscores", f"{RULE_ROUTE} AND driver_pressure_score > 0", ROUTE_ORDER, 12,
    RULE_ROUTE, ROUTE_ORDER, 6,
)
CTES["discounts"] = _pick(
    "zscores", RULE_DISCOUNT, "final_action_score DESC, zone_id", 8,
    "demand_gap > 0", "final_action_score DESC, zone_id", 5,
)
CTES["weak"] = """
SELECT * FROM zscores WHERE zone_group = 'other' AND driver_pay_per_minute_change_rate < 0
ORDER BY final_action_score, zone_id LIMIT 2"""


def _num(key: str, value: str, label: str) -> str:
    shown = f"printf('%.1f%%', {value} * 100)" if "rate" in key else f"printf('%.3f', {value})"
    return f"'{label}：' || {shown}"


TEXT = {
    "spillover_score": ("round(spillover_score, 3)", "外溢评分"),
    "demand_gap_rate": ("round(demand_gap_rate, 3)", "需求缺口率"),
    "post_policy_average_orders": ("round(order_count_post, 2)", "政策后平均订单"),
    "response_time_p90_change_min": (
        "round(response_time_p90_change, 2)", "P90 响应时长变化（分钟）",
    ),
    "slow_response_rate_change": ("round(slow_response_rate_change, 3)", "慢响应占比变化"),
    "zone_pay": ("round(driver_pay_per_minute_change_rate, 3)", "每分钟司机收入变化率"),
    "fare_rate": ("round(fare_per_mile_change_rate, 3)", "每英里票价变化率"),
    "toll_rate": ("round(tolls_per_trip_change_rate, 3)", "通行费变化率"),
}


def _text(*keys: str) -> str:
    parts = []
    for key in keys:
        if key == "orders":
            parts.append("'政策后订单量：' || trip_count_post::VARCHAR")
            continue
        value, label = TEXT[key]
        parts.append(_num("rate" if key == "zone_pay" else key, value, label))
    return " || '；' || ".join(parts)


def _card(place, source, k, order, kind, zone, window, problem, text, action, impact, sample,
          signals) -> str:
    high = f"WHEN {sample} >= 200 THEN 'High'" if signals >= 3 else ""
    where = {
        "route_level_driver_incentive": "WHERE NOT is_airport_trip",
        "airport_route_strategy": "WHERE is_airport_trip",
    }.get(kind, "")
    ends = (
        "zone_name AS target_zone, zone_group AS target_zone_group, '' AS target_od_pair"
        if zone
        else "'' AS target_zone, '' AS target_zone_group, "
        "pickup_zone_name || ' -> ' || dropoff_zone_name AS target_od_pair"
    )
    return f"""
SELECT {place} AS branch, row_number() OVER (ORDER BY {order}) AS place,
  '{kind}' AS strategy_type, {ends}, {window} AS target_time_window,
  '{problem}' AS problem_detected, {text} AS evidence_text, '{action}' AS recommended_action,
  '{impact}' AS expected_business_impact, round(final_action_score, 3) AS final_action_score,
  CASE WHEN final_action_score >= 0.75e0 THEN 'High' WHEN final_action_score >= 0.45e0
    THEN 'Medium' ELSE 'Low' END AS priority,
  CASE {high} WHEN {sample} >= 50 THEN 'Medium' ELSE 'Low' END AS confidence_level
FROM (SELECT * FROM {source} {where} ORDER BY {order} LIMIT {k})"""


def _cards() -> str:
    from curbflow import labels as L

    supply_order = (
        f"CASE WHEN {RULE_SUPPLY} THEN final_action_score ELSE spillover_score END DESC, zone_id"
    )
    zone_order = "final_action_score DESC, zone_id"
    rows = [
        _card(1, "supply", 3, supply_order, "driver_supply_reallocation", True, HOUR_WINDOW,
              L.PROBLEM_SUPPLY,
              _text("spillover_score", "demand_gap_rate", "post_policy_average_orders",
                    "response_time_p90_change_min", "slow_response_rate_change"),
              L.SUPPLY_ACTION, L.SUPPLY_IMPACT, "order_count_post", 3),
        _card(2, "incentives", 2, ROUTE_ORDER, "route_level_driver_incentive", False,
              f"'{L.WINDOW_ROUTE}'", L.PROBLEM_ROUTE,
              _text("orders", "toll_rate", "zone_pay", "fare_rate"),
              L.INCENTIVE_ACTION, L.INCENTIVE_IMPACT, "trip_count_post", 3),
        _card(3, "incentives", 2, ROUTE_ORDER, "airport_route_strategy", False,
              f"'{L.WINDOW_AIRPORT}'", L.PROBLEM_AIRPORT, _text("orders", "toll_rate", "zone_pay"),
              L.AIRPORT_CARD_ACTION, L.AIRPORT_CARD_IMPACT, "trip_count_post", 3),
        _card(4, "discounts", 2, zone_order, "passenger_discount", True, HOUR_WINDOW,
              L.PROBLEM_DISCOUNT, _text("demand_gap_rate", "fare_rate", "zone_pay"),
              L.DISCOUNT_ACTION, L.DISCOUNT_IMPACT, "actual_order_count", 3),
        _card(5, "supply", 2, supply_order, "boundary_zone_strategy", True, HOUR_WINDOW,
              L.PROBLEM_BOUNDARY,
              _text("spillover_score", "post_policy_average_orders",
                    "response_time_p90_change_min"),
              L.BOUNDARY_ACTION, L.BOUNDARY_IMPACT, "order_count_post", 3),
        _card(6, "weak", 2, "final_action_score, zone_id", "reduce_low_value_supply", True,
              HOUR_WINDOW, L.PROBLEM_LOW_VALUE,
              _text("zone_pay", "spillover_score", "demand_gap_rate"),
              L.LOW_VALUE_ACTION, L.LOW_VALUE_IMPACT, "order_count_post", 2),
    ]
    stacked = " UNION ALL ".join(f"({row})" for row in rows)
    return (
        "SELECT 'STRAT_' || lpad((row_number() OVER (ORDER BY branch, place))::VARCHAR, 4, '0') "
        f"AS strategy_id, * EXCLUDE (branch, place) FROM ({stacked})"
    )


CTES["cards"] = _cards()


def build(body: str) -> str:
    """Prefix ``body`` with every shared relation it needs, in dependency order."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        words = set(re.findall(r"[a-z_0-9]+", pending.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            pending.append(CTES[name])
    parts = [f"{name} AS ({text.strip()})" for name, text in CTES.items() if name in needed]
    recursive = "RECURSIVE " if "did_sweep" in needed else ""
    return f"WITH {recursive}{', '.join(parts)} {body}" if parts else body
