"""Zone-hour and origin-destination-hour panels.

Trips are aggregated on integer zone ids, date and hour only; names, groups and
calendar columns follow from these keys and join back after the aggregation, so
the shuffle carries neither strings nor derived columns. The features are read twice, once for
the means and once for the quantiles, so they should be a stored table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.functions.columns import MICROS_PER_MINUTE, null_safe_join
from curbflow.functions.quantiles import exact_quantiles
from curbflow.operators.features import calendar, zone_groups
from curbflow.spec import PolicySpec

HOUR_KEYS = ["pickup_location_id", "trip_date", "trip_hour"]
OD_KEYS = ["pickup_location_id", "dropoff_location_id", "trip_date", "trip_hour"]
# Panel measure -> trip column that is averaged.
SHARED_MEANS = {
    "avg_trip_miles": "trip_miles",
    "avg_trip_time": "trip_time",
    "avg_base_fare": "base_passenger_fare",
    "avg_driver_pay": "driver_pay",
    "avg_tolls": "tolls",
    "avg_cbd_congestion_fee": "cbd_congestion_fee",
    "avg_congestion_surcharge": "congestion_surcharge",
    "avg_policy_fee_burden_rate": "policy_fee_burden_rate",
    "avg_fare_per_mile": "fare_per_mile",
    "avg_driver_pay_per_minute": "driver_pay_per_minute",
    "avg_response_time_min": "response_time_min",
}


def count_where(condition):
    return F.count_if(condition)


def _means():
    return [F.avg(source).alias(name) for name, source in SHARED_MEANS.items()] + [
        F.avg(F.col("slow_response_flag").cast("double")).alias("slow_response_rate"),
        F.count("response_time_min").alias("valid_response_count"),
    ]


def _with_quantiles(
    measures: DataFrame, features: DataFrame, keys: list[str], **probs: float
) -> DataFrame:
    """Adds exact quantiles of the response time.

    They come from counted values, a second read of two columns and the keys: no buffer holds
    a group, so a zone and hour with a third of all trips is spread over all tasks.
    """
    spread = exact_quantiles(features, keys, "response_us", probs, scale=MICROS_PER_MINUTE)
    return null_safe_join(measures, spread, keys)


def _zone_columns(zones: DataFrame, spec: PolicySpec) -> DataFrame:
    return zone_groups(zones, spec).select("zone_id", "zone_name", "borough", "zone_group")


def zone_hour_panel(features: DataFrame, zones: DataFrame, spec: PolicySpec) -> DataFrame:
    """One row per pickup zone, date and hour with 27 measures."""
    miles = F.col("trip_miles")
    measures = features.groupBy(*HOUR_KEYS).agg(
        F.count(F.lit(1)).alias("order_count"),
        F.avg("total_amount").alias("avg_total_amount"),
        *_means(),
        count_where(F.col("is_airport_trip")).alias("airport_trip_count"),
        count_where(miles <= 2).alias("short_trip_count"),
        count_where((miles > 2) & (miles <= 8)).alias("medium_trip_count"),
        count_where(miles > 8).alias("long_trip_count"),
        count_where(F.col("is_pickup_treated")).alias("treated_pickup_count"),
        count_where(F.col("is_dropoff_treated")).alias("treated_dropoff_count"),
        count_where(F.col("is_pickup_spillover")).alias("spillover_pickup_count"),
        count_where(F.col("is_pickup_control")).alias("control_pickup_count"),
    )
    measures = _with_quantiles(
        measures, features, HOUR_KEYS, response_time_p50=0.5, response_time_p90=0.9
    )
    keyed = measures.withColumnsRenamed(
        {"pickup_location_id": "zone_id", "trip_hour": "hour"}
    )
    named = keyed.join(_zone_columns(zones, spec), "zone_id", "left").withColumnRenamed(
        "borough", "pickup_borough"
    )
    return calendar(named, spec).withColumns(
        {
            "zone_group": F.coalesce("zone_group", F.lit("other")),
            "treated_zone": F.coalesce(F.col("zone_group") == "treated_zones", F.lit(False)),
            "log_order_count": F.log1p("order_count"),
        }
    )


def od_hour_panel(features: DataFrame, zones: DataFrame, spec: PolicySpec) -> DataFrame:
    """One row per origin, destination, date and hour."""
    measures = features.groupBy(*OD_KEYS).agg(
        F.count(F.lit(1)).alias("od_order_count"),
        *_means(),
        F.bool_or("is_cross_treated_trip").alias("is_cross_treated_od"),
        F.bool_or("is_airport_trip").alias("is_airport_od"),
    )
    panel = _with_quantiles(measures, features, OD_KEYS, response_time_p90=0.9)
    for role in ("pickup", "dropoff"):
        names = zones.select(
            F.col("zone_id").alias(f"{role}_location_id"),
            F.col("zone_name").alias(f"{role}_zone_name"),
        )
        panel = panel.join(names, f"{role}_location_id", "left")
    return (
        calendar(panel, spec)
        .drop("weekday", "is_weekend")
        .withColumnRenamed("trip_hour", "hour")
    )


def panel_duplicates(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once; empty for a sound panel."""
    return panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def panel_preview(panel: DataFrame, keys: Sequence[str], n: int = 5000) -> DataFrame:
    return panel.orderBy(*keys).limit(n)
