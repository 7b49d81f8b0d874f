"""Metric tables over the standard trips and the warehouse trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.functions.columns import MICROS_PER_MINUTE, cut, null_safe_join, zero
from curbflow.functions.quantiles import exact_quantiles
from curbflow.labels import DISTANCE_GROUP_CUTS, MART_HOUR_CUTS

HOURLY_KEYS = ["service_type", "pickup_date", "pickup_hour", "pickup_weekday", "pickup_month"]
ZONE_HOURLY_KEYS = ["service_type", "pickup_date", "pickup_hour", "pickup_location_id"]
FLOW_KEYS = ["service_type", "pickup_location_id", "dropoff_location_id"]
ROUTE_KEYS = ["pickup_zone", "dropoff_zone", "pickup_borough", "dropoff_borough"]
# Additive column -> trip column.
SUMS = {
    "distance_sum": "trip_distance",
    "duration_sum": "trip_duration_min",
    "fare_sum": "fare_amount",
    "tips_sum": "tips",
    "driver_pay_sum": "driver_pay",
}


def _demand(standard: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Counts and sums of valid trips, then ratios of the sums."""
    totals = (
        standard.where("is_valid_trip")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("trip_count"),
            *[zero(F.sum(SUMS[name])).alias(name) for name in sums],
        )
    )
    return demand_ratios(totals)


def demand_ratios(totals: DataFrame) -> DataFrame:
    """Means and fares per mile from counts and sums."""
    return totals.withColumns(
        {
            "avg_distance": F.col("distance_sum") / F.col("trip_count"),
            "avg_duration_min": F.col("duration_sum") / F.col("trip_count"),
            "avg_fare": F.col("fare_sum") / F.col("trip_count"),
            "fare_per_mile": F.try_divide("fare_sum", "distance_sum"),
        }
    )


def hourly_demand(standard: DataFrame) -> DataFrame:
    return _demand(standard, HOURLY_KEYS, list(SUMS))


def calendar_demand(standard: DataFrame, zones: DataFrame) -> DataFrame:
    """Valid trips by hour of day, weekday and borough: a few thousand cells from one pass.

    The aggregation runs on zone ids, boroughs join afterwards.
    """
    sums = ["distance_sum", "duration_sum", "fare_sum"]
    cells = _demand(standard, ["pickup_hour", "pickup_weekday", "pickup_location_id"], sums)
    boroughs = zones.select(
        F.col("zone_id").alias("pickup_location_id"), F.col("borough").alias("pickup_borough")
    )
    return (
        cells.join(boroughs, "pickup_location_id", "left")
        .groupBy("pickup_hour", "pickup_weekday", "pickup_borough")
        .agg(*[F.sum(name).alias(name) for name in ("trip_count", *sums)])
    )


def zone_hourly_demand(standard: DataFrame, zones: DataFrame) -> DataFrame:
    demand = _demand(standard, ZONE_HOURLY_KEYS, ["distance_sum", "duration_sum", "fare_sum"])
    return with_pickup_zones(demand, zones)


def with_pickup_zones(demand: DataFrame, zones: DataFrame) -> DataFrame:
    extra = (
        [F.col("service_zone").alias("pickup_service_zone")]
        if "service_zone" in zones.columns
        else []
    )
    attributes = zones.select(
        F.col("zone_id").alias("pickup_location_id"),
        F.col("borough").alias("pickup_borough"),
        F.col("zone_name").alias("pickup_zone"),
        *extra,
    )
    return demand.join(attributes, "pickup_location_id", "left")


def od_flows(standard: DataFrame) -> DataFrame:
    return _demand(standard, FLOW_KEYS, ["distance_sum", "duration_sum", "fare_sum"])


def top_od_flows(standard: DataFrame, k: int = 5000) -> DataFrame:
    return top_k(od_flows(standard), "trip_count", FLOW_KEYS, k)


def invalid_reason_summary(standard: DataFrame) -> DataFrame:
    return (
        standard.where(~F.col("is_valid_trip"))
        .groupBy("service_type", "invalid_reason")
        .agg(F.count(F.lit(1)).alias("record_count"))
    )


def top_k(df: DataFrame, measure: str, ties: list[str], k: int, smallest: bool = False):
    """k largest (or smallest) rows; missing measures come last, ties break by key."""
    first = (
        F.col(measure).asc_nulls_last() if smallest else F.col(measure).desc_nulls_last()
    )
    return df.orderBy(first, *[F.col(c).asc_nulls_first() for c in ties]).limit(k)


def time_demand_metrics(dwd: DataFrame) -> DataFrame:
    return (
        dwd.groupBy("trip_date", "trip_hour", "weekday", "is_weekend")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.avg("trip_miles").alias("avg_trip_miles"),
            F.avg("base_passenger_fare").alias("avg_base_passenger_fare"),
            F.avg("driver_pay").alias("avg_driver_pay"),
        )
        .withColumnsRenamed({"trip_date": "date", "trip_hour": "hour"})
    )


def pickup_zone_metrics(dwd: DataFrame) -> DataFrame:
    return dwd.groupBy("pickup_zone", "pickup_borough").agg(
        F.count(F.lit(1)).alias("pickup_order_count"),
        F.avg("fare_per_mile").alias("avg_fare_per_mile"),
        F.avg("driver_pay_per_minute").alias("avg_driver_pay_per_minute"),
        F.avg("response_time_min").alias("avg_response_time_min"),
    )


def dropoff_zone_counts(dwd: DataFrame) -> DataFrame:
    return dwd.groupBy("dropoff_zone", "dropoff_borough").agg(
        F.count(F.lit(1)).alias("dropoff_order_count")
    )


def zone_demand_metrics(dwd: DataFrame) -> DataFrame:
    """Pickup and dropoff sides of each zone; the unknown zone matches itself."""
    pickup, dropoff = pickup_zone_metrics(dwd), dropoff_zone_counts(dwd)
    same_zone = F.col("pickup_zone").eqNullSafe(F.col("dropoff_zone")) & F.col(
        "pickup_borough"
    ).eqNullSafe(F.col("dropoff_borough"))
    return pickup.join(dropoff, same_zone, "full")


def od_route_metrics(dwd: DataFrame) -> DataFrame:
    return dwd.groupBy(*ROUTE_KEYS).agg(
        F.count(F.lit(1)).alias("order_count"),
        F.avg("trip_miles").alias("avg_trip_miles"),
        F.avg("trip_time_min").alias("avg_trip_time_min"),
        F.avg("base_passenger_fare").alias("avg_base_passenger_fare"),
        F.avg("fare_per_mile").alias("avg_fare_per_mile"),
        F.avg("driver_pay").alias("avg_driver_pay"),
        F.avg("driver_pay_per_minute").alias("avg_driver_pay_per_minute"),
        F.avg("response_time_min").alias("avg_response_time_min"),
    )


def price_driver_metrics(dwd: DataFrame) -> DataFrame:
    """Price and pay by distance, hour group and period.

    Pay over fare comes in both published definitions: the ratio of the means and
    the mean of the trip ratios.
    """
    return (
        dwd.withColumns(
            {
                "trip_distance_group": cut("trip_miles", DISTANCE_GROUP_CUTS),
                "hour_group": cut("trip_hour", MART_HOUR_CUTS),
            }
        )
        .dropna(subset=["trip_distance_group", "hour_group"])
        .groupBy("trip_distance_group", "hour_group", "policy_period")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.avg("fare_per_mile").alias("avg_fare_per_mile"),
            F.avg("fare_per_minute").alias("avg_fare_per_minute"),
            F.avg("tolls").alias("avg_tolls"),
            F.avg("cbd_congestion_fee").alias("avg_cbd_congestion_fee"),
            F.avg("driver_pay_per_mile").alias("avg_driver_pay_per_mile"),
            F.avg("driver_pay_per_minute").alias("avg_driver_pay_per_minute"),
            F.try_divide(F.avg("driver_pay"), F.avg("base_passenger_fare")).alias(
                "driver_pay_to_fare_ratio"
            ),
            F.avg(F.try_divide("driver_pay", "base_passenger_fare")).alias(
                "mean_trip_pay_to_fare_ratio"
            ),
        )
    )


def price_driver_by_distance(dwd: DataFrame) -> DataFrame:
    """The warehouse variant without hour groups and with the mean of trip ratios."""
    return (
        dwd.withColumn(
            "trip_distance_group",
            F.coalesce(cut("trip_miles", DISTANCE_GROUP_CUTS), F.lit(DISTANCE_GROUP_CUTS[1][2])),
        )
        .groupBy("trip_distance_group", "policy_period")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.avg("fare_per_mile").alias("avg_fare_per_mile"),
            F.avg("fare_per_minute").alias("avg_fare_per_minute"),
            F.avg("tolls").alias("avg_tolls"),
            F.avg("cbd_congestion_fee").alias("avg_cbd_congestion_fee"),
            F.avg("driver_pay_per_mile").alias("avg_driver_pay_per_mile"),
            F.avg("driver_pay_per_minute").alias("avg_driver_pay_per_minute"),
            F.avg(F.try_divide("driver_pay", "base_passenger_fare")).alias(
                "driver_pay_to_fare_ratio"
            ),
        )
    )


def answered(dwd: DataFrame) -> DataFrame:
    return dwd.where(F.col("response_time_min").isNotNull()).withColumnRenamed(
        "trip_hour", "hour"
    )


def response_metrics(dwd: DataFrame) -> DataFrame:
    """Response times per zone and hour with exact quantiles; NULL responses excluded."""
    rows = answered(dwd).withColumn(
        "_us", F.round(F.col("response_time_min") * MICROS_PER_MINUTE).cast("bigint")
    )
    keys = ["pickup_zone", "hour"]
    means = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("order_count"),
        F.avg("response_time_min").alias("avg_response_time_min"),
        F.avg((F.col("response_time_min") > 10).cast("double")).alias("slow_response_rate"),
    )
    spread = exact_quantiles(
        rows, keys, "_us", {"p50_response_time_min": 0.5, "p90_response_time_min": 0.9},
        scale=MICROS_PER_MINUTE,
    )
    return null_safe_join(means, spread, keys)
