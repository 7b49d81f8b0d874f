"""Geographic and policy features per trip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.functions.columns import is_true
from curbflow.functions.numbering import dense_numbers
from curbflow.labels import POST, PRE
from curbflow.spec import PolicySpec

GROUPS = ("treated", "spillover", "control")
# Column order of the warehouse trip table.
DWD_ORDER = (
    "trip_id", "request_datetime", "on_scene_datetime", "pickup_datetime", "dropoff_datetime",
    "trip_date", "trip_hour", "weekday", "is_weekend", "pickup_location_id",
    "dropoff_location_id", "pickup_zone", "dropoff_zone", "pickup_borough", "dropoff_borough",
    "trip_miles", "trip_time_min", "base_passenger_fare", "tolls", "congestion_surcharge",
    "cbd_congestion_fee", "airport_fee", "driver_pay", "fare_per_mile", "fare_per_minute",
    "driver_pay_per_mile", "driver_pay_per_minute", "response_time_min", "is_airport_trip",
    "is_core_zone_trip", "is_boundary_zone_trip", "policy_period",
)


def zone_groups(zones: DataFrame, spec: PolicySpec) -> DataFrame:
    """Zone dimension with its policy group and airport flag.

    The lookup by name happens once per zone here and not once per trip.
    """
    group = F.lit("other")
    for name, members in spec.zone_groups.items():
        group = F.when(F.col("zone_name").isin(*members), name).otherwise(group)
    return zones.select(
        "zone_id",
        "zone_name",
        "borough",
        group.alias("zone_group"),
        is_true(F.col("zone_name").isin(*spec.airport_zone_names)).alias("is_airport"),
    )


def _role(dimension: DataFrame, role: str) -> DataFrame:
    return dimension.select(
        F.col("zone_id").alias(f"{role}_location_id"),
        F.col("zone_name").alias(f"{role}_zone_name"),
        F.col("borough").alias(f"{role}_borough"),
        F.col("zone_group").alias(f"_{role}_group"),
        F.col("is_airport").alias(f"_{role}_airport"),
    )


def calendar(df: DataFrame, spec: PolicySpec) -> DataFrame:
    """Columns that follow from the trip date alone."""
    return df.selectExpr(
        "*",
        "weekday(trip_date) AS weekday",
        "weekday(trip_date) >= 5 AS is_weekend",
        f"trip_date >= DATE '{spec.start_iso}' AS post_policy",
    )


def policy_features(trips: DataFrame, zones: DataFrame, spec: PolicySpec) -> DataFrame:
    """Join the zone dimension in both roles and derive flags, calendar and ratios."""
    dimension = zone_groups(zones, spec)
    joined = trips.join(_role(dimension, "pickup"), "pickup_location_id", "left").join(
        _role(dimension, "dropoff"), "dropoff_location_id", "left"
    )
    grouped = joined.selectExpr(
        "*",
        "coalesce(_pickup_group, 'other') AS pickup_zone_group",
        "coalesce(_dropoff_group, 'other') AS dropoff_zone_group",
        "coalesce(_pickup_airport, false) OR coalesce(_dropoff_airport, false) "
        "AS is_airport_trip",
        f"DATE '{spec.start_iso}' AS policy_date",
        "to_date(pickup_datetime) AS trip_date",
        "hour(pickup_datetime) AS trip_hour",
    ).drop("_pickup_group", "_dropoff_group", "_pickup_airport", "_dropoff_airport")
    flags = [
        f"{role}_zone_group = '{group}_zones' AS is_{role}_{group}"
        for group in GROUPS
        for role in ("pickup", "dropoff")
    ]
    flagged = grouped.selectExpr(
        "*", *flags,
        "(pickup_zone_group = 'treated_zones') != (dropoff_zone_group = 'treated_zones') "
        "AS is_cross_treated_trip",
    )
    return unit_economics(calendar(flagged, spec))


def unit_economics(trips: DataFrame) -> DataFrame:
    """Eight ratios with floored denominators (0.01 mile, 1 minute, 0.01 dollar)."""
    floors = {
        "mile": "greatest(trip_miles, 0.01D)",
        "minute": "greatest(trip_time, 1D)",
        "fare": "greatest(base_passenger_fare, 0.01D)",
    }
    ratios = {
        "fare_per_mile": ("base_passenger_fare", "mile"),
        "fare_per_minute": ("base_passenger_fare", "minute"),
        "driver_pay_per_mile": ("driver_pay", "mile"),
        "driver_pay_per_minute": ("driver_pay", "minute"),
        "tip_rate": ("tips", "fare"),
        "driver_pay_to_fare_ratio": ("driver_pay", "fare"),
        "toll_burden_rate": ("tolls", "fare"),
        "policy_fee_burden_rate": ("(congestion_surcharge + cbd_congestion_fee)", "fare"),
    }
    return trips.selectExpr(
        "*", *[f"{top} / {floors[unit]} AS {name}" for name, (top, unit) in ratios.items()]
    )


def dwd_trips(features: DataFrame) -> DataFrame:
    """Warehouse trip table. The id is the source id, else a hash of the trip columns, which
    equal trips share; ``numbered_trips`` gives every trip its own.
    """
    if "source_trip_id" in features.columns:
        trip_id = F.col("source_trip_id")
    else:
        trip_id = F.xxhash64(
            "service_type", "request_datetime", "pickup_datetime", "dropoff_datetime",
            "pickup_location_id", "dropoff_location_id", "trip_miles", "base_passenger_fare",
            "driver_pay", "tips", "tolls",
        )
    return features.withColumns(
        {
            "trip_id": trip_id,
            "trip_time_min": F.col("trip_time"),
            "policy_period": F.when(F.col("post_policy"), POST).otherwise(PRE),
            "is_core_zone_trip": F.col("is_pickup_treated"),
            "is_boundary_zone_trip": F.col("is_pickup_spillover"),
            "pickup_zone": F.col("pickup_zone_name"),
            "dropoff_zone": F.col("dropoff_zone_name"),
        }
    ).select(*DWD_ORDER)


# Trips are numbered by time, then place, then measures; a source id comes last.
ID_ORDER = (
    "pickup_datetime", "request_datetime", "on_scene_datetime", "dropoff_datetime",
    "pickup_location_id", "dropoff_location_id", "trip_miles", "base_passenger_fare",
    "driver_pay", "tolls",
)


def numbered_trips(dwd: DataFrame) -> DataFrame:
    """The warehouse trip table with ``trip_id`` 1 … n as its key.

    The order is total up to trips that are equal in all columns. Numbers follow the rows that
    are there: a table that grows in the past is numbered anew.
    """
    numbered = dense_numbers(dwd.withColumnRenamed("trip_id", "_source_id"),
                             [*ID_ORDER, "_source_id"], "trip_id")
    return numbered.select(*DWD_ORDER)
