"""Normalisation of raw trips and the three cleaning contracts.

``standard``  keeps every row and labels the first broken rule,
``policy``    keeps only rows fit for the policy metrics,
``dwd``       the strict warehouse filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.functions.columns import MICROS_PER_MINUTE, micros_sql, minutes_sql
from curbflow.spec import TripRules

YELLOW, RIDE_HAILING = "yellow_taxi", "high_volume_fhv"


@dataclass(frozen=True)
class Target:
    """One canonical column: its type, the raw column and what fills a gap."""

    name: str
    type: str
    raw: str | None = None
    default: float | None = None

    def sql(self, available: Sequence[str]) -> str:
        """Typed expression; text that does not parse becomes NULL, and so does NaN.

        Spark orders NaN above every number, so a NaN left in place would break
        rules that must ignore missing values.
        """
        gap = "NULL" if self.default is None else f"{self.default}"
        gap = f"CAST({gap} AS {self.type})"
        if self.raw is None or self.raw not in available:
            return f"{gap} AS {self.name}"
        value = f"try_cast(`{self.raw}` AS {self.type})"
        if self.type == "double":
            value = f"nanvl({value}, CAST(NULL AS DOUBLE))"
        if self.default is not None:
            value = f"coalesce({value}, {gap})"
        return f"{value} AS {self.name}"


# Canonical schemas and the raw column behind each of their columns.
STANDARD_TARGETS = {
    YELLOW: (
        Target("pickup_datetime", "timestamp_ntz", "tpep_pickup_datetime"),
        Target("dropoff_datetime", "timestamp_ntz", "tpep_dropoff_datetime"),
        Target("pickup_location_id", "int", "PULocationID"),
        Target("dropoff_location_id", "int", "DOLocationID"),
        Target("trip_distance", "double", "trip_distance"),
        Target("fare_amount", "double", "fare_amount"),
        Target("total_amount", "double", "total_amount"),
        Target("driver_pay", "double"),
        Target("tips", "double", "tip_amount"),
        Target("payment_type", "int", "payment_type"),
        Target("shared_match_flag", "string"),
        Target("wav_request_flag", "string"),
    ),
    RIDE_HAILING: (
        Target("pickup_datetime", "timestamp_ntz", "pickup_datetime"),
        Target("dropoff_datetime", "timestamp_ntz", "dropoff_datetime"),
        Target("pickup_location_id", "int", "PULocationID"),
        Target("dropoff_location_id", "int", "DOLocationID"),
        Target("trip_distance", "double", "trip_miles"),
        Target("fare_amount", "double", "base_passenger_fare"),
        Target("total_amount", "double", "base_passenger_fare"),
        Target("driver_pay", "double", "driver_pay"),
        Target("tips", "double", "tips"),
        Target("payment_type", "int"),
        Target("shared_match_flag", "string", "shared_match_flag"),
        Target("wav_request_flag", "string", "wav_request_flag"),
    ),
}
POLICY_TARGETS = {
    YELLOW: (
        Target("request_datetime", "timestamp_ntz"),
        Target("on_scene_datetime", "timestamp_ntz"),
        Target("pickup_datetime", "timestamp_ntz", "tpep_pickup_datetime"),
        Target("dropoff_datetime", "timestamp_ntz", "tpep_dropoff_datetime"),
        Target("pickup_location_id", "int", "PULocationID"),
        Target("dropoff_location_id", "int", "DOLocationID"),
        Target("trip_miles", "double", "trip_distance"),
        Target("base_passenger_fare", "double", "fare_amount"),
        Target("total_amount", "double", "total_amount"),
        Target("driver_pay", "double"),
        Target("tips", "double", "tip_amount", 0.0),
        Target("tolls", "double", "tolls_amount", 0.0),
        Target("congestion_surcharge", "double", "congestion_surcharge", 0.0),
        Target("cbd_congestion_fee", "double", "cbd_congestion_fee", 0.0),
        Target("airport_fee", "double", "Airport_fee", 0.0),
    ),
    RIDE_HAILING: (
        Target("request_datetime", "timestamp_ntz", "request_datetime"),
        Target("on_scene_datetime", "timestamp_ntz", "on_scene_datetime"),
        Target("pickup_datetime", "timestamp_ntz", "pickup_datetime"),
        Target("dropoff_datetime", "timestamp_ntz", "dropoff_datetime"),
        Target("pickup_location_id", "int", "PULocationID"),
        Target("dropoff_location_id", "int", "DOLocationID"),
        Target("trip_miles", "double", "trip_miles"),
        Target("base_passenger_fare", "double", "base_passenger_fare"),
        Target("total_amount", "double", "base_passenger_fare"),
        Target("driver_pay", "double", "driver_pay"),
        Target("tips", "double", "tips", 0.0),
        Target("tolls", "double", "tolls", 0.0),
        Target("congestion_surcharge", "double", "congestion_surcharge", 0.0),
        Target("cbd_congestion_fee", "double", "cbd_congestion_fee", 0.0),
        Target("airport_fee", "double", "airport_fee", 0.0),
    ),
}
STANDARD_ORDER = (
    "service_type", "pickup_datetime", "dropoff_datetime", "pickup_date", "pickup_hour",
    "pickup_weekday", "pickup_month", "pickup_location_id", "dropoff_location_id",
    "trip_distance", "trip_duration_min", "fare_amount", "total_amount", "driver_pay", "tips",
    "payment_type", "shared_match_flag", "wav_request_flag", "is_valid_trip", "invalid_reason",
)


def _project(raw: DataFrame, service: str, targets: Sequence[Target]) -> DataFrame:
    available = raw.columns
    extra = ["source_trip_id"] if "source_trip_id" in available else []
    columns = [target.sql(available) for target in targets]
    return raw.selectExpr(f"'{service}' AS service_type", *columns, *extra)


def validity_rules(rules: TripRules) -> list[tuple[str, str]]:
    """Ordered (reason, predicate) pairs of the standard contract."""
    return [
        ("missing_time", "pickup_datetime IS NULL OR dropoff_datetime IS NULL"),
        ("non_positive_duration", "trip_duration_min <= 0"),
        ("duration_over_8h", f"trip_duration_min > {rules.max_trip_hours * 60}"),
        (
            "non_positive_distance",
            f"trip_distance IS NULL OR trip_distance <= {rules.min_trip_miles}D",
        ),
        ("distance_over_200", f"trip_distance > {rules.max_trip_miles}"),
        ("missing_zone", "pickup_location_id IS NULL OR dropoff_location_id IS NULL"),
        ("negative_fare", f"fare_amount < {rules.min_fare_amount}"),
        ("total_amount_over_1000", f"total_amount > {rules.max_total_amount}"),
    ]


def standard_trips(raw: DataFrame, service: str, rules: TripRules | None = None) -> DataFrame:
    """All rows in the standard schema with the first broken rule as ``invalid_reason``."""
    branches = " ".join(
        f"WHEN {predicate} THEN '{reason}'"
        for reason, predicate in validity_rules(rules or TripRules())
    )
    minutes = minutes_sql("pickup_datetime", "dropoff_datetime")
    return (
        _project(raw, service, STANDARD_TARGETS[service])
        .selectExpr(
            "*",
            f"{minutes} AS trip_duration_min",
            "to_date(pickup_datetime) AS pickup_date",
            "hour(pickup_datetime) AS pickup_hour",
            "weekday(pickup_datetime) AS pickup_weekday",
            "date_format(pickup_datetime, 'yyyy-MM') AS pickup_month",
        )
        .selectExpr("*", f"CASE {branches} END AS invalid_reason")
        .selectExpr("*", "invalid_reason IS NULL AS is_valid_trip")
        .select(*STANDARD_ORDER)
    )


def _pushdown_guard(raw: DataFrame, service: str, rules: TripRules) -> DataFrame:
    """Repeat the policy bounds on bare raw columns so that they reach the Parquet scan.

    Only for columns already stored as numbers; NaN lies above every bound, so the
    outcome equals the check on the cleaned column.
    """
    types = dict(raw.dtypes)
    bounds = {
        "trip_miles": (rules.min_trip_miles, rules.max_trip_miles),
        "base_passenger_fare": (rules.min_fare_amount, None),
    }
    for target in POLICY_TARGETS[service]:
        numeric = types.get(target.raw) in ("double", "float", "int", "bigint")
        if target.name not in bounds or not numeric:
            continue
        low, high = bounds[target.name]
        raw = raw.where(F.col(target.raw) >= low)
        if high is not None:
            raw = raw.where(F.col(target.raw) <= high)
    return raw


def policy_trips(raw: DataFrame, service: str, rules: TripRules | None = None) -> DataFrame:
    """Rows fit for policy metrics, with trip minutes and the response proxies."""
    rules = rules or TripRules()
    trips = _project(_pushdown_guard(raw, service, rules), service, POLICY_TARGETS[service])
    minutes = minutes_sql("pickup_datetime", "dropoff_datetime")
    kept = trips.selectExpr("*", f"{minutes} AS trip_time").where(
        f"""pickup_datetime IS NOT NULL AND dropoff_datetime IS NOT NULL
        AND pickup_location_id IS NOT NULL AND dropoff_location_id IS NOT NULL
        AND trip_miles BETWEEN {rules.min_trip_miles}D AND {rules.max_trip_miles}D
        AND trip_time BETWEEN 1D AND {rules.max_trip_hours * 60}D
        AND base_passenger_fare >= {rules.min_fare_amount}D"""
    )
    return response_proxies(kept)


def response_proxies(trips: DataFrame, longest_min: int = 240, slow_min: int = 10) -> DataFrame:
    """Request-to-arrival and request-to-pickup minutes; impossible values become NULL.

    ``response_us`` keeps the exact microseconds for the quantile operators.
    """
    limit = longest_min * MICROS_PER_MINUTE
    arrival = micros_sql("request_datetime", "on_scene_datetime")
    wait = micros_sql("request_datetime", "pickup_datetime")
    return trips.selectExpr(
        "*",
        f"CASE WHEN {arrival} BETWEEN 0 AND {limit} THEN {arrival} END AS response_us",
        f"CASE WHEN {wait} BETWEEN 0 AND {limit} THEN {wait} / {MICROS_PER_MINUTE}D END "
        "AS pickup_wait_proxy_min",
    ).selectExpr(
        "*",
        f"response_us / {MICROS_PER_MINUTE}D AS response_time_min",
        f"coalesce(response_us / {MICROS_PER_MINUTE}D > {slow_min}, false) AS slow_response_flag",
    )


def strict_filter(trips: DataFrame) -> DataFrame:
    """Warehouse contract: positive miles and fare, non-negative pay, forward time."""
    return trips.where(
        (F.col("trip_miles") > 0)
        & (F.col("base_passenger_fare") > 0)
        & (F.col("driver_pay") >= 0)
        & (F.col("dropoff_datetime") > F.col("pickup_datetime"))
    )


def union_services(*frames: DataFrame) -> DataFrame:
    """Stack services or months by column name; missing columns become NULL."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def prune_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL in any listed column."""
    return df.dropna(subset=list(columns))
