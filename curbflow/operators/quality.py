"""Profiling of raw trips and drop accounting, from a scan or while a layer is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from curbflow import labels as L
from curbflow.functions.columns import clean_double, minutes_sql
from curbflow.operators.cleaning import RIDE_HAILING, YELLOW
from curbflow.spec import TripRules

# Raw columns behind the profile counters of each service.
PROFILE_COLUMNS = {
    YELLOW: ("tpep_pickup_datetime", "tpep_dropoff_datetime", "trip_distance", "fare_amount",
             "total_amount"),
    RIDE_HAILING: ("pickup_datetime", "dropoff_datetime", "trip_miles", "base_passenger_fare",
                   "driver_pay"),
}


def _counted(raw: DataFrame, service: str, rules: TripRules | None):
    """``raw`` with the columns that the counters need, and the counters."""
    rules = rules or TripRules()
    start, end, distance, fare, total = PROFILE_COLUMNS[service]
    trips = raw.withColumns(
        {
            "_start": F.col(start).try_cast("timestamp_ntz"),
            "_end": F.col(end).try_cast("timestamp_ntz"),
            "_miles": clean_double(F.col(distance)),
        }
    ).selectExpr("*", f"{minutes_sql('_start', '_end')} AS _minutes")
    counters = {
        "null_pickup_time": F.col("_start").isNull(),
        "null_dropoff_time": F.col("_end").isNull(),
        "negative_or_zero_duration": F.col("_minutes") <= 0,
        "duration_over_8h": F.col("_minutes") > rules.max_trip_hours * 60,
        "missing_pickup_zone": F.col("PULocationID").isNull(),
        "missing_dropoff_zone": F.col("DOLocationID").isNull(),
        "non_positive_distance": F.col("_miles") <= 0,
        "distance_over_200": F.col("_miles") > rules.max_trip_miles,
    }
    if fare in raw.columns:
        counters["negative_fare"] = clean_double(F.col(fare)) < 0
    if total in raw.columns:
        counters["negative_total_or_pay"] = clean_double(F.col(total)) < 0
    return trips, [
        F.count(F.lit(1)).alias("sample_rows"),
        *[F.count_if(condition).alias(name) for name, condition in counters.items()],
    ]


def quality_profile(raw: DataFrame, service: str, rules: TripRules | None = None) -> DataFrame:
    """One row of counters over the raw trips, in a single pass."""
    trips, counters = _counted(raw, service, rules)
    return trips.agg(F.lit(service).alias("service"), *counters)


@dataclass
class Counters:
    """Counters that fill while a frame is written; ``values`` waits for that write."""

    observation: Observation

    @property
    def values(self) -> dict[str, int]:
        return self.observation.get


def counting(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Counters]:
    """``df``, and its number of rows once it is written. The frame is for one write only."""
    observation = Observation()
    return df.observe(observation, F.count(F.lit(1)).alias(name)), Counters(observation)


def profiling(
    raw: DataFrame, service: str, rules: TripRules | None = None
) -> tuple[DataFrame, Counters]:
    """``raw`` unchanged, and its ``quality_profile`` counters once what follows is written."""
    trips, counters = _counted(raw, service, rules)
    observation = Observation()
    return trips.observe(observation, *counters).select(*raw.columns), Counters(observation)


def profile_row(spark: SparkSession, service: str, counted: Counters, written: int) -> DataFrame | None:
    """The profile as one row, or None if tasks were repeated while it was counted: then the
    counters disagree with the ``written`` rows and the raw trips have to be read again."""
    values = counted.values
    if values["sample_rows"] != written:
        return None
    kinds = ", ".join(f"{name} long" for name in values)
    return spark.createDataFrame([(service, *values.values())], f"service string, {kinds}")


def drop_row(spark: SparkSession, raw_count: int, valid_count: int, source: str) -> DataFrame:
    """The drop summary from counts that are known."""
    known = spark.createDataFrame(
        [(source, raw_count, valid_count)],
        "source_table string, raw_count long, valid_count long",
    )
    return _with_drops(known)


def drop_summary(raw: DataFrame, kept: DataFrame, source: str) -> DataFrame:
    """Raw, valid and dropped counts. The raw count is counted, not assumed."""
    whole = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        kept.agg(F.count(F.lit(1)).alias("valid_count"))
        .select(F.lit(source).alias("source_table"), whole.alias("raw_count"), "valid_count")
        .transform(_with_drops)
    )


def _with_drops(counts: DataFrame) -> DataFrame:
    return (
        counts.withColumn(
            "dropped_count", F.greatest(F.col("raw_count") - F.col("valid_count"), F.lit(0))
        )
        .withColumn("drop_rate", F.coalesce(F.try_divide("dropped_count", "raw_count"), F.lit(0.0)))
        .withColumn("drop_reason", F.lit(L.DROP_REASON))
    )
