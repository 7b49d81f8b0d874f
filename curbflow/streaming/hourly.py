"""The zone-hour panel as a stream over arriving trip files.

Trips are cleaned and joined with the zones as in the batch chain, which works on streams
unchanged. Hours are windows over the pickup time: an hour is written once, when the watermark
has passed its end. Trips that come later than the watermark allows are left out and counted in
the query's progress. The sink is a folder of Parquet files whose log makes every hour appear
exactly once, also after a restart from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from curbflow.operators import cleaning, features
from curbflow.spec import PolicySpec

ALLOWED_DELAY = "1 day"
# Additive measure -> trip column.
SUMS = {
    "miles_sum": "trip_miles",
    "minutes_sum": "trip_time",
    "fare_sum": "base_passenger_fare",
    "driver_pay_sum": "driver_pay",
    "tolls_sum": "tolls",
    "response_sum": "response_time_min",
}


def trip_stream(
    spark: SparkSession, path: str, schema: StructType, files_at_once: int = 8
) -> DataFrame:
    """Trip files of a folder in the order in which they arrive."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    )


def hourly_panel(
    raw: DataFrame, zones: DataFrame, spec: PolicySpec, service: str = cleaning.RIDE_HAILING,
    delay: str = ALLOWED_DELAY,
) -> DataFrame:
    """Counts and sums per pickup zone and hour, from a stream or from a table of raw trips.

    State is one row per zone and open hour; partial sums are combined before the shuffle.
    """
    trips = features.policy_features(cleaning.policy_trips(raw, service, spec.rules), zones, spec)
    timed = trips.withColumn("_at", F.col("pickup_datetime").cast("timestamp"))
    hours = (
        timed.withWatermark("_at", delay)
        .groupBy(F.window("_at", "1 hour").alias("_hour"), "pickup_location_id")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.count("response_time_min").alias("valid_response_count"),
            F.count_if("slow_response_flag").alias("slow_count"),
            F.count_if("is_airport_trip").alias("airport_trip_count"),
            *[F.sum(column).alias(name) for name, column in SUMS.items()],
        )
    )
    start = F.col("_hour.start")
    return hours.select(
        F.col("pickup_location_id").alias("zone_id"), F.to_date(start).alias("trip_date"),
        F.hour(start).alias("hour"), "order_count", "valid_response_count", "slow_count",
        "airport_trip_count", *SUMS,
    )


def panel_means(sums: DataFrame) -> DataFrame:
    """The panel's means from its sums; hours that were written in parts are added first."""
    keys = ["zone_id", "trip_date", "hour"]
    counts = ["order_count", "valid_response_count", "slow_count", "airport_trip_count"]
    total = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*counts, *SUMS)])

    def mean(name: str, over: str = "order_count"):
        return F.try_divide(F.col(name), F.col(over))

    return total.select(
        *keys, "order_count", "valid_response_count", "airport_trip_count",
        mean("miles_sum").alias("avg_trip_miles"), mean("minutes_sum").alias("avg_trip_time"),
        mean("fare_sum").alias("avg_base_fare"), mean("driver_pay_sum").alias("avg_driver_pay"),
        mean("tolls_sum").alias("avg_tolls"),
        mean("response_sum", "valid_response_count").alias("avg_response_time_min"),
        mean("slow_count").alias("slow_response_rate"),
    )


def write_hours(hours: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; a later call with the same folders goes on from there."""
    return (
        hours.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .partitionBy("trip_date").trigger(availableNow=True).start()
    )
