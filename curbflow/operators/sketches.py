"""Stored sketches of response times and of distinct ids, merged to any grain.

A day's sketches are written once; coarser tables merge them and never see the trips again.
Quantiles come from KLL sketches: the rank of an estimate differs from the wanted rank by
``RANK_ERROR`` at most (the error of the given size at 99 % confidence is below a quarter of
that). Distinct counts come from HyperLogLog sketches: an estimate is within
``DISTINCT_ERROR`` of the count (five standard errors of the given size).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.functions.columns import null_safe_join
from curbflow.operators.marts import answered

KLL_SIZE = 800
RANK_ERROR = 0.02
HLL_BITS = 14
DISTINCT_ERROR = 0.04
RESPONSE_GRAIN = ("pickup_zone", "trip_date", "hour")
QUANTILES = {"p50_response_time_min": 0.5, "p90_response_time_min": 0.9}


def response_sketches(dwd: DataFrame, size: int = KLL_SIZE) -> DataFrame:
    """One row per pickup zone, date and hour: counts, sums and a sketch of the response time.

    Partial sketches are merged before the shuffle, so a zone with a third of all trips sends
    one sketch from each task.
    """
    return (
        answered(dwd)
        .groupBy(*RESPONSE_GRAIN)
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.sum("response_time_min").alias("response_sum"),
            F.count_if(F.col("response_time_min") > 10).alias("slow_count"),
            F.kll_sketch_agg_double("response_time_min", size).alias("sketch"),
        )
    )


def merged_responses(
    sketches: DataFrame, keys: Sequence[str], size: int = KLL_SIZE,
    quantiles: Mapping[str, float] = QUANTILES,
) -> DataFrame:
    """Response metrics at the grain of ``keys`` (any of the sketches' keys, or none)."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("order_count").alias("order_count"),
        (F.sum("response_sum") / F.sum("order_count")).alias("avg_response_time_min"),
        (F.sum("slow_count") / F.sum("order_count")).alias("slow_response_rate"),
        F.kll_merge_agg_double("sketch", size).alias("sketch"),
    )
    estimates = [
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name)
        for name, p in quantiles.items()
    ]
    return merged.select(*keys, "order_count", "avg_response_time_min", *estimates,
                         "slow_response_rate")


def rank_errors(
    rows: DataFrame, estimates: DataFrame, keys: Sequence[str], value: str,
    quantiles: Mapping[str, float],
) -> DataFrame:
    """For each key and quantile how far the estimate's rank among the rows is from the
    wanted one: 0 where the rows equal to the estimate span that rank."""
    both = null_safe_join(
        rows.select(*keys, value), estimates.select(*keys, *quantiles), list(keys), "inner"
    )
    shares = both.groupBy(*keys).agg(
        *[F.avg((F.col(value) < F.col(n)).cast("double")).alias(f"_below_{n}") for n in quantiles],
        *[F.avg((F.col(value) <= F.col(n)).cast("double")).alias(f"_upto_{n}") for n in quantiles],
    )
    return shares.select(
        *keys,
        *[
            F.greatest(F.col(f"_below_{n}") - p, p - F.col(f"_upto_{n}"), F.lit(0.0)).alias(n)
            for n, p in quantiles.items()
        ],
    )


# What is counted -> the columns that make up its id.
COUNTED = {
    "pickup_zones": ("pickup_location_id",),
    "routes": ("pickup_location_id", "dropoff_location_id"),
    "trips": ("trip_id",),
}


def _identity(columns: Sequence[str]) -> Column:
    """One bigint for the id; null if a part is null, as such rows are not counted."""
    known = F.lit(True)
    for column in columns:
        known = known & F.col(column).isNotNull()
    return F.when(known, F.xxhash64(*columns))


def distinct_sketches(trips: DataFrame, day: str = "trip_date", bits: int = HLL_BITS) -> DataFrame:
    """One row per day with a sketch of each of ``COUNTED``."""
    return trips.groupBy(day).agg(
        F.count(F.lit(1)).alias("orders"),
        *[F.hll_sketch_agg(_identity(c), bits).alias(name) for name, c in COUNTED.items()],
    )


def merged_distincts(sketches: DataFrame, *keys: Column | str) -> DataFrame:
    """Estimated distinct counts at the grain of ``keys`` (of days), or over all days."""
    return sketches.groupBy(*keys).agg(
        F.sum("orders").alias("orders"),
        *[F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in COUNTED],
    )


def exact_distincts(trips: DataFrame, *keys: Column | str) -> DataFrame:
    """The same counts from the trips, for checks: a shuffle of all ids."""
    return trips.groupBy(*keys).agg(
        *[F.count_distinct(*[F.col(c) for c in columns]).alias(name)
          for name, columns in COUNTED.items()],
    )
