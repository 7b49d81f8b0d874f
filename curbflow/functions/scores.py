"""Min-max scores from one-row scalar subqueries.

The bounds of all metrics come from a single aggregate, evaluated once and
inlined as a scalar: no unpartitioned window and no cross join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDS = "_bounds"


def with_bounds(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """Adds one struct column with ``<name>_lo`` and ``<name>_hi`` for every metric.

    Scores read the struct, so the subquery occurs once in the plan however many
    expressions use it. Drop ``BOUNDS`` after scoring.
    """
    fields = []
    for name, metric in metrics.items():
        fields += [F.min(metric).alias(f"{name}_lo"), F.max(metric).alias(f"{name}_hi")]
    return df.withColumn(BOUNDS, df.agg(F.struct(*fields).alias("bounds")).scalar())


def floored_minmax(metric: Column, name: str, inverted: bool = False) -> Column:
    """Position inside the range, with the range floored at 1e-9."""
    low, high = F.col(f"{BOUNDS}.{name}_lo"), F.col(f"{BOUNDS}.{name}_hi")
    distance = (high - metric) if inverted else (metric - low)
    return distance / F.greatest(high - low, F.lit(1e-9))


def guarded_minmax(metric: Column, name: str) -> Column:
    """0..1 score; a constant metric scores 0.5, or 0 when the constant is zero."""
    low, high = F.col(f"{BOUNDS}.{name}_lo"), F.col(f"{BOUNDS}.{name}_hi")
    # Closeness tolerances 1e-8 absolute and 1e-5 relative.
    constant = F.abs(low - high) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(high)
    flat = F.when(high == 0, F.lit(0.0)).otherwise(F.lit(0.5))
    return F.when(constant, flat).otherwise(F.try_divide(metric - low, high - low))
