"""Row-based demand lags, peaks and shares over the zone-hour panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbflow import labels as L
from curbflow.functions.columns import cut, label_map

HOURS = {"lag_1": 1, "lag_24": 24, "lag_168": 168}


def _series():
    # One zone holds at most one row per calendar hour, whatever its trip count.
    return Window.partitionBy("zone_id").orderBy("trip_date", "hour")


def demand_lags(panel: DataFrame, names: tuple[str, str, str], value: str = "order_count"):
    """Lags of 1, 24 and 168 rows; a missing longer lag falls back to the shorter one."""
    series = _series()
    short, day, week = (F.lag(value, n).over(series) for n in HOURS.values())
    return panel.withColumns(
        {
            names[0]: short,
            names[1]: F.coalesce(day, short),
            names[2]: F.coalesce(week, day, short),
        }
    )


def rolling_means(panel: DataFrame, value: str = "order_count") -> DataFrame:
    """Mean of the previous 3 and 24 rows, the current row excluded."""
    series = _series()
    return panel.withColumns(
        {
            f"rolling_{n}_hour_order_count": F.avg(value).over(series.rowsBetween(-n, -1))
            for n in (3, 24)
        }
    )


def peak_hour(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Hour with most orders per key; the earlier hour wins a tie."""
    hourly = panel.groupBy(*keys, "hour").agg(F.sum("order_count").alias("orders"))
    best = F.max_by("hour", F.struct("orders", (-F.col("hour")).alias("earlier")))
    return hourly.groupBy(*keys).agg(best.alias("hour"), F.max("orders").alias("peak_orders"))


def monthly_group_share(panel: DataFrame) -> DataFrame:
    """Share of each zone group in the orders of its month, in percent."""
    monthly = (
        panel.withColumn("month", F.date_format("trip_date", "yyyy-MM"))
        .groupBy("month", "zone_group")
        .agg(F.sum("order_count").alias("order_count"))
    )
    total = F.sum("order_count").over(Window.partitionBy("month"))
    return monthly.withColumns(
        {
            "monthly_share": F.col("order_count") / total * 100,
            "zone_group": label_map("zone_group", L.ZONE_GROUP_LABELS),
        }
    )


def weekday_window_share(panel: DataFrame) -> DataFrame:
    """Seven weekday rows by six window columns; each row sums to 100 (or is all zero)."""
    spark = panel.sparkSession
    names = L.DASHBOARD_WINDOW_CUTS[1]
    window = cut("hour", L.DASHBOARD_WINDOW_CUTS)
    totals = panel.groupBy("weekday").agg(
        *[
            F.sum(F.when(window == name, F.col("order_count")).otherwise(0)).alias(f"w{i}")
            for i, name in enumerate(names)
        ]
    )
    days = spark.range(7).select(F.col("id").cast("int").alias("weekday"))
    grid = days.join(totals, "weekday", "left").na.fill(0)
    whole = sum((F.col(f"w{i}") for i in range(len(names))), F.lit(0))
    shares = [
        F.coalesce(F.try_divide(F.col(f"w{i}"), whole), F.lit(0.0)).alias(f"share_{i}") * 100
        for i in range(len(names))
    ]
    labels = F.array(*[F.lit(x) for x in L.WEEKDAY_LABELS])
    return grid.select(
        "weekday",
        F.element_at(labels, F.col("weekday") + 1).alias("weekday_label"),
        *[share.alias(f"share_{i}") for i, share in enumerate(shares)],
    )
