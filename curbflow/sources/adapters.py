"""Stand-in raw inputs derived from the star-schema tables by pure arithmetic."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.spec import PolicySpec


def _names(ids) -> tuple[str, ...]:
    return tuple(f"NATION_{i}" for i in ids)


ADAPTER_SPEC = PolicySpec(
    name="adapter policy",
    start_date=date(2024, 1, 16),
    zone_groups={
        "treated_zones": _names(range(0, 6)),
        "spillover_zones": _names(range(6, 10)),
        "control_zones": _names(range(10, 16)),
    },
    airport_zone_names=_names((20, 21, 22)),
    airport_labels=tuple(
        (name, label)
        for name, label in zip(_names((20, 21, 22)), ("Airport A", "Airport B", "Airport C"))
    ),
    weeks_before=2,
    weeks_after=2,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("zone_id"),
        F.col("n_name").alias("zone_name"),
        F.col("r_name").alias("borough"),
    )


def raw_trips_hv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ride-hailing trips: one per event, pickup zone from the user's nation."""
    events = table(spark, sf_dir, "events")
    customer = table(spark, sf_dir, "customer")
    base = events.join(customer, events.user_id == customer.c_custkey, "left")
    fare = "2.5D + value * 1.5D"
    return base.selectExpr(
        "event_id", "ts", "event_type", "value", "c_nationkey",
        "timestampadd(SECOND, 960, ts) AS pickup_datetime",
    ).selectExpr(
        "event_id AS source_trip_id",
        "ts AS request_datetime",
        """CASE WHEN event_id % 5 = 0 THEN NULL
             WHEN event_id % 331 = 0 THEN timestampadd(SECOND, 18000, ts)
             ELSE timestampadd(SECOND, int(event_id * 13 % 900), ts) END AS on_scene_datetime""",
        "pickup_datetime",
        """CASE WHEN event_id % 83 <> 0 THEN timestampadd(SECOND, int(
             CASE WHEN event_id % 101 = 0 THEN -60 WHEN event_id % 103 = 0 THEN 32400
                  ELSE 30 + event_id * 37 % 5400 END), pickup_datetime) END AS dropoff_datetime""",
        "c_nationkey AS PULocationID",
        "CASE WHEN event_id % 97 <> 0 THEN int((event_id * 7 + 3) % 27) END AS DOLocationID",
        """CASE WHEN event_id % 211 = 0 THEN 250D WHEN event_id % 89 = 0 THEN 0D
             ELSE value / 5D END AS trip_miles""",
        f"""CASE WHEN event_id % 79 = 0 THEN -1D WHEN event_id % 73 = 0 THEN 1500D
             ELSE {fare} END AS base_passenger_fare""",
        f"({fare}) * (0.6D + 0.001D * (event_id % 200)) AS driver_pay",
        "CASE WHEN event_id % 10 = 0 THEN 6.94D ELSE 0D END AS tolls",
        f"CASE WHEN event_type = 'purchase' THEN ({fare}) * 0.15D ELSE 0D END AS tips",
        "CASE WHEN c_nationkey <= 5 THEN 2.75D ELSE 0D END AS congestion_surcharge",
        """CASE WHEN ts >= TIMESTAMP_NTZ '2024-01-16' AND c_nationkey <= 5 THEN 1.5D
             ELSE 0D END AS cbd_congestion_fee""",
        "CASE WHEN c_nationkey IN (20, 21, 22) THEN 2.5D ELSE 0D END AS airport_fee",
        "CASE WHEN event_id % 7 = 0 THEN 'Y' ELSE 'N' END AS shared_match_flag",
        "CASE WHEN event_id % 11 = 0 THEN 'Y' ELSE 'N' END AS wav_request_flag",
    )


def raw_trips_yellow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxi trips: one per order line. ``cbd_congestion_fee`` is absent, as in old files."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    supplier = table(spark, sf_dir, "supplier")
    # Orders meet their customers first, so the lines, the most rows, are not shuffled for them.
    placed = orders.join(customer, orders.o_custkey == customer.c_custkey)
    joined = line.join(placed, line.l_orderkey == placed.o_orderkey).join(
        supplier, line.l_suppkey == supplier.s_suppkey
    )
    fare = "l_extendedprice / 1000"
    return joined.selectExpr(
        "*",
        """timestampadd(SECOND, int(l_orderkey % 24 * 3600 + l_linenumber * 420),
             CAST(o_orderdate AS TIMESTAMP_NTZ)) AS tpep_pickup_datetime""",
    ).selectExpr(
        "tpep_pickup_datetime",
        "timestampadd(SECOND, int(l_quantity * 60), tpep_pickup_datetime) AS tpep_dropoff_datetime",
        "c_nationkey AS PULocationID",
        "s_nationkey AS DOLocationID",
        "l_quantity / 3.0D AS trip_distance",
        f"{fare} AS fare_amount",
        f"{fare} * (1D + l_tax) AS total_amount",
        f"{fare} * l_discount AS tip_amount",
        "0D AS tolls_amount",
        "0D AS congestion_surcharge",
        "0D AS Airport_fee",
        "l_linenumber % 6 AS payment_type",
    )
