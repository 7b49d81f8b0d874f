"""Warehouse layers as catalog tables over files.

Layers: ods (raw), dim (zones), dwd (trips), dws (metrics), ads (results).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Table name -> (layer folder, format, partition columns).
TABLES = {
    "ods_hvfhv_trip_raw": ("ods/hvfhv", "parquet", ()),
    "ods_yellow_trip_raw": ("ods/yellow", "parquet", ()),
    "ods_taxi_zone_lookup": ("ods/taxi_zone_lookup", "csv", ()),
    "dim_taxi_zone": ("raw/zones", "csv", ()),
    "dwd_clean_trips": ("dwd/clean_trips", "parquet", ("pickup_month",)),
    "dwd_hvfhv_trip_clean": ("dwd/hvfhv_trip_clean", "parquet", ()),
    "dwd_trip_policy_feature": ("dwd/trip_policy_feature", "parquet", ("trip_month",)),
    "dws_hourly_demand": ("dws/hourly_demand", "csv", ()),
    "dws_zone_hourly_demand": ("dws/zone_hourly_demand", "csv", ()),
    "dws_zone_hour_policy_panel": ("dws/zone_hour_policy_panel", "parquet", ("dt",)),
    "dws_od_policy_panel": ("dws/od_policy_panel", "parquet", ("dt",)),
    "dws_policy_effect_result": ("dws/policy_effect_result", "parquet", ()),
    "dws_operation_strategy_recommendation": (
        "dws/operation_strategy_recommendation", "parquet", (),
    ),
    "dws_time_demand_metrics": ("dws/time_demand_metrics", "parquet", ()),
    "dws_zone_demand_metrics": ("dws/zone_demand_metrics", "parquet", ()),
    "dws_od_route_metrics": ("dws/od_route_metrics", "parquet", ()),
    "dws_price_driver_metrics": ("dws/price_driver_metrics", "parquet", ()),
    "dws_response_metrics": ("dws/response_metrics", "parquet", ()),
}


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{TABLES[name][0]}"


def create_external_table(
    spark: SparkSession, name: str, columns: str, path: str, fmt: str = "parquet",
    partitions: Sequence[str] = (),
) -> None:
    """Table definition over existing files; dropping it keeps the files.

    ``columns`` is a DDL string that includes the partition columns.
    """
    parts = f"PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    options = "OPTIONS (header 'true', nullValue 'N/A')" if fmt == "csv" else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {fmt} {options} {parts} "
        f"LOCATION '{path}'"
    )


def register_layer(
    spark: SparkSession, root: str, schemas: dict[str, str], prefix: str = ""
) -> list[str]:
    """Create every listed layer table over ``root`` and discover its partitions."""
    created = []
    for name, columns in schemas.items():
        _, fmt, partitions = TABLES[name]
        full = f"{prefix}{name}"
        create_external_table(spark, full, columns, table_path(root, name), fmt, partitions)
        if partitions:
            discover_partitions(spark, full)
        created.append(full)
    return created


def discover_partitions(spark: SparkSession, name: str) -> None:
    spark.sql(f"MSCK REPAIR TABLE {name}")


def create_as_select(df: DataFrame, name: str, path: str, partitions: Sequence[str] = ()) -> None:
    """Create a table from a query result at an explicit location."""
    writer = df.write.format("parquet").mode("overwrite").option("path", path)
    (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(name)


def create_bucketed(
    df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int,
    order: Sequence[str] = (),
) -> DataFrame:
    """Create a table bucketed by ``keys`` and sorted by ``order`` within the buckets.

    Windows, aggregations and joins on ``keys`` then need no exchange. ``buckets`` should be
    the tasks that later reads want: a few times the cores, or the rows over some 10^7.
    """
    writer = (
        df.repartition(buckets, *keys)
        .write.format("parquet").mode("overwrite").option("path", path)
        .bucketBy(buckets, *keys)
    )
    (writer.sortBy(*order) if order else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def insert_overwrite(df: DataFrame, name: str) -> None:
    """Replace the content of an existing table, matching columns by name.

    A partitioned table keeps the partitions that ``df`` does not contain; its files are
    written in place, so no session setting is touched.
    """
    spark = df.sparkSession
    detail = {
        row.col_name: row.data_type for row in spark.sql(f"DESCRIBE FORMATTED {name}").collect()
    }
    parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    ordered = df.select(*spark.table(name).columns)
    if not parts:
        ordered.write.insertInto(name, overwrite=True)
        return
    (
        ordered.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .format(detail["Provider"])
        .save(detail["Location"])
    )
    discover_partitions(spark, name)


def register_written(spark: SparkSession, root: str, names: Sequence[str]) -> list[str]:
    """Create the listed tables over what was written below ``root``.

    Columns come from the files: Parquet footers, or the header line of CSV, whose columns
    are read as text. Existing definitions of the same name are replaced, their files are kept.
    """
    created = []
    for name in names:
        _, fmt, partitions = TABLES[name]
        path = table_path(root, name)
        reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in reader.format(fmt).load(path).schema
        )
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        created += register_layer(spark, root, {name: columns})
    return created
