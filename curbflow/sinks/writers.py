"""File and JDBC sinks for trips, panels and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Snappy Parquet; the number of files follows the number of partitions."""
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: str | Sequence[str]) -> None:
    """Overwrite only the partitions present in ``df``.

    The rebalance hint gathers each partition value into few files and lets AQE
    split a value that holds far more rows than the others over several tasks.
    """
    by = [by] if isinstance(by, str) else list(by)
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def _flat(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, for text sinks."""
    nested = {
        name: F.to_json(name)
        for name, kind in df.dtypes
        if kind.startswith(("map", "struct", "array"))
    }
    return df.withColumns(nested) if nested else df


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header. ``single_file`` is for marts whose size a top-k or key bounds."""
    out = _flat(df)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str, single_file: bool = False) -> None:
    """JSON records in UTF-8, dates and timestamps as text, NULL fields kept."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def jdbc_options(url: str, table: str, batch: int = 10_000, **extra: str) -> dict[str, str]:
    return {
        "url": url, "dbtable": table, "batchsize": str(batch), "truncate": "true", **extra,
    }


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 10_000, **extra: str) -> None:
    """Replace a database table in batches; executors write in parallel."""
    writer = _flat(df).write.format("jdbc").mode("overwrite")
    writer.options(**jdbc_options(url, table, batch, **extra)).save()


def load_marts(marts: dict[str, DataFrame], url: str, schema: str = "mobility", **extra: str):
    """Replace the serving tables of the demand marts."""
    for name, df in marts.items():
        write_jdbc(df, url, f"{schema}.{name}", **extra)
