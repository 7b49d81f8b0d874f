"""Late data: replace and add rows of a partitioned table by its declared key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.functions.columns import null_safe_join
from curbflow.session import materialize
from curbflow.sinks.writers import write_partitioned


class BrokenGrain(ValueError):
    """Rows that share a key which the table declares unique."""


def check_grain(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise ``BrokenGrain`` with a few of the keys that occur more than once."""
    copies = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
        .limit(5).collect()
    )
    if copies:
        raise BrokenGrain(f"keys {list(keys)} are not unique: {[tuple(r) for r in copies]}")


def upsert(df: DataFrame, path: str, keys: Sequence[str], by: Sequence[str]) -> None:
    """Put the rows of ``df`` into the Parquet table at ``path``, partitioned by ``by``.

    A row replaces the one with its key (null matches null), other rows stay. ``keys`` must
    include ``by``, so a key never moves between partitions. Only partitions with rows of
    ``df`` are read and rewritten. The merged partitions are written aside and their keys are
    checked before anything is replaced: a broken grain leaves the table as it was, and so
    does a job that fails before. A table that is not there is created.
    """
    if not set(by) <= set(keys):
        raise ValueError("the key must include the partition columns")
    spark = df.sparkSession
    new = materialize(df, "upsert-new")
    check_grain(new, keys)
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        write_partitioned(new, path, by)
        return
    # The folders that the new rows go to, whose names the writer holds on the driver as well.
    touched = new.select(*by).distinct()
    folders = touched.collect()
    for name in by:
        values = {row[name] for row in folders}
        inside = F.col(name).isin(*(values - {None})) if values - {None} else F.lit(False)
        old = old.where(inside | F.col(name).isNull() if None in values else inside)
    rest = null_safe_join(old, touched, by, "left_semi") if len(by) > 1 else old
    rest = null_safe_join(rest, new.select(*keys), keys, "left_anti")
    merged = materialize(rest.select(*new.columns).unionByName(new), "upsert-merged")
    check_grain(merged, keys)
    write_partitioned(merged, path, by)
