"""Reproducible samples of an exact size, without a global sort or a shuffle of the table.

A row's place in the sample is an md5 hash of its key and a seed, so any engine that has md5
can repeat the choice. Only keys and hashes are counted, by hash cell; the counts give one
hash bound per group, which is stored. The table is joined with the bounds where it is scanned,
and only the few rows that pass, with all their columns, are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.session import materialize

CELL_DIGITS = 4  # hexadecimal digits of a hash cell: 65,536 cells
SENT_GROUPS = 200_000  # so many bounds, of some 100 bytes each, go to every task


def _lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``df`` joined with a stored table of one row per ``key``: sent to the tasks if it is small
    enough, else merged, which shuffles ``df``."""
    return df.join(F.broadcast(table) if table.count() <= SENT_GROUPS else table, key)


def sample_hash(key: Sequence[str], seed: int | Column) -> Column:
    """Hexadecimal md5 of the key columns and a seed, joined by "|"."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws("|", *parts, seed.cast("string")))


def _bounds(cells: DataFrame, k: int) -> DataFrame:
    """Per group the first hash cell up to which at least ``k`` rows lie, else the last."""
    order = Window.partitionBy("group").orderBy("cell")
    upto = cells.withColumn("upto", F.sum("n").over(order))
    return upto.groupBy("group").agg(
        F.coalesce(F.min(F.when(F.col("upto") >= k, F.col("cell"))), F.max("cell")).alias("cell")
    )


def smallest_hashes(
    df: DataFrame, group: Column, key: Sequence[str], k: int, seed: int | Column
) -> DataFrame:
    """The ``k`` rows of every group with the smallest hash of ``key`` and ``seed``.

    ``key`` identifies a row; equal hashes are ordered by key. Rows without a group are left
    out. Any number of groups will do: their bounds are a table.
    """
    digest = sample_hash(key, seed)
    cells = (
        df.select(
            group.cast("string").alias("group"), F.substring(digest, 1, CELL_DIGITS).alias("cell")
        )
        .groupBy("group", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bounds = materialize(
        _bounds(cells, k).select(F.col("group").alias("_group"), F.col("cell").alias("_bound")),
        "sample-bounds",
    )
    hashed = df.select("*", group.cast("string").alias("_group"), digest.alias("_hash"))
    near = (
        _lookup(hashed, bounds, "_group")
        .where(F.substring("_hash", 1, CELL_DIGITS) <= F.col("_bound"))
        .select(*df.columns, "_group", "_hash")
    )
    order = Window.partitionBy("_group").orderBy("_hash", *key)
    return (
        near.withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= k)
        .drop("_place", "_group")
    )


def uniform_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, uniform and reproducible."""
    return smallest_hashes(df, F.lit("all"), key, n, seed).drop("_hash")


def time_spread_sample(
    files: DataFrame, key: Sequence[str], max_rows: int, slices: int = 12, seed: int = 42
) -> DataFrame:
    """At most ``max_rows`` rows per file, spread over ``slices`` parts of the file.

    ``files`` is a file scan; the slice follows from the row's position in its file, so
    rows are neither sorted nor numbered. Row counts per file come from the same metadata.
    """
    columns = files.columns
    located = files.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    sizes = materialize(
        located.groupBy("_file").agg((F.max("_row") + 1).alias("_size")), "file-sizes"
    )
    sliced = _lookup(located, sizes, "_file").withColumn(
        "_slice", F.floor(F.col("_row") * slices / F.col("_size")).cast("int")
    )
    per_slice = -(-max_rows // slices)
    cell = F.concat_ws("#", F.col("_file"), F.col("_slice").cast("string"))
    spread = smallest_hashes(sliced, cell, key, per_slice, F.lit(seed) + F.col("_slice"))
    # The slices hold a little more than the cap; what remains is small enough to order.
    order = Window.partitionBy("_file").orderBy(sample_hash(key, seed), *key)
    return (
        spread.withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= max_rows)
        .select(*columns)
    )
