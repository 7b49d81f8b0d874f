"""Dense row numbers 1 … n over a total order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.session import materialize


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def dense_numbers(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the bigint column ``name``: 1 … n in the order of ``order``, nulls first.

    The rows are written once, which gives every row a fixed place (file and row in it). Ranges
    of (``order``, place) are dealt to tasks, ordered and written; a key that a third of all rows
    share is split over several ranges by the place. The rows of each file, one count for each,
    are added up in order, and a row's number follows from its place in its file: one shuffle
    of the rows and no window. Rows that are equal in ``order`` are numbered by place; rows
    equal in all columns get different numbers, and which gets which does not show. Works
    from files only, so a lost executor repeats tasks and changes no number.
    """
    spark = df.sparkSession
    file, row, part, start = (unused(df, c) for c in ("_file", "_row", "_range", "_start"))
    placed = materialize(df, "numbered-rows", rebalance=False).select(
        "*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row)
    )
    by = [*[F.col(f"`{c}`").asc_nulls_first() for c in order], F.col(file), F.col(row)]
    dealt = placed.repartitionByRange(*by).sortWithinPartitions(*by).drop(file, row)
    ranges = materialize(
        dealt.withColumn(part, F.spark_partition_id()), "numbered-ranges", rebalance=False
    ).select(
        "*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row)
    )
    # One count for each file, however many rows there are.
    counts = sorted(tuple(r) for r in ranges.groupBy(part, file).count().collect())
    starts = [0, *accumulate(n for *_, n in counts)]
    offsets = materialize(
        spark.createDataFrame(
            [(f, k) for (_, f, _), k in zip(counts, starts)], f"`{file}` string, `{start}` long"
        ),
        "numbered-files",
    )
    return (
        ranges.join(offsets, file)
        .withColumn(name, F.col(start) + F.col(row) + 1)
        .select(*df.columns, name)
    )
