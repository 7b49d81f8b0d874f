"""Shared pieces: the shared folder, word counts, range-ordered offsets, runs of sorted rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# White space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
WORD_WITH_LEAD = rf"[{SPACE_CLASS}]*[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="curbflow-llm-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key() -> Column:
    """A long that identifies a document row by id and text; repeated rows share it."""
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


def n_words(text: str = "text") -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


# Columns of a document that operators read by name.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def apart(docs: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` on ``docs`` whose further columns have names that no operator uses, and have their
    own names again in the result. A column that ``run`` adds under such a name gets underscores
    in front of it."""
    held = {c: f"user_column_{k}" for k, c in enumerate(docs.columns) if c.lower() not in DOCUMENT}
    if not held:
        return run(docs)
    out = run(docs.toDF(*[held.get(c, c) for c in docs.columns]))
    back = {name: c for c, name in held.items()}
    taken = {c.lower() for c in docs.columns}
    names = []
    for c in out.columns:
        name = back.get(c, c)
        while c not in back and c.lower() not in DOCUMENT and name.lower() in taken:
            name = f"_{name}"
        names.append(name)
    return out.toDF(*names)


def hash_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows of different ``keys``, chosen by hash of the keys. A large table is
    first cut down to about four times as many keys by a bound on the hash, so little is sent to
    be ordered. Rows that repeat a key count once, however many there are."""
    place = F.xxhash64(*keys, F.lit(5))
    total = df.select(place.alias("place")).distinct().count()
    if total > 4 * rows:
        df = df.where(F.pmod(place, F.lit(1 << 31)) < (4 * rows << 31) // total)
    return df.dropDuplicates(keys).orderBy(place, *keys).limit(rows)


def ordered_offsets(df: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """Global running sums before each row, in ``order``, without one task for all rows.

    Rows are dealt by ranges and stored; each range sums on its own, the few range totals
    are summed in order, and both parts add up. ``order`` must be a total order.
    ``sums`` maps new columns to the columns they add up.
    """
    ranges = stored(
        df.repartitionByRange(*[F.col(c) for c in order]).withColumn(
            "_range", F.spark_partition_id()
        ),
        name,
    )
    totals = ranges.groupBy("_range").agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "_range",
        *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in sums],
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    out = ranges.join(before, "_range")
    for k, v in sums.items():
        out = out.withColumn(
            k, F.col(f"_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0))
        ).drop(f"_{k}")
    return out.drop("_range")


def runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of equal ``keys`` from a partition that is sorted by them, across batches."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        values = frame[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        starts = [0, *cuts.tolist(), len(frame)]
        if held and (held[-1][keys].to_numpy()[-1] != values[0]).any():
            yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            held = []
        for a, b in zip(starts[:-1], starts[1:]):
            held.append(frame.iloc[a:b])
            if b < len(frame):
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
