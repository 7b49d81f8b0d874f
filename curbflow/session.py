"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import sys
import tempfile
import uuid
from functools import cache

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Small relations are broadcast by Catalyst/AQE from measured sizes
# (spark.sql.autoBroadcastJoinThreshold); no operator forces a broadcast, so a
# dimension that outgrows the threshold falls back to a sort-merge join, where
# AQE splits skewed partitions.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "curbflow", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Trips carry naive local times; a UTC session keeps NTZ casts free of DST jumps."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="curbflow-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/curbflow-{name}-{uuid.uuid4().hex}"


def materialize(df, name: str, rebalance: bool = True):
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage before iterative training and for results that read a table
    several times. The files are on shared storage, so a lost executor costs a
    re-read and not a recomputation. Rebalancing sizes the files by volume, one for
    a small table and many for a large one; without it ``df`` keeps its partitions
    and nothing is shuffled.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.hint("rebalance") if rebalance else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_to_workers(module: str) -> None:
    """Send the functions of ``module`` with the task.

    Python workers then need no copy of this package on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])
