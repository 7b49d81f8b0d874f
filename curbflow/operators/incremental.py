"""Demand marts that are kept up to date from month files, reading only what is new.

A state folder holds partial sums of every month file (``partials``, a folder per batch) and a
manifest of the files behind them (``manifest``, a folder per version). The part files of a
folder are one month file: the keys of a month repeat in each of its parts, so sums by part
would be nearly as many as the trips. An update lists the files without opening them, reads
the ones that are new or changed, with the parts that were summed together with a changed or
deleted one, adds their partial sums and writes the next version of the manifest last. A month
file counts under the batches that the manifest names, so partial sums of changed, deleted or
half-finished files are left aside.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.functions.columns import zero
from curbflow.operators import cleaning, marts
from curbflow.sources import readers
from curbflow.spec import TripRules

DEMAND_SUMS = ("distance_sum", "duration_sum", "fare_sum")
# Mart -> its keys; all but the last hold valid trips.
KEYS = {
    "hourly_demand": tuple(marts.HOURLY_KEYS),
    "zone_hourly_demand": tuple(marts.ZONE_HOURLY_KEYS),
    "od_flows": tuple(marts.FLOW_KEYS),
    "invalid_trip_summary": ("service_type", "invalid_reason"),
}
ALL_KEYS = tuple(dict.fromkeys(key for keys in KEYS.values() for key in keys))
MANIFEST = "service string, path string, file string, size long, modified timestamp, batch string"
VERSIONED = f"{MANIFEST}, version int"
PARTIALS = (
    "file string, service_type string, pickup_date date, pickup_hour int, pickup_weekday int, "
    "pickup_month string, pickup_location_id int, dropoff_location_id int, invalid_reason string, "
    "trip_count long, " + ", ".join(f"{name} double" for name in marts.SUMS)
    + ", batch string, mart string"
)
FILES_AT_ONCE = 500


@dataclass(frozen=True)
class Update:
    """What an update did, in files."""

    read: int
    kept: int
    gone: int
    version: int


def manifest(spark: SparkSession, state: str) -> DataFrame:
    """Files of the last finished version, one row each."""
    try:
        every = spark.read.schema(VERSIONED).parquet(f"{state}/manifest")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], VERSIONED)
    last = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == F.lit(last))


def _listing(spark: SparkSession, sources: Mapping[str, str]) -> DataFrame:
    """Path, size and time of the files of each service; no file is opened."""
    found = None
    for service, pattern in sources.items():
        files = spark.read.format("binaryFile").load(pattern).select(
            F.lit(service).alias("service"), "path",
            F.input_file_name().alias("file"),  # spelled as the rows of the file spell it
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
        found = files if found is None else found.unionByName(files)
    return found


def _month_file(file):
    """The folder of a part file, any other file itself."""
    return F.regexp_replace(file, "/part-[^/]*$", "")


def partial_sums(standard: DataFrame) -> DataFrame:
    """Counts and sums of every mart by month file, from one pass over standard trips.

    Each mart is a grouping set of the same aggregation, combined before the shuffle; the bits
    of the grouping id say which keys are left out.
    """
    trips = standard.withColumn("file", _month_file(F.input_file_name()))
    columns = ["file", "is_valid_trip", *ALL_KEYS]
    sets = [["file", "is_valid_trip", *keys] for keys in KEYS.values()]
    left_out = {
        name: sum(1 << len(columns) - 1 - k for k, c in enumerate(columns) if c not in some)
        for name, some in zip(KEYS, sets)
    }
    mart = F.lit(None).cast("string")
    for name, bits in left_out.items():
        mart = F.when(F.grouping_id() == bits, name).otherwise(mart)
    sums = trips.groupingSets(sets, *columns).agg(
        mart.alias("mart"),
        F.count(F.lit(1)).alias("trip_count"),
        *[F.sum(column).alias(name) for name, column in marts.SUMS.items()],
    )
    return sums.where((F.col("mart") == "invalid_trip_summary") != F.col("is_valid_trip")).drop(
        "is_valid_trip"
    )


def update(
    spark: SparkSession, state: str, sources: Mapping[str, str], rules: TripRules | None = None
) -> Update:
    """Bring the state up to the files that match ``sources`` (service -> glob).

    Only paths of new or changed files come to the driver, ``FILES_AT_ONCE`` at a time. Of
    two updates of one state at the same time, the one that finishes last fails.
    """
    state = state.rstrip("/")
    same = ["service", "file", "size", "modified"]
    listing, known = _listing(spark, sources), manifest(spark, state)
    together = [_month_file("file").alias("month_file"), "batch"]
    broken = known.join(listing, same, "left_anti").select(*together).distinct()
    whole = known.select("*", together[0]).join(broken, ["month_file", "batch"], "left_anti")
    kept = whole.select(*known.columns)
    todo = listing.join(kept, same, "left_anti").orderBy("service", "path").collect()
    kept_rows, known_rows = kept.count(), known.count()
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    if not todo and kept_rows == known_rows:
        return Update(0, kept_rows, 0, version - 1)
    added = None
    for service in sources:
        rows = [row for row in todo if row.service == service]
        for k in range(0, len(rows), FILES_AT_ONCE):
            some, batch = rows[k : k + FILES_AT_ONCE], uuid.uuid4().hex
            raw = readers.read_trips(spark, [row.path for row in some])
            sums = partial_sums(cleaning.standard_trips(raw, service, rules or TripRules()))
            sums.write.partitionBy("mart").parquet(f"{state}/partials/batch={batch}")
            files = spark.createDataFrame(
                [(*(row[c] for c in ("service", "path", "file", "size", "modified")), batch)
                 for row in some],
                MANIFEST,
            )
            added = files if added is None else added.unionByName(files)
    entries = kept.drop("version")
    entries = entries if added is None else entries.unionByName(added)
    # One small file, so that a version is there as a whole or not at all.
    entries.select(*[c.split()[0] for c in MANIFEST.split(", ")]).coalesce(1).write.parquet(
        f"{state}/manifest/version={version}"
    )
    return Update(len(todo), kept_rows, known_rows - kept_rows, version)


def mart(spark: SparkSession, state: str, name: str, zones: DataFrame | None = None) -> DataFrame:
    """A mart merged from the partial sums of the files in the manifest, columns as the
    operator of that name gives them; ``zone_hourly_demand`` needs the zones."""
    names = F.array("file", _month_file("file"))  # sums of older states are by part file
    files = manifest(spark, state).select(F.explode(names).alias("file"), "batch")
    every = spark.read.schema(PARTIALS).parquet(f"{state.rstrip('/')}/partials")
    sums = every.where(F.col("mart") == name)
    mine = sums.join(files, ["file", "batch"], "left_semi")
    count = F.sum("trip_count").alias("trip_count")
    if name == "invalid_trip_summary":
        return mine.groupBy(*KEYS[name]).agg(count.alias("record_count"))
    wanted = marts.SUMS if name == "hourly_demand" else DEMAND_SUMS
    totals = mine.groupBy(*KEYS[name]).agg(count, *[zero(F.sum(c)).alias(c) for c in wanted])
    demand = marts.demand_ratios(totals)
    return marts.with_pickup_zones(demand, zones) if name == "zone_hourly_demand" else demand
