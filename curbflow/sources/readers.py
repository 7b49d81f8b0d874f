"""Raw-file readers: month files, the zone lookup, panels and optional inputs."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOGGER = logging.getLogger(__name__)

# Folder and file pattern per service.
SERVICE_PATTERNS = {
    "yellow": "yellow/yellow_tripdata_*.parquet",
    "fhvhv": "fhvhv/fhvhv_tripdata_*.parquet",
}
POLICY_MONTHS = ("2024-11", "2024-12", "2025-01", "2025-02", "2025-03")
ZONE_SCHEMA = "LocationID int, Borough string, Zone string, service_zone string"


MOST_FILES = 100_000  # paths that a listing may bring to the driver


def list_files(spark: SparkSession, pattern: str, first: int | None = None) -> list[str]:
    """Sorted paths that match a glob; error when none do. File contents stay unread.

    Meant for folders with a file per month. Only ``first`` paths, if given, reach the driver;
    without it, more than ``MOST_FILES`` are an error, as such a folder should be a table.
    """
    try:
        listing = spark.read.format("binaryFile").load(pattern).select("path").orderBy("path")
        found = [row.path for row in listing.limit(first or MOST_FILES + 1).collect()]
    except AnalysisException:
        found = []
    if not found:
        raise FileNotFoundError(f"no file matches {pattern}")
    if not first and len(found) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files match {pattern}")
    return found


def service_files(
    spark: SparkSession, root: str, service: str, first: int | None = None
) -> list[str]:
    return list_files(spark, f"{root.rstrip('/')}/{SERVICE_PATTERNS[service]}", first)


def _file_name(path: str) -> str:
    """File name without folder; the part files of a folder go by the folder's name."""
    *folders, name = path.rstrip("/").split("/")
    return folders[-1] if name.startswith("part-") and folders else name


NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def common_type(kinds: Sequence[T.DataType]) -> T.DataType:
    """The type that holds the values of all ``kinds`` of a column.

    Whole numbers widen to bigint, other numbers to double, dates and timestamps to
    timestamps without zone; anything else meets as text. An untyped (all-null) column
    takes the type of the others.
    """
    known = [k for k in dict.fromkeys(kinds) if not isinstance(k, T.NullType)]
    if not known:
        return T.StringType()
    if len(known) == 1:
        return known[0]
    if all(isinstance(k, NUMBERS) for k in known):
        broken = (T.FloatType, T.DoubleType, T.DecimalType)
        return T.DoubleType() if any(isinstance(k, broken) for k in known) else T.LongType()
    if all(isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)) for k in known):
        return T.TimestampNTZType()
    return T.StringType()


def stack_months(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name, regardless of case, with drifting types brought together.

    A column that a month lacks reads as NULL there. The casts sit in the projection of each
    scan, so column pruning still reaches the files.
    """
    names: dict[str, str] = {}
    kinds: dict[str, list[T.DataType]] = {}
    for frame in frames:
        for field in frame.schema:
            names.setdefault(field.name.lower(), field.name)
            kinds.setdefault(field.name.lower(), []).append(field.dataType)
    target = {key: common_type(found) for key, found in kinds.items()}
    stacked = None
    for frame in frames:
        own = {field.name.lower(): field.name for field in frame.schema}
        aligned = frame.select(
            *[
                (F.col(f"`{own[key]}`") if key in own else F.lit(None))
                .cast(target[key])
                .alias(name)
                for key, name in names.items()
            ]
        )
        stacked = aligned if stacked is None else stacked.unionByName(aligned)
    return stacked


def read_trips(
    spark: SparkSession,
    paths: Sequence[str],
    months: Sequence[str] | None = None,
) -> DataFrame:
    """Scan month files; ``months`` prunes files by name before Spark opens them.

    Files of one month share a schema; months may differ in types and columns. Months of
    equal schema are one scan, and the scans are stacked (``stack_months``).
    """
    chosen = [p for p in paths if not months or any(month in _file_name(p) for month in months)]
    if not chosen:
        raise FileNotFoundError(f"no file for the months {list(months or ())}")
    scans: dict[str, list[str]] = {}
    schemas: dict[str, T.StructType] = {}
    for path in chosen:
        schema = spark.read.parquet(path).schema
        schemas[schema.json()] = schema
        scans.setdefault(schema.json(), []).append(path)
    return stack_months(
        [spark.read.schema(schemas[key]).parquet(*same) for key, same in scans.items()]
    )


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zone lookup with the reading rule "N/A means missing"."""
    raw = spark.read.csv(path, header=True, schema=ZONE_SCHEMA, nullValue="N/A")
    return raw.select(
        F.col("LocationID").alias("zone_id"),
        F.col("Zone").alias("zone_name"),
        F.col("Borough").alias("borough"),
        "service_zone",
    )


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    panel = spark.read.parquet(path)
    if "trip_date" in panel.columns:
        panel = panel.withColumn("trip_date", F.to_date("trip_date"))
    return panel


def read_first_existing(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType | str, fmt: str = "parquet"
) -> DataFrame:
    """First readable path, else a warning and an empty frame of the given schema."""
    for path in paths:
        reader = spark.read.format(fmt).schema(schema)
        if fmt == "csv":
            reader = reader.option("header", "true")
        try:
            return reader.load(path)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    LOGGER.warning("optional input is unavailable: %s", list(paths))
    return spark.createDataFrame([], schema)


def month_slice(trips: DataFrame, months: Sequence[str], column: str = "pickup_month") -> DataFrame:
    """Month window on the partition column, so a partitioned table prunes folders."""
    return trips.where(F.col(column).isin(*months))


def calendar_slice(trips: DataFrame, calendar: DataFrame, column: str = "pickup_month"):
    """The rows of the months that ``calendar`` lists, which may be a filtered table.

    Both sides are joined on the partition column, and the months become a subquery of the scan:
    folders of other months are not read, and no list of months stands in the code. The
    planner makes such a subquery for a dimension with a comparison in its filter; a flag alone
    would not do, so nameless months are compared away here.
    """
    months = calendar.select(column).where(F.length(column) > 0).distinct()
    return trips.join(months, column, "left_semi")


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows under a total order (top-n per partition, then merge)."""
    return df.orderBy(*order).limit(n)
