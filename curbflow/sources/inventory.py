"""File and schema reports of a raw folder."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.session import ship_to_workers

ship_to_workers(__name__)


def file_inventory(spark: SparkSession, pattern: str | Sequence[str]) -> DataFrame:
    """One row per file with its size in MB and row count; data columns stay unread.

    Files of a folder may have different schemas, so no column is asked for.
    """
    patterns = [pattern] if isinstance(pattern, str) else list(pattern)
    scan = spark.read.schema("_none int").parquet(*patterns)
    return scan.groupBy(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file"),
        F.round(F.col("_metadata.file_size") / 1024 / 1024, 2).alias("size_mb"),
    ).agg(F.count(F.lit(1)).alias("rows"))


# Physical and logical Parquet types -> the type that Spark reads.
PLAIN_TYPES = {
    "BOOLEAN": "boolean", "INT32": "int", "INT64": "bigint", "INT96": "timestamp",
    "FLOAT": "float", "DOUBLE": "double", "BYTE_ARRAY": "binary",
    "FIXED_LEN_BYTE_ARRAY": "binary",
}
SIGNED_INTS = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}
UNSIGNED_INTS = {8: "smallint", 16: "int", 32: "bigint", 64: "decimal(20,0)"}


def _column_type(column) -> str:
    """Spark's name for the type of a flat Parquet column."""
    logical = json.loads(column.logical_type.to_json())
    kind = logical.get("Type", "None")
    if kind in ("String", "Enum", "JSON"):
        return "string"
    if kind == "Date":
        return "date"
    if kind == "Decimal":
        return f"decimal({logical['precision']},{logical['scale']})"
    if kind == "Int":
        return (SIGNED_INTS if logical["isSigned"] else UNSIGNED_INTS)[logical["bitWidth"]]
    if kind == "Timestamp" and column.physical_type == "INT64":
        return "timestamp" if logical["isAdjustedToUTC"] else "timestamp_ntz"
    return PLAIN_TYPES[column.physical_type]


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, list] = {name: [] for name in ("path", "file", "column", "type", "rows")}
        for path in batch.column("path").to_pylist():
            filesystem, place = pa_fs.FileSystem.from_uri(path)
            with filesystem.open_input_file(place) as source:
                footer = pq.ParquetFile(source).metadata
            names: dict[str, str] = {}
            for k in range(footer.num_columns):
                column = footer.schema.column(k)
                top = column.path.split(".")[0]
                # Nested columns are named by their top level only.
                names[top] = _column_type(column) if column.path == top else "nested"
            for name, kind in names.items():
                for key, value in zip(found, (path, path.rsplit("/", 1)[-1], name, kind,
                                              footer.num_rows)):
                    found[key].append(value)
        yield pa.RecordBatch.from_pydict(found, schema=_REPORT)


_REPORT = pa.schema(
    [(c, pa.string()) for c in ("path", "file", "column", "type")] + [("rows", pa.int64())]
)


def schema_report(spark: SparkSession, pattern: str | Sequence[str]) -> DataFrame:
    """One row per file and column with Spark's type name, and the file's rows.

    Files are listed without being opened; tasks read the footers, and nothing but them, over the
    file system of the path (local, HDFS or object store). Nothing comes to the driver.
    """
    patterns = [pattern] if isinstance(pattern, str) else list(pattern)
    listing = spark.read.format("binaryFile").load(patterns).select(
        F.regexp_replace("path", "^file:/+", "file:///").alias("path")
    )
    return listing.hint("rebalance").mapInArrow(
        _footers, "path string, file string, column string, type string, rows long"
    )


def schema_drift(report: DataFrame) -> DataFrame:
    """Columns whose type differs between files, or that some files lack."""
    files = report.select(F.count_distinct("file").alias("n")).scalar()
    return (
        report.groupBy("column")
        .agg(
            F.array_sort(F.collect_set("type")).alias("types"),
            F.count_distinct("file").alias("file_count"),
        )
        .where((F.size("types") > 1) | (F.col("file_count") < files))
    )
