"""Line dedup: repeated passages are found by rolling hashes over lines and removed.

``dedup_passages`` finds every shared run of lines; ``dedup_lines`` only the content-defined
chunks that lie wholly inside one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from curbflow.llm.common import apart, row_key, stored

LEAST_WORDS = 20  # of a shared passage


@dataclass(frozen=True)
class ChunkRule:
    """A chunk ends after a line where the rolling hash of the last ``window`` line hashes is
    0 modulo ``divisor`` and the chunk has ``least_lines``; at the latest after
    ``most_lines``. Chunks with fewer words than ``least_words`` are never removed: two
    short lines that happen to follow each other are no passage."""

    window: int = 2
    divisor: int = 2
    least_lines: int = 2
    most_lines: int = 64
    least_words: int = 20


_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def chunk_lines(lines: list[bytes], rule: ChunkRule) -> list[tuple[int, int]]:
    """Half-open line ranges of the chunks. Boundaries depend on the last ``window`` lines
    and the start of the chunk only, so they meet again soon after an insertion."""
    drop = pow(_BASE, rule.window, 1 << 64)
    hashes: list[int] = []
    rolling, start, out = 0, 0, []
    for i, line in enumerate(lines):
        h = xxhash.xxh64_intdigest(line)
        hashes.append(h)
        rolling = (rolling * _BASE + h) & _MASK
        if i >= rule.window:
            rolling = (rolling - drop * hashes[i - rule.window]) & _MASK
        size = i + 1 - start
        mixed = (rolling ^ (rolling >> 29)) * 0xBF58476D1CE4E5B9 & _MASK
        cut = (mixed >> 32) % rule.divisor == 0 and size >= rule.least_lines
        if cut or size == rule.most_lines:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def _chunks(rule: ChunkRule, with_text: bool):
    schema = {"doc_id": pa.int64(), "row": pa.int64(), "first": pa.int32(), "last": pa.int32(),
              "mark": pa.binary()}
    if with_text:
        schema["chunk"] = pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in schema}
            held = 0
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")))
            for doc_id, row, text in rows:
                lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                for first, last in chunk_lines(lines, rule) if len(lines) > 1 else ():
                    if last - first < 2:
                        continue
                    body = b"\n".join(lines[first:last])
                    if len(body.split()) < rule.least_words:
                        continue
                    columns["doc_id"].append(doc_id)
                    columns["row"].append(row)
                    columns["first"].append(first)
                    columns["last"].append(last)
                    columns["mark"].append(xxhash.xxh3_128_digest(body))
                    if with_text:
                        columns["chunk"].append(body)
                        held += len(body)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[n], t) for n, t in schema.items()], list(schema)
                    )
                    columns, held = {name: [] for name in schema}, 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[n], t) for n, t in schema.items()], list(schema)
            )

    return run


_PLACE = "doc_id long, row long, first int, last int, mark binary"


def repeated_chunks(docs: DataFrame, rule: ChunkRule) -> DataFrame:
    """mark, and the place of the first occurrence, of every multi-line chunk that occurs
    more than once. Rows with equal bytes meet in one group: that is the byte comparison.
    Equal chunks combine before the shuffle, so a passage in a third of all documents moves
    once per task. A mark shared by different bytes removes nothing.
    """
    texts = docs.select("doc_id", row_key().alias("row"), "text")
    place = F.struct(
        F.col("doc_id").isNull().alias("unknown"), "doc_id", "row", "first"
    )
    same_bytes = (
        texts.mapInArrow(_chunks(rule, True), f"{_PLACE}, chunk binary")
        .groupBy("mark", "chunk")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("keeper"))
        .select("mark", "n", "keeper")
    )
    return (
        same_bytes.groupBy("mark")
        .agg(
            F.count(F.lit(1)).alias("variants"),
            F.sum("n").alias("n"),
            F.min("keeper").alias("keeper"),
        )
        .where("variants = 1 AND n > 1")
        .selectExpr("mark", "keeper.row AS keeper_row", "keeper.first AS keeper_first")
    )


def dedup_lines(docs: DataFrame, rule: ChunkRule = ChunkRule()) -> DataFrame:
    """``docs`` with repeated multi-line chunks removed from ``text``, and lines_removed.

    Needs doc_id and text; all columns stay. The first occurrence, by doc_id (null last),
    row hash and line, keeps its lines. Of rows that repeat id and text, one counts as the
    first. Single lines, chunks below the rule's least words, null and empty texts stay as
    they are; a document may end with an empty text, but no row is dropped. Keys of
    decisions and texts are shuffled, each text twice at most. A user's column called
    lines_removed stays, the operator's is then called _lines_removed.
    """
    return apart(docs, lambda plain: _dedup_lines(plain, rule))


def _dedup_lines(docs: DataFrame, rule: ChunkRule) -> DataFrame:
    texts = docs.select("doc_id", row_key().alias("row"), "text")
    # Repeated rows have one key: their chunks are decided together, apart from the keeper.
    doomed = (
        texts.mapInArrow(_chunks(rule, False), _PLACE)
        .select("row", "first", "last", "mark")
        .join(stored(repeated_chunks(docs, rule), "repeated-chunks"), "mark")
        .select(
            "row",
            "first",
            "last",
            ((F.col("row") == F.col("keeper_row")) & (F.col("first") == F.col("keeper_first")))
            .alias("keeper"),
        )
        .groupBy("row")
        .agg(F.collect_set(F.struct("first", "last", "keeper")).alias("_doomed"))
    )
    joined = docs.withColumn("_row", row_key()).join(
        doomed.withColumnRenamed("row", "_row"), "_row", "left"
    )
    return _remove(joined, docs.columns)


def _remove(joined: DataFrame, columns: list[str]) -> DataFrame:
    touched = F.col("_doomed").isNotNull()
    nth = F.when(touched, F.row_number().over(Window.partitionBy("_row").orderBy("_row")))
    gone = F.expr("filter(_doomed, x -> NOT x.keeper OR _nth > 1)")
    lines = F.expr(
        "filter(split(text, '\\n', -1), (line, i) ->"
        " NOT exists(_gone, x -> i >= x.first AND i < x.last))"
    )
    cut = F.expr("size(_gone) > 0")
    out = (
        joined.withColumn("_nth", nth)
        .withColumn("_gone", gone)
        .withColumn("_text", F.when(cut, F.array_join(lines, "\n")).otherwise(F.col("text")))
        .withColumn(
            "lines_removed",
            F.when(cut, F.expr("aggregate(_gone, 0, (n, x) -> n + x.last - x.first)")).otherwise(0),
        )
    )
    picked = [F.col("_text").alias("text") if c == "text" else F.col(c) for c in columns]
    return out.select(*picked, "lines_removed")


# ---- shared passages, wherever they lie ---------------------------------------------------


def least_windows(words: list[int], least: int) -> list[tuple[int, int]]:
    """Half-open line ranges that start and end with a line that has words, have ``least``
    words, and would have fewer without their last (or without their first) line.

    They depend on their own lines only, and every line with words of a run of ``least``
    words lies in one that lies in the run: so two texts share a run exactly if they share
    its windows. A line is in 2 x ``least`` windows at most, blank lines not counted.
    """
    full = [i for i, n in enumerate(words) if n]
    found = set()
    end = held = 0
    for k, first in enumerate(full):  # shortest from each first line
        while end < len(full) and held < least:
            held += words[full[end]]
            end += 1
        if held < least:
            break
        found.add((first, full[end - 1] + 1))
        held -= words[first]
    start, held = len(full), 0
    for k in range(len(full) - 1, -1, -1):  # shortest to each last line
        while start > 0 and held < least:
            start -= 1
            held += words[full[start]]
        if held < least:
            break
        found.add((full[start], full[k] + 1))
        held -= words[full[k]]
    return sorted(found)


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


_PASSAGE = {"doc_id": pa.int64(), "row": pa.int64(), "first": pa.int32(), "last": pa.int32(),
            "mark": pa.binary()}
_WIDE = (1 << 128) - 1
_WIDE_BASE = 0x9E3779B97F4A7C15F39CC0605CEDC835


def _passages(least: int):
    """Place and mark of all windows. The mark is a rolling hash over line hashes: a
    difference of two prefix sums, so a window costs the same however many lines it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [1]
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in _PASSAGE}
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")))
            for doc_id, row, text in rows:
                lines = _lines(text)
                found = least_windows([len(x.split()) for x in lines], least)
                if not found:
                    continue
                sums = [0]
                for line in lines:
                    sums.append((sums[-1] * _WIDE_BASE + xxhash.xxh3_128_intdigest(line) + 1) & _WIDE)
                for first, last in found:
                    while len(powers) <= last - first:
                        powers.append(powers[-1] * _WIDE_BASE & _WIDE)
                    mark = (sums[last] - sums[first] * powers[last - first]) & _WIDE
                    columns["doc_id"].append(doc_id)
                    columns["row"].append(row)
                    columns["first"].append(first)
                    columns["last"].append(last)
                    columns["mark"].append(mark.to_bytes(16, "big"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[n], t) for n, t in _PASSAGE.items()], list(_PASSAGE)
            )

    return run


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks, bodies, held = [], [], 0
        for text, places in zip(*(batch.column(c).to_pylist() for c in ("text", "places"))):
            lines = _lines(text)
            for x in places:
                marks.append(x["mark"])
                bodies.append(b"\n".join(lines[x["first"] : x["last"]]))
                held += len(bodies[-1])
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(marks, pa.binary()), pa.array(bodies, pa.binary())],
                        ["mark", "body"],
                    )
                    marks, bodies, held = [], [], 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(marks, pa.binary()), pa.array(bodies, pa.binary())], ["mark", "body"]
        )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the ranges in ``_gone`` out of ``text``, and blank lines between cut lines."""
    for batch in batches:
        texts, removed = [], []
        for text, gone in zip(*(batch.column(c).to_pylist() for c in ("text", "_gone"))):
            count = 0
            if gone:
                lines = _lines(text)
                kept: list[bytes] = []
                at = 0  # end of the cut lines
                for first, last in sorted((x["first"], x["last"]) for x in gone):
                    between = lines[at:first]
                    if at and not any(x.split() for x in between):
                        count += len(between)
                    else:
                        kept += between
                    count += max(0, last - max(at, first))
                    at = max(at, last)
                text = b"\n".join(kept + lines[at:]).decode("utf-8", "surrogatepass")
            texts.append(text)
            removed.append(count)
        columns = dict(zip(batch.schema.names, batch.columns)) | {
            "text": pa.array(texts, pa.string()), "lines_removed": pa.array(removed, pa.int32())
        }
        del columns["_gone"]
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def dedup_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the passages that occur earlier, and lines_removed.

    A passage is a run of whole lines, one or more, with ``least_words`` words; it may start
    and end anywhere in its documents. Needs doc_id and text; all columns stay. The first
    occurrence, by doc_id (null last), row hash and line, keeps its lines, so one occurrence
    of every line stays. A repeat that overlaps the first occurrence stays, too. Of rows that
    repeat id and text, one counts as the first. Null texts and shorter repeats stay as they
    are; a document may end with an empty text, but no row is dropped.

    Windows (``least_windows``) are counted by marks of 16 bytes. Only windows whose mark
    repeats are compared byte by byte; a mark shared by different bytes removes nothing.
    A user's column called lines_removed stays, the operator's is then called _lines_removed.
    """
    return apart(docs, lambda plain: _dedup_passages(plain, least_words))


def _dedup_passages(docs: DataFrame, least_words: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), "text")
    windows = texts.mapInArrow(_passages(least_words), _PLACE)
    place = F.struct(
        F.col("doc_id").isNull().alias("unknown"), "doc_id", "row", "first", "last"
    )
    repeated = stored(
        windows.groupBy("mark")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("keeper"))
        .where("n > 1")
        .selectExpr("mark", "keeper.row AS keeper_row", "keeper.last AS keeper_last"),
        "repeated-marks",
    )
    found = stored(
        windows.join(repeated, "mark").selectExpr(
            "row", "first", "last", "mark", "row = keeper_row AND first < keeper_last AS keeper"
        ),
        "repeated-places",
    )
    # Repeated rows have one key and one set of places.
    places = found.groupBy("row").agg(
        F.collect_set(F.struct("first", "last", "mark")).alias("places")
    )
    unequal = (
        texts.join(places, "row")
        .select("text", "places")
        .mapInArrow(_bodies, "mark binary, body binary")
        .groupBy("mark", "body")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("mark")
        .agg(F.count(F.lit(1)).alias("variants"))
        .where("variants > 1")
        .select("mark")
    )
    doomed = (
        found.join(stored(unequal, "unequal-marks"), "mark", "left_anti")
        .groupBy(F.col("row").alias("_row"))
        .agg(F.collect_set(F.struct("first", "last", "keeper")).alias("_doomed"))
    )
    joined = docs.withColumn("_row", row_key()).join(doomed, "_row", "left")
    nth = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    cut = joined.withColumn(
        "_nth", F.when(F.col("_doomed").isNotNull(), nth)
    ).select(*docs.columns, F.expr("filter(_doomed, x -> NOT x.keeper OR _nth > 1)").alias("_gone"))
    schema = StructType([*docs.schema.fields, StructField("lines_removed", IntegerType(), False)])
    return cut.mapInArrow(_without, schema)
