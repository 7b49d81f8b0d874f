"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import apart, row_key, runs, stored
from curbflow.llm.graph import components, spanning_forest

NGRAM = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999
MOST_HASHES = 256
CELL_GRAMS = 400_000  # n-grams of one block of a candidate group
CELL_SETS = 128  # documents of one block
STRIPE = 4096  # n-grams that are compared at once


@dataclass(frozen=True)
class Bands:
    count: int
    rows: int


def choose_bands(
    threshold: float = THRESHOLD, recall: float = TARGET_RECALL, most: int = MOST_HASHES
) -> Bands:
    """The banding with most rows per band, so with fewest false candidates, that finds a
    pair at ``threshold`` with probability ``recall`` within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        chance = threshold**rows
        if chance >= 1:
            return Bands(1, most)
        count = int(np.ceil(np.log1p(-recall) / np.log1p(-chance)))
        if count * rows <= most:
            best = Bands(max(1, count), rows)
    if best is None:
        raise ValueError("no banding reaches the recall within the number of hashes")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Turns texts into sorted arrays of n-gram hashes; remembers word hashes."""

    def __init__(self, n: int):
        self.n = n
        self.words: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(words) < self.n:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        gram = np.zeros(len(h) - self.n + 1, np.uint64)
        for k in range(self.n):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - self.n + 1 + k]
        return np.unique(_mix(gram))


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _signatures(n: int, bands: Bands):
    hashes = bands.count * bands.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(n)
        seeds = _mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64))
        # 32-bit multiply-shift hashes of the upper half of the mixed n-gram hash.
        factor = ((seeds[:hashes] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]
        shift = (seeds[hashes:] >> np.uint64(32)).astype(np.uint32)[:, None]
        salt = _mix(np.arange(1, bands.rows + 1, dtype=np.uint64) + np.uint64(7777))
        for batch in batches:
            digests, sizes, marks = [], [], []
            for text in batch.column("text").to_pylist():
                words = _words(text)
                digests.append(xxhash.xxh3_128_digest("\n".join(words)))
                gram = grams(words)
                sizes.append(len(gram))
                if not len(gram):
                    marks.append(None)
                    continue
                short = (gram >> np.uint64(32)).astype(np.uint32)
                low = np.full(hashes, np.iinfo(np.uint32).max, np.uint32)
                for a in range(0, len(short), 512):
                    part = short[None, a : a + 512] * factor
                    part += shift
                    np.minimum(low, part.min(axis=1), out=low)
                rows = low.reshape(bands.count, bands.rows).astype(np.uint64)
                band = _mix((_mix(rows + salt) ).sum(axis=1, dtype=np.uint64))
                marks.append(band.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int32()),
                    pa.array(marks, pa.list_(pa.int64())),
                ],
                ["doc_id", "row", "digest", "grams", "bands"],
            )

    return run


def signatures(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """doc_id, row key, node (hash of the word sequence), number of n-grams, band hashes."""
    return (
        docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), "text")
        .mapInArrow(
            _signatures(n, bands),
            "doc_id long, row long, digest binary, grams int, bands array<long>",
        )
        .select("doc_id", "row", F.xxhash64("digest").alias("node"), "grams", "bands")
    )


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Each class with the smallest class of every bucket it falls in. Buckets are counted
    with partial sums; their rows are joined, so a hot bucket is split over tasks. Edges per
    bucket grow with its size, not with its square."""
    rows = classes.select("node", F.posexplode("bands").alias("band", "hash")).select(
        "node", F.xxhash64("band", "hash").alias("bucket")
    )
    heads = (
        rows.groupBy("bucket")
        .agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("bucket", "v")
    )
    return (
        rows.join(heads, "bucket")
        .where("node <> v")
        .select(F.col("node").alias("u"), "v")
        .distinct()
    )


def _gram_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(n)
        for batch in batches:
            made = [grams(_words(t)).tobytes() for t in batch.column("text").to_pylist()]
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(x) for x in names], pa.array(made, pa.binary())],
                [*names, "set"],
            )

    return run


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of ``left`` sets with ``right`` sets (index arrays)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    gram = np.concatenate(sets)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    first = np.concatenate([[True], gram[1:] != gram[:-1]])
    column = np.cumsum(first) - 1
    several = np.bincount(column)[column] > 1
    owner, column = owner[several], column[several]
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(column):
        return out
    column = np.unique(column, return_inverse=True)[1]
    for a in range(0, int(column[-1]) + 1, STRIPE):
        lo, hi = np.searchsorted(column, [a, a + STRIPE])
        dense = np.zeros((len(sets), STRIPE), np.float32)
        dense[owner[lo:hi], column[lo:hi] - a] = 1
        out += dense[left] @ dense[right].T
    return out


def _verify(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, links, heads = [], [], []
        for cell in runs(frames, ["group", "i", "j"]):
            cell = cell.drop_duplicates("node")  # repeated rows bring a set twice
            node = cell["node"].to_numpy()
            copies = cell["copies"].to_numpy()
            block = cell["block"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in cell["set"]]
            i, j = int(cell["i"].iloc[0]), int(cell["j"].iloc[0])
            left = np.flatnonzero(block == i)
            right = left if i == j else np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            size = np.array([len(s) for s in sets], np.float64)
            both = overlaps(sets, left, right).astype(np.float64)
            union = size[left][:, None] + size[right][None, :] - both
            linked = both >= threshold * union - 1e-9
            if i == j:
                np.fill_diagonal(linked, False)
            count = np.zeros(len(node), np.int64)
            count[left] += linked @ copies[right]
            if i != j:
                count[right] += linked.T @ copies[left]
            for a, b in zip(*spanning_forest(linked, left, right, len(node))):
                nodes.append(node[a])
                links.append(0)
                heads.append(node[b])
            for k in np.flatnonzero(count):
                nodes.append(node[k])
                links.append(count[k])
                heads.append(node[k])
            if len(nodes) > 20_000:
                yield pd.DataFrame({"node": nodes, "links": links, "head": heads})
                nodes, links, heads = [], [], []
        yield pd.DataFrame(
            {
                "node": np.array(nodes, np.int64),
                "links": np.array(links, np.int64),
                "head": np.array(heads, np.int64),
            }
        )

    return run


def jaccard_links(
    docs: DataFrame,
    n: int = NGRAM,
    threshold: float = THRESHOLD,
    bands: Bands | None = None,
) -> DataFrame:
    """doc_id, row, n_links, component and class_id of every document.

    Words are lower-cased and split at white space; documents with the same words are
    copies. Two texts are linked if the Jaccard similarity of their sets of n-word shingles
    is at least ``threshold``. ``n_links`` counts the other documents linked directly,
    copies included; ``class_id`` is the smallest doc_id that links reach. ``component`` is a
    hash that tells classes apart, also where ids are null or several texts share an id.

    Candidates come from MinHash bands (recall by ``choose_bands``): classes in a common
    bucket form a candidate group, and within a group every pair of blocks of bounded size
    is compared on full sets, so no pair of rows is ever emitted and no pair of a group is
    lost. Texts of fewer than n words, null and empty texts included, link only with copies.
    A null doc_id takes part; class_id is null only if all ids of its class are.
    """
    bands = bands or choose_bands(threshold)
    signed = stored(signatures(docs, n, bands), "jaccard-signatures")
    classes = stored(
        signed.groupBy("node").agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("doc_id").alias("least_id"),
            F.min("row").alias("row"),
            F.first("grams").alias("grams"),
            F.min("bands").alias("bands"),
        ),
        "jaccard-classes",
    )
    found = components(candidate_edges(classes.where("bands IS NOT NULL")), "jaccard-groups")
    members = stored(
        classes.drop("bands").join(found.withColumnRenamed("component", "group"), "node"),
        "jaccard-members",
    )
    volume = members.groupBy("group").agg(
        F.ceil(
            F.greatest(F.sum("grams") / F.lit(CELL_GRAMS), F.count(F.lit(1)) / F.lit(CELL_SETS))
        )
        .cast("int")
        .alias("blocks")
    )
    placed = members.join(volume, "group").withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    )
    # Always a merge join: a broadcast that only small inputs allow would make the cost jump.
    sets = (
        docs.select(row_key().alias("row"), "text")
        .join(placed.hint("merge"), "row")
        .select("row", "group", "node", "copies", "block", "blocks", "text")
        .mapInArrow(
            _gram_rows(n),
            "row long, group long, node long, copies long, block int, blocks int, set binary",
        )
    )
    cells = (
        sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "group",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            "block",
            "node",
            "copies",
            "set",
        )
        .repartition("group", "i", "j")
        .sortWithinPartitions("group", "i", "j", "node")
    )
    verified = stored(
        cells.mapInPandas(_verify(threshold), "node long, links long, head long"),
        "jaccard-links",
    )
    joined = components(
        verified.where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")),
        "jaccard-classes",
    )
    counts = verified.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = stored(
        classes.select("node", "copies", "least_id")
        .join(joined, "node", "left")
        .join(counts, "node", "left")
        .select(
            "node",
            "least_id",
            F.coalesce("component", "node").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "jaccard-labels",
    )
    ids = stored(
        labelled.groupBy("component").agg(F.min("least_id").alias("class_id")), "jaccard-ids"
    )
    # Stored sides let a join split a hot class.
    named = stored(
        labelled.join(ids, "component").select("node", "n_links", "component", "class_id"),
        "jaccard-names",
    )
    return signed.select("doc_id", "row", "node").join(named, "node").drop("node")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near-copies: the one with the smallest id.

    Of rows that share this id, the one with the smallest row key stays, once. A class
    whose ids are all null keeps the row with the smallest key.
    """
    return apart(docs, _one_of_each)


def _one_of_each(docs: DataFrame) -> DataFrame:
    best = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    keep = (
        jaccard_links(docs)
        .groupBy("component")
        .agg(F.min(best).alias("b"))
        .select(F.col("b.row").alias("_row"))
    )
    kept = docs.withColumn("_row", row_key()).join(keep.distinct(), "_row", "left_semi")
    # Equal rows are one document.
    return kept.dropDuplicates(["_row"]).select(*docs.columns)
