"""Embedding near-duplicates: a forest of random-projection trees with spill overlap."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import hash_sample, runs, stored
from curbflow.llm.graph import components, spanning_forest

COSINE = 0.98
TREES = 4
SAMPLE_ROWS = 20_000  # bound on the rows that place the splits; every row is indexed
LEAF_ROWS = 2048
LEAST_SAMPLE = 32  # a node with fewer sample rows is not split
MOST_SPILL = 0.7  # a node that would send more than this share both ways is not split
BLOCK_ROWS = 512


@dataclass(frozen=True)
class Forest:
    """Medians of the split nodes by (tree, node); node k has the children 2k+1 and 2k+2."""

    width: int
    margin: float
    medians: dict[tuple[int, int], float]
    trees: int

    def direction(self, tree: int, node: int) -> np.ndarray:
        line = np.random.default_rng((20_011, tree, node)).standard_normal(self.width)
        return line / np.linalg.norm(line)

    def leaves(self, unit: np.ndarray) -> list[list[int]]:
        """Codes of all leaves that hold each row; rows near a split go both ways."""
        out: list[list[int]] = [[] for _ in range(len(unit))]
        for tree in range(self.trees):
            open_nodes = [(0, np.arange(len(unit)))]
            while open_nodes:
                node, rows = open_nodes.pop()
                if not len(rows):
                    continue
                median = self.medians.get((tree, node))
                if median is None:
                    for r in rows.tolist():
                        out[r].append((tree << 40) | node)
                    continue
                place = unit[rows] @ self.direction(tree, node)
                open_nodes.append((2 * node + 1, rows[place < median + self.margin]))
                open_nodes.append((2 * node + 2, rows[place >= median - self.margin]))
        return [sorted(codes) for codes in out]


def fit_forest(unit: np.ndarray, total: int, cosine: float, trees: int = TREES) -> Forest:
    """Split a sample at medians of random projections until leaves would hold about
    ``LEAF_ROWS`` of all ``total`` rows. The overlap on each side of a split is the length
    that a pair at the threshold has on a random line, so a pair is parted only if it is
    two deviations long there, and then in all trees."""
    width = unit.shape[1] if unit.ndim == 2 else 0
    margin = float(np.sqrt(max(0.0, 2 - 2 * cosine)) / np.sqrt(max(1, width)))
    medians: dict[tuple[int, int], float] = {}
    forest = Forest(width, margin, medians, trees)
    depth = max(0, int(np.ceil(np.log2(max(1, total) / LEAF_ROWS))))
    for tree in range(trees if width else 0):
        open_nodes = [(0, 0, np.arange(len(unit)))]
        while open_nodes:
            node, level, rows = open_nodes.pop()
            if level >= depth or len(rows) < LEAST_SAMPLE:
                continue
            place = unit[rows] @ forest.direction(tree, node)
            median = float(np.median(place))
            left, right = rows[place < median + margin], rows[place >= median - margin]
            if len(left) + len(right) > (1 + MOST_SPILL) * len(rows):
                continue
            medians[tree, node] = median
            open_nodes += [(2 * node + 1, level + 1, left), (2 * node + 2, level + 1, right)]
    return forest


def _unit(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(width, len(v))] = v[:width]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _route(forest: Forest):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.copy()
            frame["leaves"] = forest.leaves(_unit(frame["vector"], forest.width))
            yield frame

    return run


def _verify(cosine: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, links, heads = [], [], []
        for cell in runs(frames, ["label", "leaf", "i", "j"]):
            leaf = int(cell["leaf"].iloc[0])
            i, j = int(cell["i"].iloc[0]), int(cell["j"].iloc[0])
            node, copies = cell["node"].to_numpy(), cell["copies"].to_numpy()
            block = cell["block"].to_numpy()
            left = np.flatnonzero(block == i)
            right = left if i == j else np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            size = cell["vector"].map(len).to_numpy()
            full = np.zeros((len(cell), size.max()))
            for r, v in enumerate(cell["vector"]):
                full[r, : len(v)] = v
            norm = np.linalg.norm(full, axis=1)
            close = (full[left] @ full[right].T) / (norm[left][:, None] * norm[right])
            linked = close >= cosine
            if i == j:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            # A pair counts in the first leaf that its rows share, and only there.
            earlier = [[c for c in codes if c < leaf] for codes in cell["leaves"]]
            codes = sorted({c for row in earlier for c in row})
            if codes:
                place = {c: k for k, c in enumerate(codes)}
                member = np.zeros((len(cell), len(codes)), np.float32)
                for r, row in enumerate(earlier):
                    member[r, [place[c] for c in row]] = 1
                linked &= (member[left] @ member[right].T) == 0
            count = np.zeros(len(cell), np.int64)
            count[left] += linked @ copies[right]
            if i != j:
                count[right] += linked.T @ copies[left]
            for a, b in zip(*spanning_forest(linked, left, right, len(cell))):
                nodes.append(node[a])
                links.append(0)
                heads.append(node[b])
            for k in np.flatnonzero(count):
                nodes.append(node[k])
                links.append(count[k])
                heads.append(node[k])
        yield pd.DataFrame(
            {
                "node": np.array(nodes, np.int64),
                "links": np.array(links, np.int64),
                "head": np.array(heads, np.int64),
            }
        )

    return run


def embedding_links(
    vectors: DataFrame, cosine: float = COSINE, trees: int = TREES
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``.

    Needs vec_id, embedding and label. Rows are compared only if their labels are equal and
    not null. Equal vectors of a label form one class, whose members are linked; classes that
    share a leaf in any tree are compared in double precision, in blocks of
    bounded size, and each pair counts once, in the first leaf that it shares. So no pair is
    emitted, and a large group of near-copies is spread over many tasks.
    Null or zero vectors, and those with null or non-finite components, link with nothing;
    a row without vec_id does not either, and is kept. Missing trailing components are zero.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    usable = (
        F.col("embedding").isNotNull()
        & F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & ~F.exists(
            "embedding",
            lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")),
        )
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = stored(
        vectors.where(F.coalesce(usable, F.lit(False))).select(
            F.col("vec_id").cast("long"),
            F.xxhash64("label").alias("label"),
            F.xxhash64("label", "embedding").alias("node"),
            vector.alias("vector"),
        ),
        "embed-rows",
    )
    classes = stored(
        rows.groupBy("node").agg(
            F.min("label").alias("label"),
            F.count(F.lit(1)).alias("copies"),
            F.min("vec_id").alias("least_id"),
            F.first("vector").alias("vector"),
        ),
        "embed-classes",
    )
    sample = hash_sample(classes.select("node", "vector"), ["node"], SAMPLE_ROWS).select("vector")
    chosen = sample.toPandas()["vector"]
    width = int(chosen.map(len).max()) if len(chosen) else 0
    unit = _unit(chosen, width)
    forest = fit_forest(unit, classes.count(), cosine, trees)
    routed = stored(
        classes.drop("least_id").mapInPandas(
            _route(forest),
            "node long, label long, copies long, vector array<double>, leaves array<long>",
        ),
        "embed-routed",
    )
    sizes = (
        routed.select("label", F.explode("leaves").alias("leaf"))
        .groupBy("label", "leaf")
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    )
    cells = (
        routed.withColumn("leaf", F.explode("leaves"))
        .join(sizes, ["label", "leaf"])
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .select("label", "leaf", "i", "j", "block", "node", "copies", "leaves", "vector")
        .repartition("label", "leaf", "i", "j")
        .sortWithinPartitions("label", "leaf", "i", "j")
    )
    verified = stored(
        cells.mapInPandas(_verify(cosine), "node long, links long, head long"), "embed-links"
    )
    joined = components(
        verified.where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")),
        "embed",
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
        "embed-labels",
    )
    ids = stored(
        labelled.groupBy("component").agg(F.min("least_id").alias("component_id")), "embed-ids"
    )
    # Stored sides let a join split a hot class.
    named = stored(
        labelled.join(ids, "component").select("node", "n_links", "component_id"), "embed-names"
    )
    used = rows.select("vec_id", "node").join(named, "node").drop("node")
    idle = vectors.where(~F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("long"),
        F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").cast("long").alias("component_id"),
    )
    return used.unionByName(idle).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
