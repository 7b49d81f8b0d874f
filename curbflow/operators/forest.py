"""Random regression forests, whose trees are finished in tasks of their own.

Values are put into quantile bins once and rows are kept as blocks, as in ``boosting``. Every tree
draws its rows with replacement (Poisson numbers by tree and block). A node with more than
``node_rows`` rows is split from sums over all blocks, added up and judged in tasks. Then the
rows of each tree are dealt to the nodes that are left, its parts, and a task grows the part to its
leaves: sums of a small node would hold a number for every bin of every feature, the rows of the
node are far fewer. The parts are a stored table; scoring deals the rows the same way and meets
them there, so neither rows nor trees come to the driver, only the splits of large nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.operators.boosting import (
    LEAST_GAIN, BoostSettings, Tree, _binned, _blocks, _numbers, _read, _slots, best_split,
    bin_edges,
)
from curbflow.session import materialize, ship_to_workers

ship_to_workers(__name__)

SCORE_ROWS = 8_192  # rows of a block that is scored
MOST_TASKS = 4_096
NODE = np.dtype(
    [("feature", "i2"), ("limit", "u2"), ("left", "i4"), ("right", "i4"), ("value", "f8")]
)


@dataclass(frozen=True)
class ForestSettings:
    """Depth 30 is a bound that trees without a limit hardly reach.

    ``bins`` is at least the number of zones, so that every zone can be split from the next.
    """

    trees: int = 160
    min_leaf: int = 2
    max_depth: int = 30
    bins: int = 512
    seed: int = 42
    node_rows: int = 65_536


def drawn_weights(settings: ForestSettings, tree: int, place: int, rows: int) -> np.ndarray:
    """How often a tree takes each row of a block; a single tree takes every row once."""
    if settings.trees == 1:
        return np.ones(rows)
    return np.random.default_rng([settings.seed, tree, place]).poisson(1.0, rows).astype(float)


# ---- one part -----------------------------------------------------------------------------


def _level(bins, order, node, weight, moment, rows, sums, min_leaf):
    """Gain, feature and highest bin to the left of the best split of each open node."""
    best, feature, limit = np.zeros(len(rows)), np.full(len(rows), -1), np.zeros(len(rows), int)
    rows_before, sums_before = np.cumsum(rows) - rows, np.cumsum(sums) - sums
    for f, at in enumerate(order):
        k, b = node[at], bins[at, f]
        ends = np.flatnonzero((k[1:] == k[:-1]) & (b[1:] != b[:-1]))
        k = k[ends]
        n = np.cumsum(weight[at])[ends] - rows_before[k]
        fits = (n >= min_leaf) & (rows[k] - n >= min_leaf)
        if not fits.any():
            continue
        ends, k, n = ends[fits], k[fits], n[fits]
        left = np.cumsum(moment[at])[ends] - sums_before[k]
        gain = left**2 / n + (sums[k] - left) ** 2 / (rows[k] - n) - sums[k] ** 2 / rows[k]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        top = np.maximum.reduceat(gain, first)
        near = np.flatnonzero(gain >= np.repeat(top - 1e-9 * abs(top), np.diff(np.r_[first, len(k)])))
        near = near[np.unique(k[near], return_index=True)[1]]  # the lowest bin of equal gains
        won = top > best[k[first]] * (1 + 1e-9)
        here, near = k[first][won], near[won]
        best[here], feature[here], limit[here] = top[won], f, b[ends[near]]
    return best, feature, limit


def grow_part(
    bins: np.ndarray, target: np.ndarray, weight: np.ndarray, min_leaf: int, max_depth: int
) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the tree over these rows and each feature's gain, level by level.

    Rows stay sorted by node and bin for each feature, so a level costs its rows and not its bins.
    """
    moment, square = weight * target, weight * target**2
    nodes = np.zeros(1, NODE)
    nodes["left"], nodes["value"] = -1, moment.sum() / weight.sum()
    gains = np.zeros(bins.shape[1])
    order = [np.argsort(bins[:, f], kind="stable") for f in range(bins.shape[1])]
    node, open_ = np.zeros(len(target), np.int64), np.zeros(1, np.int64)
    for _ in range(max_depth):
        live = order[0]
        rows, sums, squares = (
            np.bincount(node[live], x[live], len(open_)) for x in (weight, moment, square)
        )
        gain, feature, limit = _level(bins, order, node, weight, moment, rows, sums, min_leaf)
        split = np.flatnonzero((feature >= 0) & (gain > LEAST_GAIN * squares))
        if not len(split):
            break
        np.add.at(gains, feature[split], gain[split])
        ids = len(nodes) + np.arange(2 * len(split))
        parents = open_[split]
        nodes["feature"][parents], nodes["limit"][parents] = feature[split], limit[split]
        nodes["left"][parents], nodes["right"][parents] = ids[::2], ids[1::2]
        place = np.full(len(open_), -1)
        place[split] = 2 * np.arange(len(split))
        kept = live[place[node[live]] >= 0]
        at = node[kept]
        child = place[at] + (bins[kept, feature[at]] > limit[at])
        node[live] = -1
        n = np.bincount(child, weight[kept], len(ids))
        grown = np.zeros(len(ids), NODE)
        grown["left"], grown["value"] = -1, np.bincount(child, moment[kept], len(ids)) / n
        nodes = np.concatenate([nodes, grown])
        large = n >= 2 * max(1, min_leaf)
        if not large.any():
            break
        slot = np.where(large, np.cumsum(large) - 1, -1)
        node[kept], open_ = slot[child], ids[large]
        kind = np.uint16 if len(open_) < 1 << 16 else np.int64  # short numbers sort by digits
        for f, old in enumerate(order):
            rest = old[node[old] >= 0]
            order[f] = rest[np.argsort(node[rest].astype(kind), kind="stable")]
    return nodes, gains


def part_values(nodes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    at = np.zeros(len(bins), np.int64)
    moving = np.arange(len(bins))
    while True:
        here = nodes[at[moving]]
        inner = here["left"] >= 0
        moving, here = moving[inner], here[inner]
        if not len(moving):
            return nodes["value"][at]
        right = bins[moving, here["feature"]] > here["limit"]
        at[moving] = np.where(right, here["right"], here["left"])


# ---- large nodes --------------------------------------------------------------------------

_JUDGED = "tree int, node int, gain double, feature int, bin int, rows double, lower double, mean double"


def _node_sums(
    settings: ForestSettings, tops: Sequence[Tree], wanted: dict[int, list[int]], features: int,
    width: int, base: float,
):
    """Sums of each wanted node by feature and bin over the blocks of a task, a tree at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [block for batch in batches for block in _read(batch, features)]
        for tree, ids in wanted.items():
            out = np.zeros((2, len(ids), features, width))
            for place, bins, target, _ in blocks:
                weight = drawn_weights(settings, tree, place, len(target))
                slot = _slots(tops[tree], ids)[tops[tree].nodes(bins)]
                used = np.flatnonzero((slot >= 0) & (weight > 0))
                moment = weight[used] * (target[used] - base)
                flat = out.reshape(2, -1)
                for f in range(features):
                    code = (slot[used] * features + f) * width + bins[used, f]
                    flat[0] += np.bincount(code, moment, flat.shape[1])
                    flat[1] += np.bincount(code, weight[used], flat.shape[1])
            for k, node in enumerate(ids if blocks else []):
                yield pa.RecordBatch.from_pydict(
                    {
                        "tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                        "place": pa.array([blocks[0][0]], pa.int64()),
                        "sums": pa.array([out[:, k].tobytes()], pa.binary()),
                    }
                )

    return run


def _judge(settings: ForestSettings, features: int, width: int):
    rules = BoostSettings(min_leaf=settings.min_leaf, penalty=0.0)

    def run(key: tuple, pieces: pa.Table) -> pa.Table:
        sums = np.zeros((2, features, width))
        for piece in pieces.sort_by("place").column("sums"):
            sums += np.frombuffer(piece.as_buffer()).reshape(sums.shape)
        rows = sums[1, 0].sum()
        gain, feature, limit = best_split(sums, range(features), rules) or (0.0, -1, 0)
        values = (
            key[0].as_py(), key[1].as_py(), gain, feature, limit, rows,
            sums[1, feature, : limit + 1].sum(), sums[0, 0].sum() / max(rows, 1.0),
        )
        names = [c.split()[0] for c in _JUDGED.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()] + [pa.float64()] * 3
        return pa.table([pa.array([v], kind) for v, kind in zip(values, kinds)], names)

    return run


@dataclass
class _Tops:
    """Trees down to their parts: the depth of each part, leaves among large nodes, and gains."""

    trees: list[Tree]
    parts: list[dict[int, int]]
    gains: np.ndarray
    leaves: list[tuple[int, int, float]] = field(default_factory=list)


def _large_nodes(
    blocks: DataFrame, n: int, features: int, width: int, base: float, settings: ForestSettings
) -> _Tops:
    """Split every node of more than ``node_rows`` rows, a pass for each level of all trees."""
    count = settings.trees
    tops = _Tops([Tree() for _ in range(count)], [{0: 0} for _ in range(count)],
                 np.zeros((count, features)))
    wanted = {k: [0] for k in range(count)} if n > settings.node_rows else {}
    while wanted:
        judged = (
            blocks.mapInArrow(
                _node_sums(settings, tops.trees, wanted, features, width, base),
                "tree int, node int, place long, sums binary",
            )
            .groupBy("tree", "node")
            .applyInArrow(_judge(settings, features, width), _JUDGED)
            .collect()
        )
        wanted = {}
        for row in sorted(judged, key=lambda r: (r.tree, r.node)):
            top, parts = tops.trees[row.tree], tops.parts[row.tree]
            depth = parts.pop(row.node)
            if row.feature < 0 or depth >= settings.max_depth:
                tops.leaves.append((row.tree, row.node, row.mean))
                continue
            left = 1 + 2 * len(top.splits)
            top.splits.append((row.node, row.feature, row.bin, left, left + 1))
            tops.gains[row.tree, row.feature] += row.gain
            for child, rows in ((left, row.lower), (left + 1, row.rows - row.lower)):
                parts[child] = depth + 1
                if rows > settings.node_rows:
                    wanted.setdefault(row.tree, []).append(child)
    return tops


# ---- forest -------------------------------------------------------------------------------

_PART = "tree int, node int, nodes binary, gains array<double>"


def _dealt(settings: ForestSettings, tops: _Tops, features: int, base: float):
    """The drawn rows of each block by tree and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, bins, target, _ in _read(batch, features):
                for tree, top in enumerate(tops.trees):
                    weight = drawn_weights(settings, tree, place, len(target))
                    at = np.where(weight > 0, top.nodes(bins), -1)
                    found = [(k, np.flatnonzero(at == k)) for k in tops.parts[tree]]
                    found = [(k, rows) for k, rows in found if len(rows)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "tree": pa.array([tree] * len(found), pa.int32()),
                            "node": pa.array([k for k, _ in found], pa.int32()),
                            "place": pa.array([place] * len(found), pa.int64()),
                            "bins": pa.array([bins[r].tobytes() for _, r in found], pa.binary()),
                            "target": pa.array(
                                [(target[r] - base).tobytes() for _, r in found], pa.binary()
                            ),
                            "weight": pa.array(
                                [weight[r].astype(np.uint8).tobytes() for _, r in found], pa.binary()
                            ),
                        }
                    )

    return run


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])


def _grown_part(settings: ForestSettings, tops: _Tops, features: int):
    def run(key: tuple, dealt: pa.Table) -> pa.Table:
        tree, node = (k.as_py() for k in key)
        dealt = dealt.sort_by("place")
        nodes, gains = grow_part(
            _joined(dealt, "bins", np.uint16).reshape(-1, features),
            _joined(dealt, "target", float), _joined(dealt, "weight", np.uint8).astype(float),
            settings.min_leaf, settings.max_depth - tops.parts[tree][node],
        )
        return pa.table(
            [pa.array([tree], pa.int32()), pa.array([node], pa.int32()),
             pa.array([nodes.tobytes()], pa.binary()), pa.array([gains.tolist()])],
            ["tree", "node", "nodes", "gains"],
        )

    return run


def _score_blocks(features: Sequence[str], edges, tops: _Tops, buckets: int):
    """Rows to score by tree and part; the numbers of the rows go with the first tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SCORE_ROWS):
                some = batch.slice(start, SCORE_ROWS)
                bins = _binned([_numbers(some, f"f{k}") for k in range(len(features))], edges)
                ids = some.column("_row").to_numpy()
                for tree, top in enumerate(tops.trees):
                    at = top.nodes(bins)
                    found = [(k, np.flatnonzero(at == k)) for k in np.unique(at).tolist()]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "tree": pa.array([tree] * len(found), pa.int32()),
                            "node": pa.array([k for k, _ in found], pa.int32()),
                            "bucket": pa.array([int(ids[0]) % buckets] * len(found), pa.int32()),
                            "block": pa.array([int(ids[0])] * len(found), pa.int64()),
                            "places": pa.array(
                                [r.astype(np.uint16).tobytes() for _, r in found], pa.binary()
                            ),
                            "ids": pa.array(
                                [b"" if tree else ids[r].tobytes() for _, r in found], pa.binary()
                            ),
                            "bins": pa.array([bins[r].tobytes() for _, r in found], pa.binary()),
                        }
                    )

    return run


def _scored_part(features: int):
    def run(dealt: pa.Table, part: pa.Table) -> pa.Table:
        values = []
        if dealt.num_rows:
            nodes = np.frombuffer(part.column("nodes")[0].as_buffer(), NODE)
            for x in dealt.column("bins"):
                bins = np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, features)
                values.append(part_values(nodes, bins).tobytes())
        kept = dealt.select(["tree", "node", "block", "places", "ids"])
        return kept.append_column("values", pa.array(values, pa.binary()))

    return run


def _added(trees: int, base: float):
    def run(key: tuple, parts: pa.Table) -> pa.Table:
        parts = parts.sort_by([("tree", "ascending"), ("node", "ascending")])
        places = [np.frombuffer(x.as_buffer(), np.uint16) for x in parts.column("places")]
        rows = 1 + max(int(p.max()) for p in places)
        out, ids = np.zeros(rows), np.zeros(rows, np.int64)
        for p, values, own in zip(places, parts.column("values"), parts.column("ids")):
            out[p] += np.frombuffer(values.as_buffer())
            if len(own.as_buffer()):
                ids[p] = np.frombuffer(own.as_buffer(), np.int64)
        return pa.table([pa.array(ids), pa.array(base + out / trees)], ["_row", "_mean"])

    return run


@dataclass
class Forest:
    """A fitted forest: bin edges, base value, large nodes, the stored parts, and each
    feature's share of the gain, averaged over the trees."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    rows: int
    tops: _Tops
    parts: DataFrame
    importance: list[float]
    settings: ForestSettings

    def predict(self, table: DataFrame, name: str = "prediction") -> DataFrame:
        """``table`` with the double column ``name``."""
        numbered = materialize(
            table.withColumn("_row", F.monotonically_increasing_id()), "forest-rows", rebalance=False
        )
        n = numbered.count()
        # A part scores about as many rows at once as it was grown from.
        buckets = max(1, math.ceil(n / max(self.rows, self.settings.node_rows)))
        parts = self.parts.select(
            "tree", "node", "nodes", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")
        )
        tasks = _tasks(self.tops, buckets)
        keys = ["tree", "node", "bucket"]
        dealt = numbered.select(
            *[F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(self.features)], "_row"
        ).mapInArrow(
            _score_blocks(self.features, self.edges, self.tops, buckets),
            "tree int, node int, bucket int, block long, places binary, ids binary, bins binary",
        )
        values = (
            dealt.repartition(tasks, *keys).groupBy(*keys)
            .cogroup(parts.repartition(tasks, *keys).groupBy(*keys))
            .applyInArrow(
                _scored_part(len(self.features)),
                "tree int, node int, block long, places binary, ids binary, values binary",
            )
        )
        means = values.groupBy("block").applyInArrow(
            _added(self.settings.trees, self.base), "_row long, _mean double"
        )
        return (
            numbered.join(means, "_row").select(*table.columns, F.col("_mean").alias(name))
        )


def _tasks(tops: _Tops, buckets: int = 1) -> int:
    """Parts are few and small to Spark, but each is long work: a task for every one."""
    return max(1, min(MOST_TASKS, buckets * sum(len(p) for p in tops.parts)))


def fit_forest(
    table: DataFrame, features: Sequence[str], label: str, settings: ForestSettings
) -> Forest:
    """Fit on all rows of ``table`` whose label is known; missing features count as lowest."""
    features = list(features)
    rows = table.where(F.col(label).isNotNull())
    n, base = rows.agg(F.count(F.lit(1)), F.avg(F.col(label).cast("double"))).first()
    if base is None:
        raise ValueError("a forest needs rows with a label")
    edges = bin_edges(rows, features, settings.bins)
    width = max(len(e) for e in edges) + 1
    blocks = _blocks(rows, features, label, edges)
    tops = _large_nodes(blocks, n, len(features), width, base, settings)
    dealt = blocks.mapInArrow(
        _dealt(settings, tops, len(features), base),
        "tree int, node int, place long, bins binary, target binary, weight binary",
    )
    grown = dealt.repartition(_tasks(tops), "tree", "node").groupBy("tree", "node").applyInArrow(
        _grown_part(settings, tops, len(features)), _PART
    )
    if tops.leaves:
        leaves = []
        for tree, node, mean in tops.leaves:
            leaf = np.zeros(1, NODE)
            leaf["left"], leaf["value"] = -1, mean
            leaves.append((tree, node, leaf.tobytes(), [0.0] * len(features)))
        grown = grown.unionByName(table.sparkSession.createDataFrame(leaves, _PART))
    parts = materialize(grown, "forest-parts", rebalance=False)
    gains = tops.gains.copy()
    for row in (
        parts.select("tree", "node", F.posexplode("gains").alias("feature", "gain"))
        .groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect()
    ):
        gains[row.tree, row.feature] += row.gain
    total = gains.sum(axis=1, keepdims=True)
    shares = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).sum(axis=0)
    importance = (shares / shares.sum() if shares.sum() else shares).tolist()
    return Forest(features, edges, float(base), n, tops, parts, importance, settings)
