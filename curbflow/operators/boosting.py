"""Boosted regression trees from distributed gradient histograms.

Values are put into quantile bins once; rows are kept as blocks of bin numbers. A pass over
the blocks adds up gradients and rows by node, feature and bin; these sums, whose number does
not depend on the rows, decide the splits. Of two children only the smaller is added up, the
other is the difference to the parent. Trees grow by the best gain first (a number of
leaves) or level by level (a depth). One pass prepares the children of all open leaves, so a
tree takes about as many passes as it is deep. A pass is one job of one stage over blocks that are
kept with their predictions; a table of one block is learnt in one task by the same code, without
a job for each pass.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from curbflow.session import materialize, ship_to_workers

ship_to_workers(__name__)

BLOCK_ROWS = 65_536
STORED_ROUNDS = 10  # after so many trees the predictions of the blocks are written anew
FEW_TASKS = 32  # sums of more tasks are added up in tasks before they come to the driver
LEAST_GAIN = 1e-9  # of the gradient's square sum: below it a gain is rounding


@dataclass(frozen=True)
class BoostSettings:
    """``penalty`` is added to the rows of a leaf in its weight; ``row_share`` and
    ``column_share`` are drawn once for each tree. Without ``leaves`` every split that gains is
    made down to ``max_depth``."""

    rounds: int = 180
    max_depth: int | None = 7
    leaves: int | None = None
    step: float = 0.06
    min_leaf: int = 1
    penalty: float = 1.0
    row_share: float = 0.85
    column_share: float = 0.9
    bins: int = 255
    seed: int = 42


# ---- bins ---------------------------------------------------------------------------------


def bin_edges(table: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper edges of the bins of each feature: midway between neighbours if there are no more
    than ``bins`` values, else quantiles. At most ``bins`` numbers a feature come to the driver."""
    values = [F.col(c).cast("double") for c in features]
    probs = [k / bins for k in range(1, bins)]
    row = table.agg(
        *[F.approx_count_distinct(v, 0.02).alias(f"n{k}") for k, v in enumerate(values)],
        *[F.percentile_approx(v, probs, 10 * bins).alias(f"q{k}") for k, v in enumerate(values)],
    ).first()
    few = [k for k in range(len(values)) if row[f"n{k}"] <= 2 * bins]
    known = {}
    if few:
        found = table.agg(*[F.array_sort(F.collect_set(values[k])).alias(f"s{k}") for k in few])
        known = {k: np.array(found.first()[f"s{k}"] or [0.0]) for k in few}
    edges = []
    for k in range(len(values)):
        if k in known and len(known[k]) <= bins:
            edges.append((known[k][1:] + known[k][:-1]) / 2)
        else:
            edges.append(np.unique(np.array(row[f"q{k}"] or [], float)))
    return edges


def _binned(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers, rows by features; a missing value counts as the lowest."""
    out = np.empty((len(columns[0]), len(edges)), np.uint16)
    for k, (values, cuts) in enumerate(zip(columns, edges)):
        out[:, k] = np.searchsorted(cuts, np.nan_to_num(values, nan=-np.inf, posinf=np.inf,
                                                        neginf=-np.inf), side="left")
    return out


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


_BLOCK = "place long, rows int, bins binary, target binary, predicted binary"
Block = tuple[int, np.ndarray, np.ndarray, np.ndarray]  # place, bins, target, prediction


def _pack(features: Sequence[str], label: str, edges: Sequence[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            bins = np.concatenate([b for b, _ in held])
            target = np.concatenate([y for _, y in held])
            return pa.RecordBatch.from_pydict(
                {
                    "place": pa.array([0], pa.int64()),
                    "rows": pa.array([len(target)], pa.int32()),
                    "bins": [bins.tobytes()], "target": [target.tobytes()],
                    "predicted": [np.zeros(len(target)).tobytes()],
                }
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _binned([_numbers(batch, f"f{k}") for k in range(len(features))], edges)
            held.append((bins, _numbers(batch, "y")))
            if sum(len(y) for _, y in held) >= BLOCK_ROWS:
                yield block()
                held = []
        if held:
            yield block()

    return run


def _blocks(table: DataFrame, features: Sequence[str], label: str, edges) -> DataFrame:
    """Rows as blocks of bins; the stored table fixes their order and numbers them."""
    plain = table.select(
        *[F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(features)],
        F.col(label).cast("double").alias("y"),
    )
    packed = plain.mapInArrow(_pack(features, label, edges), _BLOCK)
    return materialize(
        packed.withColumn("place", F.monotonically_increasing_id()), "boost-blocks", rebalance=False
    )


# ---- trees --------------------------------------------------------------------------------


@dataclass
class Tree:
    """Splits in the order in which a row meets them: node, feature, highest bin to the left,
    left and right child; and the value of each leaf."""

    splits: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int32)
        for node, feature, limit, left, right in self.splits:
            here = np.flatnonzero(at == node)
            at[here] = np.where(bins[here, feature] <= limit, left, right)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        top = max([0, *(max(x[3:]) for x in self.splits)])
        table = np.zeros(top + 1)
        for node, value in self.values.items():
            table[node] = value
        return table[self.nodes(bins)]


def drawn_rows(seed: int, round_: int, place: int, rows: int, share: float) -> np.ndarray:
    """Which rows of a block a tree learns from; the same in every pass and rerun."""
    if share >= 1:
        return np.ones(rows, bool)
    return np.random.default_rng([seed, round_, place]).random(rows) < share


def drawn_columns(seed: int, round_: int, columns: int, share: float) -> list[int]:
    n = max(1, round(share * columns))
    return sorted(np.random.default_rng([seed, round_]).permutation(columns)[:n].tolist())


def _read(
    batch: pa.RecordBatch, features: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Place, bins, target and prediction of the blocks of a batch, without copies."""
    for k, place in enumerate(batch.column("place").to_pylist()):
        bins, target, predicted = (
            batch.column(c)[k].as_buffer() for c in ("bins", "target", "predicted")
        )
        yield (
            place, np.frombuffer(bins, np.uint16).reshape(-1, features),
            np.frombuffer(target), np.frombuffer(predicted),
        )


def _slots(tree: Tree, wanted: list[int]) -> np.ndarray:
    """Place of each node among the wanted ones, -1 for others."""
    slots = np.full(max([0, *wanted, *(max(x[3:]) for x in tree.splits)]) + 1, -1)
    slots[wanted] = np.arange(len(wanted))
    return slots


def _add_block(
    out: np.ndarray, bins: np.ndarray, gradient: np.ndarray, slot: np.ndarray, drawn: np.ndarray,
    columns: list[int],
) -> None:
    """Add a block to ``out`` (gradient or rows, wanted node, feature, bin)."""
    _, nodes, _, width = out.shape
    used = np.flatnonzero((slot >= 0) & drawn)
    change, row = gradient[used], slot[used] * width
    for f in columns:
        code = row + bins[used, f]
        out[0, :, f] += np.bincount(code, change, nodes * width).reshape(nodes, width)
        out[1, :, f] += np.bincount(code, minlength=nodes * width).reshape(nodes, width)


def _sums(
    tree: Tree, wanted: list[int], columns: list[int], features: int, width: int,
    settings: BoostSettings, round_: int,
):
    """Gradients and rows by wanted node, feature and bin, summed over the blocks of a task; cells
    without rows are left out."""

    def run(blocks: Iterator[Block]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = np.zeros((2, len(wanted), features, width))
        slots = _slots(tree, wanted)
        for place, bins, target, predicted in blocks:
            drawn = drawn_rows(settings.seed, round_, place, len(target), settings.row_share)
            _add_block(out, bins, predicted - target, slots[tree.nodes(bins)], drawn, columns)
        yield _cells(out)

    return run


def _cells(out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gradient, rows = out.reshape(2, -1)
    found = np.flatnonzero(rows).astype(np.int32)
    return found, gradient[found], rows[found]


def _added(parts, cells: int) -> np.ndarray:
    out = np.zeros((2, cells))
    for cell, gradient, rows in parts:
        out[0, cell] += gradient
        out[1, cell] += rows
    return out


def _learnt_block(settings: BoostSettings, features: int, width: int, base: float):
    """The whole model from the only block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, bins, target, predicted in _read(batch, features):
                now = predicted + base

                def sums_of(round_, columns, tree, wanted):
                    out = np.zeros((2, len(wanted), features, width))
                    drawn = drawn_rows(
                        settings.seed, round_, place, len(target), settings.row_share
                    )
                    slot = _slots(tree, wanted)[tree.nodes(bins)]
                    _add_block(out, bins, now - target, slot, drawn, columns)
                    return out

                def finished(tree):
                    nonlocal now
                    now = now + tree.predict(bins)

                trees, gains = _grown(settings, features, sums_of, finished)
                model = pickle.dumps(([(t.splits, t.values) for t in trees], gains))
                yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    return run


def _sums_of_tasks(cells: int):
    def run(parts: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        yield _cells(_added(parts, cells))

    return run


def _kept_blocks(features: int, base: float):
    """Blocks as arrays, for the first round."""

    def run(rows: Iterator) -> Iterator[Block]:
        for row in rows:
            bins = np.frombuffer(row["bins"], np.uint16).reshape(-1, features)
            yield row["place"], bins, np.frombuffer(row["target"]), np.frombuffer(row["predicted"]) + base

    return run


def _with_tree(tree: Tree):
    def run(blocks: Iterator[Block]) -> Iterator[Block]:
        for place, bins, target, predicted in blocks:
            yield place, bins, target, predicted + tree.predict(bins)

    return run


def _as_row(block: Block) -> tuple:
    place, bins, target, predicted = block
    return place, len(target), bins.tobytes(), target.tobytes(), predicted.tobytes()


@dataclass
class _Node:
    depth: int
    gradient: float
    rows: float
    sums: np.ndarray | None = None  # (gradient or rows, feature, bin)
    split: tuple[float, int, int] | None = None  # gain, feature, highest bin to the left
    children: tuple[int, int] | None = None


def best_split(
    sums: np.ndarray, columns: Sequence[int], settings: BoostSettings
) -> tuple[float, int, int] | None:
    """The split of largest gain; of gains that differ by rounding only, the first by feature and
    bin. Gains are those of second-order boosting with squared loss."""
    gradient, rows = sums[0], sums[1]
    total, n = gradient[columns[0]].sum(), rows[columns[0]].sum()
    penalty = settings.penalty
    if n < 2 * settings.min_leaf or n < 2:
        return None
    left, count = np.cumsum(gradient, axis=1)[:, :-1], np.cumsum(rows, axis=1)[:, :-1]
    fits = (count >= max(1, settings.min_leaf)) & (n - count >= max(1, settings.min_leaf))
    fits &= rows[:, :-1] > 0  # else it is the split of the bin before
    fits &= np.isin(np.arange(len(rows)), columns)[:, None]
    if not fits.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left**2 / (count + penalty) + (total - left) ** 2 / (n - count + penalty)
    gain = np.where(fits, gain - total**2 / (n + penalty), -np.inf)
    top = gain.max()
    if not top > LEAST_GAIN * (1 + np.abs(gradient[columns[0]]).sum()):
        return None
    near = np.argwhere(gain >= top - 1e-9 * abs(top))
    feature, limit = near[0]
    return float(top), int(feature), int(limit)


class _Grower:
    """One tree on the driver; the sums of its nodes come from passes over the blocks."""

    def __init__(self, settings: BoostSettings, columns: list[int], sums_of) -> None:
        self.settings, self.columns, self.sums_of = settings, columns, sums_of
        self.nodes: dict[int, _Node] = {}
        self.order: list[int] = []

    def _judge(self, node: _Node) -> None:
        deep = self.settings.max_depth is not None and node.depth >= self.settings.max_depth
        node.split = None if deep else best_split(node.sums, self.columns, self.settings)

    def tentative(self) -> Tree:
        tree = Tree()
        for k in self.order:
            _, feature, limit = self.nodes[k].split
            tree.splits.append((k, feature, limit, *self.nodes[k].children))
        return tree

    def _open(self, parents: list[int]) -> None:
        """Children of ``parents`` with their sums, in one pass."""
        smaller = {}
        for k in parents:
            node = self.nodes[k]
            _, feature, limit = node.split
            part = node.sums[:, feature, : limit + 1].sum(axis=1)
            ids = len(self.nodes), len(self.nodes) + 1
            self.nodes[ids[0]] = _Node(node.depth + 1, part[0], part[1])
            self.nodes[ids[1]] = _Node(
                node.depth + 1, node.gradient - part[0], node.rows - part[1]
            )
            node.children = ids
            self.order.append(k)
            if self.settings.max_depth is None or node.depth + 1 < self.settings.max_depth:
                smaller[k] = min(ids, key=lambda i: self.nodes[i].rows)
        if smaller:
            sums = self.sums_of(self.tentative(), sorted(smaller.values()))
            for k, small in smaller.items():
                node = self.nodes[k]
                other = sum(node.children) - small
                self.nodes[small].sums = sums[small]
                self.nodes[other].sums = node.sums - sums[small]
        for k in parents:
            for child in self.nodes[k].children:
                if self.nodes[child].sums is not None:
                    self._judge(self.nodes[child])

    def grow(self) -> Tree:
        root = _Node(0, 0.0, 0.0, self.sums_of(Tree(), [0])[0])
        root.gradient, root.rows = root.sums[:, self.columns[0]].sum(axis=1)
        self.nodes[0] = root
        self._judge(root)
        limit = self.settings.leaves or 1 << 30
        while True:
            made, leaves, waiting = [], 1, []
            heap = [(-root.split[0], 0)] if root.split else []
            while heap and leaves < limit:
                gain, k = heapq.heappop(heap)
                if self.nodes[k].children is None:
                    waiting = [k] + [j for _, j in heap if self.nodes[j].children is None]
                    break
                made.append(k)
                leaves += 1
                for child in self.nodes[k].children:
                    if self.nodes[child].split:
                        heapq.heappush(heap, (-self.nodes[child].split[0], child))
            if not waiting:
                return self._pruned(made)
            self._open(waiting)

    def _pruned(self, made: list[int]) -> Tree:
        tree, leaves = Tree(), {0}
        for k in made:
            node = self.nodes[k]
            tree.splits.append((k, node.split[1], node.split[2], *node.children))
            leaves = leaves - {k} | set(node.children)
        for k in leaves:
            node = self.nodes[k]
            weight = -node.gradient / (node.rows + self.settings.penalty)
            tree.values[k] = float(self.settings.step * weight)
        return tree


@dataclass
class Boosted:
    """A fitted model: bin edges, base value, trees, and each feature's share of the gain."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    importance: list[float]

    def predict(self, table: DataFrame, name: str = "prediction") -> DataFrame:
        """``table`` with the double column ``name``."""
        features, edges, base, trees = self.features, self.edges, self.base, self.trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = _binned([_numbers(batch, c) for c in features], edges)
                out = np.full(len(bins), base)
                for tree in trees:
                    out += tree.predict(bins)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(out)], [*batch.schema.names, name]
                )

        schema = StructType([*table.schema.fields, StructField(name, DoubleType())])
        return table.mapInArrow(run, schema)


def _grown(settings: BoostSettings, features: int, sums_of, finished) -> tuple[list[Tree], list]:
    """Trees round by round, and each feature's gain."""
    trees: list[Tree] = []
    gains = np.zeros(features)
    for round_ in range(settings.rounds):
        columns = drawn_columns(settings.seed, round_, features, settings.column_share)

        def of_nodes(tree: Tree, wanted: list[int]) -> dict[int, np.ndarray]:
            out = sums_of(round_, columns, tree, wanted)
            return {k: out[:, i] for i, k in enumerate(wanted)}

        grower = _Grower(settings, columns, of_nodes)
        tree = grower.grow()
        for node, feature, *_ in tree.splits:
            gains[feature] += grower.nodes[node].split[0]
        trees.append(tree)
        finished(tree)
    return trees, gains.tolist()


def fit_boosted(
    table: DataFrame, features: Sequence[str], label: str, settings: BoostSettings
) -> Boosted:
    """Fit on all rows of ``table`` whose label is known; missing features count as lowest."""
    features = list(features)
    rows = table.where(F.col(label).isNotNull())
    n, base = rows.agg(F.count(F.lit(1)), F.avg(F.col(label).cast("double"))).first()
    if base is None:
        raise ValueError("boosting needs rows with a label")
    edges = bin_edges(rows, features, settings.bins)
    width = max(len(e) for e in edges) + 1
    one = n <= BLOCK_ROWS
    blocks = _blocks(rows.coalesce(1) if one else rows, features, label, edges)
    if one:
        learnt = blocks.mapInArrow(
            _learnt_block(settings, len(features), width, base), "model binary"
        )
        found, gains = pickle.loads(learnt.first()["model"])
        trees = [Tree(*tree) for tree in found]
    else:
        trees, gains = _fit_blocks(blocks, len(features), width, base, settings)
    total = sum(gains)
    return Boosted(features, edges, float(base), trees, [g / total if total else g for g in gains])


def _fit_blocks(
    blocks: DataFrame, features: int, width: int, base: float, settings: BoostSettings
) -> tuple[list[Tree], list[float]]:
    """One job of one stage for each pass over the blocks; the sums of a pass come to the driver,
    those of many tasks after they were added up in a few.

    The blocks are kept with the predictions of all trees so far, so a pass only follows the tree
    that grows. A tree is added by the first pass of the next round. Every ``STORED_ROUNDS`` trees
    the blocks are written, so a lost executor repeats few of them.
    """
    spark = blocks.sparkSession
    tasks = max(1, min(blocks.count(), spark.sparkContext.defaultParallelism))
    made = 0

    def read(table: DataFrame, start: float):
        rows = table.repartition(tasks).select("place", "bins", "target", "predicted").rdd
        return rows.mapPartitions(_kept_blocks(features, start))

    def keep(rdd):
        return rdd.persist(StorageLevel.MEMORY_AND_DISK)

    now, before = keep(read(blocks, base)), []

    def sums_of(round_, columns, tree, wanted):
        cells = len(wanted) * features * width
        parts = now.mapPartitions(_sums(tree, wanted, columns, features, width, settings, round_))
        if tasks > FEW_TASKS:
            few = int(tasks**0.5)
            dealt = parts.mapPartitionsWithIndex(lambda k, x: ((k % few, part) for part in x))
            parts = dealt.partitionBy(few, int).values().mapPartitions(_sums_of_tasks(cells))
        out = _added(parts.collect(), cells)
        while before:  # the first pass of a round has kept the new predictions
            before.pop().unpersist()
        return out.reshape(2, len(wanted), features, width)

    def finished(tree):
        nonlocal now, made
        made += 1
        before.append(now)
        now = now.mapPartitions(_with_tree(tree))
        if made % STORED_ROUNDS == 0:
            table = spark.createDataFrame(now.map(_as_row), blocks.schema)
            now = read(materialize(table, "boost-blocks", rebalance=False), 0.0)
        now = keep(now)

    try:
        return _grown(settings, features, sums_of, finished)
    finally:
        for kept in [now, *before]:
            kept.unpersist()


def splits_table(spark: SparkSession, model: Boosted) -> DataFrame:
    """One row per split: round, node, feature, the value up to which rows go left, and the
    children with their values (null where they are split again)."""
    rows = [
        (round_, node, model.features[f], float(model.edges[f][limit]), left, right,
         tree.values.get(left), tree.values.get(right))
        for round_, tree in enumerate(model.trees, 1)
        for node, f, limit, left, right in tree.splits
    ]
    return spark.createDataFrame(
        rows,
        "round int, node int, feature string, split_at double, left int, right int, "
        "left_value double, right_value double",
    )
