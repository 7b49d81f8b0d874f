import numpy as np
import pytest

from curbflow.operators import forest
from curbflow.operators.forest import ForestSettings

NAMES = ["a", "b", "c"]


def data(n, seed=5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 30, n), rng.random(n).round(2)])
    return x, (3.0 * (x[:, 0] > 4) + 0.2 * x[:, 1] + x[:, 2] + rng.random(n)).round(3)


def frame(spark, x, y):
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double")


def by_hand(x, y, w, min_leaf, depth):
    """Prediction of each row by trying every split of every node."""
    mean = (w * y).sum() / w.sum()
    best = None
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if min(w[left].sum(), w[~left].sum()) < min_leaf:
                continue
            gain = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (left, ~left))
            if best is None or gain > best[0] + 1e-9:
                best = gain, left
    out = np.full(len(y), mean)
    if depth and best and best[0] - (w * y).sum() ** 2 / w.sum() > 1e-9:
        for side in (best[1], ~best[1]):
            out[side] = by_hand(x[side], y[side], w[side], min_leaf, depth - 1)
    return out


@pytest.mark.parametrize(("min_leaf", "depth"), [(1, 30), (3, 30), (2, 4)])
def test_a_part_has_the_best_split_of_every_node(min_leaf, depth):
    x, y = data(120)
    bins = np.column_stack([np.unique(c, return_inverse=True)[1] for c in x.T]).astype(np.uint16)
    w = np.random.default_rng(1).integers(1, 4, len(y)).astype(float)
    nodes, gains = forest.grow_part(bins, y - y.mean(), w, min_leaf, depth)
    got = forest.part_values(nodes, bins) + y.mean()
    assert got == pytest.approx(by_hand(bins, y, w, min_leaf, depth))
    square = (w * (y - np.average(y, weights=w)) ** 2).sum()
    assert gains.sum() == pytest.approx(square - (w * (y - got) ** 2).sum())


def test_large_nodes_are_split_from_sums_to_the_same_trees(spark):
    x, y = data(400)
    df = frame(spark, x, y).repartition(3).cache()
    whole, parts = (
        forest.fit_forest(df, NAMES, "y", ForestSettings(trees=4, node_rows=n)) for n in (1000, 60)
    )
    assert whole.parts.count() == 4 and parts.parts.count() > 20
    assert len(parts.tops.trees[0].splits) > 3 and not whole.tops.trees[0].splits
    assert parts.importance == pytest.approx(whole.importance)
    assert sum(whole.importance) == pytest.approx(1)

    def rows(model):
        return sorted(tuple(r) for r in model.predict(df).collect())

    for left, right in zip(rows(whole), rows(parts)):
        assert left == pytest.approx(right)
    assert len(rows(parts)) == 400


def test_parts_are_tasks_of_their_own(spark):
    """Sums of every small node were shuffled before, a number for each bin of each feature."""
    x, y = data(300)
    model = forest.fit_forest(frame(spark, x, y), NAMES, "y", ForestSettings(trees=12))
    assert model.parts.select("tree").distinct().count() == 12
    assert forest._tasks(model.tops) == 12
    found = model.predict(frame(spark, x, y)).toPandas()
    assert ((found.prediction - found.y) ** 2).mean() < 0.3 * y.var()
    alike = frame(spark, x, np.ones(300))  # nothing to split
    flat = forest.fit_forest(alike, NAMES, "y", ForestSettings(trees=2, node_rows=50))
    assert {r.prediction for r in flat.predict(alike).collect()} == {1.0}
    with pytest.raises(ValueError):
        forest.fit_forest(alike.where("y > 5"), NAMES, "y", ForestSettings(trees=1))
