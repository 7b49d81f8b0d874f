import numpy as np
import pytest

from curbflow.operators import boosting
from curbflow.operators.boosting import BoostSettings, Tree

NAMES = ["a", "b", "c"]


def rows_of(seed, n=600):
    pick = np.random.default_rng(seed)
    a = pick.integers(0, 12, n).astype(float)
    b = pick.normal(size=n).round(2)
    c = pick.integers(0, 3, n).astype(float)
    y = 3 * (a > 5) + 2 * b * (c == 1) + (a == 3) * 4 + pick.normal(scale=0.3, size=n)
    return np.column_stack([a, b, c]), y.round(3)


def frame(spark, x, y):
    rows = [(*map(float, row), float(v)) for row, v in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double").coalesce(1)


def brute_tree(bins, target, predicted, settings, columns, drawn):
    """Best-first growth that looks at every row for every candidate; rows are sets, no sums kept."""
    g = predicted - target

    def best(rows):
        found = None
        total, n, lam = g[rows].sum(), len(rows), settings.penalty
        for f in columns:
            for limit in np.unique(bins[rows, f])[:-1]:
                left = rows[bins[rows, f] <= limit]
                k = len(left)
                if k < settings.min_leaf or n - k < settings.min_leaf:
                    continue
                s = g[left].sum()
                gain = s**2 / (k + lam) + (total - s) ** 2 / (n - k + lam) - total**2 / (n + lam)
                if gain > 1e-6 and (found is None or gain > found[0] * (1 + 1e-9)):
                    found = gain, f, int(limit)
        return found

    leaves = [(np.flatnonzero(drawn), best(np.flatnonzero(drawn)), 0, np.arange(len(g)))]
    splits = []
    while settings.leaves is None or len(leaves) < settings.leaves:
        can = [
            k for k, (_, s, depth, _) in enumerate(leaves)
            if s and (settings.max_depth is None or depth < settings.max_depth)
        ]
        if not can:
            break
        k = max(can, key=lambda j: leaves[j][1][0])
        rows, (gain, f, limit), depth, every = leaves.pop(k)
        splits.append((f, limit))
        for side in (True, False):
            part = rows[(bins[rows, f] <= limit) == side]
            leaves.append((part, best(part), depth + 1, every[(bins[every, f] <= limit) == side]))
    change = np.zeros(len(g))
    for rows, _, _, every in leaves:
        change[every] = -settings.step * g[rows].sum() / (len(rows) + settings.penalty)
    return splits, change


@pytest.mark.parametrize(
    "settings",
    [
        BoostSettings(4, None, 9, 0.1, 20, 0.0, 1.0, 1.0, 255, 1),  # best first
        BoostSettings(3, 3, None, 0.3, 1, 1.0, 0.85, 0.7, 255, 7),  # by depth, rows and columns drawn
        BoostSettings(2, 4, 6, 0.5, 5, 0.5, 1.0, 1.0, 16, 3),  # few quantile bins
    ],
)
@pytest.mark.parametrize("one_task", [True, False])
def test_equals_a_brute_force_learner_split_by_split(spark, settings, one_task, monkeypatch):
    x, y = rows_of(settings.seed)
    if not one_task:
        monkeypatch.setattr(
            boosting, "_learnt_block", lambda settings, features, width, base: pytest.fail()
        )
        monkeypatch.setattr(boosting, "BLOCK_ROWS", len(y) - 1)
    model = boosting.fit_boosted(frame(spark, x, y), NAMES, "y", settings)
    bins = boosting._binned(list(x.T), model.edges)
    predicted = np.full(len(y), y.mean())
    for k, tree in enumerate(model.trees):
        columns = boosting.drawn_columns(settings.seed, k, 3, settings.column_share)
        drawn = boosting.drawn_rows(settings.seed, k, 0, len(y), settings.row_share)
        splits, change = brute_tree(bins, y, predicted, settings, columns, drawn)
        mine = [(f, limit) for _, f, limit, *_ in tree.splits]
        assert (mine if settings.leaves else sorted(mine)) == (
            splits if settings.leaves else sorted(splits)
        )
        assert np.allclose(tree.predict(bins), change, atol=1e-9)
        predicted = predicted + change
    got = model.predict(frame(spark, x, y)).collect()
    assert np.allclose([r.prediction for r in got], predicted, atol=1e-9)
    assert abs(sum(model.importance) - 1) < 1e-9


def test_many_blocks_and_stored_predictions(spark, monkeypatch):
    """One task or a job for each pass, blocks and stored rounds: the model is the same."""
    x, y = rows_of(5, 900)
    settings = BoostSettings(6, None, 5, 0.2, 10, 0.0, 1.0, 1.0, 255, 1)
    whole = boosting.fit_boosted(frame(spark, x, y), NAMES, "y", settings)
    monkeypatch.setattr(boosting, "STORED_ROUNDS", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    parts = boosting.fit_boosted(frame(spark, x, y).repartition(5), NAMES, "y", settings)
    for a, b in zip(whole.trees, parts.trees):
        assert a.splits == b.splits
        assert np.allclose([a.values[k] for k in sorted(a.values)],
                           [b.values[k] for k in sorted(b.values)])


def test_edges(spark):
    x, y = rows_of(2, 3_000)
    a, b, c = boosting.bin_edges(frame(spark, x, y), NAMES, 32)
    assert a.tolist() == [k + 0.5 for k in range(11)] and c.tolist() == [0.5, 1.5]
    counts = np.bincount(np.searchsorted(b, x[:, 1], side="left"))
    assert len(b) <= 31 and counts.max() <= 2.2 * len(y) / 32


def test_missing_values_and_no_gain(spark):
    rows = [(None, 1.0), (1.0, 1.0), (float("nan"), 1.0), (2.0, None)]
    df = spark.createDataFrame(rows, "a double, y double")
    model = boosting.fit_boosted(df, ["a"], "y", BoostSettings(rounds=2))
    assert [t.splits for t in model.trees] == [[], []] and model.importance == [0.0]
    assert [r.prediction for r in model.predict(df).collect()] == [1.0] * 4
    with pytest.raises(ValueError):
        boosting.fit_boosted(df.where("y > 5"), ["a"], "y", BoostSettings(rounds=1))


def test_a_row_meets_the_splits_in_order():
    tree = Tree([(0, 0, 3, 1, 2), (2, 1, 0, 3, 4)], {1: 1.0, 3: 3.0, 4: 4.0})
    bins = np.array([[3, 9], [4, 0], [4, 1]], np.uint16)
    assert tree.nodes(bins).tolist() == [1, 3, 4]
    assert tree.predict(bins).tolist() == [1.0, 3.0, 4.0]


def test_one_small_job_for_each_pass(spark, monkeypatch):
    """Deep trees over many blocks: no pass costs more than one job, and sums of many
    tasks that are added up in tasks give the same model."""
    x, y = rows_of(11, 900)
    settings = BoostSettings(3, 5, None, 0.2, 1, 1.0, 0.85, 1.0, 255, 1)
    passes = []

    def fitted():
        return boosting.fit_boosted(frame(spark, x, y).repartition(5), NAMES, "y", settings)

    grow = boosting._Grower.__init__

    def watched(self, settings, columns, sums_of):
        def sums(tree, wanted):
            passes.append(len(wanted))
            return sums_of(tree, wanted)

        grow(self, settings, columns, sums)

    monkeypatch.setattr(boosting._Grower, "__init__", watched)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    context = spark.sparkContext
    fit_blocks, jobs = boosting._fit_blocks, []

    def in_group(*args):
        context.setJobGroup("boost-passes", "passes over blocks")
        try:
            return fit_blocks(*args)
        finally:
            jobs.extend(context.statusTracker().getJobIdsForGroup("boost-passes"))
            context.setLocalProperty("spark.jobGroup.id", None)

    monkeypatch.setattr(boosting, "_fit_blocks", in_group)
    few = fitted()
    assert len(passes) >= 9 and len(jobs) <= len(passes) + 4
    monkeypatch.setattr(boosting, "FEW_TASKS", 2)
    many = fitted()
    for a, b in zip(few.trees, many.trees):
        assert a.splits == b.splits
        assert np.allclose([a.values[k] for k in sorted(a.values)],
                           [b.values[k] for k in sorted(b.values)])
