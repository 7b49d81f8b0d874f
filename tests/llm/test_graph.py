import numpy as np
import pytest

from curbflow.llm.common import ordered_offsets
from curbflow.llm.graph import components, spanning_forest


def find_all(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["path", "star", "random", "upward", "none", "loops"])
def test_components_equal_union_find(spark, kind):
    pick = np.random.default_rng(9)
    pairs = {
        "path": [(k, k + 1) for k in range(60)],
        "star": [(5, k) for k in range(40)],
        "random": [tuple(map(int, p)) for p in pick.integers(-30, 60, size=(50, 2))],
        "upward": [(1, 9), (2, 8)],
        "none": [],
        "loops": [(3, 3), (4, 4), (4, 6), (6, 4)],
    }[kind]
    got = components(spark.createDataFrame(pairs, "u long, v long"), "test").collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == find_all(pairs)


def test_spanning_forest_joins_what_is_linked():
    pick = np.random.default_rng(1)
    linked = pick.random((8, 5)) < 0.2
    left, right = np.arange(8), np.arange(8, 13)
    a, b = spanning_forest(linked, left, right, 13)
    pairs = [(int(left[i]), int(right[j])) for i, j in zip(*np.nonzero(linked))]
    assert find_all(list(zip(a, b))) == find_all(pairs)
    assert len(a) == len(find_all(pairs)) - len(set(find_all(pairs).values()))


def test_ordered_offsets_are_prefix_sums(spark):
    rows = [(int(k) % 17, k, int(k) % 5) for k in range(400)]
    df = spark.createDataFrame(rows, "a int, b long, x long")
    got = ordered_offsets(df, ["a", "b"], {"before": "x", "also": "x"}, "test").collect()
    total, want = 0, {}
    for a, b, x in sorted(rows):
        want[a, b] = total
        total += x
    assert {(r.a, r.b): r.before for r in got} == want
    assert all(r.before == r.also for r in got)
    assert ordered_offsets(df.limit(0), ["a", "b"], {"n": "x"}, "test").count() == 0
