"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import stored


def _stars(pairs: DataFrame) -> DataFrame:
    """Join each node's smallest neighbour to its edges.

    The minimum is combined before the shuffle; the join back splits a node with very
    many edges over tasks (skew join).
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least.select("u", F.least("u", "m").alias("m")), "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        _stars(both)
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _stars(down)
    return (
        starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(starred.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one edge, down to a root."""
    roles = edges.selectExpr("v AS node", "0 AS child", "1 AS root", "false AS up").unionByName(
        edges.selectExpr("u AS node", "1 AS child", "0 AS root", "u < v AS up")
    )
    wrong = roles.groupBy("node").agg(
        F.sum("child").alias("children"), F.max("root").alias("root"), F.max("up").alias("up")
    )
    return wrong.where("children > 1 OR (children = 1 AND root = 1) OR up").isEmpty()


def components(edges: DataFrame, name: str) -> DataFrame:
    """Columns ``u`` and ``v`` (longs, any direction) to ``node``, ``component``.

    ``component`` is the smallest node that can be reached. Nodes without edges do not
    appear. Every round is a stored table; rounds grow with the logarithm of the size of a
    component, and at most one row per round goes to the driver.
    """
    now = stored(edges.select("u", "v").where("u <> v").distinct(), f"{name}-edges")
    while not _is_star_forest(now):
        now = stored(_small(_large(now)), f"{name}-stars")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def spanning_forest(
    linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int
) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the pairs marked in ``linked`` (rows ``left``, columns
    ``right``, places below ``n``): fewer edges than places, however many pairs there are."""
    seen = np.zeros(n, bool)
    row, column = np.full(n, -1), np.full(n, -1)
    row[left] = np.arange(len(left))
    column[right] = np.arange(len(right))
    a: list[int] = []
    b: list[int] = []
    starts = np.concatenate([left[linked.any(axis=1)], right[linked.any(axis=0)]])
    for start in starts.tolist():
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        while queue:
            x = queue.pop()
            near = []
            if row[x] >= 0:
                near.append(right[linked[row[x]]])
            if column[x] >= 0:
                near.append(left[linked[:, column[x]]])
            new = np.unique(np.concatenate(near))
            new = new[~seen[new]]
            seen[new] = True
            a += new.tolist()
            b += [x] * len(new)
            queue += new.tolist()
    return a, b
