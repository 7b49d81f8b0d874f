"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import stored

BLOCK_ROWS = 8192  # candidates whose sorted lists one task builds at a time
QUERY_ROWS = 2048  # queries that one task holds at a time
DEPTHS = (16, 64, 256)  # list depths at which the bound is tested; then the whole lists


class SortedLists:
    """Rows of one block, sorted in every dimension; the ends of the lists are kept."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        rising = np.argsort(self.values, axis=0, kind="stable").T
        self.low = np.ascontiguousarray(rising[:, : DEPTHS[-1]])
        self.high = np.ascontiguousarray(rising[:, ::-1][:, : DEPTHS[-1]])

    def _prefix(self, dims: np.ndarray, up: np.ndarray, depth: int) -> np.ndarray:
        """Places of the best ``depth`` rows for each dimension: from the high end of the list
        if the query is positive there, else from the low end."""
        return np.where(up[:, None], self.high[dims, :depth], self.low[dims, :depth])

    def _best(self, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best by falling score; rows are in id order, so the place breaks ties."""
        if len(at) > k:
            floor = np.partition(scores, len(at) - k)[len(at) - k]
            close = scores >= floor
            at, scores = at[close], scores[close]
        order = np.lexsort((at, -scores))[:k]
        return at[order], scores[order]

    def _from_ends(self, query: np.ndarray, own: int, k: int):
        """Sorted access goes down all lists together; each row seen is scored in full
        (random access). Stops as soon as the sum of the products at the current depth is
        below the kth score, so that no unseen row can reach or tie it; None if that does not
        happen within the kept depth."""
        dims = np.flatnonzero(query)
        up = query[dims] > 0
        n = len(self.ids)
        seen = np.zeros(n, bool)
        best_at, best = np.empty(0, np.int64), np.empty(0, query.dtype)
        for depth in DEPTHS:
            if not len(dims) or depth >= n or depth * len(dims) >= 4 * n:
                return None
            ends = self._prefix(dims, up, depth)
            mark = np.zeros(n, bool)
            mark[ends] = True
            new = np.flatnonzero(mark & ~seen)
            seen |= mark
            score = self.values[new] @ query
            mine = self.ids[new] != own
            best_at, best = self._best(
                np.concatenate([best_at, new[mine]]), np.concatenate([best, score[mine]]), k
            )
            edge = self.values[ends[:, -1], dims]
            if len(best) == k and edge @ query[dims] < best[-1]:
                return best_at, best
        return None

    def search(
        self, queries: np.ndarray, own: np.ndarray, k: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k best (ids, scores) of every query, ties to smaller ids. Queries whose bound
        stays above their kth score go to the end of the lists together."""
        found = [self._from_ends(q, int(o), k) for q, o in zip(queries, own)]
        open_queries = [i for i, f in enumerate(found) if f is None]
        for a in range(0, len(open_queries), 128):
            some = open_queries[a : a + 128]
            scores = queries[some] @ self.values.T
            for i, line in zip(some, scores):
                others = np.flatnonzero(self.ids != own[i])
                found[i] = self._best(others, line[others], k)
        return [(self.ids[at], score) for at, score in found]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _search_cell(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            width = max(rows["q"].map(len).max(), queries["q"].map(len).max())
            block, asked = _matrix(rows["q"], width), _matrix(queries["q"], width)
            # Products are exact in doubles up to 2^53, beyond that in Python integers.
            most = np.abs(block).max(initial=0) * np.abs(asked).max(initial=0) * width
            if most >= 2**53:
                block = np.array([[int(x) for x in row] for row in block], object)
                asked = np.array([[int(x) for x in row] for row in asked], object)
            lists = SortedLists(rows["vec_id"].to_numpy(), block)
            own_ids = queries["vec_id"].to_numpy()
            for own, (ids, scores) in zip(own_ids.tolist(), lists.search(asked, own_ids, k)):
                out["query_id"] += [own] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += [int(s) for s in scores]
        return pd.DataFrame(out).astype("int64")

    return run


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component; null unless all components are finite numbers."""
    usable = vector.isNotNull() & ~F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")),
    )
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * 256)))


def top_inner_products(
    vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "q"
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows for every query.

    Both tables have an id and an array of integers. Rows are dealt into blocks of about
    ``BLOCK_ROWS`` and queries into groups, both by hash; each block meets each group once,
    runs the threshold algorithm, and passes on at most k rows per query, which are
    merged per query (the limit applies before the shuffle too). The work is that of
    the stated query set against all rows.

    Rows with a null id or vector take no part. Rows with the query's id are its own.
    Repeated rows are candidates each; repeated queries are asked once. Missing trailing
    components count as zero. Scores must fit a long.
    """
    rows = stored(
        vectors.select(F.col(id_column).alias("vec_id"), F.col(vector).alias("q")).where(
            "vec_id IS NOT NULL AND q IS NOT NULL"
        ),
        "topk-rows",
    )
    asked = stored(
        queries.select(F.col(id_column).alias("vec_id"), F.col(vector).alias("q"))
        .where("vec_id IS NOT NULL AND q IS NOT NULL")
        .distinct(),
        "topk-queries",
    )
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    groups = max(1, -(-asked.count() // QUERY_ROWS))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        place = F.pmod(F.xxhash64("vec_id", "q"), F.lit(n)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        return df.withColumn(own, place).withColumn(other, every)

    cells = ("block", "group")
    found = (
        dealt(rows, "block", blocks, "group", groups)
        .groupBy(*cells)
        .cogroup(dealt(asked, "group", groups, "block", blocks).groupBy(*cells))
        .applyInPandas(_search_cell(k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
