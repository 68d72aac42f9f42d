"""Exact top-k search by aggregating sorted lists without random access.

The candidates fall into blocks.  Within a block every dimension has its list
of candidates sorted by component; a query reads each list from the end that
suits the sign of its own component, one stretch of entries after the other.
What was read of a candidate, and the worst that its unread lists can hold, is
its lower bound; with the last entries
read instead of the worst ones it is its upper bound.  Candidates whose upper
bound is under the k-th best lower bound are out for good, those of which nothing was read among them.  When
few are left, reading stops and the scores of those few are resolved.

Queries read in step: after a stretch all that was read is the same for all of them, each
from its own ends, so the bounds of many queries are two matrix products, of what stands for a component after so many entries
from the top (and from the bottom) with the positive (and the negative) components of the queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates in a block, and queries in a block.
CANDIDATES, QUERIES = 8192, 2048
#: Queries whose bounds are kept at a time.
TOGETHER = 128
#: The first stretch is this share of a list; each later one is as long as all before it.
STRETCH = 64
#: Bound of a candidate that is out.
NEVER = -np.inf
#: Sums of whole numbers under this are exact in double precision; beyond it Python's own integers are used.
WIDE = 1 << 53


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros to ``width``."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if width and len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Block:
    """Sorted lists of a block of candidates."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        n = len(rows)
        order = np.argsort(rows, axis=0, kind="stable")  # ascending; read from either end
        self.lists = np.take_along_axis(rows, order, axis=0)
        #: Each candidate's place in each list, from the bottom.
        self.place = np.empty(rows.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.peak = int(np.abs(rows.astype(np.float64)).max(initial=0)) + 1
        #: List entries that queries have read.
        self.read = 0

    def standing(self, depth: int, worst: bool, live: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """What stands for each component after ``depth`` entries of every list, from the top and from the bottom: itself once it was read, before
        that the worst that it can be or the last entry read."""
        n = len(self.rows)
        rows, place = self.rows[live].astype(kind), self.place[live]
        top, bottom = self.lists[0 if worst else n - depth], self.lists[-1 if worst else depth - 1]
        return np.where(place >= n - depth, rows, top.astype(kind)), np.where(place < depth, rows, bottom.astype(kind))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, candidate id, score) of each query's k best other candidates."""
        out = []
        for at in range(0, len(queries), TOGETHER):
            own, some = query_ids[at : at + TOGETHER], queries[at : at + TOGETHER]
            peak = self.peak * (int(np.abs(some.astype(np.float64)).max(initial=0)) + 1) * max(queries.shape[1], 1)
            weights = some.astype(np.float64 if peak < WIDE else object)
            left = self._aggregate(weights, self.ids[:, None] != own, k)
            for q in range(len(own)):
                found = np.flatnonzero(left[:, q])
                scores = self.rows[found].astype(weights.dtype) @ weights[q]
                if weights.dtype == object:
                    scores = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in scores], np.int64)
                scores = scores.astype(np.int64)
                top = best(self.ids[found], scores, k)
                out.append((np.full(len(top), own[q]), self.ids[found][top], scores[top]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _aggregate(self, weights: np.ndarray, alive: np.ndarray, k: int) -> np.ndarray:
        """Which candidates (rows) are left for which queries (columns) when reading stops."""
        n = len(self.ids)
        up, down = np.maximum(weights, 0).T, np.minimum(weights, 0).T
        lists = (weights != 0).sum(1)
        depth, asking = 0, np.flatnonzero((alive.sum(0) > k) & (lists > 0))
        while depth < n and len(asking):
            self.read += int(lists[asking].sum()) * (-depth + (depth := min(n, max(2 * depth, n // STRETCH, 1))))
            live = np.flatnonzero(alive[:, asking].any(1))
            of = np.ix_(live, asking)
            bounds = []
            for worst in (True, False):
                high, low = self.standing(depth, worst, live, weights.dtype.type)
                found = high @ up[:, asking] + low @ down[:, asking]
                found[~alive[of]] = NEVER if weights.dtype != object else -(1 << 200)
                bounds.append(found)
            lower, upper = bounds
            bar = np.sort(lower, axis=0)[len(live) - k] if weights.dtype == object else np.partition(lower, len(live) - k, axis=0)[len(live) - k]
            alive[of] &= upper >= bar
            asking = asking[alive[:, asking].sum(0) > 8 * k]
        return alive


def scaled(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """Columns ``id`` and ``v`` (array of long) of the rows whose vectors are whole and finite."""
    v = df[vector]
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(ok & df[key].isNotNull()).select(df[key].alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


def search(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's ``k`` best other rows by the inner product of floor(scale * component).

    Queries are the rows whose id is divisible by ``every``.  Columns ``query_id``, ``rank`` (from
    1), ``vec_id`` and ``score``; ties go to the smaller id.  Rows whose id is null, or whose vector
    is null or has null or non-finite components, take no part; of vectors of unequal lengths
    the missing components count as 0, so an empty vector scores 0 with every other.  Rows that repeat an id are candidates and queries each
    for itself, but never for a row of the same id.  Scores beyond a long stop at its limits.
    """
    rows = scaled(df, key, vector, scale)
    stats = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).first()
    n_candidates = max(1, -(-stats["n"] // CANDIDATES))
    n_queries = max(1, -(-stats["q"] // QUERIES))
    width = stats["d"] or 0
    cell = lambda c, n, seed: F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(n)).cast("int").alias(c)
    queries = rows.where(F.col("id") % every == 0).select(cell("qb", n_queries, 1), F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))).alias("cb"), "id", "v")
    candidates = rows.select(F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"), cell("cb", n_candidates, 2), "id", "v")

    def run(found: pa.Table, asked: pa.Table) -> pa.Table:
        block = Block(found["id"].to_numpy(), matrix(found["v"], width))
        out = block.search(asked["id"].to_numpy(), matrix(asked["v"], width), k) if len(found) and len(asked) else (np.zeros(0, np.int64),) * 3
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    grid = candidates.groupBy("qb", "cb").cogroup(queries.groupBy("qb", "cb"))
    found = grid.applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
