"""Clustering of speakers, identities and boxes.

Each group (a clip) is small enough for one task: its members are tracks or speakers, not frames.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.functions import arrays
from timeloom.storage import materialise

#: Vectors of a block whose pairs with another block are one task's product.
BLOCK = 8192


def matrix(vectors: Sequence) -> np.ndarray:
    """Vectors as rows; components that are missing, null or no number count as 0."""
    rows = [np.array([np.nan if x is None else x for x in v], float) for v in vectors]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for to, row in zip(out, rows, strict=True):
        to[: len(row)] = np.nan_to_num(row)
    return out


def similarities(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    return unit @ unit.T


def average_linkage(distance: np.ndarray, threshold: float) -> list[int]:
    """Cluster numbers by agglomeration of the two clusters of least mean distance, while that is under the threshold."""
    d = np.array(distance, float)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    label, size = list(range(n)), np.ones(n)
    while n > 1:
        i, j = divmod(int(d.argmin()), len(d))
        if not d[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        mean = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = mean, mean
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label = [i if x == j else x for x in label]
        n -= 1
    order = {x: k for k, x in enumerate(dict.fromkeys(label))}
    return [order[x] for x in label]


def contracted(vectors: np.ndarray, labels: Sequence[int], threshold: float) -> list[int]:
    """Clusters whose mean vectors have a cosine of ``threshold`` or more become one, with all that such pairs connect.

    Means are those of the clusters given, not of what they become.  Numbers follow the order of first members.
    """
    names = sorted(set(labels))
    of = np.searchsorted(names, labels)
    near = similarities(np.stack([vectors[of == k].mean(axis=0) for k in range(len(names))])) >= threshold
    np.fill_diagonal(near, True)
    reach = near
    while (wider := (reach.astype(int) @ near.astype(int)) > 0).sum() > reach.sum():
        reach = wider
    merged = reach.argmax(axis=1)[of].tolist()  # the first cluster that it reaches
    order = {x: k for k, x in enumerate(dict.fromkeys(merged))}
    return [order[x] for x in merged]


def linked(df: DataFrame, keys: Sequence[str], member: str, vector: str, threshold: float, apart: str | None = None, penalty: float = 100.0, merge: float | None = None) -> DataFrame:
    """Average linkage of each key's members on cosine distance; members that share an entry of the array
    ``apart`` (such as frames) are pushed ``penalty`` further from each other.  With ``merge`` the clusters found are contracted (:func:`contracted`),
    which brings together what the penalty held apart.  Adds ``cluster``; rows without a vector are left out, components that are missing, null or no
    number count as 0, a null key is a key, an empty table gives no rows."""
    columns = [*keys, member, vector, *([apart] if apart else [])]
    schema = df.select(*keys, member).withColumn("cluster", F.lit(0)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(member)
        vectors = matrix(pdf[vector].to_list())
        distance = 1 - similarities(vectors)
        if apart:
            sets = [set(x) if x is not None else set() for x in pdf[apart]]
            distance = distance + penalty * np.array([[bool(a & b) for b in sets] for a in sets])
        labels = average_linkage(distance, threshold)
        pdf["cluster"] = np.array(labels if merge is None else contracted(vectors, labels, merge), np.int32)
        return pdf[[f.name for f in schema.fields]]

    return df.where(F.col(vector).isNotNull()).select(*columns).groupBy(*keys).applyInPandas(run, schema)


def join_identity(groups: list[tuple[set, list[np.ndarray]]], frames: set, vectors: np.ndarray, threshold: float) -> int:
    """Put a track into the group (its frames, its vectors) of least median cosine distance, among those that share no frame with it, if that
    is at most the threshold, else into a new one; the group's number."""
    best, at = np.inf, -1
    for g, (taken, held) in enumerate(groups):
        if taken & frames:
            continue
        both = similarities(matrix([*vectors, *(v for h in held for v in h)]))[: len(vectors), len(vectors) :]
        middle = float(np.median(1 - both))
        if middle < best:
            best, at = middle, g
    if at < 0 or best > threshold:
        at = len(groups)
        groups.append((set(), []))
    groups[at][0].update(frames)
    groups[at][1].append(vectors)
    return at


def identities(df: DataFrame, keys: Sequence[str], track: str, vectors: str, frames: str, threshold: float) -> DataFrame:
    """Tracks in order join the identity of least median pairwise cosine distance if that is at most the
    threshold and they share no frame with it, else they found a new one.  Adds ``identity``; tracks without vectors are left out; see
    :func:`linked` for odd components, keys and tables."""
    schema = df.select(*keys, track).withColumn("identity", F.lit(0)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(track)
        groups: list[tuple[set, list[np.ndarray]]] = []
        found = []
        for own_frames, own_vectors in zip(pdf[frames], pdf[vectors], strict=True):
            mine = matrix(own_vectors)
            at = join_identity(groups, set(own_frames) if own_frames is not None else set(), mine, threshold)
            found.append(at)
        pdf["identity"] = np.array(found, np.int32)
        return pdf[[f.name for f in schema.fields]]

    known = df.where(F.size(F.col(vectors)) > 0)
    return known.select(*keys, track, vectors, frames).groupBy(*keys).applyInPandas(run, schema)


def components(edges: DataFrame, keys: Sequence[str], rounds: int = 50) -> DataFrame:
    """``keys, node, component``: the smallest node that edges ``a, b`` of a key connect, by repeated minima of neighbours.

    Meant for graphs of short paths, such as speakers of a clip; stops when nothing changes.
    """
    both = edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = both.select(*keys, F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("component").alias("other"))
        step = label.join(near, [*keys, "node"], "left").select(*keys, "node", F.least("component", F.coalesce("other", "component")).alias("component"), F.col("component").alias("was"))
        step = materialise(step, "labels")
        changed = not step.where("component <> was").isEmpty()
        label = step.drop("was")
        if not changed:
            break
    return label


def suppressed(df: DataFrame, keys: Sequence[str], box: Sequence[str], score: str, threshold: float, top: int) -> DataFrame:
    """Boxes of each key that no better box of it covers by more than ``threshold`` (IoU), of the ``top`` best."""
    schema = df.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, *box], ascending=[False] + [True] * len(box)).head(top)
        b = pdf[list(box)].to_numpy(float)
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        alive = np.ones(len(b), bool)
        for i in range(len(b)):
            if alive[i]:
                side = np.maximum(0, np.minimum(b[i, 2:], b[:, 2:]) - np.maximum(b[i, :2], b[:, :2]))
                both = side[:, 0] * side[:, 1]
                either = area[i] + area - both
                covered = np.divide(both, either, out=np.zeros_like(both), where=either > 0) > threshold
                covered[: i + 1] = False
                alive &= ~covered
        return pdf[alive]

    return df.groupBy(*keys).applyInPandas(run, schema)


def similar(df: DataFrame, key: str, row: str, vector: str, threshold: float) -> DataFrame:
    """``a, b, cosine``: pairs of rows of one key, ``a < b``, whose cosine similarity reaches the threshold.

    Each key's vectors are dealt to blocks, and each two blocks meet in a task as a matrix product, by stripes; only pairs that come near
    the threshold leave it, and are decided by :func:`arrays.cosine`.  Null keys, rows, vectors and components take no part, and vectors of
    different lengths are not compared.  Work is quadratic in a key's rows, memory is not.
    """
    kinds = {name: df.schema[name].dataType.simpleString() for name in (key, row)}
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("key"), F.col(row).alias("row"), v.alias("v"), F.size(v).alias("n")).where("key IS NOT NULL AND row IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    most = rows.groupBy("key", "n").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // BLOCK))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    cells = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    dealt = rows.withColumn("block", block).select("*", cells).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    schema = f"a {kinds[row]}, b {kinds[row]}, x array<double>, y array<double>"

    def run(table: pa.Table) -> pa.Table:
        at = table["block"].to_numpy()
        vectors = np.array(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(at), table["n"][0].as_py())
        with np.errstate(all="ignore"):
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length != 0)
            i, j = table["i"][0].as_py(), table["j"][0].as_py()
            left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
            p, q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for start in range(0, len(left), 512):
                stripe = left[start : start + 512]
                near = ~(unit[stripe] @ unit[right].T < threshold - 1e-6)  # what is no number is left to be decided
                if i == j:
                    near &= stripe[:, None] < right
                m, n = np.nonzero(near)
                p.append(stripe[m])
                q.append(right[n])
        one, two = (table.take(pa.array(np.concatenate(x))) for x in (p, q))
        return pa.table([one["row"], two["row"], one["v"], two["v"]], names=["a", "b", "x", "y"])

    near = dealt.groupBy("key", "n", "i", "j").applyInArrow(run, schema).where("a <> b")
    swapped = F.col("a") > F.col("b")
    rated = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swapped, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swapped, F.col("x")).otherwise(F.col("y")).alias("y"))
    return rated.withColumn("cosine", arrays.cosine("x", "y")).where(F.col("cosine") >= threshold).select("a", "b", "cosine")
