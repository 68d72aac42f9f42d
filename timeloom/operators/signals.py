"""Sync distances, label statistics and smoothing of feature tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions import arrays


def shifted_distances(df: DataFrame, keys: Sequence[str], a: str, b: str, reach: int, frame: str = "frame") -> DataFrame:
    """``keys, frame, d``: 1 - cosine of ``a`` with ``b`` at each shift from -reach to reach; 1 beyond the ends."""
    shifts = df.select(*keys, frame, F.col(a).alias("__x"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("__s"))
    shifts = shifts.withColumn("__at", F.col(frame) + F.col("__s"))
    other = df.select(*keys, F.col(frame).alias("__at"), F.col(b).alias("__y"))
    near = shifts.join(other, [*keys, "__at"], "left").withColumn("__d", F.coalesce(1 - arrays.cosine("__x", "__y"), F.lit(1.0)))
    return near.groupBy(*keys, frame).agg(F.transform(F.array_sort(F.collect_list(F.struct("__s", "__d"))), lambda x: x["__d"]).alias("d"))


def best_shift(df: DataFrame, keys: Sequence[str], distances: str) -> DataFrame:
    """``keys, shift, middle``: the position of the least mean distance, and the median of the means."""
    means = df.select(*keys, F.posexplode(distances).alias("shift", "x")).groupBy(*keys, "shift").agg(F.avg("x").alias("x"))
    return means.groupBy(*keys).agg(F.min_by("shift", F.struct("x", "shift")).alias("shift"), F.median("x").alias("middle"))


def sync_confidence(df: DataFrame, keys: Sequence[str], distances: str, frame: str = "frame", edge: int = 0, far: float = 10.0) -> DataFrame:
    """``keys, frame, confidence``: how far a frame's distance at its track's best shift lies under the median of the means.

    With ``edge`` so many frames before the first and after the last one are there too, at the distance ``far``: scores of windows
    begin and end that much inside a track.
    """
    joined = df.join(best_shift(df, keys, distances), list(keys))
    if edge:
        ends = joined.groupBy(*keys, "shift", "middle").agg(F.min(frame).alias("__lo"), F.max(frame).alias("__hi"))
        outside = F.concat(F.sequence(F.col("__lo") - edge, F.col("__lo") - 1), F.sequence(F.col("__hi") + 1, F.col("__hi") + edge))
        more = ends.select(*keys, F.explode(outside).alias(frame), (F.col("middle") - far).alias("confidence"))
        return sync_confidence(df, keys, distances, frame).unionByName(more)
    return joined.select(*keys, frame, (F.col("middle") - F.get(F.col(distances), F.col("shift"))).alias("confidence"))


def label_distribution(df: DataFrame, ids: str, size: int, blank: int = 0) -> DataFrame:
    """``id, share`` of all ids: each counts once an utterance, at least once in all, the blank not at all."""
    seen = df.select(F.explode(F.array_distinct(ids)).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(size).select(F.col("id").cast("int").alias("id"))
    counts = every.join(seen, "id", "left").select("id", F.when(F.col("id") == blank, 0).otherwise(F.greatest(F.lit(1).cast("bigint"), F.coalesce("n", F.lit(1)))).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total), F.lit(True)).select("id", (F.col("n") / F.col("total")).alias("share"))


def average_checkpoints(df: DataFrame, checkpoint: str, key: str, values: str) -> DataFrame:
    """``key, i, x``: element-wise means over the checkpoints that have the same keys as the first one."""
    sets = df.groupBy(checkpoint).agg(F.sort_array(F.collect_set(key)).alias("keys"))
    first = sets.agg(F.min_by("keys", checkpoint).alias("keys"))
    alike = sets.join(F.broadcast(first), "keys", "left_semi").select(checkpoint)
    rows = df.join(alike, checkpoint, "left_semi").select(key, F.posexplode(values).alias("i", "x"))
    return rows.groupBy(key, "i").agg(F.avg("x").alias("x"))


def moving_average(df: DataFrame, keys: Sequence[str], value: str, reach: int, frame: str = "frame") -> DataFrame:
    """Means over a window that is as wide on both sides and shrinks towards the ends, as ``smoothed``."""
    order = Window.partitionBy(*keys).orderBy(frame)
    held = F.collect_list(value).over(order.rowsBetween(-reach, reach))
    before = F.least(F.lit(reach), F.row_number().over(order) - 1)
    after = F.least(F.lit(reach), F.count("*").over(Window.partitionBy(*keys)).cast("int") - F.row_number().over(order))
    marked = df.withColumns({"__h": held, "__b": before, "__r": F.least(before, after)})
    part = F.slice("__h", F.col("__b") - F.col("__r") + 1, 2 * F.col("__r") + 1)
    mean = F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)
    return marked.withColumn("smoothed", mean).drop("__h", "__b", "__r")


def recentred(df: DataFrame, keys: Sequence[str], points: dict[str, str], reach: int, frame: str = "frame") -> DataFrame:
    """Points (names of x columns to their y columns) whose shape is smoothed over frames while their centre stays that of the frame.

    Each coordinate's :func:`moving_average` is moved so that the mean over all points is the frame's own.
    """
    out = df
    names = [*points, *points.values()]
    for c in names:
        out = moving_average(out, keys, c, reach, frame).withColumnRenamed("smoothed", f"__{c}")
    for axis in (list(points), list(points.values())):
        shift = sum((F.col(c) - F.col(f"__{c}") for c in axis), F.lit(0.0)) / len(axis)
        out = out.withColumns({f"__{c}_s": F.col(f"__{c}") + shift for c in axis})
    return out.select(*[c for c in df.columns if c not in names], *(F.col(f"__{c}_s").alias(c) for c in names))


def slice_of_track(features: DataFrame, segments: DataFrame, keys: Sequence[str], track: str, fps: int = 25) -> DataFrame:
    """``keys, track, features``: the clip's feature rows (``frame, v``) from a track's first to its last segment, in order."""
    span = segments.groupBy(*keys, track).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    at = lambda c: F.floor(F.col(c) * fps / 1_000_000 + 0.5)
    met = features.join(span.select(*keys, track, at("t0").alias("f0"), at("t1").alias("f1")), list(keys)).where("frame >= f0 AND frame < f1")
    return met.groupBy(*keys, track).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "v"))), lambda x: x["v"]).alias("features"))
