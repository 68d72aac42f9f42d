"""Operators on frame timelines: one row a key and frame number.

Windows over frames share the layout ``partitionBy(keys).orderBy(frame)``, so several of them
in a row need one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .intervals import sweep


def ordered(keys: Sequence[str], frame: str = "frame") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(frame)


def runs(df: DataFrame, keys: Sequence[str], value: str, frame: str = "frame") -> DataFrame:
    """Run-length encoding: ``start`` and ``length`` of each run of equal values on adjacent rows."""
    order = ordered(keys, frame)
    new = F.when(F.lag(value, 1).over(order).eqNullSafe(F.col(value)) & F.lag(frame).over(order).isNotNull(), 0).otherwise(1)
    numbered = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__run", value).agg(F.min(frame).alias("start"), F.count("*").alias("length")).drop("__run")


def long_runs(df: DataFrame, keys: Sequence[str], value: str, longer_than: int, frame: str = "frame") -> DataFrame:
    return runs(df, keys, value, frame).where(F.col("length") > longer_than)


def median_filter(value: Column, order: WindowSpec, k: int) -> Column:
    """Median of ``k`` (odd) values around each row; beyond the ends there are zeros."""
    held = F.collect_list(value).over(order.rowsBetween(-(k // 2), k // 2))
    padded = F.concat(held, F.array_repeat(F.lit(0.0), F.lit(k) - F.size(held)))
    return F.element_at(F.array_sort(padded), k // 2 + 1)


def majority_filter(df: DataFrame, keys: Sequence[str], value: str, labels: Sequence, width: int, frame: str = "frame") -> DataFrame:
    """The commonest label within ``width // 2`` rows on either side, of equal ones the smallest.

    The first ``width // 2`` rows take the value of the row that follows them, and timelines
    of at most ``width`` rows stay as they are.  ``labels`` lists the possible values.
    """
    order, half = ordered(keys, frame), width // 2
    around = order.rowsBetween(-half, half)
    ranked = F.greatest(*(F.struct(F.sum(F.when(F.col(value) == x, 1).otherwise(0)).over(around).alias("n"), F.lit(-i).alias("i")) for i, x in enumerate(sorted(labels))))
    names = F.array(*(F.lit(x) for x in sorted(labels)))
    whole = Window.partitionBy(*keys)
    marked = df.withColumns({"__m": F.element_at(names, (1 - ranked["i"]).cast("int")), "__i": F.row_number().over(order), "__n": F.count("*").over(whole)})
    head = F.max(F.when(F.col("__i") == half + 1, F.col("__m"))).over(whole)
    out = F.when(F.col("__n") <= width, F.col(value)).when(F.col("__i") <= half, head).otherwise(F.col("__m"))
    return marked.withColumn("smoothed", out).drop("__m", "__i", "__n")


def closing(df: DataFrame, keys: Sequence[str], value: str, width: int, frame: str = "frame") -> DataFrame:
    """Binary closing with ``width`` adjacent ones: dilation, then erosion with zeros beyond the ends."""
    order = ordered(keys, frame)
    low, high = width // 2, width - 1 - width // 2
    wide = df.withColumn("__d", F.max(F.col(value).cast("int")).over(order.rowsBetween(-high, low)))
    around = order.rowsBetween(-low, high)
    full = F.count("*").over(around) == width
    return wide.withColumn("closed", F.when(full & (F.min("__d").over(around) == 1), 1).otherwise(0)).drop("__d")


def winner(df: DataFrame, keys: Sequence[str], score: str, candidate: str, frame: str = "frame") -> DataFrame:
    """The candidate with the best score of each frame; of equal scores the smallest candidate."""
    order = Window.partitionBy(*keys, frame).orderBy(F.desc(score), candidate)
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def coverage(spans: DataFrame, keys: Sequence[str], fps: int) -> DataFrame:
    """Frames under each number of spans, by steps at the spans' ends rather than a row a frame: ``f0, f1, active``."""
    at = lambda c: F.floor(F.col(c) * fps / 1_000_000)
    cut = spans.select(*keys, at("t0").alias("t0"), at("t1").alias("t1"))
    return sweep(cut, keys, {"active": F.lit(1)}).where("active > 0").select(*keys, F.col("t0").alias("f0"), F.col("t1").alias("f1"), "active")


def fill(value: Column, order: WindowSpec) -> Column:
    """Missing values take the next one that is there, at the end the last one."""
    after = F.first(value, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    before = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(after, before)


def interpolate(df: DataFrame, keys: Sequence[str], value: str, frame: str = "frame") -> DataFrame:
    """A row for every frame between a key's first and last, values on a straight line between known ones."""
    order = ordered(keys, frame)
    step = df.withColumns({"__f": F.lead(frame).over(order), "__v": F.lead(value).over(order)})
    upto = F.coalesce(F.col("__f") - 1, F.col(frame))
    rows = step.select(*keys, F.col(frame).alias("__a"), F.col(value).alias("__x"), "__f", "__v", F.explode(F.sequence(F.col(frame), upto)).alias(frame))
    line = F.col("__x") + (F.col("__v") - F.col("__x")) * (F.col(frame) - F.col("__a")) / (F.col("__f") - F.col("__a"))
    return rows.select(*keys, frame, F.coalesce(line, F.col("__x")).alias(value))
