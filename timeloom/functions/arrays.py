"""Expressions over array columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut_or_pad(values: Column | str, size: int, zero: Column | None = None) -> Column:
    """The first ``size`` values, with zeros at the end if there are fewer."""
    return F.slice(F.concat(column(values), F.array_repeat(F.lit(0.0) if zero is None else zero, size)), 1, size)


def rounded(x: Column, digits: int) -> Column:
    """``x`` rounded, with its sign where that gives zero: ``round`` of Spark makes 0.0 of small negative numbers, that of other engines -0.0."""
    r = F.round(x, digits)
    return F.when(r == 0, x * 0.0).otherwise(r)


def resample(values: Column | str, size: int) -> Column:
    """``size`` values on straight lines through the given ones; each stands for the middle of its share.

    An empty array gives nulls.
    """
    v = column(values)
    n = F.size(v)

    def at(i: Column) -> Column:
        p = F.least((n - 1).cast("double"), F.greatest(F.lit(0.0), (i + 0.5) * n / size - 0.5))
        low = F.floor(p).cast("int")
        a, b = F.get(v, low), F.get(v, F.least(low + 1, n - 1))
        return a + (p - low) * (b - a)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)


def add_sos_eos(ids: Column | str, sos: Column, eos: Column, padding: int) -> tuple[Column, Column]:
    """The ids without padding, once after a start and once before an end."""
    real = F.filter(column(ids), lambda x: x != padding)
    return F.array_prepend(real, sos), F.array_append(real, eos)


def length_mask(length: Column | str, size: int) -> Column:
    """``size`` booleans, true where there is padding."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: i > column(length))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(column(x), column(y), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_by(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean of a key's vectors: a row ``i, x`` for each element."""
    rows = df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    return rows.groupBy(*keys, "i").agg(F.avg("x").alias("x"))


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of boxes ``x1, y1, x2, y2``; 0 for boxes without area."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo)
    both = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    area = lambda x: side(x[0], x[2]) * side(x[1], x[3])
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def chunk_starts(length: Column, window: int, hop: int) -> Column:
    """Starts of windows of ``window`` samples every ``hop``; one at 0 if the input is shorter."""
    return F.when(length > window, F.sequence(F.lit(0), F.greatest(F.lit(0), (length - window - 1).cast("int")), F.lit(hop))).otherwise(F.array(F.lit(0)))


def warmup_cosine(step: Column, warm: int, total: int, peak: float) -> Column:
    falling = 0.5 * (1 + F.cos(math.pi * (step - warm) / (total - warm)))
    return F.when(step < warm, step / warm * peak).otherwise(peak * F.when(step >= total, 0.0).otherwise(falling))


def exponential_average(values: Column | str, keep: float) -> Column:
    """The last state of old * keep + new * (1 - keep), from the first value on."""
    v = column(values)
    return F.aggregate(F.slice(v, 2, F.greatest(F.lit(0), F.size(v) - 1)), F.get(v, F.lit(0)), lambda s, x: s * keep + x * (1 - keep))


def rename_keys(state: Column, prefixes: Sequence[str], dropped: Sequence[str]) -> Column:
    """A map's keys without leading ``prefixes`` (as often as they stand there), entries of ``dropped`` families removed."""
    pattern = "^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")+"
    kept = F.map_filter(state, lambda k, _: ~F.rlike(F.regexp_replace(k, pattern, ""), F.lit("^(?:" + "|".join(dropped) + r")\.")))
    return F.transform_keys(kept, lambda k, _: F.regexp_replace(k, pattern, ""))
