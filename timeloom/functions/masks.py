"""Seeded random masks of frame sequences: the same seed, epoch and key give the same mask, wherever a row is worked on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

KINDS = ("static", "uniform", "normal", "poisson")


@dataclass(frozen=True)
class Spans:
    """What share of the frames spans of about ``length`` frames are to cover, and how.

    ``kind`` draws the lengths: all alike, uniform from ``other`` to twice the length, normal with deviation ``other``, or Poisson.
    At least ``least`` spans are drawn.  Without ``overlap`` spans keep ``space`` free frames between them.  ``equal`` gives all sequences of a
    batch the same number of masked frames: ``"trim"`` that of the fewest, ``"fill"`` that of the most.  ``dropout`` of the masked frames are
    freed again in the end.
    """

    share: float = 0.65
    length: int = 10
    kind: str = "static"
    other: float = 0.0
    least: int = 0
    overlap: bool = True
    space: int = 0
    equal: str | None = None
    dropout: float = 0.0

    def __post_init__(self) -> None:
        if self.kind not in KINDS or self.equal not in (None, "trim", "fill") or self.length < 1:
            raise ValueError("unknown kind, way to equal counts, or length")


def drawn_lengths(rng: np.random.Generator, size: int, spans: Spans) -> np.ndarray:
    """Lengths of the spans of a sequence; the fraction of a span that is left is drawn for."""
    n = max(spans.least, int(spans.share * size / spans.length + rng.random()))
    if spans.kind == "static":
        out = np.full(n, spans.length)
    elif spans.kind == "uniform":
        out = rng.integers(int(spans.other), 2 * spans.length + 1, n)
    elif spans.kind == "normal":
        out = np.maximum(1, np.rint(rng.normal(spans.length, spans.other, n))).astype(np.int64)
    else:
        out = rng.poisson(spans.length, n)
    if n and not out.any():
        out = np.array([spans.length])
    return np.minimum(out, max(0, size - 1))


def laid_apart(rng: np.random.Generator, size: int, lengths: np.ndarray, space: int) -> list[tuple[int, int]]:
    """Starts and lengths of spans that neither meet nor come nearer than ``space``, the longest first.

    A span goes into a free part, drawn by the parts' lengths, anywhere in it; what it leaves on both sides are new parts.  Spans that fit
    nowhere are left out.
    """
    free, out = [(0, size)], []
    for length in sorted((int(x) for x in lengths if x), reverse=True):
        room = np.array([max(0, b - a) if b - a >= length else 0 for a, b in free], float)
        if not room.any():
            continue  # a shorter one may fit
        a, b = free.pop(int(rng.choice(len(free), p=room / room.sum())))
        start = int(rng.integers(a, b - length + 1))
        out.append((start, length))
        free += [part for part in ((a, start - space), (start + length + space, b)) if part[1] > part[0]]
    return out


def laid_freely(rng: np.random.Generator, size: int, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Starts and lengths of spans that begin at different frames and may overlap; what reaches past the end is cut."""
    if not len(lengths):
        return []
    starts = rng.permutation(max(size - int(lengths.min()), min(size, len(lengths))))[: len(lengths)]
    return [(int(s), min(int(k), size - int(s))) for s, k in zip(starts, lengths, strict=False)]


def masked_frames(rng: np.random.Generator, size: int, spans: Spans) -> np.ndarray:
    """Frames under the mask, ascending; never all of them."""
    if size < 2:
        return np.zeros(0, np.int64)
    lengths = drawn_lengths(rng, size, spans)
    laid = laid_freely(rng, size, lengths) if spans.overlap else laid_apart(rng, size, lengths, spans.space)
    mask = np.zeros(size, bool)
    for start, length in laid:
        mask[start : start + length] = True
    if mask.all():
        mask[rng.integers(size)] = False
    return np.flatnonzero(mask)


def evened(rng: np.random.Generator, size: int, frames: np.ndarray, target: int | None, dropout: float) -> np.ndarray:
    """``frames`` trimmed or filled to ``target``, one frame left free at least, then thinned by ``dropout``."""
    if target is not None and len(frames) > target:
        frames = np.sort(rng.choice(frames, target, replace=False))
    elif target is not None and len(frames) < target:
        open_frames = np.setdiff1d(np.arange(size), frames)
        more = min(target - len(frames), len(open_frames) - 1)
        frames = np.union1d(frames, rng.choice(open_frames, more, replace=False)) if more > 0 else frames
    holes = round(len(frames) * dropout)
    return np.sort(rng.choice(frames, len(frames) - holes, replace=False)) if holes else frames


def generator(key: int, seed: int, epoch: int, turn: int) -> np.random.Generator:
    return np.random.default_rng([seed, epoch, turn, int(key) & (2**64 - 1)])


def drawn(key: Column, size: Column, spans: Spans, seed: int, epoch: int) -> Column:
    """The first pass: frames under each row's own mask (array of int); ``key`` is a long."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(keys: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([masked_frames(generator(k, seed, epoch, 0), int(n), spans).astype(np.int32) for k, n in zip(keys, sizes, strict=True)], dtype=object)

    return run(key, size)


def finished(key: Column, size: Column, width: Column, frames: Column, target: Column, spans: Spans, seed: int, epoch: int) -> Column:
    """The second pass: a boolean for each of ``width`` frames, with as many masked as ``target`` says (-1: as drawn)."""

    @F.pandas_udf(ArrayType(BooleanType()))
    def run(keys: pd.Series, sizes: pd.Series, widths: pd.Series, found: pd.Series, targets: pd.Series) -> pd.Series:
        out = []
        for k, n, w, f, t in zip(keys, sizes, widths, found, targets, strict=True):
            mask = np.zeros(int(w), bool)
            mask[evened(generator(k, seed, epoch, 1), int(n), np.asarray(f, np.int64), None if t < 0 else int(t), spans.dropout)] = True
            out.append(mask)
        return pd.Series(out, dtype=object)

    return run(key, size, width, frames, target)


def hashed(key: Column) -> Column:
    """Any key as a number that seeds its draws."""
    return F.xxhash64(key)


def batch_masks(df: DataFrame, key: str, size: str, spans: Spans, batch: str | None = None, width: str | None = None, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``df`` with ``mask``: a boolean for each of ``width`` frames (of ``size``, without it), true under a mask.

    Frames from ``size`` on are padding and never masked, nor are all frames of a sequence; one of fewer than two frames has no mask.
    With ``spans.equal`` all rows of a batch get as many masked frames as that of its rows with the fewest (or most) has: the first pass draws masks and
    counts, the second trims or fills.  Counts meet by partial aggregation, and no batch is gathered.  Fills stop where one frame is left free,
    so a short sequence may stay below.

    The draws of a row follow from seed, epoch and key alone: rows that repeat a key and a size are drawn alike, a null key is a key.  A null or negative size counts as
    0, a width under the size as the size, a null batch is a batch.  An empty table gives no rows.  ``df`` must have no columns named
    ``mask`` or beginning with ``__``.
    """
    if any(c == "mask" or c.startswith("__") for c in df.columns):
        raise ValueError("columns named mask or beginning with __ would clash")
    if spans.equal and batch is None:
        raise ValueError("counts can be made equal within batches only")
    own = F.greatest(F.coalesce(F.col(size).cast("int"), F.lit(0)), F.lit(0))
    wide = own if width is None else F.greatest(F.coalesce(F.col(width).cast("int"), F.lit(0)), own)
    rows = df.withColumns({"__key": hashed(F.col(key)), "__size": own, "__width": wide})
    rows = rows.withColumn("__frames", drawn(F.col("__key"), F.col("__size"), spans, seed, epoch))
    if spans.equal:
        pick = F.min if spans.equal == "trim" else F.max
        counts = rows.groupBy(F.col(batch).alias("__batch")).agg(pick(F.size("__frames")).alias("__target"))
        rows = rows.join(counts, F.col(batch).eqNullSafe(F.col("__batch"))).drop("__batch")
    else:
        rows = rows.withColumn("__target", F.lit(-1))
    mask = finished(*(F.col(c) for c in ("__key", "__size", "__width", "__frames", "__target")), spans, seed, epoch)
    return rows.withColumn("mask", mask).select(*df.columns, "mask")


def span_mask(key: Column, size: Column, share: float, length: int, kind: str = "static", seed: int = 0) -> Column:
    """A boolean for each of ``size`` frames, true in masked spans, which may overlap; a null size counts as 0."""
    spans = Spans(share, length, kind, length / 4 if kind == "normal" else 1)
    number, own = hashed(key), F.coalesce(size.cast("int"), F.lit(0))
    return finished(number, own, own, drawn(number, own, spans, seed, 0), F.lit(-1), spans, seed, 0)


def masked(values: Column, mask: Column) -> Column:
    """Values with zeros where the mask is true."""
    return F.zip_with(values, mask, lambda x, m: F.when(m, F.lit(0.0)).otherwise(x))
