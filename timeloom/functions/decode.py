"""Expressions on what recognisers put out: label sequences, hypotheses, schedules, masks of frames."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(ids: Column, blank: int = 0) -> Column:
    """Frame labels as a sequence: runs of one label count once, then blanks go."""
    return F.filter(ids, lambda x, i: (x != blank) & ((i == 0) | (x != F.get(ids, i - 1))))


def hypothesis(ids: Column, names: Column, space: str = "<space>", end: str = "<eos>") -> Column:
    """``text, token, token_ids`` of a hypothesis whose first id is the start mark; ids count from 0 in ``names``."""
    rest = F.slice(ids, F.lit(2), F.greatest(F.lit(0), F.size(ids) - 1))
    tokens = F.transform(rest, lambda i: F.get(names, i))
    text = F.replace(F.replace(F.array_join(tokens, ""), F.lit(space), F.lit(" ")), F.lit(end), F.lit(""))
    return F.struct(text.alias("text"), F.array_join(tokens, " ").alias("token"), F.array_join(rest.cast("array<string>"), " ").alias("token_ids"))


def linear_then_flat(step: Column, warm: int, first: float, last: float) -> Column:
    """A value that goes from ``first`` to ``last`` on a straight line over ``warm`` steps and stays there."""
    return F.when(step < warm, first + (last - first) * step / warm).otherwise(F.lit(last))


def cosine_momentum(step: Column, total: int, low: float, high: float = 1.0) -> Column:
    """A momentum that rises from ``low`` to ``high`` along half a cosine."""
    return F.when(step >= total, F.lit(high)).otherwise(high - (high - low) * (F.cos(math.pi * step / total) + 1) / 2)


def aligned(audio: Column, frames: Column, samples: int = 640) -> Column:
    """Audio cut, or padded with zeros, to ``samples`` for each video frame."""
    size = (frames * samples).cast("int")
    return F.concat(F.slice(audio, F.lit(1), size), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), size - F.size(audio))))


def keyed(key: Column, seed: int, draw: Column | int, below: Column) -> Column:
    """A whole number in ``[0, below)``, always the same for a key, seed and draw; 0 where ``below`` is not positive."""
    d = F.lit(draw) if isinstance(draw, int) else draw
    return F.when(below > 0, F.pmod(F.xxhash64(key, F.lit(seed), d), below)).otherwise(F.lit(0)).cast("int")


def time_masked(values: Column, key: Column, spans: int, longest: Column, seed: int = 0, mean: bool = False) -> Column:
    """Values with ``spans`` random stretches of up to ``longest`` elements set to 0, or to the mean of all."""
    size = F.size(values)
    starts, lengths = [], []
    for s in range(spans):
        length = keyed(key, seed, 2 * s, longest + 1)
        lengths.append(length)
        starts.append(keyed(key, seed, 2 * s + 1, size - length + 1))
    fill = F.when(size > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / size) if mean else F.lit(0.0)
    inside = lambda i: F.greatest(F.lit(False), F.lit(False), *((i >= a) & (i < a + n) for a, n in zip(starts, lengths, strict=True)))
    return F.transform(values, lambda x, i: F.when(inside(i), fill).otherwise(x))


def frequency_masked(rows: Column, key: Column, spans: int, longest: int, seed: int = 0) -> Column:
    """Rows (an array of arrays of one width) with the same random bands of up to ``longest`` columns set to 0 in each."""
    width = F.size(F.get(rows, F.lit(0)))
    bands = [(keyed(key, seed, 2 * s + 1, width - n + 1), n) for s in range(spans) for n in (keyed(key, seed, 2 * s, F.lit(longest + 1)),)]
    inside = lambda i: F.greatest(F.lit(False), F.lit(False), *((i >= a) & (i < a + n) for a, n in bands))
    return F.transform(rows, lambda row: F.transform(row, lambda x, i: F.when(inside(i), F.lit(0.0)).otherwise(x)))


def adaptive_spans(size: Column, rate: int = 25, most: int = 10) -> Column:
    """Spans for a clip: one for each second, ``most`` at the most."""
    return F.least(F.lit(most), F.ceil(size / rate)).cast("int")
