"""Speech segments from frame probabilities: state machines that walk one timeline in order."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Hysteresis:
    """Speech starts at ``on``; it ends after ``silence`` frames under ``on - drop``; shorter speech than ``least``
    frames is dropped, longer than ``most`` is split; ends are widened by ``pad``, neighbours share a smaller gap."""

    on: float = 0.5
    drop: float = 0.15
    silence: int = 4
    least: int = 8
    most: int = 1 << 30
    pad: int = 1


class Walker:
    """The open segment; ``feed`` returns a segment when one ends.  Its state is four integers, so a stream can keep it."""

    def __init__(self, rules: Hysteresis, state: tuple[int, int, int] = (-1, -1, -1)) -> None:
        self.rules = rules
        self.start, self.quiet, self.seen = state

    def state(self) -> tuple[int, int, int]:
        return self.start, self.quiet, self.seen

    def _end(self, at: int) -> tuple[int, int] | None:
        start, self.start, self.quiet = self.start, -1, -1
        return (start, at) if at - start >= self.rules.least else None

    def feed(self, frame: int, p: float) -> tuple[int, int] | None:
        r, out = self.rules, None
        self.seen = frame
        if p >= r.on:
            self.quiet = -1
            if self.start < 0:
                self.start = frame
        if self.start >= 0 and frame - self.start >= r.most:
            # the frame of a forced cut opens nothing: speech goes on with the next one
            out = self._end(self.quiet if self.quiet >= 0 else frame)
        elif self.start >= 0 and p < r.on - r.drop:
            if self.quiet < 0:
                self.quiet = frame
            if frame - self.quiet >= r.silence:
                out = self._end(self.quiet)
        return out

    def close(self) -> tuple[int, int] | None:
        return self._end(self.seen + 1) if self.start >= 0 else None


def widened(segments: list[tuple[int, int]], length: int, pad: int) -> list[tuple[int, int]]:
    out = [list(s) for s in segments]
    for i, s in enumerate(out):
        s[0] = max(0, s[0] - pad) if i == 0 else s[0]
        if i + 1 == len(out):
            s[1] = min(length, s[1] + pad)
        else:
            gap = out[i + 1][0] - s[1]
            share = pad if gap >= 2 * pad else gap // 2
            s[1] += share
            out[i + 1][0] -= share
    return [tuple(s) for s in out]


def speech(frames: Iterable[tuple[int, float]], rules: Hysteresis) -> list[tuple[int, int]]:
    walker = Walker(rules)
    found = [s for f, p in frames if (s := walker.feed(f, p))]
    last = walker.close()
    return widened(found + [last] * (last is not None), walker.seen + 1, rules.pad)


def collector(frames: Iterable[tuple[int, bool]], window: int = 10, share: float = 0.9) -> Iterator[tuple[int, int]]:
    """Segments that start with the window in which more than ``share`` of the frames are voiced, and end with
    the one in which more than that are not."""
    held: deque[tuple[int, bool]] = deque(maxlen=window)
    start, last = -1, -1
    for frame, voiced in frames:
        last = frame
        held.append((frame, voiced))
        count = sum(v for _, v in held)
        if start < 0 and count > share * window:
            start = held[0][0]
            held.clear()
        elif start >= 0 and len(held) - count > share * window:
            yield start, frame + 1
            start = -1
            held.clear()
    if start >= 0:
        yield start, last + 1


def over_timelines(df: DataFrame, keys: Sequence[str], frame: str, score: str, run) -> DataFrame:
    """``keys, start, stop`` of ``run(frames)`` on each key's timeline, in frame order."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame)
        rows = [(*(pdf[k].iloc[0] for k in keys), a, b) for a, b in run(zip(pdf[frame].tolist(), pdf[score].tolist(), strict=True))]
        return pd.DataFrame(rows, columns=[*keys, "start", "stop"])

    return df.select(*keys, frame, score).groupBy(*keys).applyInPandas(each, f"{kinds}, start int, stop int")


def hysteresis(df: DataFrame, keys: Sequence[str], frame: str, score: str, rules: Hysteresis = Hysteresis()) -> DataFrame:
    return over_timelines(df, keys, frame, score, lambda f: speech(f, rules))


def ring_buffer(df: DataFrame, keys: Sequence[str], frame: str, score: str, threshold: float = 0.5, window: int = 10, share: float = 0.9) -> DataFrame:
    return over_timelines(df, keys, frame, score, lambda f: collector(((i, p > threshold) for i, p in f), window, share))
