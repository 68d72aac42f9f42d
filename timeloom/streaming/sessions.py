"""Streaming forms of the stateful operators.

The engine's own rules for late data: the watermark is the largest gap that an operator bridges, rows
that are later are dropped, and state goes once the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timeloom.operators.voice import Hysteresis, Walker


def islands(stream: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Sightings less than ``gap`` apart, by session windows: ``key, t0, t1, n`` in microseconds.

    Session windows are half-open, so sightings exactly ``gap`` apart fall into two.
    """
    window = F.session_window(F.col(time), gap)
    out = stream.withWatermark(time, late).groupBy(key, window).agg(F.min(time).alias("a"), F.max(time).alias("b"), F.count("*").alias("n"))
    return out.select(key, F.unix_micros("a").alias("t0"), F.unix_micros("b").alias("t1"), "n")


def once(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once within the watermark: resumed and repeated input has no effect."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def hopping(stream: DataFrame, key: str, time: str, size: str, hop: str, late: str) -> DataFrame:
    """Counts of overlapping windows: ``key, t0, n``."""
    out = stream.withWatermark(time, late).groupBy(key, F.window(time, size, hop)).agg(F.count("*").alias("n"))
    return out.select(key, F.unix_micros("window.start").alias("t0"), "n")


def speech(stream: DataFrame, key: str, frame: str, score: str, rules: Hysteresis, idle_ms: int = 60_000) -> DataFrame:
    """Speech segments ``key, start, stop`` (not widened) as they end; an idle key's open segment ends by time-out.

    Frames of a key must arrive in order over batches; within a batch they are sorted.
    """
    kind = stream.schema[key].dataType.simpleString()

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        walker = Walker(rules, state.get) if state.exists else Walker(rules)
        found = []
        if state.hasTimedOut:
            last = walker.close()
            state.remove()
            found = [last] if last else []
        else:
            rows = pd.concat([b[[frame, score]] for b in batches]).sort_values(frame)
            found = [s for f, p in rows.itertuples(index=False) if (s := walker.feed(int(f), float(p)))]
            state.update(walker.state())
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(group[0], a, b) for a, b in found], columns=[key, "start", "stop"])

    grouped = stream.groupBy(key)
    return grouped.applyInPandasWithState(run, f"{key} {kind}, start int, stop int", "start int, quiet int, seen int", "append", GroupStateTimeout.ProcessingTimeTimeout)
