"""Tracks and identities of faces as they arrive: the batch operators' rules with state by clip.

Rows wait in a list state until the watermark has passed their time, then they are worked on in order, so
batches and the order of arrival within the watermark change nothing.  One event-time timer a clip stands at whatever comes
next: a waiting row, or the end of the gap that an open track bridges.  What is open when the stream ends stays in the
state; a restart from the checkpoint goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from timeloom.operators import cluster
from timeloom.operators.tracking import Rules, mean_side, overlap_of

BOX = ("x1", "y1", "x2", "y2")


def plain(value: Any) -> Any:
    """Arrays, of arrays too, as lists: the state takes no others."""
    return [plain(x) for x in value] if isinstance(value, (np.ndarray, list)) else value.item() if isinstance(value, np.generic) else value


class InOrder(StatefulProcessor):
    """Holds rows ``(ms, ...)`` back until the watermark passes them, then gives them to :meth:`feed` in order."""

    def __init__(self, waiting: str) -> None:
        #: The last columns of the stream.
        self.waiting_schema = waiting
        self.width = len(StructType.fromDDL(waiting))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.open_states(handle)

    def open_states(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def feed(self, key: tuple, rows: list[tuple], now: int) -> tuple[list[tuple], int | None]:
        """Work on ``rows``, in order, at watermark ``now`` (ms): what is done, and when to come back without further rows."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterable[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for part in rows for r in part.iloc[:, -self.width :].itertuples(index=False, name=None)]
        yield from self.turn(key, [tuple(map(plain, r)) for r in new], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self.turn(key, [], timerValues.getCurrentWatermarkInMs())

    def turn(self, key: Any, new: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        held = [*self.waiting.get(), *new]
        due = sorted(tuple(r) for r in held if r[0] <= now)
        later = [tuple(r) for r in held if r[0] > now]
        done, back = self.feed(key, due, now)
        self.waiting.put(later) if later else self.waiting.clear()
        times = [r[0] for r in later] + ([back] if back is not None else [])
        for old in [int(t) for t in self.handle.listTimers()]:
            self.handle.deleteTimer(old)
        if times:
            self.handle.registerTimer(max(min(times), now + 1))
        if done:
            yield self.frame(key, done)

    def frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError


class Tracker(InOrder):
    """Open tracks as a list of ``(track, last ms, frame, box)`` of their detections."""

    def __init__(self, keys: Sequence[str], rules: Rules, gap_ms: int) -> None:
        super().__init__("ms bigint, frame int, x1 double, y1 double, x2 double, y2 double")
        self.keys, self.rules, self.gap_ms = list(keys), rules, gap_ms

    def open_states(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getListState("tracks", "track int, ms bigint, frame int, x1 double, y1 double, x2 double, y2 double")
        self.count = handle.getValueState("count", "n int")

    def feed(self, key: tuple, rows: list[tuple], now: int) -> tuple[list[tuple], int | None]:
        held = [tuple(r) for r in self.tracks.get()]
        live: dict[int, list[tuple]] = {}
        for track, *row in held:
            live.setdefault(track, []).append(tuple(row))
        n = first = self.count.get()[0] if self.count.exists() else 0
        done: list[tuple] = []

        def close(track: int) -> None:
            own = [r[1:] for r in live.pop(track)]
            if len(own) > self.rules.frames and mean_side(own) > self.rules.size:
                done.extend((track, *r) for r in own)

        for row in rows:
            _, at, *box = row
            for track in sorted(live):
                last = live[track][-1]
                if at - last[1] > self.rules.gap:
                    close(track)
                elif at > last[1] and overlap_of(box, last[2:]) > self.rules.iou:
                    live[track].append(row)
                    break
            else:
                live[n] = [row]
                n += 1
        for track in [t for t, own in live.items() if own[-1][0] + self.gap_ms < now]:
            close(track)
        kept = [(t, *r) for t in sorted(live) for r in live[t]]
        if kept != held:
            self.tracks.put(kept) if kept else self.tracks.clear()
        if n != first:
            self.count.update((n,))
        return done, min((own[-1][0] + self.gap_ms for own in live.values()), default=None)

    def frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*self.keys, "track", "frame", *BOX])


def tracks(stream: DataFrame, keys: Sequence[str], time: str, late: str, rules: Rules = Rules(), rate: float = 25.0) -> DataFrame:
    """:func:`timeloom.operators.tracking.tracks` of a stream of detections ``keys, frame, x1, y1, x2, y2``, as tracks end.

    ``time`` is the detections' timestamp, ``late`` how much later than others they may come; what is later still is dropped.  A
    track's rows are given out when the watermark has passed its last detection by the gap (of frames, at ``rate`` frames
    a second).  Times up to 1970 count as late, as watermarks begin there.  Tracks are numbered by clip as they begin; numbers of tracks that turn out too short or too small are left out, so
    the batch operator's numbers are these without the holes.  Rows without a time, a frame or a whole box are left out.
    """
    gap_ms = int(1000 * (rules.gap + 1) / rate)
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    rows = stream.withWatermark(time, late).dropna(subset=[time, "frame", *BOX])
    rows = rows.select(*keys, time, F.unix_millis(F.col(time).cast("timestamp")).alias("__ms"), F.col("frame").cast("int").alias("frame"), *(F.col(c).cast("double").alias(c) for c in BOX))
    out = f"{kinds}, track int, frame int, x1 double, y1 double, x2 double, y2 double"
    return rows.groupBy(*keys).transformWithStateInPandas(Tracker(keys, rules, gap_ms), out, "Append", "eventTime")


class Identifier(InOrder):
    """Identities as a list of ``(identity, frames, vectors)``, a row for each track that joined."""

    def __init__(self, keys: Sequence[str], track: str, kind: str, threshold: float) -> None:
        super().__init__(f"ms bigint, track {kind}, frames array<bigint>, vectors array<array<double>>")
        self.keys, self.track, self.threshold = list(keys), track, threshold

    def open_states(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "identity int, frames array<bigint>, vectors array<array<double>>")

    def feed(self, key: tuple, rows: list[tuple], now: int) -> tuple[list[tuple], int | None]:
        if not rows:
            return [], None
        groups: list[tuple[set, list[np.ndarray]]] = []
        for identity, frames, vectors in self.known.get():
            while len(groups) <= identity:
                groups.append((set(), []))
            groups[identity][0].update(frames)
            groups[identity][1].append(np.array([list(v) for v in vectors], float))
        out = []
        for _, track, frames, vectors in rows:
            identity = cluster.join_identity(groups, set(frames or ()), np.array([list(v) for v in vectors], float), self.threshold)
            self.known.appendValue((identity, list(frames or ()), [list(map(float, v)) for v in vectors]))
            out.append((track, identity))
        return out, None

    def frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*self.keys, self.track, "identity"])


def identities(stream: DataFrame, keys: Sequence[str], track: str, vectors: str, frames: str, time: str, late: str, threshold: float) -> DataFrame:
    """:func:`timeloom.operators.cluster.identities` of a stream of tracks, in the order of ``time``, then of ``track``.

    Gives ``keys, track, identity`` once the watermark has passed a track's time.  Tracks without vectors or without a time are left out; null
    frames are none.  A clip's identities, with all their vectors, are its state, as a median over all of them decides.
    """
    kind = stream.schema[track].dataType.simpleString()
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    rows = stream.withWatermark(time, late).where((F.size(F.col(vectors)) > 0) & F.col(time).isNotNull())
    rows = rows.select(*keys, time, F.unix_millis(F.col(time).cast("timestamp")).alias("__ms"), F.col(track).alias("__track"), F.col(frames).cast("array<bigint>").alias("__frames"), F.col(vectors).cast("array<array<double>>").alias("__vectors"))
    return rows.groupBy(*keys).transformWithStateInPandas(Identifier(keys, track, kind, threshold), f"{kinds}, `{track}` {kind}, identity int", "Append", "eventTime")
