"""What running streams have done: a callback for each batch, and totals with late rows."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


@dataclass(frozen=True)
class Report:
    """Totals of a stream so far.

    ``rows`` were read, ``late`` of what reached a stateful operator came after the watermark and were dropped, ``kept`` lie in
    states now.  ``percent`` of ``expected`` rows are done (None where it is not known; 100 at most).  ``over`` when the stream has ended,
    with the ``error`` that ended it, if one did.
    """

    name: str
    batches: int = 0
    rows: int = 0
    late: int = 0
    kept: int = 0
    watermark: str | None = None
    expected: int | None = None
    over: bool = False
    error: str | None = None

    @property
    def percent(self) -> float | None:
        if self.expected is None:
            return None
        return 100.0 if self.over and not self.error else min(100.0, 100.0 * self.rows / self.expected) if self.expected else 0.0


class Progress(StreamingQueryListener):
    """Follows streams by name (by run id, without one) and calls ``callback`` with a :class:`Report` after every batch and at the end.

    Spark calls listeners from another thread, one after the other, and repeats a batch's report when nothing came: such idle reports
    count no batch.  A callback that raises is not called again for that stream; the stream goes on.
    """

    def __init__(self, callback: Callable[[Report], Any] | None = None, expected: dict[str, int] | None = None) -> None:
        self.callback, self.expected = callback, dict(expected or {})
        self.reports: dict[str, Report] = {}
        self.names: dict[str, str] = {}
        self.mute: set[str] = set()
        self.changed = threading.Condition()

    def _put(self, report: Report) -> None:
        with self.changed:
            self.reports[report.name] = report
            self.changed.notify_all()
        if self.callback is not None and report.name not in self.mute:
            try:
                self.callback(report)
            except Exception:
                self.mute.add(report.name)

    def onQueryStarted(self, event: Any) -> None:
        name = event.name or str(event.runId)
        self.names[str(event.runId)] = name
        with self.changed:
            self.reports[name] = Report(name, expected=self.expected.get(name))

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        name = self.names.get(str(p.runId), p.name or str(p.runId))
        old = self.reports.get(name, Report(name, expected=self.expected.get(name)))
        states = p.stateOperators
        late = sum(s.numRowsDroppedByWatermark for s in states)
        new = replace(old, batches=old.batches + (p.numInputRows > 0), rows=old.rows + p.numInputRows, late=old.late + late, kept=sum(s.numRowsTotal for s in states), watermark=(p.eventTime or {}).get("watermark", old.watermark))
        self._put(new)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        name = self.names.get(str(event.runId), str(event.runId))
        self._put(replace(self.reports.get(name, Report(name)), over=True, error=event.exception))

    def report(self, name: str) -> Report | None:
        return self.reports.get(name)

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> Report:
        """The last report of a stream that has ended; reports come a little later than the end itself."""
        name = query.name or str(query.runId)
        with self.changed:
            self.changed.wait_for(lambda: name in self.reports and self.reports[name].over, seconds)
            return self.reports.get(name, Report(name))


def follow(spark: SparkSession, callback: Callable[[Report], Any] | None = None, expected: dict[str, int] | None = None) -> Progress:
    """Follow all streams that the session starts from now on, until ``spark.streams.removeListener``."""
    found = Progress(callback, expected)
    spark.streams.addListener(found)
    return found
