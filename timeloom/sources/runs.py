"""A table that grows by runs: what a run adds counts when its marker is there, all of it or nothing.

    folder/runs/000003/...     what run 3 has written
    folder/commits/000003      its marker, with its counters as JSON

A run that is killed leaves no marker; its files are never read, and the next run takes the next number.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class RunLog:
    """Runs of one kind of rows (``schema``) below a folder that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.jvm = spark.sparkContext._jvm

    def _fs(self, path: str) -> tuple[Any, Any]:
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _numbers(self, kind: str) -> list[int]:
        fs, where = self._fs(f"{self.folder}/{kind}")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()) if fs.exists(where) else []

    def path(self, run: int) -> str:
        return f"{self.folder}/runs/{run:06d}"

    def committed(self) -> list[int]:
        return self._numbers("commits")

    def read(self) -> DataFrame:
        """The rows of all committed runs; none where there is no run."""
        paths = [self.path(n) for n in self.committed()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def counters(self, run: int) -> dict[str, int]:
        fs, where = self._fs(f"{self.folder}/commits/{run:06d}")
        stream = fs.open(where)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, run: int, counters: dict[str, int]) -> None:
        """Write a run's marker; fails where another writer has taken the number."""
        fs, where = self._fs(f"{self.folder}/commits/{run:06d}")
        stream = fs.create(where, False)
        stream.write(json.dumps(counters, sort_keys=True).encode())
        stream.close()

    def append(self, rows: DataFrame, counters: Callable[[], dict[str, int]] = dict) -> int:
        """Write ``rows`` as the next run and commit it with what ``counters`` returns after the write; the run's number.

        Two writers at once take the same number; the later one fails, before it has written anything that counts.
        """
        run = max([0, *self._numbers("runs"), *self.committed()]) + 1
        rows.write.mode("error").parquet(self.path(run))
        self.commit(run, counters())
        return run

    def clear(self) -> None:
        """Delete all runs, markers first."""
        for kind in ("commits", "runs"):
            fs, where = self._fs(f"{self.folder}/{kind}")
            fs.delete(where, True)
