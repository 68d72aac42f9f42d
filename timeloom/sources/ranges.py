"""Spark data sources for recordings and array archives, read by byte ranges.

A long recording is no single value: the driver lists files and sizes, cuts them into ranges, and each task opens its file and reads its
range only, in small batches.  Windows that reach over the end of a range are read to their own end, so ranges change nothing.
Paths are files or folders, local to all executors (mounted) or in a store that ``pyarrow.fs`` opens by its address (s3, gs, hdfs).
"""

from __future__ import annotations

import fnmatch
import posixpath
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a range, and rows of a batch.
RANGE, ROWS = 16 << 20, 1024


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def found_files(path: str, pattern: str) -> list[tuple[str, int]]:
    """Files (address, size) below a folder whose names fit, or the file itself."""
    fs, top = opened(path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    info = fs.get_file_info(top)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(top, recursive=True)) if f.is_file and fnmatch.fnmatch(posixpath.basename(f.path), pattern)]
    return sorted((scheme + f.path, f.size) for f in infos)


@dataclass
class Span(InputPartition):
    """Part ``part`` of ``parts`` of a file, and for recordings the windows ``[lo, hi)``."""

    path: str
    part: int
    parts: int
    lo: int = 0
    hi: int = 0

    def __post_init__(self) -> None:
        super().__init__(None)


@dataclass
class Choice:
    """Which paths, and which rows ``[lo, hi)`` of a file, are asked for."""

    paths: set[str] | None = None
    lo: int = 0
    hi: int | None = None

    def take(self, f: Filter, row: str) -> bool:
        """Narrow the choice by a filter; whether it is kept in full."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name == "path" and isinstance(f, (EqualTo, In)):
            own = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.paths = own if self.paths is None else self.paths & own
        elif name == row and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                top = f.value + (not isinstance(f, LessThan))
                self.hi = top if self.hi is None else min(self.hi, top)
        else:
            return False
        return True

    def within(self, lo: int, hi: int) -> tuple[int, int]:
        lo, hi = max(lo, self.lo), hi if self.hi is None else min(hi, self.hi)
        return lo, max(lo, hi)


class RangeReader(DataSourceReader):
    """What both sources share: options, files, and what filters choose."""

    row = "frame"

    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("option path is missing")
        self.path, self.range = options["path"], int(options.get("rangebytes", RANGE))
        self.choice = Choice(None, int(options.get("from", 0)), int(options["to"]) if "to" in options else None)
        if self.range < 1:
            raise ValueError("rangeBytes must be 1 or more")

    def files(self, pattern: str) -> list[tuple[str, int]]:
        return [f for f in found_files(self.path, pattern) if self.choice.paths is None or f[0] in self.choice.paths]

    def filtered(self, filters: list[Filter]) -> Iterator[Filter]:
        return (f for f in filters if not self.choice.take(f, self.row))


def with_filters(reader: type[RangeReader]) -> type[RangeReader]:
    """A reader that takes pushed filters; Spark refuses those while spark.sql.python.filterPushdown.enabled is off."""
    return type(f"Filtering{reader.__name__}", (reader,), {"pushFilters": reader.filtered, "__reduce__": lambda self: (rebuilt, (reader, self.__dict__))})


def rebuilt(reader: type[RangeReader], state: dict[str, Any]) -> RangeReader:
    out = with_filters(reader).__new__(with_filters(reader))
    out.__dict__.update(state)
    return out


def wave_data(f: Any, size: int) -> tuple[int, int, int, int]:
    """Offset and bytes of the samples, rate and channels of a RIFF file of 16-bit samples."""
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE header")
    at, rate, channels = 12, 0, 0
    while at + 8 <= size:
        f.seek(at)
        name, length = (x := f.read(8))[:4], int.from_bytes(x[4:], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = np.frombuffer(f.read(16), "<u2,<u2,<u4,<u4,<u2,<u2")[0].tolist()
            if (kind, bits) != (1, 16):
                raise ValueError(f"samples of kind {kind} with {bits} bits; 16-bit samples are read")
        if name == b"data":
            return at + 8, min(length, size - at - 8), rate, channels
        at += 8 + length + length % 2
    raise ValueError("no data in the RIFF file")


class PcmReader(RangeReader):
    row = "window"

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.rate, self.channels = int(options.get("rate", 16000)), int(options.get("channels", 1))
        self.size = int(options.get("window", 512))
        self.hop = int(options.get("hop", self.size))
        self.last = options.get("last", "pad")
        self.pattern = options.get("pattern", "*")
        if min(self.size, self.hop, self.rate, self.channels) < 1 or self.last not in ("pad", "drop"):
            raise ValueError("window, hop, rate and channels must be 1 or more, last is pad or drop")

    def head(self, path: str, size: int) -> tuple[int, int, int, int]:
        """Offset of the samples, their number (of all channels at once), rate, channels."""
        if not path.lower().endswith(".wav"):
            return 0, size // (2 * self.channels), self.rate, self.channels
        fs, name = opened(path)
        with fs.open_input_file(name) as f:
            at, n, rate, channels = wave_data(f, size)
        return at, n // (2 * channels), rate, channels

    def windows(self, samples: int) -> int:
        """Windows that begin before the end; without a padded one, those that end by it."""
        return -(-samples // self.hop) if self.last == "pad" else max(0, (samples - self.size) // self.hop + 1)

    def partitions(self) -> Sequence[Span]:
        out = []
        for path, size in self.files(self.pattern):
            _, samples, _, channels = self.head(path, size)
            lo, hi = self.choice.within(0, self.windows(samples))
            step = max(1, self.range // (2 * channels * self.hop))
            out += [Span(path, 0, 1, a, min(a + step, hi)) for a in range(lo, hi, step)]
        return out or [Span("", 0, 1)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if partition.lo >= partition.hi:
            return
        fs, name = opened(partition.path)
        with fs.open_input_file(name) as f:
            at, samples, rate, channels = self.head(partition.path, f.size())
            for lo in range(partition.lo, partition.hi, ROWS):
                n = min(ROWS, partition.hi - lo)
                begin = lo * self.hop
                length = (n - 1) * self.hop + self.size
                f.seek(at + begin * 2 * channels)
                raw = f.read(max(0, min(length, samples - begin)) * 2 * channels)
                values = np.zeros(length * channels, "<i2")
                values[: len(raw) // 2] = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2")
                rows = np.lib.stride_tricks.sliding_window_view(values, self.size * channels)[:: self.hop * channels]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.size * channels), pa.array(np.ascontiguousarray(rows).ravel()))
                window = np.arange(lo, lo + n, dtype=np.int64)
                starts = pa.array(window * self.hop * 1_000_000 // rate)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(window), starts, lists], names=["path", "window", "t0", "samples"])


class PcmSource(DataSource):
    """Windows ``path, window, t0, samples`` of recordings of 16-bit samples, little-endian: raw, or RIFF files named ``*.wav``.

    Options: ``window`` and ``hop`` in samples (512, and as many), ``rate`` and ``channels`` of raw files, ``pattern`` of names, ``last`` (``pad`` the
    window at the end with zeros, or ``drop`` it), ``rangeBytes``, ``from`` and ``to`` (windows; the end exclusive), ``pushdown``.  Channels stay interleaved.  An empty file
    has no rows; half a sample at the end is left out; a RIFF file that is no such fails the read.
    """

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return "path string, window bigint, t0 bigint, samples array<smallint>"

    def reader(self, schema: Any) -> DataSourceReader:
        kind = with_filters(PcmReader) if self.options.get("pushdown", "false").lower() == "true" else PcmReader
        return kind({k.lower(): v for k, v in self.options.items()})


class Malformed(ValueError):
    """An archive that cannot be read as asked."""


class Member:
    """An array of an archive: its length, and any part of it, without reading the rest where it is stored as it is."""

    def __init__(self, f: Any, held: zipfile.ZipFile, name: str) -> None:
        try:
            self.info = held.getinfo(f"{name}.npy")
        except KeyError as e:
            raise Malformed(f"no array {name}") from e
        with held.open(self.info) as m:
            version = np.lib.format.read_magic(m)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, fortran, self.dtype = read(m)
            self.skip = m.tell()
        if self.dtype.hasobject or self.dtype.kind not in "biuf" or (fortran and len(shape) > 1):
            raise Malformed(f"array {name} holds no plain numbers in rows")
        self.file, self.held, self.length = f, held, int(np.prod(shape, dtype=np.int64))

    def part(self, lo: int, hi: int) -> np.ndarray:
        size = self.dtype.itemsize
        begin, n = self.skip + lo * size, (hi - lo) * size
        if self.info.compress_type == zipfile.ZIP_STORED:
            self.file.seek(self.info.header_offset)
            head = self.file.read(30)
            at = self.info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
            self.file.seek(at + begin)
            raw = self.file.read(n)
        else:
            with self.held.open(self.info) as m:
                while begin:
                    begin -= len(m.read(min(begin, 1 << 20))) or begin
                raw = m.read(n)
        if len(raw) != n:
            raise Malformed("the archive is cut off")
        return np.frombuffer(raw, self.dtype).astype(np.float64)


class NpzReader(RangeReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.arrays = [x.strip() for x in options.get("arrays", "").split(",") if x.strip()]
        self.strict = options.get("mode", "DROPMALFORMED").upper() == "FAILFAST"
        self.pattern = options.get("pattern", "*.npz")
        if not self.arrays:
            raise ValueError("option arrays must name the arrays to read")

    def partitions(self) -> Sequence[Span]:
        out = []
        for path, size in self.files(self.pattern):
            parts = max(1, -(-size // self.range))
            out += [Span(path, i, parts) for i in range(parts)]
        return out or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.parts:
            return
        fs, name = opened(partition.path)
        try:
            with fs.open_input_file(name) as f, zipfile.ZipFile(f) as held:
                members = [Member(f, held, x) for x in self.arrays]
                if len({m.length for m in members}) > 1:
                    raise Malformed("arrays differ in length")
                n = members[0].length
                lo, hi = self.choice.within(n * partition.part // partition.parts, n * (partition.part + 1) // partition.parts)
                step = max(ROWS, self.range // (8 * len(members)))
                for a in range(lo, hi, step):
                    b = min(a + step, hi)
                    columns = [m.part(a, b) for m in members]
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * (b - a)), pa.array(np.arange(a, b)), *map(pa.array, columns)], names=["path", "frame", *self.arrays])
        except (Malformed, zipfile.BadZipFile, ValueError) as e:
            if self.strict:
                raise ValueError(f"{partition.path}: {e}") from e


class NpzSource(DataSource):
    """Frames ``path, frame`` and a column of doubles for each of the ``arrays`` (names, by commas) of array archives below ``path``.

    Other arrays are not read.  Options: ``arrays``, ``pattern``, ``rangeBytes``, ``from`` and ``to`` (frames; the end exclusive), ``pushdown``, ``mode``: archives that cannot be read, lack
    an array, or whose arrays differ in length give no rows (``DROPMALFORMED``; what was read of one that is cut off stays) or fail the read (``FAILFAST``).  Arrays stored as they are
    (``numpy.savez``) are read from the range's first frame on; compressed ones are unpacked up to there.
    """

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        names = [x.strip() for x in self.options.get("arrays", "").split(",") if x.strip()]
        return ", ".join(["path string", "frame bigint", *(f"`{n}` double" for n in names)])

    def reader(self, schema: Any) -> DataSourceReader:
        kind = with_filters(NpzReader) if self.options.get("pushdown", "false").lower() == "true" else NpzReader
        return kind({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("pcm")`` and ``("npz")`` known."""
    spark.dataSource.register(PcmSource)
    spark.dataSource.register(NpzSource)


def recordings(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """See :class:`PcmSource`."""
    register(spark)
    return spark.read.format("pcm").options(**{k.rstrip("_"): v for k, v in options.items()}).load(path)


def archives(spark: SparkSession, path: str, arrays: Sequence[str], **options: Any) -> DataFrame:
    """See :class:`NpzSource`."""
    register(spark)
    return spark.read.format("npz").options(arrays=",".join(arrays), **{k.rstrip("_"): v for k, v in options.items()}).load(path)
