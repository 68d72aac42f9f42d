"""Sorted arrays of 64-bit keys in files of a shared folder, which workers map into memory.

A table is cut into shards by the leading bits of its keys.  A shard's file holds the number of keys, the sorted keys, then one
array for each column.  Files are written under another name first and renamed, so a task that runs
twice leaves the same file; readers search sorted queries shard by shard, so they walk through the files in order.  Where the
shared folder is no mounted one but a store, shards are read from it instead, a few at a time.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

#: Shards that a worker keeps mapped, and those that it holds of a store.
MAPPED, HELD = 512, 4
#: Keys that a task gathers before it hands them on, and bits of a key by which repeats are found.
GATHERED, KEPT_BITS = 1 << 22, 40


def mounted(uri: str) -> str | None:
    """The path of a folder that is mounted on executors; None for a store."""
    found = urlparse(uri)
    if found.scheme not in ("", "file"):
        return None
    return unquote(found.path) if found.scheme else uri


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Shards of unsigned keys, by their leading ``bits`` (1 at least)."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def parts(raw: np.ndarray, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """Keys and columns in the bytes of a shard."""
    n, out, at = int(raw[:8].view(np.int64)[0]), [], 8
    for kind in ("u8", *kinds):
        size = n * np.dtype(kind).itemsize
        out.append(raw[at : at + size].view(kind))
        at += -(-size // 8) * 8
    return tuple(out)


def empty(kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    return (np.zeros(0, np.uint64), *(np.zeros(0, k) for k in kinds))


@lru_cache(maxsize=MAPPED)
def mapped(path: str, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    return parts(np.memmap(path, np.uint8, "r"), kinds) if os.path.exists(path) else empty(kinds)


@lru_cache(maxsize=HELD)
def held(uri: str, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    fs, name = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        return empty(kinds)
    with fs.open_input_stream(name) as f:
        return parts(np.frombuffer(f.read(), np.uint8), kinds)


@dataclass(frozen=True)
class Table:
    """A folder of shards; ``kinds`` are the types of its columns."""

    folder: str
    bits: int
    kinds: tuple[str, ...]

    def path(self, shard: int) -> str:
        return f"{self.folder}/{shard:06d}.bin"

    def arrays(self, shard: int) -> tuple[np.ndarray, ...]:
        """Keys and columns of a shard; none where it was not written."""
        path = mounted(self.path(shard))
        return held(self.path(shard), self.kinds) if path is None else mapped(path, self.kinds)

    def write(self, shard: int, keys: np.ndarray, columns: tuple[np.ndarray, ...]) -> None:
        """Write a shard; ``keys`` are sorted and distinct."""
        chunks = [np.int64(len(keys)).tobytes()]
        for values, kind in zip((keys, *columns), ("u8", *self.kinds), strict=True):
            raw = np.ascontiguousarray(values, kind).tobytes()
            chunks.append(raw + bytes(-len(raw) % 8))
        path = mounted(self.path(shard))
        if path is None:
            fs, name = pafs.FileSystem.from_uri(self.path(shard))
            fs.create_dir(os.path.dirname(name), recursive=True)
            with fs.open_output_stream(own := f"{name}.{uuid.uuid4().hex}") as f:
                f.writelines(chunks)
            fs.move(own, name)
            return
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(own := f"{path}.{uuid.uuid4().hex}", "wb") as f:
            f.writelines(chunks)
        os.replace(own, path)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """For sorted distinct keys: whether each is there, its place in its shard, and its columns (0 where it is not)."""
        there, place = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        out = tuple(np.zeros(len(keys), k) for k in self.kinds)
        if not len(keys):
            return there, place, out
        shards = shard_of(keys, self.bits)
        begins = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]]))
        for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(keys)], strict=True):
            own, *columns = self.arrays(int(shards[lo]))
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(own, keys[lo:hi]), len(own) - 1)
            hit = own[at] == keys[lo:hi]
            there[lo:hi], place[lo:hi] = hit, at
            for to, values in zip(out, columns, strict=True):
                to[lo:hi][hit] = values[at[hit]]
        return there, place, out

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Columns of keys in any order, 0 where a key is not there."""
        distinct, back = np.unique(keys, return_inverse=True)
        return tuple(c[back] for c in self.find(distinct)[2])


def short(keys: np.ndarray) -> np.ndarray:
    """Keys by their leading ``KEPT_BITS`` alone."""
    return keys >> np.uint64(64 - KEPT_BITS) << np.uint64(64 - KEPT_BITS)


def packed(keys: np.ndarray) -> bytes:
    """Sorted short keys in as many bytes as they need."""
    return (keys >> np.uint64(64 - KEPT_BITS)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEPT_BITS // 8].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    width = KEPT_BITS // 8
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel() << np.uint64(64 - KEPT_BITS)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts added up."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(counts, begins) if len(begins) else counts


def repeated(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], folder: str, bits: int) -> Table:
    """A table of the keys that occur more than once over all batches of ``rows``, with how often.

    Keys are compared by their leading ``KEPT_BITS``: a few that occur once may be taken for repeated, none that repeats is missed.  Tasks
    sort and count their keys and hand on arrays of five bytes a key, one row a shard, so nothing but bytes of keys is shuffled and a frequent key
    comes once from each task.
    """
    table = Table(folder, bits, ("u4",))

    def hand_on(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = short(np.concatenate(gathered))
        keys, counts = added(keys, np.ones(len(keys), np.int64))
        counts = np.minimum(counts, 2**32 - 1).astype("<u4")
        shards = shard_of(keys, bits)
        begins = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]]))
        for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(keys)], strict=True):
            own, n = keys[lo:hi], counts[lo:hi]
            values = (int(shards[lo]), packed(own[n == 1]), packed(own[n > 1]), n[n > 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["s", "once", "more", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                size += len(keys)
                if size >= GATHERED:
                    yield from hand_on(held)
                    held, size = [], 0
        if size:
            yield from hand_on(held)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for s, once, more, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, many = unpacked(once), unpacked(more)
                found.setdefault(s, []).append((np.concatenate([one, many]), np.concatenate([np.ones(len(one), np.int64), np.frombuffer(n, "<u4").astype(np.int64)])))
        for s, held in found.items():
            keys, counts = added(*(np.concatenate(x) for x in zip(*held, strict=True)))
            table.write(s, keys[counts > 1], (np.minimum(counts[counts > 1], 2**32 - 1),))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], names=["s"])

    dealt = rows.mapInArrow(gather, "s int, once binary, more binary, n binary").repartition(1 << bits, "s")
    dealt.mapInArrow(write, "s int").write.format("noop").mode("overwrite").save()
    return table
