"""Fill-in-the-middle documents, cut by a sparse index of checkpoints.

A text is counted once, in windows of bytes; while counting, the byte and the
code point offset of every so-many-th unit are recorded.  To cut after a unit
the checkpoints are searched by bisection and the text is read again from
there, over a few units.  So a text of any length costs an index of a small
share of its size, and no list of its units is held.

A unit is a word with the ASCII blanks before it; blanks at the end of a text
are a unit of their own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8
from .words import BLANK

#: Units from one checkpoint to the next, and bytes that are looked at together.
EVERY, WINDOW = 128, 1 << 16
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


class Index:
    """Counts of a text in UTF-8, and its checkpoints."""

    def __init__(self, raw: np.ndarray, every: int = EVERY, window: int = WINDOW) -> None:
        self.raw, self.every, self.window = raw, every, window
        #: Byte and code point offsets after 0, every, 2 * every, ... units.
        self.bytes, self.chars = [0], [0]
        units = chars = 0
        for lo in range(0, len(raw), window):
            ends, first = self._ends(lo, lo + window), self._firsts(lo, lo + window)
            marked = ends[(-units - 1) % every :: every]
            if len(marked):
                self.bytes += marked.tolist()
                self.chars += (chars + np.cumsum(first, dtype=np.int64)[marked - lo - 1]).tolist()
            units += len(ends)
            chars += int(first.sum(dtype=np.int64))
        self.n_chars = chars
        #: The words end the units; blanks after the last are one more.
        self.words = units
        self.n = units + bool(len(raw) and BLANK[raw[-1]])

    def _ends(self, lo: int, hi: int) -> np.ndarray:
        """Offsets after the words that end in a stretch of bytes."""
        part = self.raw[lo : hi + 1]
        solid = ~BLANK[part]
        n = min(hi, len(self.raw)) - lo
        after = np.ones(n, bool)
        after[: len(part) - 1] = ~solid[1 : n + 1]
        return np.flatnonzero(solid[:n] & after) + lo + 1

    def _firsts(self, lo: int, hi: int) -> np.ndarray:
        """Whether each byte begins a code point."""
        return (self.raw[lo:hi] & 0xC0) != 0x80

    def after(self, unit: int) -> tuple[int, int]:
        """Byte and code point offset after so many units."""
        if unit > self.words:
            return len(self.raw), self.n_chars
        k = bisect_right(range(0, self.every * len(self.bytes), self.every), unit) - 1
        left, lo, chars = unit - k * self.every, self.bytes[k], self.chars[k]
        size = 1024
        while left:
            ends = self._ends(lo, lo + size)
            to = int(ends[left - 1]) if len(ends) >= left else min(lo + size, len(self.raw))
            chars += int(self._firsts(lo, to).sum(dtype=np.int64))
            left -= min(left, len(ends))
            lo, size = to, min(2 * size, self.window)
        return lo, chars


def check_marks(marks: Sequence[str]) -> None:
    """Marks must be told apart wherever they stand: none may begin with what one ends with, nor hold another."""
    if len(set(marks)) != 3 or not all(marks) or any(a != b and a in b for a in marks for b in marks):
        raise ValueError("marks must be three texts none of which holds another")
    if any(a[-n:] == b[:n] for a in marks for b in marks for n in range(1, min(len(a), len(b)))):
        raise ValueError("no mark may begin with what a mark ends with")


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers under 2**32 from the SHA-256 of ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: Sequence[str] = MARKS, every: int = EVERY) -> DataFrame:
    """Prefix, middle and suffix of each text in another order.

    Columns ``key``, ``n`` (units), ``form`` (``plain``, ``psm`` or ``spm``), ``prefix_chars`` and ``middle_chars`` (code points, null
    in a plain row) and ``output``.  Of 100 texts about ``rate`` are cut, and of 100 cut ones ``spm_rate`` begin with the suffix; cuts
    and forms follow from ``seed`` and key alone, so they do not depend on partitions or on other rows.  An empty or null
    text, and one that holds a mark, stays plain; the output of a null text is empty.  Rows that repeat a key are cut by the
    same draws, a null key counts as an empty one; other columns are ignored, an empty table gives no rows.
    """
    check_marks(marks)
    p, s, m = (x.encode() for x in marks)
    kind = df.schema[key].dataType.simpleString()

    def one(raw: np.ndarray, h: tuple[int, ...]) -> tuple[int, str, int | None, int | None, bytes]:
        whole, index = raw.tobytes(), Index(raw, every)
        if not whole or h[2] % 100 >= rate or any(x in whole for x in (p, s, m)):
            return index.n, "plain", None, None, whole
        (a, a_chars), (b, b_chars) = map(index.after, sorted((h[0] % (index.n + 1), h[1] % (index.n + 1))))
        if h[3] % 100 < spm_rate:
            form, parts = "spm", (s, whole[b:], p, whole[:a], m, whole[a:b])
        else:
            form, parts = "psm", (p, whole[:a], s, whole[b:], m, whole[a:b])
        return index.n, form, a_chars, b_chars - a_chars, b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            drawn = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            rows = [one(data[a:b], h) for a, b, h in zip(offsets[:-1].tolist(), offsets[1:].tolist(), drawn, strict=True)]
            columns = [[r[i] for r in rows] for i in range(5)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[:4], arrays[4].cast(pa.string())], names=[key, "n", "form", "prefix_chars", "middle_chars", "output"])

    small_batches(df.sparkSession)
    rows = df.select(df[key].alias("key"), df[text].alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draws(df[key], seed))))
    return rows.mapInArrow(run, f"`{key}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that an output was made of, from output and form alone."""
    p, s, m = marks
    size, second = F.length, F.lit(m)
    opening, first = (F.when(form == "psm", F.lit(x)).otherwise(F.lit(y)) for x, y in ((p, s), (s, p)))
    inner = F.substring(output, size(opening) + 1, size(output))
    one = F.instr(inner, first)
    rest = F.substring(inner, one + size(first), size(inner))
    two = F.instr(rest, second)
    a, b, c = F.substring(inner, F.lit(1), one - 1), F.substring(rest, F.lit(1), two - 1), F.substring(rest, two + size(second), size(rest))
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, c, b)).otherwise(F.concat(b, c, a))
