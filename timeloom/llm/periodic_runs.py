"""Maximal periodic stretches of the words of a text, by the runs theorem.

Every run has a Lyndon root, under the order of the words or under the reverse
one, that is the longest Lyndon word at its place and does not begin where the
run does.  The longest Lyndon word at a place ends before the next smaller value of the
inverse suffix array.  So all roots come from two suffix arrays; each is extended to
both sides by longest common extensions: range minima, from a sparse table, of the LCP array
of the text and of the reversed text.

A root that does not begin its run repeats the word before it one period later, and a run of the
length asked for repeats a stretch of words there.  Texts in which no root does are
done after the roots; suffix arrays of reversed texts and LCP arrays are made for the others only.

Many texts are worked on together: each ends with a mark of its own, smaller than all words, and suffixes are compared within texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, small_batches, spread, utf8
from .words import split

#: Words that are compared around a root before it is extended.
LOOK = 8
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_ranks(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The inverse suffix array: the rank of each place's suffix, texts one after the other.

    ``codes`` ends each text with -1.  Prefix doubling, where only suffixes that still share a rank are sorted again.
    """
    n = len(codes)
    width, count = int(codes.max(initial=0) + 1).bit_length(), int(text[-1] + 1).bit_length() if n else 1
    key, same = codes + 1, 1
    if count + 2 * width < 63:
        second = np.concatenate([key[1:], [0]])
        second[codes < 0] = 0
        key, same = key << width | second, 2
    key = text << (same * width) | key if count + same * width < 63 else np.unique(np.stack([text, key]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    live, first, new = order, np.zeros(n, np.int64), key[order]
    while True:
        starts = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]])) if len(new) else np.zeros(0, np.int64)
        sizes = np.diff(starts, append=len(new))
        rank[live] = first + np.repeat(starts, sizes)
        live = live[np.repeat(sizes > 1, sizes)]
        if not len(live):
            return rank
        now = rank[live]
        new = now * (n + 1) + rank[live + same]
        order = np.argsort(new, kind="stable")
        live, new, now = live[order], new[order], now[order]
        begins = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]]))
        first = now - np.repeat(begins, np.diff(begins, append=len(now)))
        same *= 2


class Minima:
    """Sparse table: minima of all stretches of 1, 2, 4, ... values, made as far as they are asked for."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last[:0])
        return self.levels[k]

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of ``values[lo[i]:hi[i] + 1]``, none of them empty."""
        out = np.empty(len(lo), self.levels[0].dtype)
        k = np.frexp(hi - lo + 1)[1] - 1
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            table = self.level(level)
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << level) + 1])
        return out


def next_smaller(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place of ``at`` the next one of a smaller rank; each has one.

    Stretches are doubled until one holds a smaller rank, and halved from there.
    """
    table, n = Minima(rank), len(rank)
    out = at + 1
    live, level = np.arange(len(at)), 0
    while len(live):
        pos, own = out[live], rank[at[live]]
        values = table.level(level)
        free = np.zeros(len(live), bool)
        inside = pos + (1 << level) <= n
        free[inside] = values[pos[inside]] > own[inside]
        done, pos_done, own_done = live[~free], pos[~free], own[~free]
        for k in range(level - 1, -1, -1):
            inside = np.flatnonzero(pos_done + (1 << k) <= n)
            step = inside[table.level(k)[pos_done[inside]] > own_done[inside]]
            pos_done[step] += 1 << k
        out[done] = pos_done
        live = live[free]
        out[live] += 1 << level
        level += 1
    return out


def plausible(codes: np.ndarray, i: np.ndarray, j: np.ndarray, need: int) -> np.ndarray:
    """Whether at least ``need`` words in a row, with that before ``i`` among them, equal those ``j - i`` later."""
    keep = np.flatnonzero((i > 0) & (codes[i - 1] >= 0) & (codes[i - 1] == codes[j - 1]))
    count = np.ones(len(keep), np.int64)
    for way in (-1, 1):
        live = np.arange(len(keep))
        for step in range(1, need):
            a, b = i[keep[live]] - 1 + way * step, j[keep[live]] - 1 + way * step
            same = (a >= 0) & (b < len(codes))
            same &= (codes[np.maximum(a, 0)] == codes[np.minimum(b, len(codes) - 1)]) & (codes[np.maximum(a, 0)] >= 0)
            live = live[same]
            if not len(live):
                break
            count[live] += 1
    return keep[count >= need]


def neighbour_lcp(codes: np.ndarray, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """LCP array: by rank, the words that a suffix shares with the one before it in order (0 across texts).

    Only values that do not follow from the place before (irreducible ones) are counted by comparing; their sum is at most n log n.
    """
    n = len(codes)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    before = np.empty(n, np.int64)
    before[order] = np.concatenate([[-1], order[:-1]])
    alone = (before < 0) | (text[before] != text)
    counted = np.flatnonzero(alone | (codes[np.arange(n) - 1] != codes[before - 1]))  # a place before the first is the last mark
    size = np.zeros(len(counted), np.int64)
    live, block = np.flatnonzero(~alone[counted]), 4
    while len(live):
        a, b = counted[live] + size[live], before[counted[live]] + size[live]
        step = np.arange(block)
        left, right = (codes[np.minimum(x[:, None] + step, n - 1)] for x in (a, b))
        differ = (left != right) | (left < 0)
        stops = differ.any(1)
        size[live] += np.where(stops, differ.argmax(1), block)
        live = live[~stops]
        block = max(4, min(2 * block, (1 << 20) // max(1, len(live))))
    base = np.zeros(n, np.int64)
    base[counted] = np.arange(len(counted))
    base = np.maximum.accumulate(base)
    by_place = size[base] - (np.arange(n) - counted[base])
    return by_place[order]


class Extensions:
    """Longest common extensions of two places of one text, to the right."""

    def __init__(self, codes: np.ndarray, text: np.ndarray) -> None:
        self.rank = suffix_ranks(codes, text)
        self.minima = Minima(neighbour_lcp(codes, text, self.rank))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.rank[a], self.rank[b]
        return self.minima.between(np.minimum(x, y) + 1, np.maximum(x, y))


def places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts stand when each text ends with a mark, and the text of every place."""
    sizes = np.diff(at)
    return np.arange(at[-1] - at[0]) + np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(sizes)), sizes + 1)


def roots(codes: np.ndarray, text: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """``i, j``: longest Lyndon words [i, j) under either order that can lie in a run and do not begin it."""
    solid = np.flatnonzero(codes >= 0)
    found = []
    for letters in (codes, np.where(codes >= 0, codes.max(initial=0) - codes, -1)):
        ends = next_smaller(suffix_ranks(letters, text), solid)
        keep = plausible(codes, solid, ends, need)
        found.append((solid[keep], ends[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def find(codes: np.ndarray, at: np.ndarray, shortest: int = 12) -> np.ndarray:
    """Rows ``text, start, length, period`` of all runs of at least ``shortest`` words and two periods, by text, start and period.

    Text i has the words ``codes[at[i]:at[i + 1]]``.
    """
    nothing = np.zeros((0, 4), np.int64)
    if not len(codes):
        return nothing

    def marked(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.diff(at)[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        where, text = places(ends)
        out = np.full(len(text), -1, np.int64)
        out[where] = codes[spread(at[which], sizes)]
        return out, text, ends[:-1] + np.arange(len(which))

    # a run of `shortest` words with period p repeats shortest - p or p words, whichever is more
    need = min(LOOK, max(1, -(-shortest // 2)))
    some = np.flatnonzero(np.diff(at) >= max(2, shortest))
    if not len(some):
        return nothing
    laid, text, begins = marked(some)
    i, j = roots(laid, text, need)
    if not len(i):
        return nothing
    busy = np.unique(text[i])
    sub, sub_text, sub_begins = marked(some[busy])
    of = np.searchsorted(busy, text[i])
    shift = sub_begins[of] - begins[busy[of]]
    i, j = i + shift, j + shift
    n = len(sub)
    flipped = np.concatenate([sub[:-1][::-1], [-1]])
    flipped_text = sub_text[-1] - sub_text[::-1]  # ascending again
    right, left = Extensions(sub, sub_text)(i, j), Extensions(flipped, flipped_text)(n - 1 - i, n - 1 - j)
    period = j - i
    length = period + left + right
    rows = np.stack([some[busy[of]], i - left - sub_begins[of], length, period], axis=1)[length >= np.maximum(shortest, 2 * period)]
    rows = np.unique(rows, axis=0) if len(rows) else nothing
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def runs_of(df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 12) -> DataFrame:
    """All runs of each text, and the text without their repeats.

    Columns ``key``, ``n_words``, ``runs`` (array of start, length and period in words, by start and period) and ``collapsed``.  A run is a
    stretch of at least ``shortest`` words, and at least two periods, that repeats itself with its smallest period and that no
    neighbouring word extends.  ``collapsed`` is the words, joined by one space, that are in no run after its first period.

    A null or blank text has no words, no runs and an empty ``collapsed``.  Rows that repeat a key stay separate rows; other columns are
    ignored, whatever their names; an empty table gives no rows.  Words are equal if their bytes are.  A text is worked on as a whole, in memory of some hundred
    bytes a word, and texts without repeats in less.
    """
    kind = df.schema[key].dataType.simpleString()
    struct = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])

    def collapsed(raw: bytes, rows: np.ndarray) -> str:
        words = raw.split()
        if len(rows):
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, rows[:, 1] + rows[:, 3], 1)
            np.add.at(gone, rows[:, 1] + rows[:, 2], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
        return b" ".join(words).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets):
                own, own_at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                words = split(own, own_at)
                rows = find(words.codes, words.at, shortest)
                bounds = np.searchsorted(rows[:, 0], np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in (1, 2, 3)], fields=list(struct)))
                texts = [collapsed(own[a:b].tobytes(), rows[p:q]) for a, b, p, q in zip(own_at[:-1].tolist(), own_at[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(words.at)), lists, pa.array(texts, pa.string())], names=[key, "n_words", "runs", "collapsed"])

    small_batches(df.sparkSession)
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, n_words bigint, runs {RUNS}, collapsed string")
