"""Exact Jaccard join of documents on word shingles by PartEnum signatures.

Two sets of Jaccard similarity t or more differ in few elements: in at most
(1 - t) / (1 + t) of the sum of their sizes.  Sizes fall into bands so that this
bound, k, is one number a band.  The feature domain is dealt into n1 groups of n2
cells with 2 * n1 > k; two such sets differ in at most one element within some
group, hence agree on all but one of its cells.  A set's signatures are, for
each group and each left-out cell, the hash of the elements in the other
cells: similar sets share one.  A set signs for its own band and for the next.

Groups of few elements often leave cells empty, and a signature over empty cells says little.  Where that is common a
band has so many groups that similar sets agree in three of them at least: empty signatures are dropped, and each three
of a set's empty ones together are a signature.  Similar sets share a full one or three empty ones.

Equal sets are one class from the start.  Classes that share a signature with
another pass a second filter: with two to four times as many cells as elements may differ, similar sets differ
in at most k of them, so they share one of their k + 1 rarest cells, and a
near copy whose own cells alone fill that prefix has no partner.  Classes that
still meet are first compared with one leader of their cell; linked classes
join into components, and only pairs of classes in different components
are compared after that.  No pair that could link two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialise, slices, small_batches, spread, utf8
from .hash_store import Table, repeated, short
from .hashing import MIX, MIX2, mix, range_hashes

#: White space that parts words: blank and \x09 to \x0d.
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Rows of one or two numbers that may be broadcast.
BROADCAST_ROWS = 2_000_000
#: Added to the seed of hashes that check the others.
CHECK = 1 << 20
#: Keys of a shard of the tables that count signatures and cells.
SHARD = 1 << 21
#: Members of a cell up to which their pairs are listed, and members of a block beyond that.
FEW, MEMBERS = 8, 400
#: Cells of a group, one of which is left out of each signature: three where sets are small and two
#: cells would often be empty, two where there are more groups than this.
MANY = 8


#: Groups of few elements (under this many on average) take three cells even where there are many groups, and spare groups.
THIN, SPARE, TRIPLES = 14, 3, 60
#: What becomes of signatures over empty cells: signed anew, kept, or combined by ``SPARE``.
ANEW, KEPT, COMBINED = 0, 1, 2


def thin(like: "Similarity") -> bool:
    """Whether the groups of a similarity hold few elements: a set has about this many for each group."""
    return like.den + like.num < THIN * (like.den - like.num)


def cells_of(groups: np.ndarray) -> np.ndarray:
    return np.where(groups > MANY, 2, 3)


def fine_of(like: "Similarity") -> int:
    """Cells of the second filter for each element that may differ, so that a cell holds about two elements."""
    return max(2, (like.den + like.num) // (4 * (like.den - like.num)))


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least ``num / den``, in integers so that the bound is exact."""

    num: int = 90
    den: int = 100

    def differ(self, total: int) -> int:
        """The most elements in which two similar sets of ``total`` elements together can differ."""
        return total * (self.den - self.num) // (self.den + self.num)


@lru_cache(maxsize=8)
def bands(like: Similarity, top: int = 1 << 31) -> np.ndarray:
    """The smallest size of each band: the largest size of a band is similar to its smallest."""
    out = [1]
    while out[-1] < top:
        out.append(out[-1] * like.den // like.num + 1)
    return np.array(out, np.int64)


def groups_of(like: Similarity, band: np.ndarray) -> np.ndarray:
    """Groups of cells in a band; 0 where similar sets are equal sets.

    A pair that meets in a band has its larger set there and its smaller one there or one below.
    """
    edge = bands(like)
    largest = edge[np.minimum(band + 1, len(edge) - 1)] - 1
    k = (2 * largest) * (like.den - like.num) // (like.den + like.num)
    # two sets of unlike sizes: the smaller has at least num / den of the larger's
    return np.where(k > 0, (k + 2) // 2, 0)


def empties(like: Similarity, band: np.ndarray, n1: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """How many signatures a band's smallest sets leave empty on average.

    Where they are more than two, signing anew for each would multiply at every depth, and threes of more than ``TRIPLES``
    are too many; such bands keep empty signatures as they are, and the second filter parts the sets that meet there.  This depends
    on the band alone, so similar sets decide alike.
    """
    total = np.maximum(1, n1 * cells)
    smallest = bands(like)[np.clip(band - 1, 0, len(bands(like)) - 1)]
    return total * np.exp(-smallest * (cells - 1) / total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and where each text's begin.

    A text of fewer words has its whole word sequence as one shingle, one without words none.  ``seed`` goes into the
    hash of every word, so sets that are hashed under another seed are hashed independently from the bytes on.
    """
    n = len(data)
    data = LOWER[data]
    blank = SPACE[data]
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    previous = np.concatenate([[True], blank[:-1]]) | text_start[:n]
    starts = np.flatnonzero(~blank & previous)
    following = np.concatenate([blank[1:], [True]]) | text_start[1:]
    ends = np.flatnonzero(~blank & following) + 1
    h = range_hashes(data, starts, ends, seed)
    at = np.searchsorted(starts, offsets)
    counts = np.diff(at)
    made = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    first = spread(at[:-1], made)
    own = np.repeat(np.minimum(counts, words), made)
    out = np.zeros(len(first), np.uint64)
    for j in range(words):
        there = j < own
        out[there] = mix(out[there] * MIX + h[first[there] + j] + np.uint64(j + 1))
    owner = np.repeat(np.arange(len(counts)), made)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[keep], owner[keep]
    return out, np.searchsorted(owner, np.arange(len(counts) + 1))


def set_hashes(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits of each set that do not depend on the order of its elements."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(elements ^ MIX), dtype=np.uint64)])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


def signatures(elements: np.ndarray, at: np.ndarray, like: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) for all sets, by number."""
    sizes = np.diff(at)
    edge = bands(like)
    own = np.searchsorted(edge, sizes, side="right") - 1
    owners, found = [], []
    for shift in (0, 1):
        band = own + shift
        n1 = np.where(sizes > 0, groups_of(like, np.maximum(band, 0)), 0)
        spare = (n1 > MANY) & thin(like)
        lots = empties(like, band, n1 + (SPARE - 1) * spare, np.where(spare, 3, cells_of(n1)))
        empty = np.where(spare & (lots <= TRIPLES), COMBINED, np.where(spare | (lots > 2), KEPT, ANEW))
        # in all but SPARE - 1 of the groups two differences each would be too many, so SPARE groups have at most one
        o, s = sign(elements, at, band, n1 + (SPARE - 1) * spare, np.where(spare, 3, cells_of(n1)), np.uint64(1), empty)
        owners.append(o)
        found.append(s)
    return np.concatenate(owners), np.concatenate(found)


def sign(elements: np.ndarray, at: np.ndarray, band: np.ndarray, n1: np.ndarray, cells: np.ndarray, seed: np.uint64, full: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) for the sets with ``n1`` groups of ``cells`` cells.

    A signature over empty cells says little and would bring many sets together; ``full`` says what a set does with them.
    A set that signs anew does so with cells dealt by another hash, among the sets with the same empty one.
    """
    sizes = np.diff(at)
    owners, found = [], []
    for c in (2, 3):
        used = np.flatnonzero((n1 > 0) & (cells == c))
        if len(used):
            o, f = sign_with(c, used, elements, at, sizes, band, n1, seed, full, depth)
            owners.append(o)
            found.append(f)
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(found)


def sign_with(cells: int, used: np.ndarray, elements: np.ndarray, at: np.ndarray, sizes: np.ndarray, band: np.ndarray, n1: np.ndarray, seed: np.uint64, full: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    groups = n1[used]
    base = np.cumsum(groups * cells) - groups * cells
    of = np.repeat(np.arange(len(used)), sizes[used])
    x = elements[spread(at[used], sizes[used])]
    h = mix(x ^ mix(np.array([seed], np.uint64) * MIX))
    cell = base[of] + ((h >> np.uint64(32)) * (groups * cells)[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ MIX2)[order], dtype=np.uint64)])
    edges = np.searchsorted(cell[order], np.arange(int(groups.sum()) * cells + 1))
    sums = (total[edges[1:]] - total[edges[:-1]]).reshape(-1, cells)
    filled = np.diff(edges).reshape(-1, cells)
    remaining = sums.sum(1, dtype=np.uint64)[:, None] - sums
    empty = (filled.sum(1)[:, None] - filled) == 0
    number = spread(np.zeros(len(used), np.int64), groups)
    subset = (number[:, None] * cells + np.arange(cells)).astype(np.uint64)
    tag = mix((np.repeat(band[used], groups).astype(np.uint64)[:, None] << np.uint64(40) | subset) * MIX + seed)
    out = mix(remaining * MIX2 ^ tag)
    owner = np.repeat(np.repeat(used, groups), cells).reshape(-1, cells)
    empty &= full[owner] != KEPT
    owners, found = [owner[~empty]], [out[~empty]]
    several = empty & (full[owner] == COMBINED)
    if several.any():
        o, f = combined(owner[several], tag[several])
        owners.append(o)
        found.append(f)
    anew = empty & (full[owner] == ANEW)
    if depth >= 3:
        owners.append(owner[anew])
        found.append(out[anew])
    else:
        for o, s in zip(owner[anew].tolist(), tag[anew].tolist(), strict=True):
            one = np.array([0, sizes[o]])
            _, deeper = sign(elements[at[o] : at[o + 1]], one, band[o : o + 1], n1[o : o + 1], np.array([cells]), np.uint64(s), full[o : o + 1], depth + 1)
            owners.append(np.full(len(deeper), o))
            found.append(deeper)
    return np.concatenate(owners), np.concatenate(found)


def combined(owner: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) for each ``SPARE`` empty signatures of a set; owners ascend, and a set's tags come in one order for all sets."""
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    counts = np.diff(np.append(starts, len(owner)))
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in np.unique(counts[counts >= SPARE]).tolist():
        rows = starts[counts == n]
        picks = np.array(list(combinations(range(n), SPARE)))
        held = tag[rows[:, None] + np.arange(n)][:, picks]
        key = np.zeros(held.shape[:2], np.uint64)
        for j in range(SPARE):
            key = mix(key * MIX2 ^ held[:, :, j])
        owners.append(np.repeat(owner[rows], len(picks)))
        found.append(key.ravel())
    return np.concatenate(owners), np.concatenate(found)


def fine_cells(elements: np.ndarray, at: np.ndarray, like: Similarity) -> tuple[np.ndarray, ...]:
    """(set, scheme, bound, cell hash) with :func:`fine_of` times as many cells as elements may differ.

    Similar sets that meet in a scheme differ in at most ``bound`` of its cells.
    """
    sizes = np.diff(at)
    edge = bands(like)
    own = np.searchsorted(edge, sizes, side="right") - 1
    out = []
    for shift in (0, 1):
        band = own + shift
        n1 = np.where(sizes > 0, groups_of(like, np.maximum(band, 0)), 0)
        used = np.flatnonzero(n1 > 0)
        bound = 2 * n1[used] - 1
        cells = fine_of(like) * (bound + 1)
        base = np.cumsum(cells) - cells
        of = np.repeat(np.arange(len(used)), sizes[used])
        h = mix(elements[spread(at[used], sizes[used])] ^ MIX2)
        cell = base[of] + ((h >> np.uint64(32)) * cells[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h)[order], dtype=np.uint64)])
        edges = np.searchsorted(cell[order], np.arange(int(cells.sum()) + 1))
        tag = (np.repeat(band[used], cells).astype(np.uint64) << np.uint64(40)) | spread(np.zeros(len(used), np.int64), cells).astype(np.uint64)
        sums = mix((total[edges[1:]] - total[edges[:-1]]) * MIX ^ mix(tag))
        out.append((np.repeat(used, cells), np.full(int(cells.sum()), shift), np.repeat(bound, cells), sums))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def over_sets(df: DataFrame, words: int, seeds: tuple[int, ...], schema: str, make) -> DataFrame:
    """``make(batch, elements, at, ...)`` over slices of ``df``, whose last column is a text, with sets for each seed."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            for lo, hi in slices(offsets):
                own, at_of = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                sets = [shingle_sets(own, at_of, words, s) for s in seeds]
                yield make(batch.slice(lo, hi - lo), *(x for pair in sets for x in pair))

    return df.mapInArrow(run, schema)


def record(names: list[str], *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def sizes_and_hashes(docs: DataFrame, words: int, seed: int) -> DataFrame:
    def make(batch: pa.RecordBatch, elements: np.ndarray, at: np.ndarray, others: np.ndarray, other_at: np.ndarray) -> pa.RecordBatch:
        # under either seed words that share a hash would make a set too small; the larger count is the right one
        return record(["key", "n", "h1", "h2"], batch.column(0), np.maximum(np.diff(at), np.diff(other_at)), set_hashes(elements, at), set_hashes(others, other_at))

    return over_sets(docs, words, (seed, CHECK + seed), "key bigint, n bigint, h1 bigint, h2 bigint", make)


def set_slices(batch: pa.RecordBatch, words: int, seed: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows whose last column is a text, with their sets."""
    data, offsets = utf8(batch.column(batch.num_columns - 1))
    for lo, hi in slices(offsets):
        yield lo, hi, *shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words, seed)


def shared_signatures(docs: DataFrame, words: int, seed: int, like: Similarity, bits: int) -> Table:
    """Signatures of more than one document, and a few that are taken for such."""
    keys = lambda batch: (signatures(elements, at, like)[1] for _, _, elements, at in set_slices(batch, words, seed))
    small_batches(docs.sparkSession)
    return repeated(docs, keys, fresh_path(docs.sparkSession, "signatures"), bits)


def signed(docs: DataFrame, words: int, seed: int, like: Similarity, shared: Table) -> DataFrame:
    """A row for each signature of each document that others may have."""

    def make(batch: pa.RecordBatch, elements: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        h = set_hashes(elements, at)
        owner, found = signatures(elements, at, like)
        often = shared.look_up(short(found))[0] > 1
        return record(["sig", "h1"], found[often], h[owner[often]])

    return over_sets(docs, words, (seed,), "sig bigint, h1 bigint", make)


def candidates(docs: DataFrame, wanted: DataFrame, many: int) -> DataFrame:
    """``h1, text`` rows of the classes ``wanted`` (columns h1, rep); the sets are still to be checked."""
    side = F.broadcast(wanted) if many <= BROADCAST_ROWS else wanted
    return docs.join(side, docs["key"].eqNullSafe(side["rep"])).select("h1", "text")


def prefixes(texts: DataFrame, words: int, seed: int, like: Similarity, bits: int) -> DataFrame:
    """``cell, h1, scheme, common``: the rarest cells of each class and scheme, one more than may differ.

    Sets that agree in all but ``bound`` of their cells share one of these.  A cell that no other class
    has fills a place but needs no row; a class with too many such cells has no partner at all.
    """
    keys = lambda batch: (fine_cells(elements, at, like)[3] for _, _, elements, at in set_slices(batch, words, seed))
    small_batches(texts.sparkSession)
    often = repeated(texts, keys, fresh_path(texts.sparkSession, "cells"), bits)

    def make(batch: pa.RecordBatch, elements: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy()
        owner, scheme, bound, cell = fine_cells(elements, at, like)
        freq = often.look_up(short(cell))[0]
        group, n = np.unique(owner * 2 + scheme, return_inverse=True, return_counts=True)[1:]
        known = np.bincount(group, freq > 1, len(n)).astype(np.int64)
        # the rarest first; frequencies are the same for all sets, so similar sets order alike
        order = np.lexsort((cell, freq, group))
        order = order[freq[order] > 1]
        place = np.arange(len(order)) - (np.cumsum(known) - known)[group[order]]
        taken = order[place < bound[order] + 1 - (n - known)[group[order]]]
        return record(["cell", "h1", "scheme", "common"], cell[taken], ids[owner[taken]], scheme[taken].astype(np.int32), known[group[taken]].astype(np.int32))

    return over_sets(texts, words, (seed,), "cell bigint, h1 bigint, scheme int, common int", make)


def matching(texts: DataFrame, words: int, seed: int) -> DataFrame:
    """The rows whose text has the set that ``h1`` stands for: a repeated key may bring others."""

    def make(batch: pa.RecordBatch, elements: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        h = set_hashes(elements, at)
        return batch.filter(pa.array(batch.column(0).to_numpy() == h.view(np.int64)))

    return over_sets(texts, words, (seed,), "h1 bigint, text string", make)


def verified(pairs: DataFrame, texts: DataFrame, words: int, like: Similarity) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar, by word hashes of their own: what collides in signatures does not here."""
    left = texts.select(F.col("h1").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("h1").alias("b"), F.col("text").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    small_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in slices(offsets):
                x, i = sets_of(batch.column(2).slice(lo, hi - lo), words)
                y, j = sets_of(batch.column(3).slice(lo, hi - lo), words)
                good = np.zeros(hi - lo, bool)
                for r in range(hi - lo):
                    u, v = x[i[r] : i[r + 1]], y[j[r] : j[r + 1]]
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    good[r] = like.den * both >= like.num * (len(u) + len(v) - both)
                yield batch.slice(lo, hi - lo).select(["a", "b"]).filter(pa.array(good))

    return rows.mapInArrow(run, "a bigint, b bigint")


def sets_of(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(*utf8(column), words, CHECK)


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id reachable from each id in ``edges`` (columns a, b).

    Alternates two star operations: every node hangs its larger neighbours on its smallest one, then
    its smaller ones.  Each round is a table of its own in the shared folder; rounds grow with
    the logarithm of the longest chain.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            near = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = near.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    check: tuple | None = None
    while True:
        now = materialise(star(star(now, True), False), "stars")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == check:
            break
        check = state
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def close_pairs(members: DataFrame, texts: DataFrame, words: int, seed: int, like: Similarity) -> DataFrame:
    """Pairs ``a, b`` of members of one cell in different components that differ in few enough cells.

    Members: ``cell, h1, scheme, part, many``.  Each comes with a byte of each of its cells, so that
    pairs are compared in memory and only those that can be similar become rows.  A busy
    cell is dealt into blocks, and each pair of blocks is a group of its own.
    """
    small_batches(members.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets):
                part = batch.slice(lo, hi - lo)
                elements, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words, seed)
                owner, scheme, _, cell = fine_cells(elements, at, like)
                order = np.lexsort((np.arange(len(owner)), scheme, owner))
                owner, scheme, cell = owner[order], scheme[order], cell[order]
                starts = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (scheme[1:] != scheme[:-1])])) if len(owner) else np.zeros(0, np.int64)
                raw = (cell & np.uint64(255)).astype(np.uint8).tobytes()
                bounds = [*starts.tolist(), len(raw)]
                sketches = pa.array([raw[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                own = owner[starts]
                yield record(["h1", "scheme", "size", "sketch"], part.column(0).take(pa.array(own)), scheme[starts].astype(np.int32), np.diff(at)[own], sketches)

    wanted = members.select("h1").distinct()
    sketches = texts.join(wanted, "h1", "left_semi").select("h1", "text").mapInArrow(run, "h1 bigint, scheme int, size bigint, sketch binary")
    blocks = F.ceil(F.col("many") / MEMBERS).cast("int")
    rows = members.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("h1"), blocks).cast("int")}).join(sketches, ["h1", "scheme"])
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "h1", "part", "size", "sketch")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        h, part, size, block = (table[c].to_numpy() for c in ("h1", "part", "size", "block"))
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(h), -1)
        left = np.flatnonzero(block == lo)
        right = left if lo == hi else np.flatnonzero(block == hi)
        found: list[np.ndarray] = []
        for i in left.tolist():
            others = right[(part[right] != part[i]) & (h[right] > h[i] if lo == hi else True)]
            apart = (sketch[others] != sketch[i]).sum(1)
            good = others[apart <= (size[others] + size[i]) * (like.den - like.num) // (like.den + like.num)]
            found.append(np.stack([np.full(len(good), h[i]), h[good]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table([pa.array(pairs.min(0)), pa.array(pairs.max(0))], names=["a", "b"])

    return rows.groupBy("cell", "lo", "hi").applyInArrow(compare, "a bigint, b bigint")


def links(texts: DataFrame, words: int, seed: int, like: Similarity, bits: int) -> DataFrame:
    """Enough links (``a, b``) between classes to span their components, each verified."""
    rows = materialise(prefixes(texts, words, seed, like, bits), "prefixes")
    groups = rows.groupBy("cell").agg(F.max_by("h1", F.struct("common", "h1")).alias("leader"), F.count("*").alias("n")).where("n > 1")
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    stars = rows.join(groups, "cell").where("h1 <> leader").select(*pair("h1", "leader")).distinct()
    stars = materialise(stars, "stars")
    first = materialise(verified(stars, texts, words, like), "links")
    part = components(first)
    labelled = rows.join(part.withColumnRenamed("id", "h1"), "h1", "left")
    labelled = labelled.select("cell", "h1", "scheme", F.coalesce("component", "h1").alias("part"))
    mixed = labelled.groupBy("cell").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("many")).where("lo <> hi").select("cell", "many")
    left = materialise(labelled.join(mixed, "cell"), "mixed")
    few = left.where(F.col("many") <= FEW)
    x, y = few.select("cell", F.col("h1").alias("a"), F.col("part").alias("p")), few.select("cell", F.col("h1").alias("b"), F.col("part").alias("q"))
    rest = x.join(y, "cell").where("a < b and p <> q").select("a", "b")
    rest = rest.unionByName(close_pairs(left.where(F.col("many") > FEW), texts, words, seed, like)).distinct()
    rest = rest.join(stars, ["a", "b"], "left_anti")
    return first.unionByName(materialise(verified(rest, texts, words, like), "links"))


def join(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, like: Similarity = Similarity()) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` of each row.

    Rows link when the Jaccard similarity of their sets of ``words``-word shingles reaches
    ``like``; ``component_id`` is the smallest key that links reach, a row's own included.
    Texts are in lower case for A-Z, words parted by ASCII white space; a text of fewer words is
    one shingle, an empty or null text has none, links with nothing and keeps its own key.  Rows
    that repeat a key are rows of their own.  A null key links like others but is never the
    smallest, so a component of such rows only has a null id.  Other columns are ignored.
    """
    docs = df.select(df[key].cast("bigint").alias("key"), df[text].alias("text"))
    for seed in range(1, 9):
        summary = materialise(sizes_and_hashes(docs, words, seed), "sets")
        classes = summary.where("n > 0").groupBy("h1").agg(F.min("key").alias("rep"), F.min("h2").alias("lo"), F.max("h2").alias("hi"))
        classes = materialise(classes, "classes")
        if classes.where("lo <> hi").isEmpty():  # else two sets share 64 of their 128 bits: hash anew
            break
    else:
        raise RuntimeError("sets that cannot be told apart by 128-bit hashes")
    # a shingle has about two signatures
    bits = max(6, int((summary.agg(F.sum("n")).first()[0] or 0) * 2 // SHARD).bit_length())
    hits = signed(docs, words, seed, like, shared_signatures(docs, words, seed, like, bits))
    hits = materialise(hits.distinct(), "hits")
    met = hits.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig")
    wanted = materialise(hits.join(met, "sig").select("h1").distinct().join(classes, "h1").select("h1", "rep"), "wanted")
    texts = matching(candidates(docs, wanted, wanted.count()), words, seed)
    texts = materialise(texts.groupBy("h1").agg(F.first("text").alias("text")), "texts")
    part = components(links(texts, words, seed, like, bits))
    named = part.join(classes.select(F.col("h1").alias("id"), "rep"), "id")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = named.join(least, "component").select(F.col("id").alias("h1"), "component_id")
    of = classes.join(linked, "h1", "left").select("h1", F.when(F.col("component_id").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("found"))
    out = summary.join(of, "h1", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("key")).alias("component_id"))
