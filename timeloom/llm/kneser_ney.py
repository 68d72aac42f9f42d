"""Interpolated modified Kneser-Ney language model, counted by Spark and looked up in mapped files.

Words get numbers: their places in the sorted array of their hashes.  Tasks
count the n-grams of their texts and add up equal ones; what is left is dealt out by hash, and
each shard becomes a file of sorted hashes and counts.  From a shard's n-grams follow, once more
added up before they are dealt out, the contexts (how often, and followed by how many words once, twice, more often) and
the n-grams one shorter, which count the words seen before them.  So each order is made of the one above, down to single words.

All files lie in the shared folder; workers map them, and look up the sorted hashes of a slice of texts.  The probability of a word is

    p(w | c) = (n(c w) - D(n(c w))) / n(c) + (D1 N1(c) + D2 N2(c) + D3 N3+(c)) / n(c) * p(w | c without its first word)

where the discounts follow from how many n-grams were counted once to four times; p of no context ends in 1 / (V + 1), the share of
a word never seen.  A context never seen adds nothing: p is that of the shorter one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialise, slices, small_batches, spread, utf8
from .hash_store import Table, shard_of
from .hashing import mix, range_hashes
from .words import split

#: Bytes of text that are looked at together, n-grams that a task counts before it hands them on, and n-grams a shard (about).
SLICE, FOLD, SHARD = 4 << 20, 1 << 22, 1 << 21
#: Numbers of what is no word: the place before a text, and a word never seen.
BEFORE, UNSEEN = -1, -2
#: Kinds of rows between tasks: n-grams, contexts, and what the driver adds up.
GRAM, CONTEXT, SUMS = 0, 1, 2
#: Discounts where too few n-grams were counted to estimate them.
DISCOUNTS = (0.5, 1.0, 1.5)
#: Spark hands rows to Python in batches of so many.
ROWS = 1 << 16


class Clash(RuntimeError):
    """Two words or n-grams have one hash."""


def gram_keys(columns: tuple[np.ndarray, ...], seed: int) -> np.ndarray:
    """Hashes of n-grams, given as columns of word numbers."""
    out = mix(np.full(len(columns[0]), seed + 1, np.uint64)) if columns else np.zeros(0, np.uint64)
    for c in columns:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + (c + 3).astype(np.uint64))
    return out


def folded(columns: tuple[np.ndarray, ...], sums: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Equal rows of ``columns`` made one, with their ``sums`` added up."""
    if not columns or not len(columns[0]):
        return columns, sums
    pair = len(columns) == 2 and all(int(c.min()) >= UNSEEN and int(c.max()) < 2**31 - 4 for c in columns)
    # pairs in their own order, as rows that follow each other then compress well; others by a hash
    key = (columns[0] + 2) << 32 | (columns[1] + 2) if pair else gram_keys(columns, 0)
    order = np.argsort(key)
    differ = np.ones(len(order), bool)
    differ[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    begins = np.flatnonzero(differ)
    return tuple(c[order[begins]] for c in columns), tuple(np.add.reduceat(s[order], begins) for s in sums)


class Folder:
    """Rows that are added up whenever there are many; what then is left goes on."""

    def __init__(self, limit: int = FOLD) -> None:
        self.limit, self.parts, self.size = limit, [], 0

    def add(self, columns: tuple[np.ndarray, ...], sums: tuple[np.ndarray, ...]) -> Iterator[tuple]:
        columns, sums = folded(columns, sums)
        self.parts.append((columns, sums))
        self.size += len(columns[0])
        if self.size > self.limit:
            yield from self._fold(self.limit // 2)

    def _fold(self, most: int) -> Iterator[tuple]:
        if self.parts:
            columns, sums = (tuple(np.concatenate(x) for x in zip(*(p[i] for p in self.parts), strict=True)) for i in (0, 1))
            self.parts, self.size = [], 0
            columns, sums = folded(columns, sums)
            if len(columns[0]) > most:
                yield columns, sums
            elif len(columns[0]):
                self.parts, self.size = [(columns, sums)], len(columns[0])

    def rest(self) -> Iterator[tuple]:
        yield from self._fold(0)


def rows_out(kind: int, shards: np.ndarray, columns: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of ``part`` (shard and kind in one number), columns and values."""
    for lo in range(0, len(shards), ROWS):
        part = (shards[lo : lo + ROWS] * 3 + kind).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(x[lo : lo + ROWS].astype(np.int64)) for x in (*columns, *values))], names=names)


def gathered(batches: Iterator[pa.RecordBatch], n_columns: int) -> dict[int, list[tuple]]:
    """The rows of a partition by ``part``: columns and sums of each batch."""
    out: dict[int, list[tuple]] = {}
    for batch in batches:
        part, *rest = (c.to_numpy() for c in batch.columns)
        order = np.argsort(part, kind="stable")
        if not len(part):
            continue
        begins = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))
        for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(part)], strict=True):
            own = tuple(c[order[lo:hi]] for c in rest)
            out.setdefault(int(part[order[lo]]), []).append((own[:n_columns], own[n_columns:]))
    return out


def joined(parts: list[tuple]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    return folded(*(tuple(np.concatenate(x) for x in zip(*(p[i] for p in parts), strict=True)) for i in (0, 1)))


def sorted_by(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    return tuple(x[order] for x in (keys, *columns))


def schema_of(names: list[str]) -> str:
    return ", ".join(f"{n} {'int' if n == 'part' else 'bigint'}" for n in names)


@dataclass(frozen=True)
class Model:
    """What a fitted model's lookups need: its tables, and a few numbers of each order."""

    order: int
    seed: int
    words: Table
    #: Number of the first word of each shard.
    first: tuple[int, ...]
    grams: tuple[Table, ...] = ()
    contexts: tuple[Table, ...] = ()
    discounts: tuple[tuple[float, float, float], ...] = ()
    #: Of single words as n-grams: all counts, and words counted once, twice, more often.
    totals: tuple[int, int, int, int] = (0, 0, 0, 0)
    #: Tokens and distinct tokens that were learnt from.
    n_tokens: int = 0
    n_words: int = 0

    def numbers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (or UNSEEN) and count of each word ``data[offsets[i]:offsets[i + 1]]``."""
        keys, back = np.unique(range_hashes(data, offsets[:-1], offsets[1:], 2 * self.seed), return_inverse=True)
        there, place, (count,) = self.words.find(keys)
        ids = np.where(there, place + np.array(self.first, np.int64)[shard_of(keys, self.words.bits)], UNSEEN)
        return ids[back], count[back].astype(np.int64)

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and counts of all tokens, and where each text's begin."""
        codes, at, known, known_at = tokens_of(data, offsets)
        ids, counts = self.numbers(known, known_at)
        return ids[codes], counts[codes], at

    def log10(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token, given those before it in its text."""
        columns = grams_of(ids, at, self.order)
        p = np.full(len(ids), 1.0 / (self.n_words + 1))
        for k in range(1, self.order + 1):
            keys, back = np.unique(gram_keys(columns[self.order - k :], self.seed), return_inverse=True)
            n = self.grams[k - 1].find(keys)[2][0][back].astype(np.float64)
            if k == 1:
                total, *many = (np.full(len(ids), float(x)) for x in self.totals)
            else:
                keys, back = np.unique(gram_keys(columns[self.order - k : -1], self.seed), return_inverse=True)
                total, *many = (x[back].astype(np.float64) for x in self.contexts[k - 2].find(keys)[2])
            d = np.array([0.0, *self.discounts[k - 1]])
            rest = sum(d[i + 1] * many[i] for i in range(3))
            held = np.maximum(n - d[np.minimum(n, 3).astype(np.int64)], 0)
            p = np.where(total > 0, (held + rest * p) / np.maximum(total, 1), p)
        return np.log10(p)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens, where each text's begin, and bytes and offsets of the distinct ones; the last, empty one is the end of a text."""
    words = split(data, offsets, lower=True)
    n = len(words.offsets) - 1
    sizes = np.diff(words.at) + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.full(at[-1], n, np.int64)
    codes[spread(at[:-1], sizes - 1)] = words.codes
    return codes, at, words.data, np.concatenate([words.offsets, words.offsets[-1:]])


def grams_of(ids: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, ...]:
    """``order`` columns: of each token those before it, then itself."""
    depth = np.arange(len(ids)) - np.repeat(at[:-1], np.diff(at))
    out = []
    for back in range(order - 1, 0, -1):
        column = np.full(len(ids), BEFORE, np.int64)
        column[back:] = ids[: max(0, len(ids) - back)]
        column[depth < back] = BEFORE
        out.append(column)
    return (*out, ids)


def texts_in(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        for lo, hi in slices(offsets, SLICE):
            yield batch, lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def learn_words(texts: DataFrame, model: Model) -> Model:
    """The table of words and their counts."""
    names, bits, table, seed = ["part", "h", "g", "n"], model.words.bits, model.words, model.seed

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()

        def out(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for columns, sums in found:
                yield from rows_out(GRAM, shard_of(columns[0].view(np.uint64), bits), columns, sums, names)

        for *_, data, offsets in texts_in(batches, 0):
            codes, _, known, at = tokens_of(data, offsets)
            h, g = (range_hashes(known, at[:-1], at[1:], 2 * seed + i).view(np.int64) for i in (0, 1))
            yield from out(folder.add((h, g), (np.bincount(codes, minlength=len(h)),)))
        yield from out(folder.rest())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in gathered(batches, 2).items():
            (h, _), (n,) = joined(found)
            h, n = sorted_by(h.view(np.uint64), n)
            table.write(part // 3, h, (n,))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part // 3, len(h), int(n.sum()), int((h[1:] == h[:-1]).sum()))], names=["s", "words", "tokens", "clashes"])

    rows = texts.mapInArrow(count, schema_of(names)).repartition(1 << bits, "part")
    # a row for each shard, so they grow with the shards alone
    found = {r.s: r for r in rows.mapInArrow(write, "s bigint, words bigint, tokens bigint, clashes bigint").collect()}
    if any(r.clashes for r in found.values()):
        raise Clash
    sizes = [found[s].words if s in found else 0 for s in range(1 << bits)]
    first = np.cumsum([0, *sizes[:-1]]).tolist()
    return replace(model, first=tuple(first), n_tokens=sum(r.tokens for r in found.values()), n_words=sum(sizes))


def learn_grams(texts: DataFrame, model: Model) -> Model:
    """The tables of n-grams and contexts of all orders, from the highest down."""
    order, bits, seed = model.order, model.words.bits, model.seed
    values = ["a", "b", "c", "d"]
    names_of = lambda k, v: ["part", *(f"w{i}" for i in range(k)), *values[:v]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()

        def out(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for columns, sums in found:
                yield from rows_out(GRAM, shard_of(gram_keys(columns, seed), bits), columns, sums, names_of(order, 1))

        for *_, data, offsets in texts_in(batches, 0):
            ids, _, at = model.tokens(data, offsets)
            yield from out(folder.add(grams_of(ids, at, order), (np.ones(len(ids), np.int64),)))
        yield from out(folder.rest())

    rows = texts.mapInArrow(count, schema_of(names_of(order, 1))).repartition(1 << bits, "part")
    grams, contexts, discounts = [], [], []
    number = "u4" if model.n_tokens < 2**32 else "u8"
    for k in range(order, 0, -1):
        own = Table(f"{model.words.folder}-grams-{k}", bits, (number,))
        above = Table(f"{model.words.folder}-contexts-{k + 1}", bits, (number,) * 4)
        rows, often, totals = level(rows, k, own, above, seed, names_of(k - 1, 4))
        grams.insert(0, own)
        contexts.insert(0, above)
        discounts.insert(0, discounts_of(*often))
        rows = rows.repartition(1 << bits, "part")
    return replace(model, grams=tuple(grams), contexts=tuple(contexts[:-1]), discounts=tuple(discounts), totals=totals)


def level(rows: DataFrame, k: int, own: Table, above: Table, seed: int, out_names: list[str]) -> tuple[DataFrame, tuple[int, ...], tuple[int, ...]]:
    """Write the n-grams of ``k`` words, and the contexts of as many.

    Returns the rows that follow for ``k - 1`` words, how many n-grams were counted once to four times, and (of single words) the totals.
    """
    bits = own.bits

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders = {GRAM: Folder(), CONTEXT: Folder()}

        def out(kind: int, found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for columns, sums in found:
                shards = shard_of(gram_keys(columns, seed), bits) if k > 1 else np.zeros(len(sums[0]), np.int64)
                yield from rows_out(kind, shards, columns, (*sums, *[np.zeros(len(shards), np.int64)] * (4 - len(sums))), out_names)

        for part, found in gathered(batches, k).items():
            columns, sums = joined(found)
            shard, kind = divmod(part, 3)
            keys = gram_keys(columns, seed)
            if kind == CONTEXT:
                keys, *sums = sorted_by(keys, *sums)
                above.write(shard, keys, tuple(sums))
                clashes = int((keys[1:] == keys[:-1]).sum())
                yield from summed(clashes)
                continue
            n = sums[0]
            often = np.bincount(np.minimum(n, 5), minlength=6)
            sorted_keys, sorted_n = sorted_by(keys, n)
            own.write(shard, sorted_keys, (sorted_n,))
            yield from summed(int((sorted_keys[1:] == sorted_keys[:-1]).sum()), often)
            many = (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))
            if k == 1:
                yield from out(CONTEXT, [((), tuple(np.array([int(x.sum())]) for x in many))])
                continue
            yield from out(CONTEXT, folders[CONTEXT].add(columns[:-1], many))
            yield from out(GRAM, folders[GRAM].add(columns[1:], (np.ones(len(n), np.int64),)))
        for kind, folder in folders.items():
            yield from out(kind, folder.rest())

    def summed(clashes: int, often: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Rows for the driver: the first kind holds clashes, the second how many n-grams were counted once to four times."""
        none = (np.zeros(1, np.int64),) * (k - 1)
        for at, row in enumerate([[clashes, 0, 0, 0]] + ([] if often is None else [often[1:5].tolist()])):
            yield from rows_out(SUMS, np.array([at]), none, tuple(np.array([x]) for x in row), out_names)

    made = materialise(rows.mapInArrow(write, schema_of(out_names)), f"grams-{k}")
    sums = made.where((F.col("part") % 3 == SUMS) | F.lit(k == 1)).groupBy("part").agg(*(F.sum(c).alias(c) for c in "abcd")).collect()
    by = {r.part: tuple(int(r[c]) for c in "abcd") for r in sums}
    none = (0, 0, 0, 0)
    if by.get(SUMS, none)[0]:
        raise Clash
    return made.where(F.col("part") % 3 != SUMS), by.get(3 + SUMS, none), by.get(CONTEXT, none)


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of n-grams counted once, twice and more often, from how many were counted once to four times.

    An estimate that is no discount (none, or more than the count) gives way to a usual one, so every word keeps some probability.
    """
    if not (n1 and n2 and n3 and n4):
        return DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d <= i else usual for i, (d, usual) in enumerate(zip(found, DISCOUNTS, strict=True), 1))


def fit(df: DataFrame, text: str = "text", order: int = 2, folder: str | None = None) -> Model:
    """A model of ``order`` words of all rows of ``df``.

    Texts are lower-cased (A-Z); tokens are the words between ASCII blanks, and an end after each text.  A null text is an empty
    one, which still has its end.  Repeated rows count as often as they stand there; an empty table gives a model for which each
    token has probability 1.  ``folder`` (by default one in ``spark.checkpoint.dir``) is shared by all executors: files of a mounted one are mapped into memory, those of a store are read shard by shard.

    Words and n-grams are told apart by 64 bits; where two have the same, all is counted anew under another seed.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(df[text].alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(6, int(size // 6 // SHARD).bit_length())
    for seed in range(8):
        base = (folder or fresh_path(spark, "kneser-ney")) + f"/{seed}"
        try:
            return learn_grams(texts, learn_words(texts, Model(order, seed, Table(f"{base}-words", bits, ("u8",)), ())))
        except Clash:
            continue
    raise RuntimeError("words with equal hashes under every seed")


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``key``, those of ``carry``, ``n_tokens``, ``n_known`` (tokens that were learnt), ``base_score``, ``score`` and ``perplexity``.

    ``score`` is the model's log10 probability of the text, its end included; ``base_score`` that of single words with 0.1
    added to each count.  A null text counts as empty and has its end alone.  Rows that repeat a key, or have none, are
    scored each for itself; other columns are ignored; an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    names = [key, *carry, "n_tokens", "n_known", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offsets in texts_in(batches, 0):
            ids, counts, at = model.tokens(data, offsets)
            base = np.log10((counts + 0.1) / (model.n_tokens + 0.1 * (model.n_words + 1)))
            sums = [np.add.reduceat(x, at[:-1]) for x in ((counts > 0).astype(np.int64), base, model.log10(ids, at))]
            n = np.diff(at)
            arrays = [pa.array(x) for x in (n, *sums, 10.0 ** (-sums[2] / n))]
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[1:]), *arrays], names=names)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *carry))
    rows = df.select(df[text].alias("text"), *(df[c].alias(f"c{i}") for i, c in enumerate((key, *carry))))
    return rows.mapInArrow(run, f"{kinds}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")
