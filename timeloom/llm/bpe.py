"""Byte-pair encoding and decoding with forced boundaries.

A pair of adjacent bytes that occurs inside no token of the vocabulary can
never be joined, so a cut between the two is certain: the text falls into
fragments that are encoded independently, and the ids of the fragments in a
row are the ids of the text.  Fragments repeat, so each distinct one is
encoded once per worker and looked up by hash after that, where its bytes must
be the same; texts never pass through a loop over their characters.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import slices, small_batches, spread, utf8
from .hashing import HashTable, equal_ranges, range_hashes

#: How byte-level and word-end vocabularies of this family split text before merging (fixed values).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = frozenset(b" \t\n\r\x0b\x0c")
#: Distinct fragments that a worker keeps, bytes of them (and of their ids), and the longest one that it keeps.
CACHE_FRAGMENTS, CACHE_BYTES, LONG_FRAGMENT = 400_000, 32 << 20, 256
#: Fragments up to this many bytes are merged together in one array.
SHORT = 48
#: UTF-8 lead byte of U+0240 and up, where classes and cases of characters differ between Unicode
#: versions; fragments with such characters go to the tokenizers library itself.
FIRST_RARE = 0xC9
NO_RANK = np.int32(2**31 - 1)
#: Ids in a row and the number of ids of each item.
Coded = tuple[np.ndarray, np.ndarray]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Vocabulary:
    """Tokens, merge ranks and special tokens of a tokenizer file.

    ``fragments`` encodes byte fragments by the merge ranks alone; how a text
    becomes fragments is up to :class:`ByteLevel` and :class:`WordEnd`.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        chars = byte_characters()
        to_byte = {c: b for b, c in enumerate(chars)}
        self.tokens: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            body = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
            if all(c in to_byte for c in body):
                self.tokens[i] = bytes(to_byte[c] for c in body)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.end] for c in chars], np.int64)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = rank, vocab[a + b]
        pairs = np.array([a << 32 | b for a, b in self.ranks], np.uint64) + np.uint64(1)
        self._scramble = np.uint64(0x9E3779B97F4A7C15)
        self._pairs = HashTable(19)
        self._pairs.add(pairs * self._scramble, np.arange(len(pairs)))
        self._new = np.array([new for _, new in self.ranks.values()], np.int64)
        #: The last entry stands for no pair.
        self._rank = np.array([*(rank for rank, _ in self.ranks.values()), NO_RANK], np.int32)
        #: inside[a, b]: some token holds byte a right before byte b.
        self.inside = np.zeros((256, 256), bool)
        for i, token in enumerate(self.tokens):
            if i not in self.special.values() and len(token) > 1:
                raw = np.frombuffer(token, np.uint8)
                self.inside[raw[:-1], raw[1:]] = True
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.token_starts, self.token_lengths = np.cumsum(lengths) - lengths, lengths

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a row of ids."""
        return self.token_bytes[spread(self.token_starts[ids], self.token_lengths[ids])]

    def fragments(self, parts: list[bytes], whole: np.ndarray) -> Coded:
        """Ids of all fragments in a row, and how many each has; ``whole[i]``: it ends its word."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(lengths > SHORT).tolist():
            ids = self._long(parts[i], bool(whole[i]))
            done.append((np.array([i]), np.array([len(ids)]), ids))
        size = np.where(lengths > SHORT, 0, (lengths + 1) // 2)
        for width in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == width)
            done += self._short([parts[i] for i in at.tolist()], whole[at], 2 * width, at)
        counts = np.zeros(len(parts), np.int64)
        for at, n, _ in done:
            counts[at] = n
        before = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for at, n, ids in done:
            out[spread(before[at], n)] = ids
        return out, counts

    def _start(self, part: bytes, whole: bool) -> np.ndarray:
        ids = self.first[np.frombuffer(part, np.uint8)]
        if whole:
            ids[-1] = self.last[part[-1]]
        return ids

    def _short(self, parts: list[bytes], whole: np.ndarray, width: int, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge many fragments at once: in each round every fragment joins its lowest-ranked pair."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        raw = np.zeros(len(parts) * width, np.uint8)
        raw[spread(np.arange(len(parts)) * width, lengths)] = np.frombuffer(b"".join(parts), np.uint8)
        raw = raw.reshape(-1, width)
        live = np.where(np.arange(width) < lengths[:, None], self.first[raw], -1).astype(np.int32)
        ends = np.flatnonzero(whole)
        live[ends, lengths[ends] - 1] = self.last[raw[ends, lengths[ends] - 1]]
        pair = self._find(live)
        done = []
        while len(at):
            rank = self._rank[pair]
            where = rank.argmin(1) if rank.shape[1] else np.zeros(len(at), np.int64)
            on = rank[np.arange(len(at)), where] < NO_RANK if rank.shape[1] else np.zeros(len(at), bool)
            if not on.all():
                rest = live[~on]
                done.append((at[~on], (rest >= 0).sum(1), rest[rest >= 0].astype(np.int64)))
                live, pair, at, where = live[on], pair[on], at[on], where[on]
                if not len(at):
                    break
            each = np.arange(len(at))
            new = self._new[pair[each, where]]
            # close the gap: what stands after the pair moves one place to the left
            later = np.arange(live.shape[1] - 1) > where[:, None]
            live[:, :-1] = np.where(later, live[:, 1:], live[:, :-1])
            live[:, -1] = -1
            live[each, where] = new
            later = later[:, :-1]
            pair[:, :-1] = np.where(later, pair[:, 1:], pair[:, :-1])
            pair[:, -1] = -1
            for shift in (-1, 0):
                i = where + shift
                fits = (i >= 0) & (i + 1 < live.shape[1])
                r, i = each[fits], i[fits]
                pair[r, i] = self._lookup(live[r, i], live[r, i + 1])
            if (live[:, -1] < 0).all():
                live, pair = live[:, :-1].copy(), pair[:, :-1].copy()
        return done

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = ((a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1)) * self._scramble
        return np.where(b >= 0, self._pairs.find(keys), -1).astype(np.int32)

    def _find(self, live: np.ndarray) -> np.ndarray:
        a, b = live[:, :-1], live[:, 1:]
        return self._lookup(a.ravel(), b.ravel()).reshape(a.shape)

    def _long(self, part: bytes, whole: bool) -> np.ndarray:
        """One fragment by a heap of its pairs, in n log n steps."""
        ids = self._start(part, whole).tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.ranks.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.ranks[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], np.int64)


def kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are ASCII white space, letters or digits, other printable ASCII."""
    b = np.arange(256)
    space = np.isin(b, list(SPACE))
    word = ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))
    return space, word, (b > 32) & (b < 127) & ~word


class Encoder:
    """Turns texts into ids: certain cuts, one lookup per fragment, ids in a row."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.table = HashTable(20)
        self._reset()
        space, word, sign = kinds()
        apostrophe = np.arange(256) == 39
        #: Pairs of bytes where a word of the splitting pattern surely ends ...
        ends = (~space[:, None] & space[None, :]) | (word[:, None] & sign[None, :]) | ((sign & ~apostrophe)[:, None] & word[None, :])
        #: ... and that stand in no token.
        self.cut = ends & ~self.vocabulary.inside
        self.space = space
        self.newline_cut = (np.arange(256) == 10)[:, None] & ~space[None, :] & ~self.vocabulary.inside
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names)).encode()) if names else None

    def _reset(self) -> None:
        self.table.clear(20)
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # the fragments' own bytes, with eight spare ones at the end
        self.raw, self.raw_used = np.zeros(1 << 20, np.uint8), 0
        self.raw_at, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def chunks(self, fragments: list[bytes]) -> Coded:
        raise NotImplementedError

    def prepare(self, data: np.ndarray) -> np.ndarray:
        return data

    def _remember(self, hashes: np.ndarray, fragments: list[bytes]) -> None:
        coded, counts = self.chunks(fragments)
        total = len(coded)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = coded
        whole = b"".join(fragments)
        while self.raw_used + len(whole) + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.raw[self.raw_used : self.raw_used + len(whole)] = np.frombuffer(whole, np.uint8)
        sizes = np.fromiter(map(len, fragments), np.int64, len(fragments))
        self.raw_at = np.concatenate([self.raw_at, self.raw_used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.raw_used += len(whole)
        self.table.add(hashes, np.arange(len(self.starts), len(self.starts) + len(counts)))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.used += total

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin; texts without special tokens."""
        n = len(data)
        texts = len(offsets) - 1
        if not n:
            return np.zeros(0, np.int32), np.zeros(texts + 1, np.int64)
        data = self.prepare(data)
        begins = np.zeros(n, bool)
        a, b = data[:-1], data[1:]
        begins[1:] = self.cut[a, b]
        lone = np.flatnonzero(a == 10)
        lone = lone[(lone == 0) | ~self.space[data[lone - 1]]]
        begins[lone + 1] |= self.newline_cut[data[lone], data[lone + 1]]
        first = offsets[:-1][np.diff(offsets) > 0]
        begins[first] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)
        hashes = range_hashes(data, starts, ends)
        size = ends - starts
        kept = size <= LONG_FRAGMENT  # longer ones seldom come again and would fill the table: each is encoded for itself
        slots = self.table.find(hashes)
        missing = np.flatnonzero((slots < 0) & kept)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            over = self.raw_used + int(size[at].sum()) > CACHE_BYTES or 4 * self.used > CACHE_BYTES
            if self.table.size and (over or self.table.size + len(new) > CACHE_FRAGMENTS):
                self._reset()
                every = np.flatnonzero(kept)
                new, at = np.unique(hashes[every], return_index=True)
                at = every[at]
            whole = data.tobytes()
            self._remember(new, [whole[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slots = self.table.find(hashes)
        alike = kept & (slots >= 0)
        counts, first, raw_at, pool = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), self.ids
        found = slots[alike]
        counts[alike], first[alike], raw_at[alike] = self.counts[found], self.starts[found], self.raw_at[found]
        alike[alike] = self.sizes[found] == size[alike]
        alike &= equal_ranges(np.concatenate([data, np.zeros(8, np.uint8)]), starts, self.raw, raw_at, np.where(alike, size, 0))
        odd = np.flatnonzero(~alike)
        if len(odd):  # long ones, and those whose hash another fragment has
            coded, n = self.chunks([data[i:j].tobytes() for i, j in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)])
            counts[odd], first[odd] = n, len(pool) + np.cumsum(n) - n
            pool = np.concatenate([pool, coded.astype(np.int32)])
        ids = pool[spread(first, counts)]
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, before[np.searchsorted(starts, offsets)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`plain`, for texts that may hold the strings of special tokens."""
        raw = data.tobytes()
        if self.special is None or not self.special.search(raw):
            return self.plain(data, offsets)
        # pieces: the ordinary stretches between special tokens, each a text of its own
        bounds, piece_of, fixed = [0], [], []
        for t in range(len(offsets) - 1):
            lo, hi = int(offsets[t]), int(offsets[t + 1])
            for m in self.special.finditer(raw, lo, hi):
                bounds += [m.start(), m.end()]
                piece_of += [t, t]
                fixed += [-1, self.vocabulary.special[m.group().decode()]]
            bounds.append(hi)
            piece_of.append(t)
            fixed.append(-1)
        kept = np.array(fixed) < 0
        lengths = np.diff(np.array(bounds))
        ordinary = np.concatenate([[0], np.cumsum(np.where(kept, lengths, 0))])
        ids, at = self.plain(data[np.repeat(kept, lengths)], np.append(ordinary[:-1][kept], ordinary[-1]))
        out, sizes, k = [], np.zeros(len(offsets) - 1, np.int64), 0
        for t, x in zip(piece_of, fixed, strict=True):
            if x < 0:
                part, k = ids[at[k] : at[k + 1]], k + 1
            else:
                part = np.array([x], np.int32)
            out.append(part)
            sizes[t] += len(part)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])


class ByteLevel(Encoder):
    """Byte-level vocabularies: every byte is a token, spaces lead words."""

    pattern = regex.compile(BYTE_LEVEL_PATTERN)

    def chunks(self, fragments: list[bytes]) -> Coded:
        words: list[bytes] = []
        owner: list[int] = []
        for i, f in enumerate(fragments):
            if f.isalpha() or (f[:1] == b" " and f[1:].isalpha()):
                words.append(f)
                owner.append(i)
            else:
                found = self.pattern.findall(f.decode())
                words += [w.encode() for w in found]
                owner += [i] * len(found)
        whole = b"".join(words)
        raw = np.frombuffer(whole, np.uint8)
        begins = np.concatenate([[True], ~self.vocabulary.inside[raw[:-1], raw[1:]]])
        word_at = np.cumsum([0, *map(len, words[:-1])])
        begins[word_at] = True
        starts = np.flatnonzero(begins)
        bounds = [*starts.tolist(), len(raw)]
        parts = [whole[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        owners = np.array(owner)[np.searchsorted(word_at, starts, side="right") - 1]
        return joined(self.vocabulary.fragments(parts, np.zeros(len(parts), bool)), owners, len(fragments))


class WordEnd(Encoder):
    """Lower-case vocabularies whose tokens mark the ends of words; white space is dropped."""

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    lower = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

    def __init__(self, path: str) -> None:
        super().__init__(path)
        space, word, sign = kinds()
        self.cut |= space[:, None] & ~space[None, :]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def prepare(self, data: np.ndarray) -> np.ndarray:
        return self.lower[data]

    def chunks(self, fragments: list[bytes]) -> Coded:
        parts: list[bytes] = []
        owner: list[int] = []
        rare: list[int] = []
        for i, f in enumerate(fragments):
            f = f.strip(b" \n")
            if f.isalpha():
                parts.append(f)
                owner.append(i)
            elif max(f, default=0) < FIRST_RARE:
                words = self.pattern.findall(unicodedata.normalize("NFC", f.decode()).lower())
                parts += [w.encode() for w in words]
                owner += [i] * len(words)
            else:
                rare.append(i)
        ids, counts = joined(self.vocabulary.fragments(parts, np.ones(len(parts), bool)), np.array(owner, np.int64), len(fragments))
        if not rare:
            return ids, counts
        own = [self.library.encode(fragments[i].decode(), add_special_tokens=False).ids for i in rare]
        kept = counts > 0
        counts[rare] = [len(x) for x in own]
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        out[spread(starts[kept], counts[kept])] = ids
        out[spread(starts[rare], counts[rare])] = [y for x in own for y in x]
        return out, counts


def joined(coded: Coded, owner: np.ndarray, n: int) -> Coded:
    """Put the parts of each owner in a row; owners ascend."""
    ids, counts = coded
    before = np.concatenate([[0], np.cumsum(counts)])
    first = np.searchsorted(owner, np.arange(n + 1))
    return ids, np.diff(before[first])


@lru_cache(maxsize=4)
def encoder(kind: str, path: str) -> Encoder:
    """One encoder per worker and file, so that its fragments serve later tasks."""
    return {"byte_level": ByteLevel, "word_end": WordEnd}[kind](path)


def per_text(df: DataFrame, key: str, text: str, kind: str, path: str, schema: str, make: Callable, prefix: str = "") -> DataFrame:
    """``make(encoder, keys, ids, at)`` for slices of texts; it returns a record batch of ``schema``."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(kind, path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets):
                base = offsets[lo]
                ids, at = coder.encode(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
                yield make(coder, batch.column(0).slice(lo, hi - lo), ids, at)

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", kind: str = "byte_level") -> DataFrame:
    """Token ids of each text: columns ``key`` and ``ids`` (array of int).

    A null text counts as empty and has no ids; repeated keys stay separate rows; other columns
    of ``df`` are ignored, whatever their names.  An empty table gives an empty table.
    """

    def make(coder: Encoder, keys: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([keys, lists], names=[key, "ids"])

    return per_text(df, key, text, kind, path, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>", make)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", kind: str = "byte_level") -> DataFrame:
    """Text of each row of ids: columns ``key`` and ``text``.

    Null or no ids give the empty text.  Bytes that are no UTF-8 become U+FFFD, as ids of any
    source need not come from a text.  Ids outside the vocabulary raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(kind, path).vocabulary
        for batch in batches:
            texts = [vocabulary.decode(np.array(x or [], np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    small_batches(df.sparkSession)
    return df.select(df[key].alias("key"), df[ids].alias("ids")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


def digits(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The decimal forms of 0 to n - 1, each after a comma."""
    forms = [b",%d" % i for i in range(n)]
    lengths = np.array([len(x) for x in forms], np.int64)
    return np.frombuffer(b"".join(forms), np.uint8), np.cumsum(lengths) - lengths, lengths


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each text's ids and of what they decode to.

    Columns ``key``, ``n_tokens`` (long), ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256`` (of the decoded text in UTF-8).  A null text counts as empty: no tokens, and
    the digests of the empty string.
    """
    forms: list = []

    def make(coder: Encoder, keys: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        if not forms:
            forms.extend(digits(coder.vocabulary.size))
        raw, starts, lengths = forms
        wide = ids.astype(np.int64)
        printed = raw[spread(starts[wide], lengths[wide])]
        printed_at = np.concatenate([[0], np.cumsum(lengths[wide])])[at]
        decoded = coder.vocabulary.decode(wide)
        decoded_at = np.concatenate([[0], np.cumsum(coder.vocabulary.token_lengths[wide])])[at]
        a = [hashlib.sha256(printed[min(i + 1, j) : j]).hexdigest() for i, j in zip(printed_at[:-1].tolist(), printed_at[1:].tolist(), strict=True)]
        b = []
        for i, j in zip(decoded_at[:-1].tolist(), decoded_at[1:].tolist(), strict=True):
            whole = decoded[i:j].tobytes()
            b.append(hashlib.sha256(whole.decode("utf-8", "replace").encode()).hexdigest())
        return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(at)), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return per_text(df, key, text, "byte_level", path, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
