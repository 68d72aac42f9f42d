"""Vectorised 64-bit hashes of byte ranges and an open-addressing hash table."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
FULL = np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: Ranges of more bytes are hashed one at a time, by xxhash.
LONG = 256


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of ``data[starts[i]:ends[i]]`` for all ranges; never 0.

    Blocks of eight bytes are mixed into a state one after the other, so the hash is not linear in the
    bytes; ranges of up to eight bytes of one length have one hash only if they are equal.  Equal bytes have equal hashes wherever
    they stand.  Other ranges may collide by chance, or under a known seed by design: where results rest on a match,
    bytes are compared or a second seed is asked.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    h = mix(size.astype(np.uint64) * MIX2 ^ mix(np.array([seed], np.uint64)))
    at, left, live = starts, np.where(size > LONG, 0, size), np.flatnonzero((size <= LONG) & (size > 0))
    at, left = at[live], left[live]
    while len(live):
        short = np.minimum(left, 8).astype(np.uint64)
        h[live] = mix(h[live] ^ (blocks[at] & (FULL >> (np.uint64(64) - np.uint64(8) * short))))
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = np.uint64(xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed & 0xFFFFFFFF))
    return np.where(h == 0, np.uint64(1), h)


def equal_ranges(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``a[a_at[i]:][:sizes[i]]`` equals ``b[b_at[i]:][:sizes[i]]``, for each i; both arrays end with eight spare bytes."""
    out = np.ones(len(sizes), bool)
    views = [np.ndarray((len(x) - 7,), "<u8", x, strides=(1,)) for x in (a, b)]
    live, p, q, left = np.flatnonzero(sizes > 0), a_at, b_at, sizes
    p, q, left = p[live], q[live], left[live]
    while len(live):
        mask = FULL >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64))
        same = ((views[0][p] ^ views[1][q]) & mask) == 0
        out[live[~same]] = False
        on = same & (left > 8)
        live, p, q, left = live[on], p[on] + 8, q[on] + 8, left[on] - 8
    return out


class HashTable:
    """Maps non-zero 64-bit keys to small integers with vectorised probes."""

    def __init__(self, bits: int = 16) -> None:
        self.clear(bits)

    def clear(self, bits: int | None = None) -> None:
        self.bits = bits or self.bits
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slots = np.zeros(1 << self.bits, np.int64)
        self.size = 0

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The integer of each key, -1 where there is none."""
        mask = (1 << self.bits) - 1
        at = self._at(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.slots[at], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & mask
            want = keys[left]
            there = self.keys[at]
            hit = there == want
            out[left[hit]] = self.slots[at[hit]]
            on = ~hit & (there != 0)
            left, at = left[on], at[on]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that the table lacks."""
        if 2 * (self.size + len(keys)) > 1 << self.bits:
            full = self.keys != 0
            old, was = self.keys[full], self.slots[full]
            while 2 * (len(old) + len(keys)) > 1 << self.bits:
                self.bits += 1
            self.clear()
            keys, values = np.concatenate([old, keys]), np.concatenate([was, values])
        mask = (1 << self.bits) - 1
        at = self._at(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.slots[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & mask
        self.size += len(keys)
