"""Words of many texts at once: stretches of bytes that are no ASCII blanks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import utf8

#: Space and U+0009 to U+000D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class Words:
    """``codes`` of all words, ``at`` their places by text (text i has those from ``at[i]`` to ``at[i + 1]``); equal words have equal codes.

    Word ``c`` is ``data[offsets[c]:offsets[c + 1]]``.
    """

    codes: np.ndarray
    at: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; ``lower`` turns A-Z into a-z.  Words are compared as bytes."""
    if lower:
        data = LOWER[data]
    solid = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    if len(data):
        before[1:] = ~solid[:-1]
        after[:-1] = ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    at = np.searchsorted(starts, offsets)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)), pa.py_buffer(data[solid])])
    coded = words.dictionary_encode()
    known, known_at = utf8(coded.dictionary)
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), at, known, known_at)
