"""Vectorised words of Arrow text columns: boundaries, 64-bit hashes, and an open-addressing index of hashes.

Texts are taken as UTF-8 bytes in chunks of 128 KB (a longer text is a chunk of its own), so memory
follows the longest text and not the batch. A word's hash sums one random 64-bit value per (place, byte); two
different words get equal hashes with a probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PLACES = 64
TABLE = np.random.PCG64(20240607).random_raw(PLACES * 256).astype(np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


class Alphabet(NamedTuple):
    """fold: byte to byte; word: whether a byte belongs to words."""

    fold: np.ndarray
    word: np.ndarray


def _alphabet(is_word, lower: bool) -> Alphabet:
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return Alphabet(fold, np.array([is_word(int(fold[b])) for b in range(256)]))


#: Words between ASCII white space.
SPACED = _alphabet(lambda b: b not in (32, 9, 10, 11, 12, 13), False)
SPACED_LOWER = _alphabet(lambda b: b not in (32, 9, 10, 11, 12, 13), True)
#: Runs of digits, letters a-z after lower-casing, and everything beyond ASCII.
LETTERS_LOWER = _alphabet(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128, True)


class Words(NamedTuple):
    data: np.ndarray  # folded bytes
    start: np.ndarray
    stop: np.ndarray
    doc: np.ndarray  # index of each word's text in the chunk
    off: np.ndarray  # of each text's words; one more than texts
    hash: np.ndarray


def chunks(column: pa.Array, limit: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD
    return h ^ (h >> np.uint64(29))


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of inside; a run ends with its text."""
    size = len(inside)
    cut = np.zeros(size + 1, bool)
    cut[off] = True
    lead = inside.copy()
    lead[1:] &= ~inside[:-1] | cut[1:size]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:] | cut[1:size]
    return np.flatnonzero(lead), np.flatnonzero(tail) + 1


def run_hashes(data: np.ndarray, inside: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    size = stop - start
    base = np.cumsum(size) - size
    place = np.arange(base[-1] + size[-1], dtype=np.int64) - np.repeat(base, size)
    value = TABLE[((place & (PLACES - 1)) << 8) | data[inside]]
    if size.max() > PLACES:
        value = value * (2 * (place // PLACES) + 1).astype(np.uint64)
    return mix(np.add.reduceat(value, base) + size.astype(np.uint64) * ODD)


def words(data: np.ndarray, off: np.ndarray, kind: Alphabet, hashes: bool = True) -> Words:
    folded, inside = kind.fold[data], kind.word[data]
    start, stop = runs(inside, off)
    doc = np.searchsorted(off, start, "right") - 1
    return Words(folded, start, stop, doc, np.searchsorted(start, off), run_hashes(folded, inside, start, stop) if hashes else np.zeros(0, np.uint64))


def combine(*hashes: np.ndarray) -> np.ndarray:
    """One hash for each tuple of hashes, in order."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h)
    return out


class HashIndex:
    """Place of each of some distinct uint64 keys, found for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, np.uint64)
        self.mask = (1 << max(4, (4 * max(1, len(keys))).bit_length())) - 1
        self.slot = np.full(self.mask + 1, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = (self.keys & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = left[self.slot[at[left]] < 0]
            self.slot[at[free]] = free
            left = left[self.slot[at[left]] != left]
            at[left] = (at[left] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index in keys, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int32)
        at = (h & np.uint64(self.mask)).astype(np.int64)
        out = self.slot[at]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != h))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            out[left] = self.slot[at[left]]
            left = left[(out[left] >= 0) & (self.keys[out[left]] != h[left])]
        return out
