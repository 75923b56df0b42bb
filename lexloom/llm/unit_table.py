"""Values of many strings in a few numpy arrays: a table from a string's 128-bit hash to a run of numbers.

A dictionary of a million short strings takes hundreds of megabytes of Python objects; here an entry takes
28 bytes and its numbers, and a batch of strings is looked up at once."""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa

from .word_hashes import mixed

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: For each of the two hashes: a number for each byte, and the factor of a place. Fixed by their rule, to be the same everywhere.
_BYTES = [mixed(np.arange(1, 257, dtype=np.uint64) * _ODD + np.uint64(k)) for k in (0, 1 << 40)]
_FACTORS = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]


#: Bytes of strings that are hashed at once; a longer string is hashed by itself.
STEP, LONG = 1 << 19, 1 << 12


def name_hashes(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string of an Arrow array (without nulls)."""
    names = names.cast(pa.large_binary())
    first, second = np.zeros(len(names), np.uint64), np.zeros(len(names), np.uint64)
    if not len(names):
        return first, second
    ends = np.frombuffer(names.buffers()[1], np.int64, len(names) + 1, 8 * names.offset)
    raw = np.frombuffer(names.buffers()[2] or b"", np.uint8)
    n = np.diff(ends)
    powers = [np.cumprod(np.full(min(int(n.max()), LONG) + 1, f, np.uint64)) for f in _FACTORS]
    size = np.where(n <= LONG, n, 0)
    part = np.cumsum(size) // STEP
    for a, b in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)]):
        filled = a + np.flatnonzero(size[a:b])
        if len(filled):
            own = size[filled]
            at = np.cumsum(own) - own
            within = np.arange(int(own.sum())) - np.repeat(at, own)
            data = raw[within + np.repeat(ends[filled], own)]
            first[filled] = np.add.reduceat(_BYTES[0][data] * powers[0][within], at)
            second[filled] = np.add.reduceat(_BYTES[1][data] * powers[1][within], at)
    for i in np.flatnonzero(n > LONG):
        digest = hashlib.blake2b(raw[ends[i] : ends[i + 1]], digest_size=16).digest()
        first[i], second[i] = np.frombuffer(digest, "<u8")
    return mixed(first ^ n.astype(np.uint64)), mixed(second + n.astype(np.uint64) * _ODD)


class UnitTable:
    """first, second: the hashes, sorted by the first one; begin, size: where an entry's numbers are in `data`."""

    def __init__(self, item: str):
        self.first = self.second = np.zeros(0, np.uint64)
        self.begin, self.size, self.data = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, item)

    def __len__(self) -> int:
        return len(self.first)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The entry of each pair of hashes, -1 for none."""
        if not len(self):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.first, first), len(self) - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), at, -1)

    def add(self, first: np.ndarray, second: np.ndarray, size: np.ndarray, data: np.ndarray) -> None:
        """New entries (none is there yet), their numbers one after the other."""
        begin = len(self.data) + np.cumsum(size) - size
        self.data = np.concatenate([self.data, data])
        own = np.argsort(first)
        place = np.searchsorted(self.first, first[own])
        self.first, self.second = np.insert(self.first, place, first[own]), np.insert(self.second, place, second[own])
        self.begin, self.size = np.insert(self.begin, place, begin[own]), np.insert(self.size, place, size[own])

    def taken(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, numbers one after the other) of entries."""
        return self.size[at], self.data[runs(self.begin[at], self.size[at].astype(np.int64))]


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    ends = np.cumsum(size)
    whole = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(whole, int(begin.max(initial=0)) + whole) < 1 << 31 else np.int64
    at = np.repeat((begin - (ends - size)).astype(kind), size)
    at += np.arange(whole, dtype=kind)
    return at
