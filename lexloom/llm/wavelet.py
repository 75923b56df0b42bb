"""Wavelet matrix over non-negative integers: one packed bit plane a level, most significant
first, with counts of ones before each 64-bit word. Rank, select, access and counting work on
numpy arrays of positions or values at once; `decode` gives back all values."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<4sIQ")
_MARK = b"WVM1"


class WaveletMatrix:
    """`bits` planes over `n` values."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.bits = len(planes)
        self._before: list[np.ndarray | None] = [None] * self.bits

    @classmethod
    def build(cls, values: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        """Splits the values stably by one bit after the other, highest first."""
        n = len(values)
        top = int(values.max()) if n else 0
        bits = max(1, top.bit_length()) if bits is None else bits
        now = values.astype(np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64)
        kind, planes, zeros = now.dtype.type, [], []
        for b in range(bits - 1, -1, -1):
            bit = (now & kind(1 << b)) != 0
            raw = np.zeros(((n + 63) // 64) * 8, np.uint8)
            raw[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            planes.append(raw.view("<u8"))
            low = now.compress(~bit)
            zeros.append(len(low))
            now = np.concatenate([low, now.compress(bit)]) if b else now
        return cls(n, planes, zeros)

    def before(self, level: int) -> np.ndarray:
        """Ones before each word of a plane."""
        if self._before[level] is None:
            self._before[level] = np.concatenate([[0], np.cumsum(np.bitwise_count(self.planes[level]), dtype=np.int64)])
        return self._before[level]

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before positions of a plane (0 to n)."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        plane = self.planes[level]
        held = plane[np.minimum(word, max(0, len(plane) - 1))] if len(plane) else np.zeros(len(at), np.uint64)
        return self.before(level)[word] + np.bitwise_count(held & ((np.uint64(1) << rest) - np.uint64(1)))

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at positions."""
        at, out = np.asarray(at, np.int64).copy(), np.zeros(len(at), np.int64)
        for level in range(self.bits):
            bit = (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            one = self.ones(level, at)
            out = out << 1 | bit.astype(np.int64)
            at = np.where(bit == 1, self.zeros[level] + one, at - one)
        return out

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values of a position range end up below the last plane, by value."""
        for level in range(self.bits):
            bit = (values >> (self.bits - 1 - level)) & 1
            s, e = self.ones(level, start), self.ones(level, end)
            start = np.where(bit == 1, self.zeros[level] + s, start - s)
            end = np.where(bit == 1, self.zeros[level] + e, end - e)
        return start, end

    def count(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each value stands in its position range."""
        values = np.asarray(values, np.int64)
        s, e = self.ranges(values, np.asarray(start, np.int64), np.asarray(end, np.int64))
        return np.where((values >> self.bits) == 0, e - s, 0)

    def rank(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value stands before its position."""
        return self.count(values, np.zeros(len(at), np.int64), at)

    def select(self, value: int, which: np.ndarray) -> np.ndarray:
        """The positions of a value's occurrences, counted from 0."""
        start, end = self.ranges(np.array([value]), np.array([0]), np.array([self.n]))
        which = np.asarray(which, np.int64)
        if value >> self.bits or ((which < 0) | (which >= end[0] - start[0])).any():
            raise IndexError("no such occurrence")
        at = start[0] + which
        for level in range(self.bits - 1, -1, -1):
            one = (value >> (self.bits - 1 - level)) & 1
            at = self._find(level, at - self.zeros[level] if one else at, one)
        return at

    def _find(self, level: int, which: np.ndarray, one: int) -> np.ndarray:
        """Positions of the bits `one` with the given numbers (from 0)."""
        before = self.before(level)
        if not one:
            before = np.arange(len(before), dtype=np.int64) * 64 - before
        word = np.searchsorted(before, which, side="right") - 1
        left, held = which - before[word], self.planes[level][word]
        held = held if one else ~held
        bits = np.unpackbits(held.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)

    def decode(self) -> np.ndarray:
        """All values in order."""
        kind = np.uint16 if self.bits <= 16 else np.uint32 if self.bits <= 32 else np.uint64
        now = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~bit)] = now[: self.zeros[level]]
            out[np.flatnonzero(bit)] = now[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            now = out
        return now

    def to_bytes(self) -> bytes:
        """Head (mark, planes, length), zeros of each plane, planes."""
        return b"".join([_HEAD.pack(_MARK, self.bits, self.n), np.array(self.zeros, "<u8").tobytes(), *(p.tobytes() for p in self.planes)])

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        mark, bits, n = _HEAD.unpack_from(raw)
        if mark != _MARK:
            raise ValueError("not a wavelet matrix")
        zeros = np.frombuffer(raw, "<u8", bits, _HEAD.size).astype(int).tolist()
        words, at = (n + 63) // 64, _HEAD.size + 8 * bits
        return cls(n, [np.frombuffer(raw, "<u8", words, at + 8 * words * i) for i in range(bits)], zeros)
