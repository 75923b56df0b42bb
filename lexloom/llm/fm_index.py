"""FM-index over a sequence of symbols: Burrows-Wheeler transform in a wavelet matrix."""

from __future__ import annotations

import numpy as np

from .wavelet import WaveletMatrix


class FMIndex:
    """Backward search for many patterns at once. The order of suffixes is worked out to `depth`
    symbols, which is enough for patterns of that length at most. A 0 is put at the text's end;
    patterns hold no 0, so a text may use it to part its pieces. weights: how often each symbol's place
    counts (1), for a text that holds one copy of pieces that stand in several places."""

    def __init__(self, text: np.ndarray, depth: int = 64, weights: np.ndarray | None = None):
        weights = np.ones(len(text), np.int64) if weights is None else weights
        text = np.append(text, 0)
        self.n = len(text)
        top = int(text.max()) + 1 if self.n else 1
        order = np.zeros(self.n, np.int64)
        rank, reach = text.astype(np.int64), 1
        while True:
            ahead = np.zeros(self.n, np.int64)
            ahead[: self.n - reach] = rank[reach:] + 1
            key = rank * (int(ahead.max(initial=0)) + 1) + ahead
            order = np.argsort(key, kind="stable")
            held = key[order]
            new = np.ones(self.n, bool)
            new[1:] = held[1:] != held[:-1]
            rank = np.empty(self.n, np.int64)
            rank[order] = np.cumsum(new) - 1
            reach *= 2
            if reach >= depth or new.all():
                break
        self.before = np.concatenate([[0], np.cumsum(np.append(weights, 0)[order])])
        self.bits = max(1, (top - 1).bit_length())
        self.wave = WaveletMatrix.build(text[order - 1], self.bits)
        below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])
        symbols = np.arange(top)
        zero = np.zeros(top, np.int64)
        self.shift = below[:-1] - self.wave.ranges(symbols, zero, zero)[0]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of patterns with one more symbol in front."""
        low, high = self.wave.ranges(symbol, low, high)
        return low + self.shift[symbol], high + self.shift[symbol]

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How often the patterns of these intervals occur, by weight."""
        return self.before[high] - self.before[low]

    def twice(self, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which substrings text[start : start + length] occur twice or more: one walk each from its right
        end, which goes on while the interval holds two places."""
        out, rows = np.zeros(len(start), bool), np.arange(len(start))
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        at = start + length - 1
        while len(rows):
            low, high = self.extend(text[at], low, high)
            live = self.count(low, high) >= 2
            done = live & (at == start[rows])
            out[rows[done]] = True
            go = live & ~done
            rows, low, high, at = rows[go], low[go], high[go], at[go] - 1
        return out

    def repeated(self, text: np.ndarray, start: np.ndarray, length: int, head: int = 8) -> np.ndarray:
        """Which substrings text[start : start + length] occur twice or more in the index. Matching
        statistics cut at `length`: each search goes on from the right while two places match. The
        first `head` symbols go first, since they alone rule out many."""
        good = np.arange(len(start))
        for size in (min(head, length), length):
            rows = good
            low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
            for k in range(size - 1, -1, -1):
                low, high = self.extend(text[start[rows] + k], low, high)
                live = self.count(low, high) >= 2
                if not live.all():
                    rows, low, high = rows[live], low[live], high[live]
                if not len(rows):
                    break
            good = rows
        out = np.zeros(len(start), bool)
        out[good] = True
        return out
