"""Words of whole texts as 64-bit hashes, many texts at once, in numpy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _bytes_table() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


@lru_cache(maxsize=8)
def factors(n: int, seed: int = 1) -> np.ndarray:
    """n odd numbers that look random."""
    return mixed((np.arange(n, dtype=np.uint64) + np.uint64(seed << 32)) * _ODD) | np.uint64(1)


@dataclass
class Words:
    """hashes: of all words in order; owner: the text of each; starts: of texts, one more than texts."""

    hashes: np.ndarray
    owner: np.ndarray
    starts: np.ndarray


def word_hashes(texts: list[str | None], lower: bool = False) -> Words:
    """Words are runs of bytes other than space and \\t to \\r; lower: with A-Z as a-z."""
    raw = [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in texts]
    joined = b"\n".join([*raw, b""])
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = np.flatnonzero(first)
    text_at = np.concatenate([[0], np.cumsum(sizes + 1)])
    starts = np.searchsorted(begin, text_at)
    owner = np.repeat(np.arange(len(raw)), np.diff(starts))
    if not len(begin):
        return Words(np.zeros(0, np.uint64), owner, starts)
    where = np.flatnonzero(inside)
    n = np.diff(np.append(np.searchsorted(where, begin), len(where)))
    within = where - np.repeat(begin, n)
    longest = int(n.max())
    powers = np.cumprod(np.full(longest, 0xD6E8FEB86659FD93, np.uint64))
    value = _bytes_table()[data[where]] * powers[within]
    return Words(mixed(np.add.reduceat(value, np.cumsum(n) - n) ^ n.astype(np.uint64)), owner, starts)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the different n-word shingles of each text, ordered by text and hash; a
    text with fewer words has its whole sequence as its one shingle."""
    h, owner = words.hashes, words.owner
    k = factors(n, 3)
    count = np.diff(words.starts)
    full = np.flatnonzero(owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :]) if len(owner) >= n else np.zeros(0, np.int64)
    s = np.zeros(len(full), np.uint64)
    for i in range(n):
        s += h[full + i] * k[i]
    short = np.flatnonzero((count > 0) & (count < n))
    few = np.array([(h[words.starts[i] : words.starts[i + 1]] * k[: count[i]]).sum(dtype=np.uint64) ^ np.uint64(count[i]) for i in short], np.uint64)
    s, of = mixed(np.concatenate([s, few])), np.concatenate([owner[full], short])
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    return s[new], of[new]
