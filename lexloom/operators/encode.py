"""Plain BPE encoding of a text column by a table of rules."""

from __future__ import annotations

import heapq
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches


def merge_word(text: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """Characters merged by the lowest rank among neighbours, all places of a pair from the left, until no pair has a
    rank. Parts are a linked list, pairs wait in a heap: a word of n characters takes n log n steps."""
    n = len(text)
    part: list[str | None] = list(text)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := rank.get((text[i], text[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        least, fresh = heap[0][0], []
        while heap and heap[0][0] == least:  # a pair's places at this moment; what arises meanwhile waits
            _, i = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or rank.get((part[i], part[j])) != least:
                continue
            part[i], part[j] = part[i] + part[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                fresh.append(i)
            if before[i] >= 0:
                fresh.append(before[i])
        for i in fresh:
            if part[i] is not None and after[i] < n and (r := rank.get((part[i], part[after[i]]))) is not None:
                heapq.heappush(heap, (r, i))
    return [p for p in part if p is not None]


def encode_words(words: DataFrame, word: str, ranks: dict[str, dict[tuple[str, str], int]]) -> DataFrame:
    """Adds the tokens of each word under each named table of ranks (one vocabulary's), in Arrow batches."""
    bound_batches(words.sparkSession)

    def one(rank: dict[tuple[str, str], int]) -> Column:
        def batch(values: pd.Series) -> pd.Series:
            return values.map(lambda w: merge_word(w, rank))

        return F.pandas_udf(batch, T.ArrayType(T.StringType()))(F.col(word))

    return words.withColumns({name: one(rank) for name, rank in ranks.items()})


class Known(dict):
    """word to its number of tokens under the ranks `a`, negative if `b` gives other tokens; worked out when first asked."""

    #: Words that a worker keeps, and the longest of them in characters.
    most, longest = 1_000_000, 256

    def __init__(self, a: dict[tuple[str, str], int], b: dict[tuple[str, str], int]):
        super().__init__()
        self.a, self.b = a, b

    def __missing__(self, word: str) -> int:
        one = merge_word(word, self.a)
        n = len(one) if one == merge_word(word, self.b) else -len(one)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=1)
def known(a: tuple, b: tuple) -> Known:
    """One worker's words under two tables of ranks."""
    return Known(dict(a), dict(b))


def same_encoding(docs: DataFrame, key: str, text: str, a: dict[tuple[str, str], int], b: dict[tuple[str, str], int]) -> DataFrame:
    """(key, n_tokens, same) of each key: its number of tokens under the ranks `a`, and whether `b` gives
    the same tokens. Words (split on white space) are looked up where the text is, and each different word is
    encoded once a worker; only the numbers are grouped by key. Null and blank texts have no token."""
    bound_batches(docs.sparkSession)
    ranks = tuple(a.items()), tuple(b.items())

    def batch(values: pd.Series) -> pd.DataFrame:
        of = known(*ranks).__getitem__
        found = [list(map(of, x.split())) if x else [] for x in values]
        return pd.DataFrame({"n": [sum(map(abs, x)) for x in found], "same": [min(x, default=1) > 0 for x in found]})

    coded = F.pandas_udf(batch, "n long, same boolean")(F.coalesce(F.col(text), F.lit("")))
    out = docs.select(F.col(key), coded.alias("_c")).groupBy(key)
    return out.agg(F.sum("_c.n").cast("int").alias("n_tokens"), F.bool_and("_c.same").alias("same"))
