"""Questions of truncation and budgets, answered from the steps that `token_prefixes` gives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokens_within(steps: Column, chars: Column) -> Column:
    """Tokens of a text's first `chars` characters (all of it, if it is shorter)."""

    def within(steps: pd.Series, chars: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or pd.isna(n) else int(np.frombuffer(s, "<i2")[: max(0, int(n))].sum(dtype=np.int64)) for s, n in zip(steps, chars, strict=True)], dtype="Int64")

    return F.pandas_udf(within, T.LongType())(steps, chars)


def longest_prefix(steps: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most `budget` tokens."""

    def one(s: bytes, n: int) -> int:
        fit = np.flatnonzero(np.cumsum(np.frombuffer(s, "<i2"), dtype=np.int64) <= n)
        return int(fit[-1]) + 1 if len(fit) and n >= 0 else 0

    def longest(steps: pd.Series, budget: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or pd.isna(n) else one(s, int(n)) for s, n in zip(steps, budget, strict=True)], dtype="Int64")

    return F.pandas_udf(longest, T.LongType())(steps, budget)
