"""Joins of many rows to one row a key, where a key may hold a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has at least this part of all rows; so at most HOT keys are.
HOT = 1000


def join_to_one(many: DataFrame, one: DataFrame, on: dict[str, str], rows: str, how: str = "inner") -> DataFrame:
    """`many` joined to `one`, whose keys are unique and which tells by `rows` (a column, dropped) how many rows of
    `many` each of its keys has. on: column of `many` to column of `one` (dropped); nulls meet nothing. how:
    inner or left.

    The rows of `one` with a thousandth of all or more are a thousand at most (of fixed width, so keep texts
    out of them): they go to all tasks, and rows of such keys are not shuffled. The others are joined by a shuffle,
    in which no key has more than a thousandth. `many` and `one` are read twice: write them first."""
    whole = one.agg(F.sum(rows)).first()[0] or 0
    is_hot = F.col(rows) * HOT >= whole
    keys = [F.col(k).alias(f"_one_{k}") for k in on.values()]
    rest = [c for c in one.columns if c not in on.values() and c != rows]
    hot = one.filter(is_hot).select(*keys, *rest, F.lit(True).alias("_hot"))
    cold = one.filter(~is_hot).select(*keys, *rest)
    same = reduce(lambda a, b: a & b, [F.col(m) == F.col(f"_one_{o}") for m, o in on.items()])
    held = many.join(F.broadcast(hot), same, "left").drop(*[f"_one_{k}" for k in on.values()])
    found = held.filter("_hot").drop("_hot")
    others = held.filter("_hot is null").drop("_hot", *rest).join(cold, same, how).drop(*[f"_one_{k}" for k in on.values()])
    return found.unionByName(others)
