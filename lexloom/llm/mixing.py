"""Mixes sources to target weights by fitting whole documents to each source's budget.

A source's documents are counted by exact length. Of its budget, full passes over all documents
come first; the rest is filled in proportion from every length, and what then remains by
bounded-knapsack dynamic programming over the counts that are left. Seeded hashes order the documents of
a length; those below a cut make up its count, so reruns agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cleaned, written

#: Parts into which the documents of one length are dealt before they are ranked.
PARTS = 1024
#: Most rows of a table of cuts that goes to all tasks.
MOST_CUTS = 200_000
#: Most words that dynamic programming fills (the default of fit_words).
FIT_WORDS = 1 << 16


def fill_budget(lengths: list[int], counts: list[int], budget: int, fit_words: int = FIT_WORDS) -> dict[int, int]:
    """How many documents of each length to take so that their sizes sum to the budget or as
    little below it as can be found. Lengths are over 0, each stands once.

    A share of every length in proportion comes first, then long documents until what remains is
    within half of fit_words, then bounded-knapsack dynamic programming over all lengths that fit.
    What remains short: nothing, if any choice of the documents left sums to the remainder; else as
    little as any choice does, where the remainder is at most fit_words. Above that (sources of a few
    very long documents) it is less than the shortest document left."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return dict(zip(lengths, counts, strict=True))
    take = {n: c * budget // total for n, c in zip(lengths, counts, strict=True)}
    left = {n: c - take[n] for n, c in zip(lengths, counts, strict=True)}
    rest = budget - sum(n * k for n, k in take.items())
    for n in sorted(lengths, reverse=True):  # long ones first, down to what the table covers
        k = min(left[n], max(0, rest - fit_words // 2) // n)
        take[n], left[n], rest = take[n] + k, left[n] - k, rest - k * n
    most = min(rest, fit_words)
    reached, via = np.zeros(most + 1, bool), np.full(most + 1, -1, np.int64)
    reached[0] = True
    steps: list[tuple[int, int]] = []
    for n in sorted(n for n in lengths if left[n] and n <= most):
        c, k = min(left[n], most // n), 1
        while c > 0 and not reached[most]:  # 1, 2, 4, ... copies at once
            k = min(k, c)
            new = reached[: most + 1 - n * k] & ~reached[n * k :]
            via[n * k :][new] = len(steps)  # the first step that reaches a sum
            reached[n * k :] |= new
            steps.append((n, k))
            c, k = c - k, 2 * k
    at = int(np.flatnonzero(reached)[-1])
    rest -= at
    while at:
        n, k = steps[via[at]]
        take[n], left[n], at = take[n] + k, left[n] - k, at - n * k
    for n in sorted(lengths, reverse=True):  # what the table could not hold
        k = min(left[n], rest // n)
        take[n], rest = take[n] + k, rest - k * n
    return take


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): sources by code point, null last,
    weigh `weights` in turn and share all sizes; a target stops at `most` times its source's size
    and the excess is shared anew by weight until none is above. One row a source."""

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches], ignore_index=True)
        if not len(rows):
            return
        named = sorted((i for i in rows.index if pd.notna(rows.source[i])), key=lambda i: rows.source[i])
        order = [*named, *(i for i in rows.index if pd.isna(rows.source[i]))]
        weight = {i: weights[k % len(weights)] for k, i in enumerate(order)}
        size = {i: float(rows.source_size[i]) for i in order}
        target, free, budget = {}, set(order), sum(size.values())
        while free:
            whole = sum(weight[i] for i in order if i in free)
            over = [i for i in order if i in free and budget * weight[i] / whole > most * size[i]]
            if not over:
                target |= {i: budget * weight[i] / whole for i in free}
                break
            for i in over:
                target[i] = most * size[i]
                free.discard(i)
            budget -= sum(target[i] for i in over)
        yield rows.assign(target=[max(0.0, target[i]) for i in rows.index])

    return sizes.coalesce(1).mapInPandas(share, "source string, source_size long, target double")


def marks(size: Column, source: Column, number: Column) -> dict[str, Column]:
    """Columns that mixing goes by: the source as text (_src is never null, so equal joins keep the null
    source), the size in words, a hash that orders documents of one length, and its part."""
    named = source.cast("string")
    return {
        "_source": named, "_src": F.coalesce(F.concat(F.lit("="), named), F.lit("")), "_size": F.coalesce(size, F.lit(0)).cast("long"),
        "_number": number, "_part": F.pmod(number, F.lit(PARTS)).cast("int"),
    }


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def mix_plan(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, fit_words: int = FIT_WORDS) -> tuple[DataFrame, DataFrame]:
    """(cuts, targets) of written rows with the columns of `marks` and `_row`, different in each.

    cuts has a row a source and length: of its documents, all are taken `passes` times, and once more those whose
    (part, number, row) is not above that of the cut. So a document's share follows from its own columns and a
    table that does not grow with the documents of a length; no document is moved. targets: _src, source_size,
    target."""
    lengths = written(rows.groupBy("_src", "_source", "_size", "_part").agg(F.count(F.lit(1)).alias("_n")), "mix-counts")
    by_source = lengths.groupBy(F.col("_source").alias("source")).agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"))
    targets = source_targets(by_source, weights, most).withColumn("_src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    targets = written(targets.drop("source"), "mix-targets")
    by_length = lengths.filter("_size > 0").groupBy("_src", "_size").agg(F.sum("_n").alias("_n")).join(targets, "_src")

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        budget, whole = int(round(float(group.target.iloc[0]))), int(group.source_size.iloc[0])
        passes = min(budget // whole, int(most))
        rest = budget - passes * whole if passes < most else 0
        take = fill_budget(group["_size"].tolist(), group["_n"].tolist(), rest, fit_words)
        return pd.DataFrame({"_src": group["_src"], "_size": group["_size"], "passes": passes, "extra": [take[n] for n in group["_size"]]})

    plans = written(by_length.groupBy("_src").applyInPandas(plan, "_src string, _size long, passes int, extra long"), "mix-plans")
    # the part in which the last document taken once more lies, and how many of that part go with it
    ahead = F.expr("coalesce(sum(_n) over (partition by _src, _size order by _part rows between unbounded preceding and 1 preceding), 0)")
    edge = lengths.withColumn("_ahead", ahead).join(plans, ["_src", "_size"]).filter("extra > _ahead and extra <= _ahead + _n")
    edge = written(edge.select("_src", "_size", "_part", (F.col("extra") - F.col("_ahead")).alias("_take")), "mix-edges")
    own = rows.select("_src", "_size", "_part", "_number", "_row").join(edge, ["_src", "_size", "_part"])
    rank = F.expr("row_number() over (partition by _src, _size, _part order by _number, _row)")
    last = own.withColumn("_rank", rank).filter("_rank = _take").select("_src", "_size", F.struct("_part", "_number", "_row").alias("_last"))
    return written(plans.select("_src", "_size", "passes").join(last, ["_src", "_size"], "left"), "mix-cuts"), targets


def repeated(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds `repeats` to rows with the columns of `marks` and `_row`. The cuts go to all tasks if they are at most
    MOST_CUTS, which is counted; else Spark joins as it sees fit."""
    cuts = F.broadcast(cuts) if cuts.count() <= MOST_CUTS else cuts
    once = F.coalesce(F.struct("_part", "_number", "_row") <= F.col("_last"), F.lit(False)).cast("int")
    out = rows.join(cuts, ["_src", "_size"], "left")
    return out.withColumn("repeats", F.coalesce(F.col("passes") + once, F.lit(0)).cast("long")).drop("passes", "_last")


@cleaned
def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    most: float = 3.0,
    seed: int = 7,
    fit_words: int = FIT_WORDS,
) -> DataFrame:
    """One row per document: key, size (words), source, source_size, target, repeats, taken.

    Null texts have size 0 and take nothing; null sources are one source, the last. Rows that
    repeat a key are documents of their own. No document repeats more than `most` times (rounded
    up where the rest of a budget picks it). A source's taken words miss its target by what
    `fill_budget` says of fit_words. Only sums by source, and counts by source, length and
    hash part, are shuffled; of the documents only small rows, and of these those at a cut."""
    number = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    rows = docs.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), *[c.alias(n) for n, c in marks(words_in(F.col(text)), F.col(source), number).items()])
    rows = written(rows, "mix-sizes")
    cuts, targets = mix_plan(rows, weights, most, fit_words)
    out = repeated(rows, cuts).join(targets, "_src")
    return out.select(F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_source").alias("source"), "source_size", "target", "repeats", (F.col("repeats") * F.col("_size")).alias("taken"))
