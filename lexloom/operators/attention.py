"""Which positions see each other, as runs of keys, and layers of experts as joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import with_ordinal

#: What is applied to the gate of an expert.
ACTIVATIONS = {
    "gelu_tanh": lambda x: 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3))),
    "silu": lambda x: x / (1 + np.exp(-x)),
}


def window_runs(positions: DataFrame, by: list[str], pos: str, left: int, right: int) -> DataFrame:
    """For each query position the run of keys that it sees in a sliding window: by, pos, first_key, last_key, n_keys.

    A key is seen less than `left` positions before the query (itself included, if left > 0) or less than `right`
    after it. Positions may have gaps, and are there once each. A query that sees nothing has no row. Positions
    are cut into bins as wide as the window reaches; a key goes to its own bin and its neighbours, so a task holds
    three bins of a sequence and no pair of positions is formed, however long a sequence is."""
    reach = max(left - 1, right - 1, 1)
    rows = positions.select(*by, F.col(pos).cast("long").alias("_k")).withColumn("_own", F.floor(F.col("_k") / reach))
    near = rows.withColumn("_bin", F.explode(F.array(F.col("_own") - 1, F.col("_own"), F.col("_own") + 1)))
    start, end = (1 if left < 1 else 1 - left), max(right - 1, 0 if left > 0 else -1)
    if start > end:
        return rows.limit(0).select(*by, F.col("_k").alias(pos), F.col("_k").alias("first_key"), F.col("_k").alias("last_key"), F.lit(0).cast("long").alias("n_keys"))
    seen = Window.partitionBy(*by, "_bin").orderBy("_k").rangeBetween(start, end)
    out = near.withColumns({"first_key": F.min("_k").over(seen), "last_key": F.max("_k").over(seen), "n_keys": F.count("_k").over(seen)})
    return out.filter((F.col("_bin") == F.col("_own")) & (F.col("n_keys") > 0)).select(*by, F.col("_k").alias(pos), "first_key", "last_key", "n_keys")


def group_runs(positions: DataFrame, by: list[str], pos: str, group: str) -> DataFrame:
    """For each query position the runs of keys of its own group: by, pos, first_key, last_key. Positions of a group below 0,
    or of none, see nothing. A group that is one run (as `groups_of_runs` numbers them) gives one row a query; one in
    several pieces one row a piece."""
    rows = positions.filter(F.col(group) >= 0).select(*by, F.col(group).alias("_g"), F.col(pos).cast("long").alias("_k"))
    placed = with_ordinal(rows, "_k", [*by, "_g"], "_o")
    runs = placed.groupBy(*by, "_g", (F.col("_k") - F.col("_o")).alias("_piece")).agg(F.min("_k").alias("first_key"), F.max("_k").alias("last_key"))
    return rows.join(runs.drop("_piece"), [*by, "_g"]).select(*by, F.col("_k").alias(pos), "first_key", "last_key")


def expert_blocks(gate_up: DataFrame, down: DataFrame, width: int, block: int) -> DataFrame:
    """(e, block, gate, up, down): the weights of each expert cut along its inner width, rows one after the other.

    gate_up: e, r, values: 2 * width rows an expert, gates first; down: e, r, values: a row an output entry, `width` values
    each. A block has the gates, ups and the part of each output row of `block` inner units."""
    both = gate_up.select("e", F.when(F.col("r") < width, "gate").otherwise("up").alias("k"), (F.col("r") % width).alias("i"), "values")
    flat = lambda rows: F.flatten(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["values"]))
    part = lambda k: flat(F.when(F.col("k") == k, F.struct("i", "values"))).alias(k)
    inner = both.groupBy("e", F.floor(F.col("i") / block).alias("block")).agg(part("gate"), part("up"))
    pieces = down.select("e", "r", F.explode(F.sequence(F.lit(0), F.lit((width - 1) // block))).alias("block"), "values")
    pieces = pieces.select("e", F.col("block").cast("long").alias("block"), "r", F.slice("values", F.col("block") * block + 1, F.lit(block)).alias("values"))
    return inner.join(pieces.groupBy("e", "block").agg(flat(F.struct("r", "values")).alias("down")), ["e", "block"])


def experts(tokens: DataFrame, routes: DataFrame, blocks: DataFrame, activation: str = "gelu_tanh", rows: int = 4096) -> DataFrame:
    """(t, values): for each token the sum over its experts of weight * down(act(gate x) * up x).

    tokens: t, values; routes: t, e, weight; blocks: `expert_blocks`. Pairs of token and expert meet that expert's blocks; an
    expert's tokens are dealt into groups of about `rows`, so a hot expert is many tasks' work, and a task
    holds one block of weights and that many tokens. What blocks and experts give is added up per token.
    Tokens without a route have no row. How many tokens each expert has (one row an expert) goes to all tasks."""
    act = ACTIVATIONS[activation]
    deals = routes.groupBy("e").agg(F.ceil(F.count(F.lit(1)) / rows).alias("_deals"))
    dealt = routes.join(F.broadcast(deals), "e").withColumn("_deal", F.pmod(F.xxhash64("t"), F.col("_deals")))
    parts = blocks.select("e", "block")
    pairs = dealt.join(tokens, "t").join(parts, "e").select(F.col("e").alias("_e"), F.col("block").alias("_b"), "_deal", "t", "weight", "values")
    weights = blocks.join(F.broadcast(deals), "e").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_deals") - 1))).drop("_deals")

    def work(key: tuple, own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(held):
            return pd.DataFrame({"t": [], "part": []})
        x = np.stack([np.asarray(v) for v in own["values"]])
        w = held.iloc[0]
        gate, up = (np.asarray(w[k]).reshape(-1, x.shape[1]) for k in ("gate", "up"))
        out = (act(x @ gate.T) * (x @ up.T)) @ np.asarray(w["down"]).reshape(-1, len(gate)).T
        return pd.DataFrame({"t": own["t"], "part": list(out * own["weight"].to_numpy()[:, None])})

    kind = tokens.schema["t"].dataType.simpleString()
    made = pairs.groupBy("_e", "_b", "_deal").cogroup(weights.groupBy("e", "block", "_salt")).applyInPandas(work, f"t {kind}, part array<double>")
    summed = F.reduce(F.slice("_p", 2, F.size("_p")), F.col("_p")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return made.groupBy("t").agg(F.collect_list("part").alias("_p")).select("t", summed.alias("values"))  # a part an expert and block


def rotary(values: Column, pos: Column, width: int, base: float = 10000.0) -> Column:
    """Rotary position: entry i of the first half and entry i of the second half, turned by pos / base^(2 i / width)."""
    half = width // 2
    angle = lambda i: pos / F.pow(F.lit(base), 2 * i / F.lit(float(width)))
    both = F.sequence(F.lit(0), F.lit(half - 1))
    at = lambda i: F.get(values, i.cast("int"))
    first = F.transform(both, lambda i: at(i) * F.cos(angle(i)) - at(i + half) * F.sin(angle(i)))
    second = F.transform(both, lambda i: at(i + half) * F.cos(angle(i)) + at(i) * F.sin(angle(i)))
    return F.concat(first, second)
