"""Merge rules as a table: precedence edges, reduction, orders, deletion and synthesis.

`rules` has tokenizer_id, idx, left, right, merged. One tokenizer's rules are a bounded group (a
vocabulary); work over many tokenizers is spread by tokenizer_id."""

from __future__ import annotations

import heapq
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import space_priority

#: Names of the orders and what they sort by. The names are fixed values.
ORDERS = {
    "original": "the rules' own order",
    "good": "shorter results first, then by result, left and right part",
    "length_then_lexicographic": "the same as good",
    "lexicographic": "by result, then shorter first, then by left and right part",
    "length_descending": "longer results first, then by result, left and right part",
    "left_right": "by left part, right part, result",
    "whitespace_first": "results that begin with white space first, longer ones before, then by result and parts",
}


def edges(rules: DataFrame) -> DataFrame:
    """(tokenizer_id, src, dst): for each token, each rule that has it as a part and the next such
    rule. A rule with the same token on both sides counts once."""
    parts = rules.select("tokenizer_id", "idx", F.explode(F.array_distinct(F.array("left", "right"))).alias("token"))
    before = Window.partitionBy("tokenizer_id", "token").orderBy("idx")
    return parts.withColumn("src", F.lag("idx").over(before)).filter("src is not null").select("tokenizer_id", "src", F.col("idx").alias("dst")).distinct()


#: Rules whose reach one task follows.
REACH_BLOCK = 4096


def reduce_edges(links: DataFrame, block: int = REACH_BLOCK) -> DataFrame:
    """The edges without those that a longer path replaces: of a node's predecessors lo < hi, lo goes if it
    reaches hi.

    Which nodes reach a node is swept in index order, as the bits of one integer a node. The nodes that may
    be reached from are cut into blocks, each a group of its own: so a vocabulary is the work of as many tasks
    as it has blocks, and a task holds `block` bits a node however large the vocabulary is."""
    last = links.groupBy("tokenizer_id").agg(F.max("src").alias("_top"))
    blocks = last.select("tokenizer_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("_top") / block).cast("int"))).alias("_block"))
    # below a block nothing can be reached from it
    rows = links.join(blocks, "tokenizer_id").filter(F.col("dst") >= F.col("_block") * block)

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * block
        before: dict[int, list[int]] = {}
        for s, d in sorted(zip(group.src, group.dst, strict=True), key=lambda x: (x[1], x[0])):
            before.setdefault(int(d), []).append(int(s))
        reach: dict[int, int] = {}
        kept = []
        for d in sorted(before):
            above = 0
            for s in sorted(before[d], reverse=True):
                own = 1 << (s - first) if first <= s < first + block else 0
                if own and not above & own:
                    kept.append((s, d))
                above |= reach.get(s, 0) | own
            if above:
                reach[d] = above
        return pd.DataFrame({"tokenizer_id": key[0], "src": [s for s, _ in kept], "dst": [d for _, d in kept]})

    return rows.groupBy("tokenizer_id", "_block").applyInPandas(one, "tokenizer_id string, src int, dst int")


def order_keys(rules: DataFrame) -> DataFrame:
    """Each rule's place, from 0, in every named order taken alone (no precedence)."""
    n = F.length("merged")
    keys = {
        "original": [F.col("idx")],
        "good": [n, F.col("merged"), F.col("left"), F.col("right"), F.col("idx")],
        "length_then_lexicographic": [n, F.col("merged"), F.col("left"), F.col("right"), F.col("idx")],
        "lexicographic": [F.col("merged"), n, F.col("left"), F.col("right"), F.col("idx")],
        "length_descending": [-n, F.col("merged"), F.col("left"), F.col("right"), F.col("idx")],
        "left_right": [F.col("left"), F.col("right"), F.col("merged"), F.col("idx")],
        "whitespace_first": [space_priority(F.col("merged")), -n, F.col("merged"), F.col("left"), F.col("right"), F.col("idx")],
    }
    place = lambda key: (F.row_number().over(Window.partitionBy("tokenizer_id").orderBy(*key)) - 1).alias
    return rules.select("tokenizer_id", "idx", *[place(k)(f"place_{name}") for name, k in keys.items()])


def sort_key(order: str) -> Callable[[tuple], tuple]:
    """The key of a named order over (idx, left, right, merged)."""
    space = lambda m: 0 if m[:1] in ("\n", "\t", " ") else 1 if m[:1] == "▁" else 2
    keys: dict[str, Callable[[tuple], tuple]] = {
        "original": lambda r: (r[0],),
        "good": lambda r: (len(r[3]), r[3], r[1], r[2], r[0]),
        "length_then_lexicographic": lambda r: (len(r[3]), r[3], r[1], r[2], r[0]),
        "lexicographic": lambda r: (r[3], len(r[3]), r[1], r[2], r[0]),
        "length_descending": lambda r: (-len(r[3]), r[3], r[1], r[2], r[0]),
        "left_right": lambda r: (r[1], r[2], r[3], r[0]),
        "whitespace_first": lambda r: (space(r[3]), -len(r[3]), r[3], r[1], r[2], r[0]),
    }
    if order not in keys:
        raise ValueError(f"unknown order {order!r}; known are {', '.join(ORDERS)}")
    return keys[order]


def circle(waiting: set[int], after: dict[int, list[int]]) -> list[int]:
    """One circle among rules that all wait for each other: each waits for the one before it, the first one for the last."""
    before: dict[int, int] = {}
    for s in sorted(waiting, reverse=True):
        for d in after.get(s, []):
            if d in waiting:
                before[d] = s  # the smallest that it waits for
    seen: dict[int, int] = {}
    at = min(before)
    while at not in seen:  # back along what is waited for, until a rule comes again
        seen[at] = len(seen)
        at = before[at]
    return [x for x, i in seen.items() if i >= seen[at]][::-1]


def ordered(rules: DataFrame, links: DataFrame, order: str | Callable[[tuple], tuple] = "good", seed: int | None = None) -> DataFrame:
    """(tokenizer_id, place, idx): rules so that every edge points forward, the smallest key among
    the available rules first; with order `original` and a seed, a seeded random choice among
    them instead. order: a name, or a function from (idx, left, right, merged) to a key, ties to the
    smaller idx. A circle is an error that names its rules."""
    if seed is not None and order != "original":
        raise ValueError("a seed goes with the order `original` only")
    key = sort_key(order) if isinstance(order, str) else lambda r: (order(r), r[0])
    arrows = links.select(F.col("tokenizer_id").alias("_tokenizer"), F.col("src").alias("src"), F.col("dst").alias("dst"))

    def one(k: tuple, own: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        rows = {int(r.idx): (int(r.idx), r.left, r.right, r.merged) for r in own.itertuples()}
        waits = dict.fromkeys(rows, 0)
        after: dict[int, list[int]] = {}
        for s, d in sorted(zip(arcs.src, arcs.dst, strict=True)):
            after.setdefault(int(s), []).append(int(d))
            waits[int(d)] += 1
        out: list[int] = []
        free = [i for i in sorted(rows) if not waits[i]]
        pick = random.Random(seed) if seed is not None else None
        heap = [(key(rows[i]), i) for i in free]
        heapq.heapify(heap)
        while free if pick else heap:
            i = free.pop(pick.randrange(len(free))) if pick else heapq.heappop(heap)[1]
            out.append(i)
            for d in after.get(i, []):
                waits[d] -= 1
                if not waits[d]:
                    free.append(d) if pick else heapq.heappush(heap, (key(rows[d]), d))
        if len(out) < len(rows):
            names = [f"{rows[i][1]} {rows[i][2]} ({i})" for i in circle(set(rows) - set(out), after)]
            raise ValueError(f"merge rules of {k[0]} depend on each other in a circle: {' -> '.join(names)}")
        return pd.DataFrame({"tokenizer_id": k[0], "place": range(len(out)), "idx": out})

    return rules.groupBy("tokenizer_id").cogroup(arrows.groupBy("_tokenizer")).applyInPandas(one, "tokenizer_id string, place int, idx int")


def delete_cascade(rules: DataFrame, deleted: DataFrame) -> DataFrame:
    """(tokenizer_id, token): the given tokens and every token made from one of them, in rounds
    until none is new. A token goes even if another rule still makes it."""
    gone = deleted.select("tokenizer_id", "token").distinct().persist()
    made = rules.select("tokenizer_id", F.col("merged").alias("_to"), F.explode(F.array_distinct(F.array("left", "right"))).alias("token")).persist()
    fresh = gone
    while True:  # a round more than the longest chain of merges
        hit = made.join(fresh, ["tokenizer_id", "token"], "left_semi").select("tokenizer_id", F.col("_to").alias("token"))
        fresh = hit.distinct().join(gone, ["tokenizer_id", "token"], "left_anti").persist()
        if fresh.isEmpty():
            fresh.unpersist()
            made.unpersist()
            return gone
        more = gone.unionByName(fresh).persist()
        more.count()
        gone.unpersist()
        gone = more


def surviving(rules: DataFrame, gone: DataFrame, keep: bool = True) -> DataFrame:
    """The rules none of whose three tokens is gone; keep=False: the others."""
    hit = None
    for side in ("left", "right", "merged"):
        part = rules.join(gone.withColumnRenamed("token", side), ["tokenizer_id", side], "left_semi").select("tokenizer_id", "idx")
        hit = part if hit is None else hit.unionByName(part)
    return rules.join(hit.distinct(), ["tokenizer_id", "idx"], "left_anti" if keep else "left_semi")


def synthesize(token: str, available: set[str]) -> list[tuple[str, str]]:
    """The merges that build a token from tokens at hand: fewest merges (repeats counted), then the
    shortest left part, then by text; each pair once, parts before wholes."""
    n = len(token)
    if n < 2:
        if token in available:
            return []
        raise ValueError(f"{token!r} cannot be built from the tokens at hand")
    best: dict[tuple[int, int], tuple[int, tuple | None]] = {}
    for size in range(1, n + 1):
        for i in range(n - size + 1):
            j = i + size
            if token[i:j] in available and size < n:
                best[i, j] = (0, None)
                continue
            ways = [(best[i, k][0] + best[k, j][0] + 1, k - i, token[i:k], token[k:j]) for k in range(i + 1, j) if (i, k) in best and (k, j) in best]
            if ways:
                cost, cut, *_ = min(ways)
                best[i, j] = (cost, (i, i + cut, j))
    if (0, n) not in best:
        raise ValueError(f"{token!r} cannot be built from the tokens at hand")
    plan: list[tuple[str, str]] = []

    def build(i: int, j: int) -> None:
        cut = best[i, j][1]
        if cut:
            build(i, cut[1])
            build(cut[1], j)
            plan.append((token[i : cut[1]], token[cut[1] : j]))

    build(0, n)
    return list(dict.fromkeys(plan))


def ambiguous(rules: DataFrame, shown: int = 3) -> DataFrame:
    """Merged tokens with two or more parent pairs: how many, and the first of them by index."""
    pairs = rules.groupBy("tokenizer_id", "merged").agg(F.count(F.lit(1)).alias("n_pairs"), F.array_sort(F.collect_list(F.struct("idx", "left", "right"))).alias("_p"))
    first = F.transform(F.slice("_p", 1, shown), lambda p: F.concat_ws(" ", p["left"], p["right"]))
    return pairs.filter("n_pairs > 1").select("tokenizer_id", "merged", "n_pairs", F.array_join(first, ", ").alias("first_pairs"))


def chains(rules: DataFrame) -> DataFrame:
    """(tokenizer_id, idx, next_idx): for each rule the first other rule (by idx) whose left part is this
    one's right part."""
    one = rules.select("tokenizer_id", "idx", F.col("right").alias("_at"))
    two = rules.select("tokenizer_id", F.col("idx").alias("_next"), F.col("left").alias("_at"))
    # of the rules with one left part only the first two can be a first other rule
    two = two.withColumn("_k", F.row_number().over(Window.partitionBy("tokenizer_id", "_at").orderBy("_next"))).filter("_k <= 2")
    return one.join(two, ["tokenizer_id", "_at"]).filter("idx <> _next").groupBy("tokenizer_id", "idx").agg(F.min("_next").alias("next_idx"))
