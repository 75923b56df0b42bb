"""Strings on which two orders of merge rules can differ, found from the rules, and seeded random ones.

Orders can differ only where two rules compete for a token: the right part of one is the left part of the
other (a critical pair), a part is doubled, or a result has two derivations. Each such place gives probes; all
are joins over the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def critical_pairs(rules: DataFrame, partners: int | None = None) -> DataFrame:
    """(tokenizer_id, idx, other_idx, text): rules (l, m) and (m, r) that compete for the token m, and the string l m r.
    partners: so many rules of each side that share m, the first by index (None: all)."""
    one = rules.select("tokenizer_id", "idx", F.col("left").alias("_l"), F.col("right").alias("_m"))
    two = rules.select("tokenizer_id", F.col("idx").alias("other_idx"), F.col("left").alias("_m"), F.col("right").alias("_r"))
    if partners is not None:
        first = lambda rows, place: rows.withColumn("_k", F.row_number().over(Window.partitionBy("tokenizer_id", "_m").orderBy(place))).filter(F.col("_k") <= partners).drop("_k")
        one, two = first(one, "idx"), first(two, "other_idx")
    return one.join(two, ["tokenizer_id", "_m"]).select("tokenizer_id", "idx", "other_idx", F.concat("_l", "_m", "_r").alias("text"))


def double_derivations(rules: DataFrame) -> DataFrame:
    """(tokenizer_id, idx, text): each rule whose result another rule makes too, with its result, and the result between
    its own parts, where each derivation can take its first token from the neighbour."""
    made = rules.groupBy("tokenizer_id", "merged").agg(F.count(F.lit(1)).alias("_ways")).filter("_ways > 1")
    own = rules.join(made, ["tokenizer_id", "merged"])
    texts = F.array("merged", F.concat("left", "merged"), F.concat("merged", "right"), F.concat("merged", "merged"))
    return own.select("tokenizer_id", "idx", F.explode(texts).alias("text"))


def probes(rules: DataFrame, longest: int | None = None, partners: int | None = None, repeats: int = 3) -> DataFrame:
    """(tokenizer_id, kind, idx, text): all probes, each text once a tokenizer, under its first kind and rule: `result` (every
    rule's result alone), `run` (a part that can meet itself, `repeats` times and once more), `pair`
    (`critical_pairs`, alone and after a space), `double` (`double_derivations`). longest: longer texts are left out."""
    row = lambda rows, kind, text: rows.select("tokenizer_id", F.lit(kind).alias("kind"), "idx", F.explode(text).alias("text"))
    run = F.array(*[F.repeat("left", F.lit(n)) for n in (repeats, repeats + 1)])
    pairs = critical_pairs(rules, partners)
    out = row(rules, "result", F.array("merged")).unionByName(row(rules.filter(F.col("left") == F.col("right")), "run", run))
    out = out.unionByName(row(pairs, "pair", F.array("text", F.concat(F.lit(" "), "text")))).unionByName(double_derivations(rules).select("tokenizer_id", F.lit("double").alias("kind"), "idx", "text"))
    if longest is not None:
        out = out.filter(F.length("text") <= longest)
    place = F.element_at(F.create_map(*[x for i, k in enumerate(("result", "run", "pair", "double")) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    first = out.groupBy("tokenizer_id", "text").agg(F.min(F.struct(place.alias("p"), "kind", "idx")).alias("_f"))
    return first.select("tokenizer_id", F.col("_f.kind").alias("kind"), F.col("_f.idx").alias("idx"), "text")


def random_probes(vocab: DataFrame, texts: int, most: int, seed: int) -> DataFrame:
    """(tokenizer_id, no, text): for each tokenizer of `vocab` (tokenizer_id, token) `texts` strings of 1 to `most` of its
    tokens. Each draw is a hash of seed, string and place, so the same seed gives the same strings, however
    tasks are cut."""
    numbered = vocab.select("tokenizer_id", "token").distinct()
    numbered = numbered.withColumn("_i", F.row_number().over(Window.partitionBy("tokenizer_id").orderBy("token")) - 1)
    sizes = numbered.groupBy("tokenizer_id").agg(F.count(F.lit(1)).alias("_n"))
    draw = lambda *x: F.xxhash64(F.lit(seed), *x)
    rows = sizes.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(texts - 1)))) if texts > 0 else sizes.withColumn("no", F.lit(0)).limit(0)
    rows = rows.withColumn("_at", F.explode(F.sequence(F.lit(1), 1 + F.pmod(draw("no"), F.lit(most)).cast("int"))))
    rows = rows.withColumn("_i", F.pmod(draw("no", "_at"), F.col("_n")).cast("int")).join(numbered, ["tokenizer_id", "_i"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_at", "token"))), lambda x: x["token"])
    return rows.groupBy("tokenizer_id", "no").agg(F.array_join(parts, "").alias("text"))
