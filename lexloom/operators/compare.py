"""Comparison of paired answers and of paired logits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import cosine, dot, unit
from ..functions.text import normalize

#: Similarity from which answers mean the same.
ALIKE = 0.92


def zip_answers(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Joins two answer tables on their key. An answer without its counterpart is an error when the
    result is read."""
    both = a.alias("a").join(b.withColumnRenamed(key, "_other"), F.col(f"a.{key}") == F.col("_other"), "full_outer")
    whole = F.assert_true(F.col(f"a.{key}").isNotNull() & F.col("_other").isNotNull(), F.lit("answers without a counterpart"))
    return both.filter(whole.isNull()).drop("_other")


def flags(pairs: DataFrame, threshold: float = ALIKE, judge_all: bool = False) -> DataFrame:
    """answer_a, answer_b, semantic_similarity to which are added match, normalized_match,
    semantic_match and is_candidate (put to a judge)."""
    out = pairs.withColumn("match", F.col("answer_a").eqNullSafe(F.col("answer_b")))
    out = out.withColumn("normalized_match", normalize(F.col("answer_a")).eqNullSafe(normalize(F.col("answer_b"))))
    out = out.withColumn("semantic_match", F.coalesce(F.col("semantic_similarity") >= threshold, F.lit(False)))
    return out.withColumn("is_candidate", F.lit(judge_all) | ~(F.col("match") | F.col("normalized_match") | F.col("semantic_match")))


def judged(flagged: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Adds judge_match (null where no candidate or no verdict), close_match and any_mismatch. A
    verdict of no never undoes another kind of match, but counts as a mismatch."""
    found = verdicts.select(F.col(key), F.col("verdict").alias("_verdict"))
    out = flagged.join(found, key, "left").withColumn("judge_match", F.when(F.col("is_candidate"), F.col("_verdict"))).drop("_verdict")
    sure = F.col("match") | F.col("normalized_match") | F.col("semantic_match")
    out = out.withColumn("close_match", sure | F.coalesce("judge_match", F.lit(False)))
    every = F.col("match") & F.col("normalized_match") & F.col("semantic_match")
    return out.withColumn("any_mismatch", ~every | F.coalesce(~F.col("judge_match"), F.lit(False)))


def summary(rows: DataFrame) -> DataFrame:
    """One row: counts of each kind of match, of verdicts, and the mean similarity (0 if no rows)."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(c).alias(f"{c}_count") for c in ("match", "normalized_match", "semantic_match", "close_match")],
        F.count_if("judge_match").alias("judge_match_count"),
        F.count("judge_match").alias("judged_count"),
        F.coalesce(F.avg("semantic_similarity"), F.lit(0.0)).alias("mean_similarity"),
    )


def logit_rows(logits: DataFrame, key: str, a: str = "a", b: str = "b", mask: str | None = None, atol: float = 1e-4, rtol: float = 1e-4) -> DataFrame:
    """Per key, over its unmasked positions and the vocabulary: token_count, largest, mean and root
    mean square difference, and whether all are close (|a-b| <= atol + rtol*|b|)."""
    rows = logits.filter(F.col(mask) != 0) if mask else logits
    gap = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    close = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")) <= atol + rtol * F.abs(y.cast("double"))), lambda x: x)
    each = rows.select(key, gap.alias("_d"), close.alias("_close"))
    each = each.select(key, F.array_max("_d").alias("_max"), F.aggregate("_d", F.lit(0.0), lambda s, x: s + x).alias("_sum"), dot(F.col("_d"), F.col("_d")).alias("_sq"), F.size("_d").alias("_n"), "_close")
    return each.groupBy(key).agg(
        F.count(F.lit(1)).alias("token_count"),
        F.max("_max").alias("max_diff"),
        (F.sum("_sum") / F.sum("_n")).alias("mean_diff"),
        F.sqrt(F.sum("_sq") / F.sum("_n")).alias("rms_diff"),
        F.bool_and("_close").alias("all_close"),
    )


def logit_summary(rows: DataFrame) -> DataFrame:
    """One row over all keys: total, all_close_count, global maximum and means (0 if no rows)."""
    zero = F.lit(0.0)
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("all_close").alias("all_close_count"), F.coalesce(F.max("max_diff"), zero).alias("max_diff"),
        F.coalesce(F.avg("max_diff"), zero).alias("mean_max_diff"), F.coalesce(F.avg("mean_diff"), zero).alias("mean_diff"), F.coalesce(F.avg("rms_diff"), zero).alias("mean_rms_diff"),
    )


def misaligned(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Positions that only one side has, or where the values differ; none if both are aligned."""
    left = a.select(*keys, F.col(value).alias("value_a"))
    right = b.select(*keys, F.col(value).alias("value_b"))
    return left.join(right, keys, "full_outer").filter(~F.col("value_a").eqNullSafe(F.col("value_b")))


def misaligned_lists(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, pos, value_a, value_b: the same for two lists of one row, place by place from 0. Nothing is
    shuffled, and only places that differ become rows. A null list counts as an empty one."""
    whole = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))
    both = F.transform(F.arrays_zip(whole(a).alias("a"), whole(b).alias("b")), lambda x, i: F.struct(i.alias("pos"), x["a"].alias("a"), x["b"].alias("b")))
    off = F.filter(both, lambda x: ~x["a"].eqNullSafe(x["b"]))
    found = rows.select(*keys, F.explode(off).alias("_x"))
    return found.select(*keys, F.col("_x.pos").alias("pos"), F.col("_x.a").alias("value_a"), F.col("_x.b").alias("value_b"))


def config_differences(a: DataFrame, b: DataFrame, shown: int = 8) -> DataFrame:
    """Two (key, value) tables to one row: how many keys differ, and the first of them by name."""
    off = misaligned(a, b, ["key"], "value")
    return off.agg(F.count(F.lit(1)).alias("n_different"), F.slice(F.array_sort(F.collect_list("key")), 1, shown).alias("first_keys"))


def masked_mean(states: DataFrame, by: list[str], values: str, mask: str, width: int) -> DataFrame:
    """Per text: the mean of its positions' vectors where the mask is 1 (a count of 0 counts as 1),
    scaled to length 1. width: entries of a vector. Sums are formed position by position before the
    shuffle."""
    own = [F.sum(F.element_at(values, i + 1).cast("double") * F.col(mask)).alias(f"_{i}") for i in range(width)]
    sums = states.groupBy(*by).agg(*own, F.greatest(F.sum(mask), F.lit(1)).alias("_n"))
    mean = F.transform(F.array(*[f"_{i}" for i in range(width)]), lambda x: x / F.col("_n"))
    return sums.select(*by, unit(mean).alias(values))


def pooled_similarity(a: DataFrame, b: DataFrame, key: str, values: str = "values") -> DataFrame:
    """(key, semantic_similarity) of two tables of pooled vectors."""
    other = b.select(F.col(key).alias("_key"), F.col(values).alias("_other"))
    return a.join(other, F.col(key) == F.col("_key")).select(key, cosine(F.col(values), F.col("_other")).alias("semantic_similarity"))


def aligned(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both tables joined on their keys; a position that only one has, or where the values differ, is an
    error when read (two models must have cut the prompts into the same tokens)."""
    left, right = a.withColumn("_a", F.lit(True)), b.select(*keys, F.col(value).alias("_value"), F.lit(True).alias("_b"))
    both = left.join(right, keys, "full_outer")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col(value).eqNullSafe(F.col("_value"))
    return both.filter(F.assert_true(same, F.lit("the token ids of both sides differ")).isNull()).drop("_a", "_b", "_value")


def vocabulary_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: tokens that only one of two vocabularies (token, id) has or that have another id, and
    whether the vocabularies are equal."""
    off = misaligned(a, b, ["token"], "id")
    return off.agg(F.count(F.lit(1)).alias("n_different"), (F.count(F.lit(1)) == 0).alias("equal"))


def scored(pairs: DataFrame, similarity: Callable[[Column, Column], Column], judge: Callable[[Column, Column], Column] | None, key: str, threshold: float = ALIKE, judge_all: bool = False) -> DataFrame:
    """Answers (key, answer_a, answer_b) compared by functions of two columns: a similarity, and a judge's
    verdict that is worked out for candidates only (None: no judge)."""
    found = flags(pairs.withColumn("semantic_similarity", similarity(F.col("answer_a"), F.col("answer_b"))), threshold, judge_all)
    asked = found.filter("is_candidate")
    verdict = judge(F.col("answer_a"), F.col("answer_b")) if judge else F.lit(None).cast("boolean")
    return judged(found, asked.select(key, verdict.alias("verdict")), key)
