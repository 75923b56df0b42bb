"""Loss values from logits held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import let, logsumexp


def next_token_loss(rows: DataFrame, key: str, pos: str, ids: str, logits: str, mask: str) -> DataFrame:
    """Per key: loss_sum and tokens of predicting each next id: logsumexp of a position's logits less
    the logit of the next position's id, where the next position is not masked."""
    w = Window.partitionBy(key).orderBy(pos)
    ahead = rows.withColumn("_id", F.lead(ids).over(w)).withColumn("_m", F.lead(mask).over(w)).filter("_id is not null")
    loss = logsumexp(F.col(logits)) - F.element_at(logits, F.col("_id").cast("int") + 1)
    return ahead.groupBy(key).agg(F.sum(loss * F.col("_m")).alias("loss_sum"), F.sum("_m").cast("long").alias("tokens"))


def mean_loss(loss_sum: Column, tokens: Column) -> Column:
    """A sum over its tokens, of which at least one is assumed."""
    return loss_sum / F.greatest(tokens.cast("double"), F.lit(1.0))


def kl_divergence(teacher: Column, student: Column, subset: list[int] | None = None) -> Column:
    """Divergence of softmax(student) from softmax(teacher), over all entries or a subset."""
    if subset is not None:
        pick = F.array(*map(F.lit, subset))
        part = lambda v: F.transform(pick, lambda i: F.element_at(v, i + 1))
        teacher, student = part(teacher), part(student)
    parts = lambda t, s: F.zip_with(teacher, student, lambda x, y: F.exp(x - t) * ((x - t) - (y - s)))
    total = lambda t, s: F.aggregate(parts(t, s), F.lit(0.0), lambda a, x: a + x)
    return let(logsumexp(teacher), lambda t: let(logsumexp(student), lambda s: total(t, s)))
