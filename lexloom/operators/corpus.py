"""Corpus counting, cyclic interleave, batches and padding."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import steps_needed
from ..functions.text import blank
from .ordinal import batch_number, with_ordinal


def ordered_dedupe(df: DataFrame, value: Column, order: str) -> DataFrame:
    """(value, first, copies): each different value with its first place, and how often it stands."""
    return df.groupBy(value.alias("value")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))


def counts(docs: DataFrame, stream: Column) -> DataFrame:
    """(stream, examples) of the rows with a text."""
    return docs.filter(F.col("text").isNotNull()).groupBy(stream.alias("stream")).agg(F.count(F.lit(1)).alias("examples"))


def resolve_steps(examples: DataFrame, shares: dict[str, float], epochs: float, per_step: int) -> DataFrame:
    """(stream, examples, steps): what each stream needs for its epochs, at its share of a step. A
    stream without a share is an error when read."""
    share = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))])
    own = F.coalesce(share[F.col("stream")], F.lit(0.0))
    sure = F.when(F.assert_true(own > 0, F.lit("a stream has examples but no share")).isNull(), own)
    return examples.select("stream", "examples", steps_needed(F.col("examples"), epochs, sure * per_step).alias("steps"))


def schedule(docs: DataFrame, key: str, stream: Column, cycle: dict[str, int], batch: int) -> DataFrame:
    """Adds stream, example_no (within the stream), batch_no and micro_batch: the place of the batch
    in the cycle, in which each stream has its number of turns, in the order of `cycle`. Rows of
    streams without a turn go."""
    own = docs.withColumn("stream", stream).filter(F.col("stream").isin(*[k for k, n in cycle.items() if n > 0]))
    out = with_ordinal(own, key, ["stream"], "example_no").withColumn("batch_no", batch_number(F.col("example_no"), batch))
    whole, at, place = sum(cycle.values()), 0, F.lit(None).cast("long")
    for name, n in cycle.items():
        if n > 0:
            turn = F.floor(F.col("batch_no") / n) * whole + at + F.col("batch_no") % n
            place = F.when(F.col("stream") == name, turn).otherwise(place)
        at += n
    return out.withColumn("micro_batch", place.cast("long"))


def pad(rows: DataFrame, ids: str, batch: list[str], fill: int = 0, most: int | None = None, left: bool = False, fixed: bool = False) -> DataFrame:
    """Cuts id arrays to `most` and fills them up to the longest of their batch, or (fixed) to `most`;
    adds `mask`."""
    if fixed and not most:
        raise ValueError("a fixed width needs `most`")
    cut = rows.withColumn(ids, F.slice(F.col(ids), 1, most)) if most else rows
    out = cut.withColumn("_n", F.size(ids))
    out = out.withColumn("_wide", F.lit(most)) if fixed else out.withColumn("_wide", F.max("_n").over(Window.partitionBy(*batch)))
    gap, ones, zeros = F.col("_wide") - F.col("_n"), F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), F.col("_wide") - F.col("_n"))
    filler = F.array_repeat(F.lit(fill).cast(rows.schema[ids].dataType.elementType), gap.cast("int"))
    both = F.concat(filler, ids) if left else F.concat(ids, filler)
    return out.withColumn("mask", F.concat(zeros, ones) if left else F.concat(ones, zeros)).withColumn(ids, both).drop("_n", "_wide")


def most_steps(steps: DataFrame) -> DataFrame:
    """One row of `resolve_steps`: the steps of the stream that needs most (null if there is none)."""
    return steps.agg(F.max("steps").alias("steps"))


def planned_steps(examples: DataFrame, shares: dict[str, float], steps: int, per_step: int) -> DataFrame:
    """One row (steps): a number over 0 as it is; a negative number -n means n epochs of the stream that
    needs most steps; 0 is an error."""
    if steps == 0:
        raise ValueError("the number of steps is 0")
    if steps > 0:
        return examples.sparkSession.createDataFrame([(steps,)], "steps long")
    return most_steps(resolve_steps(examples, shares, float(-steps), per_step))


def stream_share(docs: DataFrame, stream: Column) -> DataFrame:
    """(stream, share): each stream's part of all rows."""
    n = docs.groupBy(stream.alias("stream")).agg(F.count(F.lit(1)).alias("_n"))
    whole = F.sum("_n").over(Window.partitionBy(F.lit(1)))  # one row a stream
    return n.select("stream", (F.col("_n") / whole).alias("share"))


def path_orders(paths: list[str], epochs: int, seed: int) -> list[list[int]]:
    """For each epoch the order of the files' numbers: shuffled anew at the end of each pass."""
    pick = random.Random(seed)
    now, out = list(range(len(paths))), []
    for _ in range(epochs):
        pick.shuffle(now)
        out.append(now[:])
    return out


def cycle_examples(lines: DataFrame, epochs: int, orders: list[list[int]]) -> DataFrame:
    """Lines (path_no, line_no, text) of several files, for each epoch in that epoch's order of files:
    (epoch, path_ord, line_no, text, example_no), numbered from 0 over all epochs. Blank lines are
    passed over; a pass that holds no line is an error. orders: for each epoch the files' numbers."""
    if len(orders) < epochs:
        raise ValueError("each epoch needs an order of its files")
    kept = lines.filter(~blank(F.col("text")))
    sizes = {r["path_no"]: r["n"] for r in kept.groupBy("path_no").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a file
    if epochs and not any(sizes.values()):
        raise ValueError("a whole pass over the corpus holds no example")
    at, starts = 0, []
    for e in range(epochs):
        for i, p in enumerate(orders[e]):
            starts.append((e, p, i, at))
            at += sizes.get(p, 0)
    order = lines.sparkSession.createDataFrame(starts, "epoch int, path_no int, path_ord int, _start long")
    own = with_ordinal(kept, "line_no", ["path_no"], "_own")
    out = own.join(F.broadcast(order), "path_no")
    return out.select("epoch", "path_ord", "line_no", "text", (F.col("_start") + F.col("_own")).alias("example_no"))


def position(paths: list[str], seed: int, batch: int, done: int) -> dict:
    """What is saved of a corpus stream after `done` batches: the files, the seed, and the next example."""
    return {"paths": list(paths), "seed": seed, "batch": batch, "next_example": done * batch}


def resume(examples: DataFrame, saved: dict, paths: list[str], seed: int) -> DataFrame:
    """The examples from a saved position on. Other files or another seed than those saved are an error."""
    if saved["paths"] != list(paths) or saved["seed"] != seed:
        raise ValueError("the saved position is one of other files or of another order")
    return examples.filter(F.col("example_no") >= saved["next_example"])


def resume_schedule(saved: list[str], cycle: list[str], position_: int) -> tuple[int, bool]:
    """(place in the cycle, whether it was restored): a saved place of another cycle is not taken."""
    return (position_ % len(cycle), True) if saved == cycle else (0, False)
