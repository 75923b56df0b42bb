"""What a training run would do, before it does: option checks, a recipe, a dry run."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as P
from ..operators import parameters as W


def check_options(options: dict[str, Any], ranges: dict[str, tuple[float | None, float | None]], exclusive: list[tuple[str, ...]] = ()) -> None:
    """Raises ValueError for an option outside its range (low, high; None: open; a missing or null option is
    not looked at) and where more than one of a group of options is set."""
    for name, (low, high) in ranges.items():
        x = options.get(name)
        if x is not None and (low is not None and x < low or high is not None and x > high):
            raise ValueError(f"{name} is {x}, not within {low} to {high}")
    for group in exclusive:
        if len(held := [name for name in group if options.get(name)]) > 1:
            raise ValueError(f"only one of {', '.join(held)} can be set")


def recipe(options: dict[str, Any], sources: dict[str, list[str]]) -> str:
    """A run's options and the files of each stream as JSON, keys by name."""
    return json.dumps({"options": options, "sources": {k: sorted(v) for k, v in sources.items()}}, ensure_ascii=False, sort_keys=True, default=str)


def dry_run(docs: DataFrame, stream: Column, shares: dict[str, float], steps: int, per_step: int, routed: DataFrame) -> DataFrame:
    """One row: examples of each stream, steps, numbers that are trained and that are not, optimizer groups
    (rate, weight_decay, number of tensors, numbers), as a training run over `docs` with the parameters of
    `operators.parameters.route` would have them."""
    examples = P.counts(docs, stream)
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda n, k: n * k)
    one = lambda df: df.withColumn("_one", F.lit(1))
    streams = examples.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stream", "examples")))).alias("examples"))
    numbers = routed.agg(F.coalesce(F.sum(F.when(F.col("rate") > 0, size)), F.lit(0)).alias("trained"), F.coalesce(F.sum(F.when(F.col("rate") <= 0, size)), F.lit(0)).alias("frozen"))
    groups = W.optimizer_groups(routed).select("rate", "weight_decay", F.size("names").alias("tensors"), "parameters")
    groups = groups.agg(F.array_sort(F.collect_list(F.struct("rate", "weight_decay", "tensors", "parameters"))).alias("groups"))
    out = one(streams)
    for part in (P.planned_steps(examples, shares, steps, per_step), numbers, groups):
        out = out.join(one(part), "_one")
    return out.drop("_one")
