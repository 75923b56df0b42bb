"""Named parameters of a model as a table (name, shape or values): what they are, who trains them, and
summaries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import dot

#: Parts of names that mark a router's and an expert's parameters. Fixed values.
ROUTER, EXPERT = ".router.", ".experts."


def is_router(name: Column) -> Column:
    return name.contains(ROUTER)


def is_expert(name: Column) -> Column:
    return name.contains(EXPERT)


def is_expert_pair(name: Column, shape: Column) -> Column:
    """Whether a parameter holds two experts along its first axis."""
    return is_expert(name) & (F.size(shape) >= 2) & (F.try_element_at(shape, F.lit(1)) == 2)


def route(parameters: DataFrame, rates: dict[str, float], masked: list[str], trained: tuple[str, ...] = (ROUTER, EXPERT), decay: float = 0.0) -> DataFrame:
    """Adds class, rate and weight_decay to (name, shape).

    Classes: `router`; `masked` for the names listed, of which only some rows are trained; `standard`
    for names with one of the parts in `trained`; `frozen` for all others. rates: the rate of each
    class (frozen: 0 unless given). Vectors and scalars have no decay."""
    name = F.col("name")
    own = F.lit(False)
    for x in trained:
        own = own | name.contains(x)
    kind = F.when(is_router(name), "router").when(name.isin(masked) if masked else F.lit(False), "masked").when(own, "standard").otherwise("frozen")
    rate = F.create_map(*[x for k in ("router", "masked", "standard", "frozen") for x in (F.lit(k), F.lit(float(rates.get(k, 0.0))))])
    out = parameters.withColumn("class", kind)
    return out.withColumn("rate", rate[F.col("class")]).withColumn("weight_decay", F.when(F.size("shape") >= 2, F.lit(float(decay))).otherwise(0.0))


def optimizer_groups(routed: DataFrame) -> DataFrame:
    """(rate, weight_decay, names, parameters): parameters that are trained alike, names in order, and
    how many numbers they hold; those with no rate are left out."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda n, k: n * k)
    groups = routed.filter("rate > 0").groupBy("rate", "weight_decay")
    return groups.agg(F.array_sort(F.collect_list("name")).alias("names"), F.sum(size).alias("parameters"))


def unique_parameters(parameters: DataFrame, storage: str = "storage") -> DataFrame:
    """One row: how many numbers the parameters hold, each storage (tied weights share one) once."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda n, k: n * k)
    each = parameters.groupBy(storage).agg(F.max(size).alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("parameters"))


def gradient_norm(gradients: DataFrame, by: list[str], values: str = "values") -> DataFrame:
    """Per group: the length of all gradients taken as one vector; null if there is none. A row
    without a gradient (null) counts for nothing."""
    return gradients.groupBy(*by).agg(F.sqrt(F.sum(dot(F.col(values), F.col(values)))).alias("grad_norm"))
