"""Numeric and vector expressions over columns of doubles and arrays of doubles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def finite(x: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two arrays scaled to length 1; 0 if one has length 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def logsumexp(a: Column) -> Column:
    """Log of the sum of exponentials, shifted by the largest."""
    return let(F.array_max(a).cast("double"), lambda top: top + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))))


def learning_rate(step: Column, base: float, least: float, warm_up: int, steps: int) -> Column:
    """Rate at a step counted from 1: a linear rise over `warm_up` steps, then half a cosine from
    `base` to `least` at the last step."""
    rise = F.lit(base) * step / F.lit(max(1, warm_up))
    part = F.least(F.greatest((step - warm_up) / F.lit(max(1, steps - warm_up)), F.lit(0.0)), F.lit(1.0))
    fall = F.lit(least) + F.lit(0.5 * (base - least)) * (1 + F.cos(F.lit(math.pi) * part))
    return F.when((step <= warm_up) & F.lit(warm_up > 0), rise).otherwise(fall)


def anneal_scale(done: Column, steps: int) -> Column:
    """Scale of a bias after `done` qualifying steps: half a cosine from 1 to 0 over `steps`."""
    if steps <= 1:
        return F.lit(0.0)
    return F.when(done >= steps - 1, 0.0).otherwise(0.5 * (1 + F.cos(F.lit(math.pi) * done / F.lit(steps - 1))))


def frozen_scale(frozen_rate: Column, rate: Column) -> Column:
    """Ratio of two rates, 0 if one is not over 0."""
    return F.when((frozen_rate > 0) & (rate > 0), frozen_rate / rate).otherwise(0.0)


def steps_needed(examples: Column, epochs: float, per_step: Column) -> Column:
    """Steps that show `examples` for some epochs: rounded up, 1 at least. No examples, or nothing shown
    a step, is an error when read."""
    sure = F.assert_true((examples >= 1) & (per_step > 0), F.lit("no examples, or a step shows none"))
    return F.when(sure.isNull(), F.greatest(F.lit(1), F.ceil(examples * F.lit(float(epochs)) / per_step)).cast("long"))


def gate(step: Column, every: int, weight: float, enabled: Column) -> Column:
    """Whether a loss is worked out at a step: it has a weight, its stream is enabled, its turn."""
    return F.lit(weight > 0) & enabled & (step % F.lit(every) == 0)


def top_k_weights(scores: Column, k: int) -> Column:
    """The k largest of softmax(scores) as (index, weight), weights rescaled to sum 1; ties go to
    the smaller index."""
    p = let(F.array_max(scores), lambda top: F.transform(scores, lambda x, i: F.struct((-F.exp(x - top)).alias("w"), i.alias("i"))))
    whole = lambda best: F.aggregate(best, F.lit(0.0), lambda s, x: s - x["w"])
    part = lambda best, n: F.transform(best, lambda x: F.struct(x["i"].alias("index"), (-x["w"] / n).alias("weight")))
    return let(F.slice(F.array_sort(p), 1, k), lambda best: let(whole(best), lambda n: part(best, n)))


def rms_norm(v: Column, eps: float = 1e-6) -> Column:
    """A vector over the root of its mean square."""
    return let(dot(v, v) / F.size(v), lambda mean: F.transform(v, lambda x: x / F.sqrt(mean + eps)))


def gibibytes(size: Column) -> Column:
    """Bytes in units of 2^30; null stays null."""
    return size.cast("double") / F.lit(float(1 << 30))


def headroom(most: Column, used: Column) -> Column:
    """What is left of a limit, 0 at least; null without a limit."""
    return F.when(most.isNotNull(), F.greatest(most - used, F.lit(0)))


def unit(v: Column) -> Column:
    """An array scaled to length 1; one of length 0 stays as it is."""
    return let(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))
