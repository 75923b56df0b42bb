"""Training metrics: rollups of micro-batches, rolling means, limits, annealing, metric lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import anneal_scale, finite
from .ordinal import running_total, with_ordinal


def step_rollup(rows: DataFrame, values: list[str], accumulation: int, step: str = "step") -> DataFrame:
    """Per step: the sum of each value over its micro-batches by the number of micro-batches that a
    step takes, and the mix of streams as `{ind}ind/{ood}ood`."""
    mix = F.concat(F.count_if(F.col("stream") == "ind").cast("string"), F.lit("ind/"), F.count_if(F.col("stream") == "ood").cast("string"), F.lit("ood"))
    return rows.groupBy(step).agg(mix.alias("mix"), *[(F.sum(v) / F.lit(accumulation)).alias(v) for v in values])


def stream_rollup(rows: DataFrame, values: list[str], streams: tuple[str, ...] = ("ind", "ood"), step: str = "step") -> DataFrame:
    """Per step and stream: each value's mean over that stream's own micro-batches, null if none."""
    own = lambda v, s: F.avg(F.when(F.col("stream") == s, F.col(v)))
    return rows.groupBy(step).agg(*[F.count_if(F.col("stream") == s).alias(f"{s}_batches") for s in streams], *[own(v, s).alias(f"{s}_{v}") for s in streams for v in values])


def rolling_mean(rows: DataFrame, value: str, width: int, order: str, by: list[str], name: str, part: int = 1 << 14) -> DataFrame:
    """Adds the mean of the row's value and of those of the width - 1 rows before it in its series;
    nulls are skipped, null if all are. A series is cut into parts of `part` rows, each of which also
    gets the last width - 1 rows before it, so a long series is many tasks' work."""
    if width <= 1:
        return rows.withColumn(name, F.col(value))
    part = max(part, width)
    no = with_ordinal(rows, order, by, "_no").withColumn("_part", F.floor(F.col("_no") / part))
    ahead = F.when(F.col("_no") % part >= part - (width - 1), F.array("_part", F.col("_part") + 1)).otherwise(F.array("_part"))
    cut = no.withColumn("_in", F.explode(ahead))
    mean = F.avg(value).over(Window.partitionBy(*by, "_in").orderBy("_no").rowsBetween(1 - width, 0))
    return cut.withColumn(name, mean).filter(F.col("_in") == F.col("_part")).select(*rows.columns, name)


def quantiles(rows: DataFrame, value: str, by: list[str], at: dict[str, float]) -> DataFrame:
    """Per series: exact quantiles of a numeric value, linear between neighbours, as columns named by
    `at`; null values are left out. Values are counted, and running counts over ranges of values tell
    which hold the two places that a quantile lies between: no task sees a whole series, and values
    that repeat are one row."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    before = running_total(counts, "_v", by, F.col("_n"), "_before")
    whole = before.groupBy(*by).agg(F.sum("_n").alias("_all"))
    whole = whole.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_all")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    held = before.join(whole, same)
    low = lambda p: F.floor((F.col("_all") - 1) * F.lit(p))
    has = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_n"))
    ends = {f"_{side}{i}": F.when(has(k), F.col("_v")) for i, p in enumerate(at.values()) for side, k in (("a", low(p)), ("b", F.least(low(p) + 1, F.col("_all") - 1)))}
    found = held.withColumns(ends).groupBy(*by).agg(F.max("_all").alias("_all"), *[F.max(c).alias(c) for c in ends])
    part = lambda p: (F.col("_all") - 1) * F.lit(p) - low(p)
    return found.select(*by, *[((1 - part(p)) * F.col(f"_a{i}") + part(p) * F.col(f"_b{i}")).alias(name) for i, (name, p) in enumerate(at.items())])


def trimmed_limits(rows: DataFrame, value: str, by: list[str], trim: float = 0.05, low: float | None = None, high: float | None = None) -> DataFrame:
    """Per series: limits between the quantiles of half of `trim` at each end (linear between
    values), clamped, widened by 5 % (flat: by 5 % of the value, 1e-6 at least), clamped again;
    null where the lower is not below the upper."""
    tail = min(trim, 0.99) / 2
    clamp = lambda x: F.greatest(F.least(x, F.lit(high)), F.lit(low))  # noqa: E731  greatest and least skip nulls
    found = quantiles(rows.filter(finite(F.col(value))), value, by, {"a": tail, "b": 1 - tail})
    found = found.withColumn("a", clamp(F.col("a"))).withColumn("b", clamp(F.col("b")))
    gap = F.when(F.col("b") > F.col("a"), 0.05 * (F.col("b") - F.col("a"))).otherwise(F.greatest(0.05 * F.abs("a"), F.lit(1e-6)))
    found = found.withColumn("lo", clamp(F.col("a") - gap)).withColumn("hi", clamp(F.col("b") + gap))
    good = F.col("lo") < F.col("hi")
    return found.select(*by, F.when(good, F.col("lo")).alias("low"), F.when(good, F.col("hi")).alias("high"))


def anneal(rows: DataFrame, loss: str, steps: int, threshold: float, offset: int, order: str, by: list[str]) -> DataFrame:
    """Adds progress (qualifying steps so far, `steps` at most) and bias_scale (from the progress
    before the step). A step qualifies after the first `offset` rows if its loss is finite and not
    over the threshold."""
    w = Window.partitionBy(*by).orderBy(order)
    out = rows.withColumn("_no", F.row_number().over(w))
    fits = (F.col("_no") > offset) & finite(F.col(loss)) & (F.col(loss) <= threshold)
    out = out.withColumn("_fit", F.coalesce(fits, F.lit(False)).cast("int"))
    out = out.withColumn("progress", F.least(F.lit(steps), F.sum("_fit").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    before = F.least(F.lit(steps), F.coalesce(F.sum("_fit").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.withColumn("bias_scale", anneal_scale(before, steps)).drop("_no", "_fit")


def carry_last(rows: DataFrame, value: str, order: str, by: list[str], name: str) -> DataFrame:
    """Adds the latest non-null value up to the row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def last_finite(rows: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Per series, the last finite value by order."""
    return rows.filter(finite(F.col(value))).groupBy(*by).agg(F.max_by(value, order).alias(value))


def weighted_eval(rows: DataFrame, loss: str, weight: str, order: str, batch: int, most: int, by: list[str]) -> DataFrame:
    """Per series: the weighted mean loss over the first `most` batches (0: all)."""
    no = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / F.lit(batch))
    kept = rows.withColumn("_b", no).filter(F.col("_b") < most) if most else rows
    return kept.groupBy(*by).agg((F.sum(F.col(loss) * F.col(weight)) / F.sum(weight)).alias("eval_loss"), F.sum(weight).cast("long").alias("tokens"))


def metric_line(fields: dict[str, str]) -> Column:
    """`name=value` of each field that is not null, in order; formats as `%.4f`."""
    return F.concat_ws(" ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.format_string(f, F.col(c)))) for c, f in fields.items()])


def routing_averages(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means of router columns per stream, padding included: prob, unbiased, their gap, weight."""
    return rows.groupBy(*by).agg(
        F.avg("prob").alias("prob"), F.avg("unbiased").alias("unbiased"), (F.avg("prob") - F.avg("unbiased")).alias("bias_delta"), F.avg("weight").alias("weight")
    )


def route_loss(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per batch: for each router the mean of -ln(max(target probability, 1e-8)), summed over routers."""
    own = rows.groupBy(*by, "router").agg(F.avg(-F.log(F.greatest(F.col("target_prob"), F.lit(1e-8)))).alias("l"))
    return own.groupBy(*by).agg(F.sum("l").alias("route_loss"))


#: The metric line's fields in their order: name, format, and columns of which the first that is not
#: null is shown. Fixed values.
LINE = [
    ("step", "%d", ("step",)),
    ("mix", "%s", ("mix",)),
    ("loss", "%.4f", ("loss", "lm_loss")),
    ("lm", "%.4f", ("lm_loss",)),
    ("distill", "%.4f", ("distill_loss",)),
    ("route", "%.4f", ("route_loss",)),
    ("eval", "%.4f", ("eval_lm_loss", "latest_eval_lm_loss")),
    ("lr", "%.2e", ("learning_rate",)),
    ("grad", "%.3f", ("grad_norm",)),
]


def training_line(rows: DataFrame, fields: list[tuple[str, str, tuple[str, ...]]] | None = None) -> Column:
    """One record as a line: fields in fixed order, each from the first of its columns that is there and
    not null, numbers only if finite; columns that `rows` lacks count as null."""
    parts = []
    for name, form, columns in fields or LINE:
        held = [c for c in columns if c in rows.columns]
        if not held:
            continue
        value = F.coalesce(*held)
        sure = value.isNotNull() if form in ("%s", "%d") else finite(value)
        parts.append(F.when(sure, F.concat(F.lit(f"{name}="), F.format_string(form, value))))
    return F.concat_ws(" ", *parts)


def series(rows: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """(order, field, value): several fields as one long series without nulls; fields that `rows`
    lacks count as null."""
    held = [f for f in fields if f in rows.columns]
    if not held:
        return rows.select(*order, F.lit("").alias("field"), F.lit(0.0).alias("value")).limit(0)
    own = rows.select(*order, *[F.col(f).cast("double").alias(f) for f in held])
    return own.unpivot(order, held, "field", "value").filter("value is not null")


def groups_of_runs(rows: DataFrame, flag: str, order: str, by: list[str], name: str = "group") -> DataFrame:
    """Adds the number (from 0) of the run of flagged rows that a row is in, -1 where it is not flagged:
    a run starts at a flagged row after one that is not (or none)."""
    w = Window.partitionBy(*by).orderBy(order)
    on = F.coalesce(F.col(flag), F.lit(False))
    start = on & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    out = rows.withColumn("_start", start.cast("int"))
    run = F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return out.withColumn(name, F.when(on, run).otherwise(-1).cast("long")).drop("_start")
