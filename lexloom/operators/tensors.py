"""Weight matrices as tables: (name, r, values), one row of the matrix per row of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import with_ordinal


def zeros(n: int | Column) -> Column:
    return F.array_repeat(F.lit(0.0), n if isinstance(n, int) else n.cast("int"))


def reindex_rows(rows: DataFrame, mapping: DataFrame, size: int, width: int) -> DataFrame:
    """Rows moved from old to new number by `mapping` (old_id, new_id), `size` of them; numbers that
    nothing maps to hold zeros."""
    target = rows.sparkSession.range(size).select(F.col("id").alias("r"))
    moved = rows.join(mapping, rows.r == mapping.old_id).select(F.col("new_id").alias("r"), F.transform("values", lambda x: x.cast("double")).alias("values"))
    return target.join(moved, "r", "left").select("r", F.coalesce("values", zeros(width)).alias("values"))


def permute_columns(values: Column, order: list[int]) -> Column:
    """Entries of an array in another order."""
    return F.transform(F.array(*map(F.lit, order)), lambda i: F.element_at(values, i + 1))


def mean_rows(rows: DataFrame, by: list[str], values: str = "values", width: int = 64) -> DataFrame:
    """Per value of `by`: the mean of the rows' arrays, position by position. Arrays are cut into pieces
    of `width` positions and pieces are summed column by column before the shuffle, so what is
    shuffled is one piece per group and task, not one row per cell."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / F.lit(width)).cast("int") - 1, F.lit(0)))
    pieces = rows.select(*by, F.explode(starts).alias("_piece"), F.col(values).alias("_v"))
    pieces = pieces.select(*by, "_piece", F.slice("_v", F.col("_piece") * width + 1, width).alias("_v"))
    sums = pieces.groupBy(*by, "_piece").agg(*[F.avg(F.try_element_at("_v", F.lit(i + 1)).cast("double")).alias(f"_{i}") for i in range(width)], F.max(F.size("_v")).alias("_size"))
    sums = sums.select(*by, "_piece", F.slice(F.array(*[f"_{i}" for i in range(width)]), F.lit(1), F.col("_size")).alias("_v"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_piece", "_v"))), lambda x: x["_v"]))
    return sums.groupBy(*by).agg(whole.alias(values))


def added_rows(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(new_id, old_id) to (r, values): each new row is the mean of its old rows; an old row that is
    listed twice counts twice."""
    each = sources.select("new_id", "old_id").join(rows, F.col("old_id") == F.col("r"))
    return mean_rows(each.select("new_id", "values"), ["new_id"]).withColumnRenamed("new_id", "r").select("r", "values")


def pad_and_stack(rows: DataFrame, width: int, size: int, experts: int, copy: bool = True) -> DataFrame:
    """(e, r, values): a matrix filled with zeros up to `size` rows of `width`, for each expert (the
    same for all, or zeros with copy=False)."""
    full = rows.select("r", F.concat(F.transform("values", lambda x: x.cast("double")), zeros(F.greatest(F.lit(width) - F.size("values"), F.lit(0)))).alias("values"))
    all_rows = rows.sparkSession.range(size).select(F.col("id").alias("r")).join(full, "r", "left").select("r", F.coalesce("values", zeros(width)).alias("values"))
    out = all_rows.select(F.explode(F.sequence(F.lit(0), F.lit(experts - 1))).alias("e"), "r", "values")
    return out if copy else out.withColumn("values", F.transform("values", lambda x: F.lit(0.0)))


def expert_gap(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(…, e, r, values) with e 0 or 1: mean absolute and mean squared difference of the experts'
    entries, pooled over all rows."""
    one = pairs.filter("e = 0").select(*by, "r", F.col("values").alias("v0"))
    two = pairs.filter("e = 1").select(*by, "r", F.col("values").alias("v1"))
    d = one.join(two, [*by, "r"]).select(*by, F.zip_with("v0", "v1", lambda x, y: x.cast("double") - y.cast("double")).alias("d"))
    total = lambda f: F.sum(F.aggregate("d", F.lit(0.0), lambda s, x: s + f(x))) / F.sum(F.size("d"))
    return d.groupBy(*by).agg(total(F.abs).alias("mean_abs"), total(lambda x: x * x).alias("mean_sq"), F.sum(F.size("d")).cast("long").alias("entries"))


def rename(tensors: DataFrame, pattern: str, to: str, drop: str | None = None) -> DataFrame:
    """Names rewritten by a pattern; tensors whose name fits `drop` go."""
    kept = tensors.filter(~F.col("name").rlike(drop)) if drop else tensors
    return kept.withColumn("name", F.regexp_replace("name", pattern, to))


def row_mask(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds mask: 1 where the row's number is among `ids` (id), else 0."""
    return rows.join(ids.select(F.col("id").alias("r"), F.lit(1).alias("mask")).distinct(), "r", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def masked_gradient(gradient: Column, mask: Column, scale: float) -> Column:
    """Gradient rows: whole where the mask is 1, scaled elsewhere."""
    return F.transform(gradient, lambda g: g * (mask + (1 - mask) * F.lit(scale)))


def reindex_axis(shape: list[int], largest: int) -> int:
    """Which axis of a matrix the old numbers go along: of the first and the last, the only one that is
    longer than the largest number; both or neither is an error. A vector has one axis."""
    if not shape:
        raise ValueError("a scalar has no axis")
    fits = [i for i in sorted({0, len(shape) - 1}) if shape[i] > largest]
    if len(fits) != 1:
        raise ValueError(f"{'both axes' if fits else 'no axis'} of {shape} can hold number {largest}")
    return fits[0]


def check_permutation(mapping: DataFrame, size: int) -> DataFrame:
    """mapping (old_id, new_id), of which a repeated number, one outside the rows, or a gap among the new
    numbers 0 to n - 1 is an error when read. The check is one row joined to all."""
    one = mapping.agg(
        F.lit(1).alias("_one"), F.count(F.lit(1)).alias("_n"), F.count_distinct("old_id").alias("_old"), F.count_distinct("new_id").alias("_new"),
        F.min("old_id").alias("_low"), F.max("old_id").alias("_high"), F.min("new_id").alias("_first"), F.max("new_id").alias("_last"),
    )
    good = (F.col("_n") == 0) | (
        (F.col("_n") == F.col("_old")) & (F.col("_n") == F.col("_new")) & (F.col("_low") >= 0) & (F.col("_high") < size) & (F.col("_first") == 0) & (F.col("_last") == F.col("_n") - 1)
    )
    sure = F.assert_true(good, F.lit("the mapping is no permutation of the first rows"))
    return mapping.withColumn("_one", F.lit(1)).join(one, "_one").filter(sure.isNull()).select("old_id", "new_id")


def permute_rows(rows: DataFrame, mapping: DataFrame, keep_rest: bool = True) -> DataFrame:
    """(r, values) in a new order without a size: mapped rows at their new numbers, then (keep_rest) all
    others in their old order. The mapping must be free of gaps and repeats (`check_permutation`)."""
    size = rows.count()
    sure = check_permutation(mapping, size)
    first = rows.join(sure, F.col("r") == F.col("old_id")).select(F.col("new_id").alias("r"), "values")
    if not keep_rest:
        return first
    rest = with_ordinal(rows.join(mapping, F.col("r") == F.col("old_id"), "left_anti"), "r", name="_no")
    return first.unionByName(rest.select((F.col("_no") + mapping.count()).alias("r"), "values"))


def permute_mapped_columns(rows: DataFrame, mapping: dict[int, int], width: int) -> DataFrame:
    """The same along the last axis: entries of each row at their new numbers, then all others."""
    if sorted(mapping.values()) != list(range(len(mapping))) or not all(0 <= i < width for i in mapping):
        raise ValueError("the mapping is no permutation of the first columns")
    order = [old for old, _ in sorted(mapping.items(), key=lambda p: p[1])] + [i for i in range(width) if i not in mapping]
    return rows.withColumn("values", permute_columns(F.col("values"), order))


def dense_to_experts(tensors: DataFrame, layer: str, width: int, hidden: int, experts: int, copy: bool = True) -> DataFrame:
    """A layer's gate, up and down matrices (name, r, values) to those of its experts (name, e, r, values).

    Gate and up, `hidden` rows of `width` each at most, are filled with zeros and stand one after the
    other as gate_up; down has `width` rows of `hidden`. All experts get the same (copy) or zeros; the
    router's projection is zeros, its scales ones. Other tensors are left out; a matrix that is larger
    than asked is an error when read."""
    names = {f"{layer}.mlp.{x}_proj.weight": x for x in ("gate", "up", "down")}
    kind = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    own = tensors.filter(F.col("name").isin(list(names))).withColumn("_kind", kind[F.col("name")])
    rows_of, cols_of = F.when(F.col("_kind") == "down", width).otherwise(hidden), F.when(F.col("_kind") == "down", hidden).otherwise(width)
    sure = F.assert_true((F.col("r") < rows_of) & (F.size("values") <= cols_of), F.lit("a matrix is larger than the experts"))
    own = own.filter(sure.isNull())
    parts = None
    for x, n, w, offset, name in (("gate", hidden, width, 0, "gate_up_proj"), ("up", hidden, width, hidden, "gate_up_proj"), ("down", width, hidden, 0, "down_proj")):
        part = pad_and_stack(own.filter(F.col("_kind") == x).select("r", "values"), w, n, experts, copy)
        part = part.select(F.lit(f"{layer}.experts.{name}").alias("name"), "e", (F.col("r") + offset).alias("r"), "values")
        parts = part if parts is None else parts.unionByName(part)
    router = tensors.sparkSession.range(experts).select(F.lit(f"{layer}.router.proj.weight").alias("name"), F.lit(0).alias("e"), F.col("id").alias("r"), zeros(width).alias("values"))
    scales = tensors.sparkSession.range(1).select(F.lit(f"{layer}.router.scale").alias("name"), F.lit(0).alias("e"), F.col("id").alias("r"), F.array_repeat(F.lit(1.0), width).alias("values"))
    return parts.unionByName(router).unionByName(scales)


def checked_mask(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """`row_mask`, of which an id outside 0 to size - 1 is an error when read."""
    sure = F.assert_true((F.col("id") >= 0) & (F.col("id") < size), F.lit("an id is outside the rows"))
    return row_mask(rows, ids.filter(sure.isNull()))
