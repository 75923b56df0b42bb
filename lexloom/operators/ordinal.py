"""Running sums and row numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most ranges that a key is cut into; a session with fewer shuffle partitions gets twice as many as these.
RANGES = 512


def key_range(df: DataFrame, key: str, ranges: int | None = None) -> Column:
    """The number of a row's range: ranges of a numeric key that hold about as many rows each, between
    approximate quantiles of the table at hand; -1 for null keys. However sparse or dense keys are, a
    range has its share of the rows, unless one key alone has more."""
    if ranges is None:
        ranges = max(8, min(RANGES, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    bounds = sorted(set(found or []))

    def place(lo: int, hi: int) -> Column:  # a decision tree over bounds[lo:hi]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) < F.lit(bounds[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))

    return F.when(F.col(key).isNull(), -1).otherwise(place(0, len(bounds)))


def running_total(df: DataFrame, key: str, by: list[str], amount: Column, name: str, ranges: int | None = None) -> DataFrame:
    """Adds `name`: the sum of a whole-number amount over the rows before this one in the order of a
    numeric key, within each value of `by`. Ranges of keys are summed, their running sums (one row per
    range and value of `by`) are added to the sums within a range. Keys that repeat stand in no stated
    order; rows with a null key come first. Null values of `by` are a group of their own."""
    cut = df.withColumn("_amount", amount.cast("long")).withColumn("_range", key_range(df, key, ranges))
    sizes = cut.groupBy(*by, "_range").agg(F.sum("_amount").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    sizes = sizes.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate([*by, "_range"])], "_ahead")
    own = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    same = F.lit(True)
    for i, c in enumerate([*by, "_range"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    out = cut.withColumn("_own", F.coalesce(F.sum("_amount").over(own), F.lit(0))).join(sizes, same)
    return out.withColumn(name, (F.col("_own") + F.col("_ahead")).cast("long")).select(*df.columns, name)


def with_ordinal(df: DataFrame, key: str, by: list[str] | None = None, name: str = "ordinal", ranges: int | None = None) -> DataFrame:
    """Adds `name`: the row's number from 0 in the order of a numeric key, within each value of `by`."""
    return running_total(df, key, by or [], F.lit(1), name, ranges)


def batch_number(ordinal: Column, size: int) -> Column:
    """The batch of a row's number; the last batch may be short."""
    return F.floor(ordinal / F.lit(size)).cast("long")
