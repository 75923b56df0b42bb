"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): root is the smallest node that can be reached. Each step
    re-hangs neighbours on a smaller node; steps are written to the shared folder. A node's links
    are reduced to their minimum before the shuffle, so a node with very many is no hot group."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(down, F.col("a") == F.col("u"))
        small = small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = written(small.filter("a <> b").distinct(), "links")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = after
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
