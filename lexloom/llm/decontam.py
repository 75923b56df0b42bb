"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame functions only.

An item is contaminated text if a window of a document, as many words long as the item (the whole
document, if it has fewer), is as similar to the item as asked: the sum over shingles of the lesser
count by the sum of the greater. Steps, all on Spark's own functions:

1. Document shingles that some item has, with their positions (a join with the items' shingles). A
   document may hold an item only if it has one of the item's rarest shingles, so many as a similar
   window cannot do without; common shingles alone make no pair.
2. Windows to look at: those that begin at such a shingle, or end the document, and have enough of
   them. A window that is similar enough can be moved on to its first shared shingle without loss,
   and what "enough" is follows from the sizes, so no similar window is passed over here.
3. A 64-bit SimHash of every window and item, shingles weighted by their counts. Fingerprints are
   cut into BLOCKS blocks; two that differ in at most `radius` bits differ in at most radius / BLOCKS
   bits of some block. Items, which are few, stand under all keys that near each of their blocks, windows
   under their own, so an equal join on (size, block number, block) meets every such pair, and few others.
4. The pairs within the radius are checked on the weighted shingles themselves."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cleaned, written

#: Blocks of a fingerprint.
BLOCKS = 4
#: Bits in which fingerprints may differ. At similarity 0.8 windows of equal length share 8/9 of
#: their weight, so each bit differs with a chance of about 0.15: 9 bits on average. Of windows just at
#: 0.8, 99.97 % lie within 19 bits (208,000 windows of 9 to 60 shingles; all within 23).
RADIUS = 19


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, n: int) -> Column:
    """Hashes of all n-word shingles in order; fewer words give one shingle, none give none."""
    many = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(n)]))
    few = lambda h: F.when(F.size(h) > 0, F.array(F.xxhash64(h, F.size(h)))).otherwise(F.array().cast("array<bigint>"))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= n, many(h)).otherwise(few(h)))


def simhash(shingles: Column) -> Column:
    """64-bit SimHash of an array of shingle hashes; a shingle counts as often as it stands there.
    A bit is set where more than half of the weight has it."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def of(s: Column) -> Column:
        ones = lambda b: F.aggregate(s, F.lit(0), lambda n, h: n + F.call_function("getbit", h, b).cast("int"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), none, lambda f, b: F.when(2 * ones(b) > F.size(s), f.bitwiseOR(F.call_function("shiftleft", one, b))).otherwise(f))

    return let(shingles, of)


def block_keys(fingerprint: Column) -> Column:
    """(number, bits) of each block of a fingerprint."""
    size = 64 // BLOCKS
    cut = lambda i: F.shiftrightunsigned(fingerprint, size * i).bitwiseAND(F.lit((1 << size) - 1)).cast("int")
    return F.array(*[F.struct(F.lit(i).alias("number"), cut(i).alias("bits")) for i in range(BLOCKS)])


def flips(radius: int) -> Column:
    """All block values with at most radius / BLOCKS bits set, as one constant array."""
    size, most = 64 // BLOCKS, min(64 // BLOCKS, radius // BLOCKS)
    held = [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(size), k)]
    return F.split(F.lit(",".join(map(str, held))), ",").cast("array<int>")


def overlap(left: Column, right: Column) -> Column:
    """Sum over shingles of the lesser count, of two arrays."""
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    return F.aggregate(F.array_intersect(left, right), F.lit(0), lambda s, v: s + F.least(count(left, v), count(right, v)))


@cleaned
def contaminated(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    words: int = 5,
    percent: int = 80,
    radius: int = RADIUS,
) -> DataFrame:
    """(key, item_key, start, n_words, similarity): for each document and item that it holds, the
    most similar window (ties: the first); `start` counts words from 0.

    Null and blank texts and items match nothing. A text or an item of fewer than `words` words is
    one shingle, its whole sequence; such an item is looked for as a run of its words. Rows that
    repeat a key are one document, of which the best window counts; of items each counts. Other
    columns are not read. Items are few against the documents; Spark sends them to all tasks only
    below its own size limit."""
    own = items.select(F.col(item_key).alias("_item"), text_words(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    own = own.select("_item", F.size("_w").alias("_size"), F.least(F.size("_w"), F.lit(words)).alias("g"), "_w")
    known = None
    for g in range(1, words + 1):
        part = own.filter(F.col("g") == g).withColumn("_i", shingle_hashes(F.col("_w"), g)).drop("_w")
        known = part if known is None else known.unionByName(part)
    known = known.select("_item", "_size", "g", "_i", F.size("_i").alias("m"), F.xxhash64("_i").alias("_no"), simhash(F.col("_i")).alias("_if"))
    known = written(known, "items")
    found = None
    for (g,) in sorted(known.select("g").distinct().collect()):  # one size, unless items are very short
        part = _of_size(docs, known.filter(F.col("g") == g), key, text, g, percent, radius)
        found = part if found is None else found.unionByName(part)
    if found is None:
        kinds = [docs.schema[key], T.StructField(item_key, items.schema[item_key].dataType), T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("similarity", T.DoubleType())]
        return docs.sparkSession.createDataFrame([], T.StructType(kinds))
    best = found.groupBy("_doc", "_item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("later"), "n_words")).alias("b"))
    return best.select(F.col("_doc").alias(key), F.col("_item").alias(item_key), (-F.col("b.later")).alias("start"), F.col("b.n_words").alias("n_words"), F.col("b.similarity").alias("similarity"))


def _of_size(docs: DataFrame, known: DataFrame, key: str, text: str, g: int, percent: int, radius: int) -> DataFrame:
    """The windows that hold an item, for the items whose shingles have g words."""
    texts = known.dropDuplicates(["_no"]).drop("_item")
    marks = texts.select(F.explode("_i").alias("h"), "_no", "m").groupBy("_no", "m", "h").agg(F.count(F.lit(1)).alias("weight"))
    marks = written(marks, "item-shingles")
    rows = docs.select(F.col(key).alias("_doc"), F.xxhash64(F.col(text)).alias("_row"), F.col(text).alias("_text"))
    each = rows.select("_doc", "_row", shingle_hashes(text_words(F.col("_text")), g).alias("_s"))
    each = each.select("_doc", "_row", F.size("_s").alias("n"), F.posexplode("_s").alias("p", "h"))
    shared = written(each.join(marks.select("h").distinct(), "h").distinct(), "shared-shingles")

    # an item's rarest shingles, of which a similar window has at least one: their weight is more
    # than what the window may lack, m - 0.8 m
    common = marks.join(shared.groupBy("h").agg(F.count(F.lit(1)).alias("often")), "h", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    ahead = F.sum("weight").over(Window.partitionBy("_no", "m").orderBy("often", "h").rowsBetween(Window.unboundedPreceding, -1))
    lacks = F.col("m") - F.ceil(F.col("m") * percent / F.lit(100.0) - 1e-9)
    rare = common.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).filter(F.col("_ahead") <= lacks).select("h", "_no", "m")
    met = shared.join(rare, "h").select("_doc", "_row", "_no", "m").distinct()
    met = met.select(F.col("_doc").alias("_d"), F.col("_row").alias("_r"), "_no", "m")

    # positions of an item's shingles in a document; a window is m shingles from one of them on
    hits = shared.join(met, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r"))).drop("_d", "_r")
    hits = hits.join(marks.select("_no", "m", "h"), ["_no", "m", "h"]).groupBy("_doc", "_row", "n", "_no", "m").agg(F.sort_array(F.collect_set("p")).alias("P"))
    need = F.ceil((F.col("m") + F.least("m", "n")) * percent / F.lit(100.0 + percent) - 1e-9).cast("int")
    hits = hits.withColumn("need", F.greatest(need, F.lit(1))).withColumn("last", F.greatest(F.col("n") - F.col("m"), F.lit(0))).filter(F.size("P") >= F.col("need"))
    enough = lambda i: F.element_at("P", (i + F.col("need") - 1).cast("int")) < F.element_at("P", i) + F.col("m")
    firsts = F.filter(F.sequence(F.lit(1), F.size("P") - F.col("need") + 1), lambda i: (F.element_at("P", i) <= F.col("last")) & enough(i))
    starts = F.transform(firsts, lambda i: F.element_at("P", i))
    at_end = F.size(F.filter("P", lambda p: p >= F.col("last"))) >= F.col("need")
    starts = F.when(at_end, F.array_union(starts, F.array("last"))).otherwise(starts)
    spots = hits.select("_doc", "_row", "m", F.explode(starts).alias("start")).distinct()
    spots = written(spots.groupBy("_doc", "_row").agg(F.collect_list(F.struct("start", "m")).alias("spots")), "windows")

    there = rows.join(spots.withColumnRenamed("_doc", "_d").withColumnRenamed("_row", "_r"), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")))
    there = there.select("_doc", "_row", shingle_hashes(text_words(F.col("_text")), g).alias("_s"), F.size(text_words(F.col("_text"))).alias("n_all"), F.explode("spots").alias("spot"))
    windows = there.select("_doc", "_row", "n_all", F.col("spot.start").alias("start"), F.col("spot.m").alias("m"), F.slice("_s", F.col("spot.start") + 1, F.col("spot.m")).alias("w"))
    windows = written(windows.withColumn("f", simhash(F.col("w"))), "fingerprints")

    cut = windows.select("*", F.explode(block_keys(F.col("f"))).alias("k")).select("*", "k.number", "k.bits").drop("k")
    ours = texts.select("_no", "_if", "m", F.explode(block_keys(F.col("_if"))).alias("k"))
    ours = ours.select("_no", "_if", "m", "k.number", F.explode(F.transform(flips(radius), lambda x: x.bitwiseXOR(F.col("k.bits")))).alias("bits"))
    apart = F.col("f").bitwiseXOR(F.col("_if"))
    near_block = lambda i: F.bit_count(F.shiftrightunsigned(apart, 64 // BLOCKS * i).bitwiseAND(F.lit((1 << 64 // BLOCKS) - 1))) <= radius // BLOCKS
    first = F.coalesce(*[F.when(near_block(i), F.lit(i)) for i in range(BLOCKS)])
    near = cut.hint("shuffle_hash").join(ours, ["m", "number", "bits"]).filter((F.bit_count(apart) <= radius) & (first == F.col("number")))  # a pair once, at its first block
    pairs = near.join(texts.select("_no", "_i", "_size"), "_no").withColumn("both", overlap(F.col("w"), F.col("_i")))
    total = F.size("w") + F.size("_i") - F.col("both")
    good = pairs.filter(F.col("both") * 100 >= total * percent)
    good = good.join(known.select("_no", "_item"), "_no")
    return good.select("_doc", "_item", "start", F.least("_size", "n_all").alias("n_words"), F.round(F.col("both") / total, 6).alias("similarity"))
