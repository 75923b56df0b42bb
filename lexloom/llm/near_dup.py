"""Near-duplicates by MinHash: one permutation, optimal densification, banded buckets, stars.

A text's set is its different word shingles. Texts with the same set are one node. A node's shingle
hashes fall into bins; each bin keeps its least, an empty bin borrows from a bin that a fixed
random order of its own names. Bands of bins give buckets. Shingles that no other candidate has bound how
similar a text can be to any other. In a bucket all members are compared with the one that has the
least share of such shingles (a star), on their full sets, where the bound lets them be similar at
all; members outside that star get a second centre among themselves.

Where the links found leave a bucket in more than one component, members are told apart by how they
differ from the first centre c: D(x) is what c has and x lacks, and the other way round. Two members
can be linked only if D(x) and D(y) share so many shingles as their sizes ask for, and of two sets
that share so many, the rarest must meet early in both. So pairs come from an equal join on (centre,
rare shingle of D) with a bound on what can follow it. No link between two texts that share a bucket
is lost, and a large group of copies costs about as many pairs as it has members and links that no
star has found."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cleaned, forget_units, release, written
from .graph import components
from .token_counts import slices
from .url_rules import build_filter, possible_hits
from .word_hashes import factors, mixed, shingles, word_hashes

#: 32 bands of 4 bins: two texts of similarity 0.8 share no bucket with a chance of 5e-8.
BANDS, ROWS = 32, 4
SEEDS = 0xA5A5A5A5A5A5A5A5, 0x5C5C5C5C5C5C5C5C


@lru_cache(maxsize=2)
def _borrow(bins: int) -> np.ndarray:
    """For each bin, in which order it asks other bins."""
    return np.argsort(mixed(np.arange(bins * bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(bins, bins), axis=1)


def signatures(s: np.ndarray, of: np.ndarray, texts: int, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Text by band: the bucket of each band, from shingle hashes ordered by text and hash. The bin
    of a hash is its top bits. Rows of texts without shingles mean nothing."""
    bins = bands * rows
    place = ((s >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.ones(len(s), bool)
    first[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1])
    table, full = np.zeros((texts, bins), np.uint64), np.zeros((texts, bins), bool)
    table[of[first], place[first].astype(np.int64)] = s[first]
    full[of[first], place[first].astype(np.int64)] = True
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    for k in range(bins):
        if not len(row):
            break
        ask = _borrow(bins)[col, k]
        good = full[row, ask]
        table[row[good], col[good]] = table[row[good], ask[good]]
        row, col = row[~good], col[~good]
    key = (table.reshape(texts, bands, rows) * factors(rows, 5)).sum(axis=2, dtype=np.uint64)
    return mixed(key ^ factors(bands, 7)).view(np.int64)


def set_hash(s: np.ndarray, of: np.ndarray, texts: int, seed: int) -> np.ndarray:
    """A hash of each text's whole set."""
    out = np.zeros(texts, np.uint64)
    if len(s):
        at = np.flatnonzero(np.diff(of, prepend=-1))
        out[of[at]] = np.add.reduceat(mixed(s ^ np.uint64(seed)), at)
    return out.view(np.int64)


def set_table(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(doc, n, h1, h2, bands): each row's set size, a 128-bit hash of its set, and its buckets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_units()
        for whole in batches:
            for batch in slices(whole, "_text", 1 << 18):
                texts = batch.column("_text").to_pylist()
                s, of = shingles(word_hashes(texts, lower=True), words)
                n = np.bincount(of, minlength=len(texts))
                sums = [pa.array(set_hash(s, of, len(texts), seed)) for seed in SEEDS]
                bands = signatures(s, of, len(texts))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), pa.array(n, pa.int64()), *sums, lists], names=["doc", "n", "h1", "h2", "bands"]
                )

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("_text"))
    return rows.mapInArrow(sign, "doc long, n long, h1 long, h2 long, bands array<bigint>")


def full_sets(docs: DataFrame, key: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """(doc, h1, n, shingles) of the rows that may be among `wanted` (doc): a filter of bounded size spares
    most others. Those that it lets through too are harmless: bounds get weaker, pairs name their rows."""

    bloom = build_filter(wanted, "doc")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_units()
        for whole in batches:
            near = whole.filter(pa.array(bloom.has(whole.column("_hash").to_numpy())))
            for batch in slices(near, "_text", 1 << 18):
                texts = batch.column("_text").to_pylist()
                s, of = shingles(word_hashes(texts, lower=True), words)
                n = np.bincount(of, minlength=len(texts))
                cuts = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(set_hash(s, of, len(texts), SEEDS[0])), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(s.view(np.int64)))], names=["doc", "h1", "n", "shingles"])

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("_text")).filter("doc is not null")
    return rows.withColumn("_hash", F.xxhash64("doc")).mapInArrow(take, "doc long, h1 long, n long, shingles array<bigint>")


@cleaned
def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: key (an integer; others are cast to long), n_shingles, component_id, kept.

    Two texts are linked if 100 * (shingles in both) >= percent * (shingles in either), counted on
    their full sets; component_id is the smallest key that links reach, kept whether it is the
    row's own. A text with fewer than `words` words has its whole sequence as its one shingle. Null
    and blank texts have no shingle and no link. Rows with a null key take no part (component_id
    null, kept true). Rows that repeat a key are one document: what either text is linked with is
    linked with both."""
    bound_batches(docs.sparkSession)
    signed = written(set_table(docs, key, text, words), "sets")
    nodes = signed.filter("n > 0 and doc is not null").groupBy("h1", "h2").agg(
        F.min("doc").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")
    )
    nodes = written(nodes, "nodes")
    buckets = nodes.select("rep", "h1", F.explode("bands").alias("bucket"))
    shared = written(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("bucket"), "shared")
    rows = written(possible_hits(buckets, "bucket", build_filter(shared, "bucket")).join(shared, "bucket"), "buckets")
    sets = written(full_sets(docs, key, text, words, rows.select(F.col("rep").alias("doc")).distinct()), "shingles")
    rows = rows.join(solid_sizes(sets).filter(F.col("solid") * 100 >= F.col("n") * percent), ["rep", "h1"])
    rows = written(centred(rows), "starred")
    links = repeated_keys(signed, nodes).unionByName(verified(sets, star_pairs(rows, percent), percent))
    roots = components(links)
    release(docs.sparkSession)
    # members outside the first star: a star of their own
    split = written(split_rows(rows, roots), "split")
    away = centred(split.filter("root <> main").drop("centre", "centre_n", "centre_solid"))
    more = verified(sets, star_pairs(away.filter("root <> main"), percent), percent)
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links)
        split = written(split_rows(rows, roots), "split")
    more = verified(sets, unlike_pairs(split, sets, percent), percent)
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    named = nodes.join(roots, nodes.rep == roots.node, "left").select("h1", "h2", F.coalesce("root", "rep").alias("_component"))
    out = signed.select("doc", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("_component")), F.col("doc")))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def repeated_keys(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): a key that stands with different sets, and the smallest key of each of these."""
    own = signed.filter("n > 0 and doc is not null").select("doc", "h1", "h2")
    twice = own.groupBy("doc").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo < hi").select("doc")
    return own.join(twice, "doc", "left_semi").join(nodes, ["h1", "h2"]).select(F.col("doc").alias("a"), F.col("rep").alias("b"))


def solid_sizes(sets: DataFrame) -> DataFrame:
    """(rep, h1, n, solid): how many of a node's shingles some other node has too. Two sets cannot share
    more than the lesser of these, which rules out most pairs of texts that were edited too much."""
    each = sets.select("doc", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("doc").alias("doc"), F.max("doc").alias("_hi"))
    lone = each.filter("doc = _hi").groupBy("doc").agg(F.count(F.lit(1)).alias("lone"))
    # a document that stands with several sets: its shingles may be in another of them
    several = sets.groupBy("doc").agg(F.count(F.lit(1)).alias("sets"))
    found = sets.select("doc", "h1", "n").join(lone, "doc", "left").join(several, "doc")
    lone = F.when(F.col("sets") == 1, F.coalesce("lone", F.lit(0))).otherwise(0)
    return written(found.select(F.col("doc").alias("rep"), "h1", "n", (F.col("n") - lone).alias("solid")), "solid")


def centred(rows: DataFrame) -> DataFrame:
    """Rows (bucket, rep, n, solid, ...) of buckets with two members or more, with each bucket's centre:
    the member with the greatest share of shingles that others have, ties to the smaller key."""
    best = F.max(F.struct((F.col("solid") / F.col("n")).alias("share"), (-F.col("rep")).alias("back"), "n", "solid"))
    middle = rows.groupBy("bucket").agg(best.alias("c"), F.count(F.lit(1)).alias("_members")).filter("_members > 1")
    return rows.join(middle.select("bucket", (-F.col("c.back")).alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.solid").alias("centre_solid")), "bucket")


def star_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each bucket's centre and the members that can be linked with it."""
    reach = F.least("solid", "centre_solid") * (100 + percent) >= (F.col("n") + F.col("centre_n")) * percent
    star = rows.filter(reach & (F.col("rep") != F.col("centre")))
    return star.select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct()


def split_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets whose members lie in several components, with each member's root and that
    of the bucket's centre (main)."""
    named = rows.join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep")).drop("node")
    spread = named.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.when(F.col("rep") == F.col("centre"), F.col("root"))).alias("main"))
    return named.join(spread.filter("lo < hi").select("bucket", "main"), "bucket")


def unlike_pairs(split: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of a split bucket, in different components, that may be linked.

    With R what the centre c has and x lacks, A what x has and c lacks, and D = R + A, the shingles
    in both of x and y are |c| - |Rx| - |Ry| + |Dx and Dy|. So a link asks for
        |Dx and Dy| >= (Wx + Wy) / (100 + percent) - |c|,   W = percent * |x| + (100 + percent) * |R|,
    which is 1 or more as soon as x has no link with c. With each D ordered by how few members of
    the star have a shingle (alone in one D, it is left out), the first common shingle of two such
    sets stands where enough of both still follows."""
    arms = split.filter("rep <> centre").select("centre", "rep", "root", (F.col("root") != F.col("main")).alias("probe")).distinct()
    open_ = arms.groupBy("centre").agg(F.count(F.lit(1)).alias("arms"), F.max("probe").alias("any")).filter("arms > 1 and any").select("centre")
    arms = written(arms.join(open_, "centre", "left_semi"), "open-arms")
    sets = sets_of(sets, arms, "centre", "rep")
    one = sets.select(F.col("doc").alias("centre"), F.col("shingles").alias("s"))
    two = sets.select(F.col("doc").alias("rep"), F.col("shingles").alias("t"))
    arms = arms.join(one, "centre").join(two, "rep").withColumn("gone", F.array_except("s", "t"))
    weight = F.size("t") * percent + F.size("gone") * (100 + percent) - F.size("s") * (100 + percent)  # |c| once in each of two
    arms = written(arms.select("centre", "rep", "root", "probe", weight.cast("long").alias("w"), F.size("s").alias("c"), F.concat("gone", F.array_except("t", "s")).alias("d")), "arms")
    each = arms.select("centre", "rep", F.explode("d").alias("e"))
    rare = each.groupBy("centre", "e").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    order = each.join(rare, ["centre", "e"]).groupBy("centre", "rep").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("d"))
    least = arms.groupBy("centre").agg(F.min("w").alias("any_w"), F.min(F.when(F.col("probe"), F.col("w"))).alias("probe_w"))
    ordered = order.join(arms.drop("d"), ["centre", "rep"]).join(least, "centre").withColumn("size", F.size("d"))
    need = lambda x, y: F.ceil((F.col(x) + F.col(y) + F.col("c") * (100 + percent)) / (100.0 + percent) - 1e-9)
    members = ordered.filter((F.col("size") >= need("w", "probe_w"))).withColumn("last", F.col("size") - need("w", "probe_w"))
    probes = ordered.filter(F.col("probe") & (F.col("size") >= need("w", "any_w"))).withColumn("last", F.col("size") - need("w", "any_w"))

    def early(rows: DataFrame, mark: str) -> DataFrame:
        at = rows.select("centre", "c", "rep", "root", "w", "size", "last", F.posexplode("d").alias("at", "k")).filter("at <= last")
        return at.select("centre", F.col("k.e").alias("e"), *[F.col(x).alias(f"{mark}_{x}") for x in ("c", "rep", "root", "w", "size", "at")])

    follow = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    enough = follow * (100 + percent) >= F.col("x_w") + F.col("y_w") + F.col("x_c") * (100 + percent)
    met = early(probes, "x").join(early(members, "y"), ["centre", "e"]).filter((F.col("x_root") != F.col("y_root")) & enough)
    return met.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def sets_of(sets: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """The sets of the documents that a written table of pairs names, so that no others are shuffled."""
    asked = None
    for c in columns:
        own = pairs.select(F.col(c).alias("doc"))
        asked = own if asked is None else asked.unionByName(own)
    return sets.join(written(asked.distinct(), "asked"), "doc", "left_semi")


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked, written to the shared folder."""
    pairs = written(pairs, "candidates")
    sets = sets_of(sets, pairs, "a", "b")
    one = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    found = pairs.join(one, "a").join(two, "b").withColumn("both", both)
    found = found.filter(F.col("both") * 100 >= (F.size("s") + F.size("t") - F.col("both")) * percent)
    return written(found.select("a", "b").distinct(), "links-found")
