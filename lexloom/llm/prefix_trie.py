"""The trie of conversations' prefixes: which conversations begin with the same turns.

A conversation's prefixes get polynomial rolling fingerprints, as running sums of a numpy scan over
the turns in order (`running`). Equal depth and fingerprint make a candidate group. In each group
every turn is verified, turn by turn, against the group's representative (its smallest conversation):
by the SHA-256 of role and text, and by the group of the prefix before. Conversations that
differ are split off, with all their longer prefixes, and groups are made again until none
differs. The groups are the nodes; what is below a node is rolled up to it over its members.

Texts are read once, for their digests; all shuffles after that are of numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cleaned, written
from .hot_keys import join_to_one
from .running import running_sums

#: Primes below 2^31 and a number for each: a fingerprint is a polynomial's value modulo each.
PRIMES = ((2147483647, 1103515245), (2147483629, 1664525013))
#: Ids that go into a digest at once; characters of a text that samples for ranges hold.
PIECE, BEGINNING = 4096, 32


def numbered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (1, 2, ... by turn, nulls first, then role and text), digest (SHA-256 of role and text), chars
    (code points of the text) of every row with a conversation (an integer id). Null roles and texts count as
    empty; rows without a conversation take no part. Other columns are not read."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    whole = F.concat(F.length(by).cast("string"), F.lit(":"), by, said)
    kept = rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("_turn"), by.alias("_role"), said.alias("_text"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), F.length(said).cast("long").alias("chars"), F.lit(1).cast("long").alias("pos"),
    )
    order = [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_text")]
    # the beginnings of texts are enough to cut a conversation, also one whose turns tie, into tasks
    ranges = [F.col("_turn").asc_nulls_first(), F.left("_role", F.lit(BEGINNING)), F.left("_text", F.lit(BEGINNING))]
    return running_sums(kept, "conv_id", order, {"pos": None}, ["digest", "chars"], "turns", ranges).withColumnRenamed("run_pos", "pos")


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo prime."""
    out, square, left = np.ones(len(exponents), np.int64), base % prime, exponents.copy()
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = out[odd] * square % prime
        square, left = square * square % prime, left >> 1
    return out


def with_terms(turns: DataFrame, primes: tuple) -> DataFrame:
    """Each turn's terms of the two polynomials: a number from its digest times a power by its place."""
    kept = ["conv_id", "pos", "digest", "chars"]
    schema = T.StructType([turns.schema[c] for c in kept] + [T.StructField(f"term_{i}", T.LongType()) for i in (0, 1)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column("pos").to_numpy()
            heads = np.frombuffer(b"".join(x[:8] for x in batch.column("digest").to_pylist()), ">u4").reshape(len(pos), 2).astype(np.int64)
            terms = [pa.array((heads[:, i] % (p - 1) + 1) * powers(b, pos, p) % p, pa.int64()) for i, (p, b) in enumerate(primes)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *terms], names=schema.names)

    return turns.select(*kept).mapInArrow(work, schema)


def fingerprints(turns: DataFrame, primes: tuple = PRIMES) -> DataFrame:
    """Each turn with its depth d, the fingerprint fp of the prefix that it ends, and before_fp of the prefix before it."""
    terms = with_terms(turns, primes)
    sums = running_sums(terms, "conv_id", [F.col("pos")], {f"term_{i}": p for i, (p, _) in enumerate(primes)}, ["pos", "digest", "chars", "term_0", "term_1"], "prefixes")
    joined = lambda a, b: F.shiftleft(a, 31).bitwiseOR(b)
    before = [(F.col(f"run_term_{i}") - F.col(f"term_{i}") + p) % p for i, (p, _) in enumerate(primes)]
    return sums.select("conv_id", F.col("pos").alias("d"), "digest", "chars", joined(F.col("run_term_0"), F.col("run_term_1")).alias("fp"), joined(*before).alias("before_fp"))


KEY = ["d", "fp", "split"]


def verified(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes with `split` and `before_split`, nodes): groups by depth, fingerprint and split whose members all
    have the representative's turns.

    A group's members are first put together by what is compared (digest, group of the prefix before), on the side
    of the map: any number of copies comes to one row a task. A round settles all groups of the
    least depth with a difference at least, so it ends; with 62 bits there is hardly ever a second one."""
    what = ["digest", "before_fp", "before_split"]
    held = prefixes.withColumn("split", F.lit("")).withColumn("before_split", F.lit(""))
    while True:
        kinds = written(held.groupBy(*KEY, *what).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars")), "kinds")
        several = kinds.groupBy(*KEY).agg(F.min("conv_id").alias("_rep"), F.count(F.lit(1)).alias("_kinds")).filter("_kinds > 1")
        other = written(kinds.join(several, KEY).filter("conv_id <> _rep").select(*KEY, *what, F.col("conv_id").alias("_branch")), "others")
        if other.isEmpty():
            return held, kinds
        # the shallowest difference of each conversation; its longer prefixes go along
        found = held.join(other, [*KEY, *what]).groupBy("conv_id").agg(F.min(F.struct(F.col("d").alias("at"), F.col("_branch").alias("to"))).alias("_cut"))
        joined = held.join(found, "conv_id", "left")
        mark = F.concat(F.lit("/"), F.col("_cut.at").cast("string"), F.lit(":"), F.col("_cut.to").cast("string"))
        moved = lambda old, depth: F.when(depth >= F.col("_cut.at"), F.concat(F.col(old), mark)).otherwise(F.col(old))
        joined = joined.withColumns({"split": moved("split", F.col("d")), "before_split": moved("before_split", F.col("d") - 1)})
        held = written(joined.drop("_cut"), "split")


def end_digests(ends: DataFrame) -> DataFrame:
    """For each node (KEY) the SHA-256 of the ids of the conversations that end in it, ascending, joined by commas.

    Ids are sorted by range, so a node's ids may lie over any number of tasks, which join them to pieces of text. The
    pieces of a node go to one task in order, and through the hash one after the other: a SHA-256 is
    sequential, but a task holds one batch of pieces, however many ids a node has."""
    bound_batches(ends.sparkSession)
    node = ends.schema["d"], ends.schema["fp"], ends.schema["split"]
    schema = T.StructType([*node, T.StructField("from_id", T.LongType()), T.StructField("ids", T.BinaryType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            keys = [batch.column(c) for c in KEY]
            new = np.ones(len(ids), bool)
            new[1:] = False
            for k in keys:
                codes = k.dictionary_encode().indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            begin = np.unique(np.concatenate([np.flatnonzero(new), np.arange(0, len(ids), PIECE)])) if len(ids) else np.zeros(0, np.int64)
            pieces = [",".join(map(str, x.tolist())).encode() for x in np.split(ids, begin[1:])] if len(ids) else []
            yield pa.RecordBatch.from_arrays([*(k.take(pa.array(begin)) for k in keys), pa.array(ids[begin], pa.int64()), pa.array(pieces, pa.binary())], names=schema.names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out = []
            for *key, _, ids in zip(*(batch.column(c).to_pylist() for c in schema.names)):
                if key != held:
                    if held is not None:
                        out.append((*held, state.hexdigest()))
                    held, state = key, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=arrow)
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*held, state.hexdigest())))], schema=arrow)

    names = [*KEY, "ends_sha256"]
    arrow = pa.schema([("d", pa.int64()), ("fp", pa.int64()), ("split", pa.string()), ("ends_sha256", pa.string())])
    pieces = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(join, schema)
    out = T.StructType([*node, T.StructField("ends_sha256", T.StringType())])
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "from_id").mapInArrow(digest, out)


@cleaned
def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, primes: tuple = PRIMES) -> DataFrame:
    """The nodes: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    turns: conv_id, pos (its order; without ties, gaps do not count), digest, chars, as `numbered_turns` gives them.
    convs: conv_id of all conversations, once each (None: those with a turn); one without turns is a
    member of the root alone. saved_tokens of a node sums (n_convs - 1) * chars of the last turn over its
    subtree, itself included: what is saved if each prefix is computed once. Without a conversation
    there is no node.

    Subtrees are not walked level by level, since conversations can be long. The nodes whose smallest member is the
    same are one path down, from where that conversation parts from smaller ones to its end. A node's
    subtree is its own path from there on, and the whole paths of its other members: two
    aggregations, whatever the depth. One conversation, or one node, may hold any part of all rows."""
    gaps = running_sums(turns.withColumn("_one", F.lit(1).cast("long")), "conv_id", [F.col("pos")], {"_one": None}, ["digest", "chars"], "places")
    prefixes = written(fingerprints(gaps.withColumnRenamed("run__one", "pos"), primes), "fingerprints")
    members, nodes = verified(prefixes)
    named = turns.select("conv_id").distinct() if convs is None else convs.select(F.col("conv_id").cast("long"))
    lengths = prefixes.groupBy("conv_id").agg(F.max("d").alias("_turns"))
    named = written(named.join(lengths, "conv_id", "left"), "conversations")
    root = named.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("d"), zero.alias("fp"), F.lit("").alias("split"), "conv_id", "n_convs", zero.alias("chars"), F.lit(None).cast("long").alias("before_fp"), F.lit(None).cast("string").alias("before_split"))
    nodes = root.unionByName(nodes.drop("digest"))

    # children, and the smallest member of the node above
    up = {"before_fp": "fp", "before_split": "split", "_above": "d"}
    kids = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("before_fp").alias("fp"), F.col("before_split").alias("split")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(kids, KEY, "left").fillna(0, ["n_children"]).withColumn("_above", F.col("d") - 1), "nodes")
    above = nodes.filter("n_children > 0").select(*KEY, F.col("conv_id").alias("parent_conv_id"), "n_children")
    parents = join_to_one(nodes.filter("d > 0").select("conv_id", *KEY, *up), above, up, "n_children").select(*KEY, "parent_conv_id")

    # each path's sums, then those of all members' paths, less what lies above a node on its own path
    own = nodes.select("conv_id", *KEY, ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    paths = own.groupBy("conv_id").agg(F.sum("saved").alias("path_saved"), F.sum("leaf").alias("path_leaves"))
    paths = written(paths.join(named, "conv_id").withColumn("_turns", F.coalesce("_turns", F.lit(0)) + 1), "paths")
    everyone = named.select("conv_id", zero.alias("d"), zero.alias("fp"), F.lit("").alias("split")).unionByName(members.select("conv_id", *KEY))
    below = join_to_one(written(everyone, "members"), paths, {"conv_id": "conv_id"}, "_turns")
    below = below.groupBy(*KEY).agg(F.sum("path_saved").alias("_saved"), F.sum("path_leaves").alias("n_leaves"))
    along = running_sums(own, "conv_id", [F.col("d")], {"saved": None}, [*KEY, "saved"], "along")
    along = along.select(*KEY, (F.col("run_saved") - F.col("saved")).alias("_before"))

    last = F.max(F.struct(*KEY)).alias("_last")
    stops = members.groupBy("conv_id").agg(last).select("conv_id", "_last.*")
    turnless = named.filter("_turns is null").select("conv_id", zero.alias("d"), zero.alias("fp"), F.lit("").alias("split"))
    ends = end_digests(written(stops.unionByName(turnless), "ends"))
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.join(parents, KEY, "left").join(below, KEY).join(along, KEY).join(ends, KEY, "left")
    return out.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("_saved") - F.col("_before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
