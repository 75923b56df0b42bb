"""Exact top-k search by inner product: a ball tree per shard, branch and bound in numpy.

Rows go to the nearest of a few coarse centres, and the rows of a centre to shards of bounded size,
so a shard is a ball in space. A task gets one shard's rows, then the queries in batches (a sort
within the partition puts them in this order). For a batch it goes down the tree level by level: a
node's bound is q . centre + |q| * radius, and never over its parent's; nodes below the k-th score
known so far are cut. The leaves left are visited in falling order of bound, in rounds of twice as
many, a leaf once a round for all queries that are due there; the k-th score rises from round to
round, and only scores that reach it are sorted. The first pass searches the shards about the
centre of the highest product with a query; its k-th score then rules out all centres whose own
bound is lower, and goes with the query to the shards of the others, which so begin with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cleaned, written

#: Most rows of a shard, rows of a leaf, queries that are searched at once.
SHARD_ROWS, LEAF_ROWS, BATCH = 4096, 32, 1024
#: Scores found that are held before they are taken into the k best.
HITS = 1 << 17
#: Most coarse centres, most numbers in them, and rows of the sample that they are fitted on.
CENTRES, CENTRE_NUMBERS, SAMPLE_ROWS = 1024, 1 << 20, 8192
LONG = (1 << 63) - 1


class BallTree:
    """A balanced tree over the rows of a shard: level by level, each node's range, centre, radius."""

    def __init__(self, keys: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS):
        order, cuts = np.arange(len(points)), np.array([0, len(points)])
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            centre = np.add.reduceat(points[order], cuts[:-1], axis=0) / np.diff(cuts)[:, None]
            far = np.linalg.norm(points[order] - np.repeat(centre, np.diff(cuts), axis=0), axis=1)
            self.levels.append((centre, np.maximum.reduceat(far, cuts[:-1])))
            if np.diff(cuts).max() <= leaf:
                break
            halves = [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # each node splits at the median of its widest axis
                own = points[order[a:b]]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, np.argmax(np.ptp(own, axis=0))], half)]
                halves += [a + half, b]
            cuts = np.array(halves)
        self.cuts, self.keys, self.points = cuts, keys[order], points[order]

    def search(self, keys: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best (scores, keys) of each query that are not below its `least`, and how many leaves
        were visited. Scores are exact whole numbers: doubles, int64 or Python's, whichever hold
        them; -inf (or None) fills up."""
        norm = np.linalg.norm(queries, axis=1)
        bound, slack = np.full((len(queries), 1), np.inf), room(norm, np.linalg.norm(self.points, axis=1).max())
        for depth, (centre, radius) in enumerate(self.levels):
            if depth:
                bound = np.repeat(bound, 2, axis=1)
            with np.errstate(all="ignore"):
                here = queries @ centre.T + norm[:, None] * radius + slack[:, None]
            bound = np.minimum(bound, np.where(np.isnan(here), np.inf, here))
            bound[bound < least[:, None]] = -np.inf
        turn = np.empty(bound.shape, np.int64)
        np.put_along_axis(turn, np.argsort(-bound, axis=1, kind="stable"), np.arange(bound.shape[1])[None, :], axis=1)
        kind = holds(queries, self.points)
        none = none_of(kind)
        best = np.full((len(queries), k), none, kind)
        owner = np.full((len(queries), k), np.iinfo(np.int64).max)
        least, visited, start, held = least.copy(), 0, 0, 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle() -> None:
            nonlocal held
            if found:
                merge(best, owner, *(np.concatenate(x) for x in zip(*found, strict=True)))
                found.clear()
                held = 0
                np.maximum(least, below(best[:, -1], none), out=least)

        # the best leaf of each query, then the next, the next two, four and so on: the k-th score rises between
        # them, and a leaf is taken for many queries at once
        while start < bound.shape[1]:
            stop = max(1, 2 * start)
            live = (turn >= start) & (turn < stop) & (bound >= least[:, None]) & (bound > -np.inf)
            for node in np.flatnonzero(live.any(axis=0)):
                rows = np.flatnonzero(live[:, node])
                a, b = self.cuts[node], self.cuts[node + 1]
                visited += len(rows)
                score = products(queries[rows], self.points[a:b], kind)
                q, r = np.nonzero(score >= least[rows][:, None])
                score, q, own = score[q, r], rows[q], self.keys[a:b][r]
                # of those that tie with the k-th only smaller keys get in
                new = (keys[q] != own) & ((score > best[q, -1]) | (own < owner[q, -1]))
                found.append((q[new], score[new], own[new]))
                held += int(new.sum())
                if held > HITS:
                    settle()
            settle()
            if not ((turn >= stop) & (bound >= least[:, None]) & (bound > -np.inf)).any():
                break
            start = stop
        return best, owner, visited


def merge(best: np.ndarray, owner: np.ndarray, rows: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
    """Takes found (row, score, key) into the k best of their rows, highest score first, ties to the smaller key."""
    k, own = best.shape[1], np.unique(rows)
    rows = np.concatenate([np.repeat(own, k), rows])
    scores, keys = np.concatenate([best[own].ravel(), scores]), np.concatenate([owner[own].ravel(), keys])
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(-scores[order], kind="stable")]
    order = order[np.argsort(rows[order], kind="stable")]
    begin = np.searchsorted(rows[order], own)  # each row has k at least
    first = order[begin[:, None] + np.arange(k)]
    best[own], owner[own] = scores[first], keys[first]


def room(norm: np.ndarray, longest: float) -> np.ndarray:
    """What a bound may be short of by rounding."""
    with np.errstate(over="ignore"):
        return 1.0 + 1e-9 * norm * longest


def holds(a: np.ndarray, b: np.ndarray) -> type:
    """The kind of number that holds all inner products of the rows, and all sums on the way."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object


def none_of(kind: type | np.dtype) -> float | int:
    return -LONG if np.dtype(kind) == np.int64 else -np.inf


def products(a: np.ndarray, b: np.ndarray, kind: type) -> np.ndarray:
    """Inner products of rows of whole numbers, exact in numbers of this kind."""
    if kind is object:
        a, b = (np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (a, b))
        return a @ b.T
    return a.astype(kind, copy=False) @ b.astype(kind, copy=False).T


def below(scores: np.ndarray, none: float | int) -> np.ndarray:
    """Doubles that are not above the scores; -inf for none."""
    out = np.array([-np.inf if s == none else float(s) for s in scores]) if scores.dtype == object else np.where(scores == none, -np.inf, scores.astype(np.float64))
    return np.where(np.abs(out) < 2.0**53, out, np.nextafter(out, -np.inf))


def split_score(score: int) -> tuple[int, bytes]:
    """A whole number as a long (the nearest, if it does not fit) and bytes that order what does not."""
    if -LONG <= score <= LONG:
        return score, b""
    size = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    raw = len(size).to_bytes(4, "big") + size
    return (LONG, raw) if score > 0 else (-LONG, bytes(255 - x for x in raw))


def fit_centres(sample: np.ndarray, n: int, steps: int = 8) -> np.ndarray:
    """n centres of a sample of rows, by a few steps of k-means from rows spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(steps):
        own = nearest(sample, centres)[0]
        number = np.bincount(own, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(number[:, None] > 0, sums / np.maximum(number, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and how far it is."""
    with np.errstate(all="ignore"):
        apart = (centres**2).sum(axis=1) - 2 * points @ centres.T
    own = np.where(np.isnan(apart), np.inf, apart).argmin(axis=1)
    return own, np.linalg.norm(points - centres[own], axis=1)


def by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length."""
    sizes = lists.value_lengths().to_numpy()
    flat, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        yield own, flat[(ends - sizes)[own][:, None] + np.arange(size)]


@cleaned
def exact_top_k(
    vectors: DataFrame,
    query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    scale: float = 256.0,
    shard_rows: int = SHARD_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k highest inner products of each query row with
    all other rows, ties to the smaller key. Components x become floor(scale * x).

    key: an integer column (others are cast to long). query: a condition on the columns of `vectors`. Rows whose key or vector is null, or whose
    vector is empty or holds a null or a number that is not finite (before or after scaling), take no
    part. Rows that repeat a key are candidates each, but not of a query of their own key; of queries
    that repeat a key the greatest vector asks. A query is compared with vectors of its own length
    only. Products are whole numbers of any size and ranked as such; a score outside the range of a
    long is given as the nearest long but one. Other columns are not read. Coarse centres are fitted
    on SAMPLE_ROWS rows; every row is indexed, and results do not depend on the centres."""
    spark = vectors.sparkSession
    bound_batches(spark)
    clean = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    rows = vectors.filter(F.col(key).isNotNull() & (F.size(vector) > 0) & clean)
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
    rows = rows.select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda x: whole(F.lit(scale) * x.cast("double"))).alias("vector"), F.coalesce(query, F.lit(False)).alias("asks"))
    total = rows.count()
    share = SAMPLE_ROWS / max(1, total)
    some = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20)).select("vector").limit(2 * SAMPLE_ROWS).toArrow().column("vector").combine_chunks()
    sample = max((m for _, m in by_length(some)), key=len, default=np.zeros((0, 1))) if len(some) else np.zeros((0, 1))
    width = sample.shape[1]
    count = max(1, min(CENTRES, CENTRE_NUMBERS // width, -(-total // shard_rows), len(sample)))
    centres = fit_centres(sample, count) if len(sample) else np.zeros((1, width))

    # group: the nearest centre; rows of another length than most have the last one, always searched
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, far = np.full(batch.num_rows, count), np.full(batch.num_rows, np.inf)
            for own, points in by_length(batch.column("vector")):
                if points.shape[1] == width:
                    group[own], far[own] = nearest(points, centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group, pa.int32()), pa.array(far)], names=[*batch.schema.names, "group", "far"])

    rows = written(rows.mapInArrow(assign, "key long, vector array<double>, asks boolean, group int, far double"), "top-k-rows")
    parts, radius, first = np.zeros(count + 1, np.int64), np.full(count + 1, -np.inf), np.zeros(count + 2, np.int64)
    for r in rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # one row a centre
        parts[r["group"]], radius[r["group"]] = -(-r["n"] // shard_rows), r["far"]
    first[1:] = np.cumsum(parts)
    groups = spark.createDataFrame([(g, int(parts[g]), int(first[g])) for g in range(count + 1)], "group int, parts long, first long")
    shard = (F.col("first") + F.pmod(F.xxhash64("key", F.lit(5)), F.col("parts"))).cast("int").alias("shard")
    stored = rows.join(F.broadcast(groups), "group").select(shard, F.lit(0).alias("kind"), "key", "vector", F.lit(float("-inf")).alias("least"))
    asking = rows.filter("asks").groupBy("key").agg(F.max("vector").alias("vector"))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query: the shards of its first centre, or of all others that can reach its k-th score."""
        for batch in batches:
            for own, points in by_length(batch.column("vector")):
                reach = np.full((len(own), count + 1), -np.inf)
                reach[:, count] = np.inf
                best = np.full(len(own), count)
                if points.shape[1] == width:
                    norm = np.linalg.norm(points, axis=1)
                    with np.errstate(all="ignore"):
                        near = points @ centres.T
                        longest = float(np.abs(centres).max(initial=0)) * width**0.5 + max(0.0, float(radius[:count].max(initial=0)))
                        reach[:, :count] = near + norm[:, None] * radius[:count] + room(norm, longest)[:, None]
                    near[:, parts[:count] == 0] = -np.inf
                    reach[np.isnan(reach)], near[np.isnan(near)] = np.inf, -np.inf
                    best = near.argmax(axis=1)
                least = batch.column("least").to_numpy()[own]
                go = (np.arange(count + 1) == best[:, None]) if batch.column("begin")[0].as_py() else (reach >= least[:, None]) & (np.arange(count + 1) != best[:, None])
                q, g = np.nonzero(go & (parts > 0))
                to = np.repeat(first[g], parts[g]) + np.arange(int(parts[g].sum())) - np.repeat(np.cumsum(parts[g]) - parts[g], parts[g])
                row = pa.array(own[np.repeat(q, parts[g])])
                for at in range(0, len(row), BATCH):
                    part = row.slice(at, BATCH)
                    yield pa.RecordBatch.from_arrays([pa.array(to[at : at + BATCH], pa.int32()), *[batch.column(c).take(part) for c in ("key", "vector", "least")]], names=["shard", "key", "vector", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        trees: dict[int, BallTree] = {}
        now = -1
        for batch in batches:
            shard, kind = (batch.column(c).to_numpy() for c in ("shard", "kind"))
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(shard)], strict=True):
                if a == b:
                    continue
                if shard[a] != now:
                    held, trees, now = {}, {}, shard[a]
                part = batch.slice(a, b - a)
                ids, least = part.column("key").to_numpy(), part.column("least").to_numpy()
                for own, points in by_length(part.column("vector")):
                    size = points.shape[1]
                    if kind[a] == 0:
                        held.setdefault(size, []).append((ids[own], points))
                        continue
                    if size in held:
                        trees[size] = BallTree(*(np.concatenate(x) for x in zip(*held.pop(size), strict=True)), leaf_rows)
                    for i in range(0, len(own) if size in trees else 0, BATCH):
                        some = own[i : i + BATCH]
                        score, hit, _ = trees[size].search(ids[some], points[i : i + BATCH], k, least[some])
                        q, r = np.nonzero(score != none_of(score.dtype))
                        both = [split_score(int(x)) for x in score[q, r]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[some][q]), pa.array(hit[q, r]), pa.array([x for x, _ in both], pa.int64()), pa.array([x for _, x in both], pa.binary())], names=["query_id", "vec_id", "score", "beyond"]
                        )

    def searched(queries: DataFrame, begin: bool) -> DataFrame:
        aimed = queries.select("key", "vector", "least", F.lit(begin).alias("begin")).mapInArrow(aim, "shard int, key long, vector array<double>, least double")
        both = stored.unionByName(aimed.select("shard", F.lit(1).alias("kind"), "key", "vector", "least"))
        # a task takes one shard after the other, so there are no more tasks than the session asks for
        tasks = max(1, min(int(first[-1]), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        spread = both.repartition(tasks, "shard").sortWithinPartitions("shard", "kind")
        return spread.mapInArrow(run, "query_id long, vec_id long, score long, beyond binary")

    nearby = written(searched(asking.withColumn("least", F.lit(float("-inf"))), True), "top-k-home")
    order = "partition by query_id order by score desc, beyond desc, vec_id"
    kth = nearby.withColumn("_no", F.expr(f"row_number() over ({order})")).filter(F.col("_no") == k)
    # a double that is not above the k-th score
    kth = kth.select("query_id", F.when(F.abs("score") < 1 << 52, F.col("score").cast("double")).when(F.col("score") > -LONG, F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15).alias("least"))
    others = asking.join(kth, asking.key == kth.query_id, "left").select("key", "vector", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    hits = nearby.unionByName(searched(others, False))
    best = hits.withColumn("rank", F.expr(f"row_number() over ({order})")).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
