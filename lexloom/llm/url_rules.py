"""URL rules: a blocked Bloom filter over the listed keys passes possible hits to an exact join.

A rule names a host and a path prefix and fits the host and all its subdomains. A URL's possible
keys are its host's suffixes with each prefix of its path that is as long as some rule's path. The
filter has a size limit whatever the list's length; past it, more false hits reach the join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, forget_units

#: Words of 64 bits in a block, bits set for a key, bits a key, most bytes of a filter.
BLOCK_WORDS, KEY_BITS, BITS_A_KEY, MOST_BYTES = 8, 8, 16, 8 << 20


class BlockedBloom:
    """All bits of a key lie in one 512-bit block: one cache line a test."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def sized(cls, keys: int) -> BlockedBloom:
        blocks = -(-max(1, keys) * BITS_A_KEY // (64 * BLOCK_WORDS))
        return cls(np.zeros((min(blocks, MOST_BYTES // (8 * BLOCK_WORDS)), BLOCK_WORDS), np.uint64))

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = hashes.astype(np.int64).view(np.uint64)
        block = ((h >> np.uint64(32)) % np.uint64(len(self.words))).astype(np.int64)
        step = (h & np.uint64(0xFFFF)) | np.uint64(1)
        bit = ((h >> np.uint64(16)) & np.uint64(0xFFFF))[:, None] + step[:, None] * np.arange(KEY_BITS, dtype=np.uint64)
        bit &= np.uint64(64 * BLOCK_WORDS - 1)
        return block[:, None], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    def add(self, hashes: np.ndarray) -> None:
        block, word, bit = self.places(hashes)
        np.bitwise_or.at(self.words, (np.broadcast_to(block, word.shape), word), bit)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        block, word, bit = self.places(hashes)
        return ((self.words[block, word] & bit) != 0).all(axis=1)


def build_filter(listed: DataFrame, key: str) -> BlockedBloom:
    """The filter of all keys of a list: parts by task, joined block range by block range. What
    reaches the driver is the filter, at most MOST_BYTES."""
    hashes = listed.select(F.xxhash64(key).alias("h")).filter(F.col(key).isNotNull())
    whole = BlockedBloom.sized(hashes.count())
    span = 4096

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_units()
        own = BlockedBloom(np.zeros_like(whole.words))
        for batch in batches:
            own.add(batch.column("h").to_numpy())
        at = [i for i in range(0, len(own.words), span) if own.words[i : i + span].any()]
        if at:
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([own.words[i : i + span].tobytes() for i in at], pa.binary())], names=["at", "bits"])

    def joined(group: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint64) for x in group.column("bits").to_pylist()])
        return pa.table({"at": group.column("at")[:1], "bits": [bits.tobytes()]})

    for row in hashes.mapInArrow(part, "at long, bits binary").groupBy("at").applyInArrow(joined, "at long, bits binary").collect():
        held = np.frombuffer(row.bits, np.uint64).reshape(-1, BLOCK_WORDS)
        whole.words[row["at"] : row["at"] + len(held)] = held
    return whole


def possible_hits(rows: DataFrame, key: str, bloom: BlockedBloom) -> DataFrame:
    """The rows whose key the filter may hold. Null keys go."""
    held = rows.filter(F.col(key).isNotNull()).withColumn("_hash", F.xxhash64(key))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(bloom.has(batch.column("_hash").to_numpy())))

    return held.mapInArrow(keep, held.schema).drop("_hash")


def listed_rows(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """The rows whose key is listed: filter first, then an exact hash join. Repeated list entries
    count once; Spark sends the list to all tasks only below its own size limit."""
    exact = listed.select(key).filter(F.col(key).isNotNull()).distinct()
    return possible_hits(rows, key, build_filter(exact, key)).join(exact, key, "left_semi")


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, a leading `www.`, a final `/`, query and fragment; null where
    nothing is left."""
    both = F.concat(F.regexp_replace(url_host(url), "^www\\.", ""), F.regexp_replace(url_path(url), "/$", ""))
    return F.when(both != "", both)


def listed_pages(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """The pages whose canonical URL is that of a listed URL (column `url` of `listed`)."""
    own = pages.withColumn("_canonical", canonical_url(F.col(url)))
    return listed_rows(own, listed.select(canonical_url(F.col("url")).alias("_canonical")), "_canonical").drop("_canonical")


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: key, host, path, rule (host and path of the longest rule that fits, else
    null), verdict (the rule's, else `default`).

    rules: host, path, verdict; rows with a null are no rules, and of rules with the same host and
    path the first verdict by name holds. Null URLs and such without `://` have an empty host and
    path and fit no rule but one for the empty host. Repeated pages are judged each. Each different
    host and path is judged once: shuffles carry these, never the pages' other columns."""
    rules = rules.dropna(subset=["host", "path", "verdict"]).groupBy(F.translate("host", UPPER, LOWER).alias("_h"), F.col("path").alias("_p")).agg(F.min("verdict").alias("_verdict"))
    rules = rules.select(F.concat("_h", F.lit("\n"), "_p").alias("_rule_key"), F.concat("_h", "_p").alias("_rule"), "_verdict", F.length("_p").alias("_n"))
    sizes = sorted(r[0] for r in rules.select("_n").distinct().collect())  # no more than lengths of paths
    own = pages.select(F.col(key), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    sites = own.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("path")) if sizes else F.array().cast("array<int>")
    heads = F.transform(heads, lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = sites.select("host", "path", F.explode(suffixes).alias("_suffix"), heads.alias("_heads"))
    keys = keys.select("host", "path", F.explode("_heads").alias("_head"), "_suffix")
    keys = keys.select("host", "path", F.concat("_suffix", F.lit("\n"), "_head").alias("_rule_key"))
    hits = possible_hits(keys, "_rule_key", build_filter(rules, "_rule_key")).join(rules, "_rule_key")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("_rule").alias("n"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))).alias("_best"))
    out = own.join(best, ["host", "path"], "left")
    return out.select(key, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
