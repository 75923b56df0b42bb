"""Token ids of a corpus in shard files, each a wavelet matrix over the shard's own alphabet.

Documents are range-partitioned by key and sorted, so shards in order hold the ids of all
documents in ascending key order. A shard is one row of a Parquet folder (zstd): its keys, the
length of each document, and one blob (alphabet, bit planes with rank support). A blob answers
access, counting and occurrence look-ups without being unpacked. A task holds one shard at a time."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import library_ids
from .common import forget_units, tidy
from .token_counts import gathered, tokenizer_path
from .wavelet import WaveletMatrix

#: Ids of a shard: it is closed once it has so many (a longer document is a shard by itself).
SHARD_IDS = 1 << 19
_SIZE = struct.Struct("<Q")


def pack_ids(ids: np.ndarray) -> bytes:
    """A shard's blob: the distinct ids in order, then the wavelet matrix of their numbers."""
    seen = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    seen[ids] = True
    alphabet = np.flatnonzero(seen).astype("<u4")
    code = np.zeros(len(seen), np.uint32)
    code[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    matrix = WaveletMatrix.build(code[ids], max(1, (len(alphabet) - 1).bit_length()) if len(alphabet) else 1)
    return _SIZE.pack(len(alphabet)) + alphabet.tobytes() + matrix.to_bytes()


def open_ids(blob: bytes) -> tuple[np.ndarray, WaveletMatrix]:
    """A blob's alphabet and wavelet matrix."""
    (n,) = _SIZE.unpack_from(blob)
    return np.frombuffer(blob, "<u4", n, _SIZE.size), WaveletMatrix.from_bytes(blob[_SIZE.size + 4 * n :])


def write_token_shards(
    docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int | None = 2, shard_ids: int = SHARD_IDS
) -> None:
    """Encodes every whole text with the tokenizers library and writes the shards to `folder`.

    Keys are integers (others are cast to long). Null texts count as empty and hold just the end id. Null keys come first; rows with the same
    key stand side by side, ordered by their text. Other columns are not read. One shuffle (of the
    texts, by range of key); encoding follows it."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_text")).repartitionByRange("_key", "_tie").sortWithinPartitions("_key", "_tie", "_text")
    schema = "part int, seq int, before long, n_ids long, doc_keys array<bigint>, lengths array<int>, blob binary"
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        store, part = library_ids(path), TaskContext.get().partitionId()
        keys: list[int | None] = []
        held: list[bytes] = []
        seq = size = before = 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            row = [[part], [seq], [before], [len(ids)], [keys], [[len(x) // 4 for x in held]], [pack_ids(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["part", "seq", "before", "n_ids", "doc_keys", "lengths", "blob"])

        for batch in gathered((whole.select(["_key", "_text"]) for whole in batches), "_text", 2 << 20):
            for k, ids in zip(batch.column("_key").to_pylist(), store.batch(batch.column("_text").to_pylist()), strict=True):
                keys.append(k)
                held.append(ids + end)
                size += len(held[-1]) // 4
                if size >= shard_ids:
                    yield shard()
                    seq, before, size, keys, held = seq + 1, before + size, 0, [], []
                    tidy()
        if held:
            yield shard()

    rows.mapInArrow(pack, schema).write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(folder)


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shard rows with `start`, the ids of all shards before. Only each partition's total is
    gathered (one row a partition of the writing job)."""
    rows = spark.read.parquet(folder)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("_total"))
    ahead = totals.select(
        F.col("part").alias("_part"),
        F.expr("coalesce(sum(_total) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("_ahead"),
    )
    return rows.join(F.broadcast(ahead), F.col("part") == F.col("_part")).withColumn("start", F.col("_ahead") + F.col("before")).drop("_part", "_ahead")


def read_token_shards(spark: SparkSession, folder: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document from the files: key, start (ids of all documents before it), n_tokens,
    ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit integers), and with_ids: ids."""
    schema = f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_units()
        for batch in batches:
            for i in range(batch.num_rows):
                alphabet, matrix = open_ids(batch.column("blob")[i].as_py())
                ids = alphabet[matrix.decode()]
                n = np.array(batch.column("lengths")[i].as_py(), np.int64)
                ends = np.cumsum(n)
                view = memoryview(ids.tobytes())
                cuts = [(4 * (e - k), 4 * e) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                crc = [zlib.crc32(view[a:b]) for a, b in cuts]
                out = [pa.array(batch.column("doc_keys")[i].as_py(), pa.int64()), pa.array(ends - n + batch.column("start")[i].as_py()), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.array([ids[a // 4 : b // 4].astype(np.int64) for a, b in cuts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names=[key, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return shards(spark, folder).select("doc_keys", "lengths", "blob", "start").mapInArrow(unpack, schema)


def count_ids(spark: SparkSession, folder: str, ids: list[int]) -> DataFrame:
    """How often each of a short list of ids stands in the files: (id, n), by rank queries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                alphabet, matrix = open_ids(batch.column("blob")[i].as_py())
                code = np.searchsorted(alphabet, ids)
                there = [k for k in range(len(ids)) if code[k] < len(alphabet) and alphabet[code[k]] == ids[k]]
                n = matrix.rank(code[there], np.full(len(there), matrix.n))
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in there], pa.int64()), pa.array(n, pa.int64())], names=["id", "n"])

    found = spark.read.parquet(folder).select("blob").mapInArrow(count, "id bigint, n bigint")
    return found.groupBy("id").agg(F.sum("n").alias("n"))


def find_id(spark: SparkSession, folder: str, wanted: int) -> DataFrame:
    """The positions in the whole stream at which an id stands: (at), by select queries."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                alphabet, matrix = open_ids(batch.column("blob")[i].as_py())
                code = int(np.searchsorted(alphabet, wanted))
                if code < len(alphabet) and alphabet[code] == wanted:
                    n = int(matrix.rank(np.array([code]), np.array([matrix.n]))[0])
                    at = matrix.select(code, np.arange(n)) + batch.column("start")[i].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], names=["at"])

    return shards(spark, folder).select("blob", "start").mapInArrow(find, "at bigint")


def ids_at(spark: SparkSession, folder: str, positions: list[int]) -> DataFrame:
    """The ids at a short list of positions of the whole stream: (at, id), by access queries."""
    wanted = np.array(sorted(set(positions)), np.int64)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, n = batch.column("start")[i].as_py(), batch.column("n_ids")[i].as_py()
                at = wanted[(wanted >= start) & (wanted < start + n)]
                if len(at):
                    alphabet, matrix = open_ids(batch.column("blob")[i].as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(alphabet[matrix.access(at - start)].astype(np.int64))], names=["at", "id"])

    return shards(spark, folder).select("blob", "start", "n_ids").mapInArrow(take, "at bigint, id bigint")
