"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

`token_prefixes` gives each text's number of tokens and, as little-endian int16 steps, by how much
each character changes it; the sum of the first n steps is the count that the tokenizers library
gives for the first n characters. So `token_budget` answers questions of
truncation and budgets without encoding again. The work is one narrow pass: no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import prefix_counts


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, column: str, most: int = 16 << 20, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `rows` rows whose texts have about `most` bytes; a longer text is
    a part of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    at = 0
    for end in [*(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]:
        for first in range(at, end, rows):
            yield batch.slice(first, min(rows, end - first))
        at = end
    pa.default_memory_pool().release_unused()  # several workers share an executor's memory


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined or cut so that each has texts of about `most` bytes: work that looks each different
    word of a batch up once wants large ones."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for batch in slices(whole, column, most):
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()
        yield from joined


def token_prefixes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, keep_steps: bool = True
) -> DataFrame:
    """One row per row of `docs`: the key, n_bytes (UTF-8), n_tokens and, with keep_steps, steps.

    Null texts count as empty: 0 bytes, 0 tokens, no steps. Null and repeated keys pass through.
    Special strings in a text are one token each, as the library has it. Other columns of `docs`
    are not read. path: a byte-level BPE file on every executor (None: the installed one)."""
    path = path or tokenizer_path()
    kept = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = [kept.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("steps", T.BinaryType())] * keep_steps

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_counts(path)
        for batch in gathered(batches, "_text", 16 << 20):
            texts = batch.column("_text").to_pylist()
            steps = table.batch(texts)
            out = [batch.column(key), pa.array([len(x.encode()) for x in texts], pa.int64())]
            out.append(pa.array([int(np.frombuffer(x, "<i2").sum(dtype=np.int64)) for x in steps], pa.int64()))
            out += [pa.array(steps, pa.binary())] * keep_steps
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return kept.mapInArrow(count, T.StructType(fields))
