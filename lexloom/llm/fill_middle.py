"""Fill-in-the-middle: each text as prefix, suffix and middle between sentinels, cut between units.

A first scan of a byte automaton (`byte_automaton`) over each batch of texts counts, by the marks of
its transitions, the units, the code points and the sentinels of each text. A second pass goes
through the marks of the texts that are to be cut and finds the bytes where the drawn units begin.
One narrow pass over the table: no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_automaton import BREAK, CHAR, SENTINEL, UNIT, automaton, scan
from .common import bound_batches
from .token_counts import gathered

#: Of the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")


def drawn(key: Column, seed: int, n: int = 4) -> Column:
    """n numbers below 2^32 of a key (at most 8): the groups of 8 digits in the SHA-256 of `seed:key`."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)])


def cut(texts: list[bytes], draws: np.ndarray, rate: int, spm: int, sentinels: tuple[str, ...]) -> tuple:
    """(units, form, code points of the prefix, of the middle (-1: not cut), output) of each text. draws: four numbers a row."""
    p, s, m = (x.encode() for x in sentinels)
    table = automaton(sentinels)
    joined = b"".join([bytes([BREAK]), *(x + bytes([BREAK]) for x in texts)])
    marks = scan(np.frombuffer(joined, np.uint8), table)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size + 1) - size
    # first pass: transitions of each text, by mark (the break after it has none, so no segment is empty)
    count = lambda mark: np.add.reduceat((marks & mark) > 0, start, dtype=np.int64)
    units, held = count(UNIT), count(SENTINEL)
    plain = (size == 0) | (held > 0) | (draws[:, 2] % 100 >= rate)
    spm_form = draws[:, 3] % 100 < spm
    # second pass: where the drawn units of the texts that are cut begin
    begins = np.append(np.flatnonzero(marks & UNIT), 0)
    ends = draws[:, :2] % (units + 1)[:, None]
    ends.sort(axis=1)
    first = np.cumsum(units) - units
    at = np.where(ends < units[:, None], begins[np.minimum(first[:, None] + ends, len(begins) - 1)], (start + size)[:, None])
    edges = np.column_stack([start, at, start + size])
    char_marks = (marks & CHAR).astype(bool)
    forms, before, middle, out = [], [], [], []
    for i, text in enumerate(texts):
        if plain[i]:
            forms.append("plain")
            before.append(-1)
            middle.append(-1)
            out.append(text)
            continue
        a, b, c, d = edges[i].tolist()
        forms.append("spm" if spm_form[i] else "psm")
        before.append(int(np.count_nonzero(char_marks[a:b])))
        middle.append(int(np.count_nonzero(char_marks[b:c])))
        parts = (s, joined[c:d], p, joined[a:b], m, joined[b:c]) if spm_form[i] else (p, joined[a:b], s, joined[c:d], m, joined[b:c])
        out.append(b"".join(parts))
    return units, forms, np.array(before), np.array(middle), out


def fill_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """One row per row of `docs`: the key, n_units (lines), form, prefix_chars, middle_chars, output.

    rate: percent of the texts that are cut; spm: percent of these whose suffix comes first. Of n units the
    smaller of two drawn numbers up to n end in the prefix, those up to the larger one in the middle.
    A text that is empty, holds a sentinel or is not drawn stays as it is: form `plain`, counts null.
    Null texts count as empty. Draws depend on the key and the seed only, so rows that repeat a key draw
    alike; a null key draws as an empty one. Other columns are not read."""
    bound_batches(docs.sparkSession)
    if any(x[:i] == x[-i:] for x in sentinels for i in range(1, len(x))):
        raise ValueError("a sentinel may not begin as it ends, else an output can be read in two ways")
    automaton(sentinels)  # refuses sentinels that cannot be told apart
    kept = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), drawn(F.col(key), seed).alias("_draws"))
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("n_units", T.LongType()), T.StructField("form", T.StringType())]
    fields += [T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "_text", 4 << 20):
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            draws = np.asarray(batch.column("_draws").flatten()).reshape(len(texts), 4)
            units, forms, before, middle, out = cut(texts, draws, rate, spm, sentinels)
            chars = [pa.array(x, pa.int64(), mask=x < 0) for x in (before, middle)]
            columns = [batch.column("_key"), pa.array(units, pa.int64()), pa.array(forms, pa.string()), *chars, pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return kept.mapInArrow(work, T.StructType(fields))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from."""
    p, s, m = sentinels

    def between(left: str, right: str | None) -> Column:
        begin = F.locate(left, output) + len(left)
        tail = F.substring(output, begin, F.length(output))
        return F.substring(tail, F.lit(1), F.locate(right, tail) - 1) if right else tail

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
