"""Exact removal of repeated passages: windows of words that also start anywhere else.

Every window has an anchor, the least hash among its shorter runs of words; equal windows have
equal anchors. Neighbouring windows with the same anchor make a span. So only spans whose anchor
occurs twice can hold a repeated window:

* Spans that are equal as a whole are one kind, with the number of its places.
* The kinds of an anchor go to a shard. The shard builds an FM-index (Burrows-Wheeler transform in a
  wavelet matrix) over one copy of each, weighted by its places, streams all its kinds through it from
  the right, and reports the intervals of windows whose matching statistics reach the window's length
  in two places or more. So every repeated window is found by the index, once for all its places.
* An anchor with very many kinds is dealt over several shards; windows that their shard does not find
  twice are then counted over all of them by a hash.
* What is found of a kind holds in all its places: a join.

Windows are judged on the input. Work and shuffles grow with the words, whatever repeats."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cleaned, written
from .fm_index import FMIndex
from .token_counts import slices
from .url_rules import build_filter, possible_hits
from .word_hashes import factors, mixed, word_hashes

#: Words of an anchor; spans of one shard, beyond which an anchor is dealt over several.
ANCHOR, SHARD_SPANS = 10, 2000
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def spans(texts: list[str | None], window: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor, hash of the whole span) of all spans of the texts."""
    words = word_hashes(texts)
    h, owner = words.hashes, words.owner
    q = min(ANCHOR, window)
    n = len(h) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    grams = np.zeros(len(h) - q + 1, np.uint64)
    for i, k in enumerate(factors(q, 11)):
        grams += h[i : i + len(grams)] * k
    grams = mixed(grams)
    start = np.flatnonzero(owner[:n] == owner[window - 1 :])
    view = np.lib.stride_tricks.sliding_window_view(grams, window - q + 1)
    anchor = np.empty(n, np.int64)
    for at in range(0, n, 1 << 16):
        anchor[at : at + (1 << 16)] = view[at : at + (1 << 16)].argmin(axis=1)
    anchor = start + anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    if not len(first):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    count = np.diff(np.append(first, len(start)))
    begin, value = start[first], grams[anchor[first]]
    end = begin + count - 1 + window
    base = 0xD6E8FEB86659FD93
    power, back, total = (np.ones(len(h) + 1, np.uint64) for _ in range(3))
    power[1:], back[1:], total[0] = base, pow(base, -1, 1 << 64), 0
    power, back = np.cumprod(power), np.cumprod(back)
    np.cumsum(h * power[:-1], out=total[1:])
    whole = mixed((total[end] - total[begin]) * back[begin] ^ (count.astype(np.uint64) * factors(1, 13)[0]))
    return owner[begin], begin - words.starts[owner[begin]], count, value, whole


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, row, text): row tells rows apart that share a key."""
    kept = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("_text"))
    return kept.withColumn("row", F.xxhash64("doc", "_text"))


@cleaned
def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """(doc, row, start, windows): runs of repeated windows, written to the shared folder."""
    bound_batches(docs.sparkSession)
    rows = _rows(docs, key, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", 1 << 20):
                of, at, n, anchor, content = spans(batch.column("_text").to_pylist(), window)
                row = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(row), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                    names=["row", "at", "n", "anchor", "content"],
                )

    # rows that repeat key and text are places of their own, so they are kept apart from the start
    found = written(rows.select("row", "_text").mapInArrow(cut, "row long, at int, n int, anchor long, content long"), "spans")
    seen = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("anchor"), "anchors")
    held = written(possible_hits(found, "anchor", build_filter(seen, "anchor")).join(seen, "anchor"), "held-spans")
    kinds = held.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "at", "n")).alias("one"))
    kinds = written(kinds, "kinds")
    groups = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    todo = kinds.join(groups, "anchor").select("anchor", "content", "times", "kinds", "one.row", "one.at", "one.n")
    shards = max(64, -(-todo.count() // SHARD_SPANS))
    salted = F.col("kinds") > SHARD_SPANS
    shard = F.when(salted, F.xxhash64("anchor", F.pmod("content", F.ceil(F.col("kinds") / SHARD_SPANS)))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    todo = written(todo.select("row", "at", "n", "anchor", "content", "times", salted.alias("salted"), shard.alias("shard")), "open-spans")

    carried = ("anchor", "content", "times", "salted", "shard")
    # the words of these spans, as hashes, from the texts that have them
    wanted = todo.groupBy("row").agg(F.collect_list(F.struct("at", "n", *carried)).alias("spans"))
    there = possible_hits(rows.select("row", "_text"), "row", build_filter(todo.select("row").distinct(), "row")).join(wanted, "row")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", 1 << 20):
                words = word_hashes(batch.column("_text").to_pylist())
                lists = batch.column("spans")
                of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
                size = n.astype(np.int64) - 1 + window
                ends = np.cumsum(size)
                take = np.repeat(words.starts[of] + at - (ends - size), size) + np.arange(int(size.sum()))
                got = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(words.hashes[take].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*[flat.field(c) for c in carried], got], names=[*carried, "words"]
                )

    full = there.mapInArrow(fetch, "anchor long, content long, times long, salted boolean, shard long, words array<bigint>")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def shard() -> pa.RecordBatch:
            group = pa.Table.from_batches(held).combine_chunks()
            lists = group.column("words").combine_chunks()
            size = lists.value_lengths().to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy()
            _, code = np.unique(flat, return_inverse=True)
            begin = np.cumsum(size + 1) - size - 1
            symbols = np.zeros(int(size.sum()) + len(size), np.int64)  # 0 ends each span
            inside = np.ones(len(symbols), bool)
            inside[begin + size] = False
            symbols[inside] = code + 1
            salted, times, anchor, content = (group.column(c).to_numpy() for c in ("salted", "times", "anchor", "content"))
            windows = size - window + 1
            of = np.repeat(np.arange(len(size)), windows)
            within = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
            index = FMIndex(symbols, int(size.max()), np.repeat(times, size + 1))
            # a span that is found twice as a whole needs one walk; of others, each window by itself
            twice = index.twice(symbols, begin, size)[of]
            rest = np.flatnonzero(~twice)
            twice[rest] = index.repeated(symbols, begin[of[rest]] + within[rest], window)
            # intervals of windows found twice
            first = twice & ~(np.append(False, twice[:-1]) & np.append(False, of[1:] == of[:-1]))
            last = twice & ~(np.append(twice[1:], False) & np.append(of[1:] == of[:-1], False))
            a, b = np.flatnonzero(first), np.flatnonzero(last)
            # windows of anchors in several shards: a hash, to be counted over all of them
            over = np.flatnonzero(salted[of])
            value = np.zeros(len(over), np.uint64)
            words = np.zeros(len(symbols), np.uint64)
            words[inside] = flat.view(np.uint64)
            for i, k in enumerate(factors(window, 17)):
                value += words[(begin[of] + within)[over] + i] * k
            kind = np.concatenate([of[a], of[over]])
            hashes = pa.array(np.concatenate([np.zeros(len(a), np.int64), mixed(value).view(np.int64)]), mask=np.arange(len(kind)) < len(a))
            return pa.RecordBatch.from_arrays(
                [pa.array(anchor[kind]), pa.array(content[kind]), pa.array(np.concatenate([within[a], within[over]]).astype(np.int32)), pa.array(np.concatenate([b - a + 1, np.ones(len(over), np.int64)]).astype(np.int32)),
                 hashes, pa.array(times[kind]), pa.array(np.concatenate([np.ones(len(a), bool), twice[over]]))],
                names=["anchor", "content", "start", "windows", "window", "times", "twice"],
            )

        now = None
        for batch in batches:
            key = batch.column("shard").to_numpy()
            for a, b in zip([0, *(np.flatnonzero(np.diff(key)) + 1)], [*(np.flatnonzero(np.diff(key)) + 1), len(key)]):
                if a == b:
                    continue
                if held and key[a] != now:
                    yield shard()
                    held = []
                now = key[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield shard()

    kinds_found = "anchor long, content long, start int, windows int, window long, times long, twice boolean"
    hits = written(full.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, kinds_found), "hits")
    # windows of dealt anchors that their own shard has not found twice
    again = hits.filter("window is not null").groupBy("window").agg(F.sum("times").alias("places")).filter("places > 1")
    across = hits.filter("window is not null and not twice").join(again, "window", "left_semi")
    good = hits.filter("window is null").select("anchor", "content", "start", "windows").unionByName(across.select("anchor", "content", "start", "windows"))
    return held.select("row", "at", "anchor", "content").join(good, ["anchor", "content"]).select("row", (F.col("at") + F.col("start")).alias("start"), "windows")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: key (an integer; others are cast to long), n_words, n_removed, kept_sha256, and with_text: the kept
    words joined by one space, and the removed spans (first word, words).

    A word goes if a window of `window` consecutive words that covers it has a word sequence that
    also starts anywhere else, in the same text or another; windows are judged on the input. Null
    texts have no words (the hash of nothing). Texts shorter than a window keep all. Rows that
    repeat a key or a text are places of their own. Other columns are not read."""
    rows = _rows(docs, key, text)
    found = repeated_windows(docs, key, text, window)
    marks = found.groupBy("row").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    joined = rows.join(marks, "row", "left").select("doc", "_text", "runs")
    schema = f"`{key}` long, n_words long, n_removed long, kept_sha256 string" + ", kept string, removed array<struct<first:int,words:int>>" * with_text

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for x, runs in zip(batch.column("_text"), batch.column("runs"), strict=True):
                words = _WORDS.findall((x.as_py() or "").encode("utf-8", "surrogatepass"))
                gone = np.zeros(len(words) + 1, np.int64)
                for r in runs.as_py() or []:
                    gone[r["start"]] += 1
                    gone[r["start"] + r["windows"] - 1 + window] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else b" ".join(words)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                for o, v in zip(out, (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), [{"first": int(a), "words": int(b - a)} for a, b in edges.reshape(-1, 2)]), strict=True):
                    o.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))]
            n = 5 if with_text else 3
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *[pa.array(o, k) for o, k in zip(out[:n], kinds, strict=False)]], names=[key, "n_words", "n_removed", "kept_sha256", "kept", "removed"][: n + 1])

    return joined.mapInArrow(take, schema)
