"""Quality rules by tokenizer fertility: how public vocabularies cut a text.

Each vocabulary gives a text three measures: characters per token, the share of tokens that stand
for single bytes (a piece the vocabulary does not have), and how evenly tokens are used (entropy).
A language's (or script's) rejection bands follow from the quartiles of each measure over all its
texts, so that they fit any language. Words, symbols, repeated lines and
repeated windows, the plain rules that come before, are counted in the same pass."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import byte_letters
from .common import bound_batches, cleaned, written
from .hot_keys import join_to_one
from .token_counts import gathered, tokenizer_path
from .word_hashes import mixed, word_hashes

#: Files of the installed vocabularies that measure: bytes' pairs of many languages, pieces with byte fallback.
VOCABULARIES = ("byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model")
MEASURES = ("chars_per_token", "byte_share", "entropy")
SYMBOLS = b"#*$%&|<>"
#: Letters of a script lie between these code points (from Unicode's blocks); fixed values.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}


def script_of(text: Column) -> Column:
    """The script of most of a text's letters (a tie: the first by SCRIPTS); `None` without a known letter."""
    names = list(SCRIPTS)
    letters = ["[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in SCRIPTS[n]) + "]" for n in names]
    counts = [F.length(text) - F.length(F.regexp_replace(text, x, "")) for x in letters]
    most = F.greatest(*counts)
    return F.when(most > 0, F.element_at(F.array(*map(F.lit, names)), F.array_position(F.array(*counts), most).cast("int"))).otherwise("None")


class Pieces:
    """The library's ids for whole texts of a vocabulary file; single: which ids stand for one byte."""

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
            library = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.single = np.zeros(max(ranks.values()) + 1, bool)
            # a byte of ASCII is a character; one above is a part of a character that no token covers
            self.single[[i for t, i in ranks.items() if len(t) == 1 and t[0] > 127]] = True
            self.ids = library.encode_ordinary
        elif path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.single = np.array([library.is_byte(i) for i in range(library.get_piece_size())])
            # a line feed has no piece of its own and is no gap of the vocabulary
            self.single[[i for i in range(len(self.single)) if self.single[i] and int(library.id_to_piece(i)[1:-1], 16) < 128]] = False
            self.ids = lambda text: library.encode(text, num_threads=1)
        else:
            import tokenizers

            library = tokenizers.Tokenizer.from_file(path)
            library.encode_special_tokens = True
            self.single = np.zeros(library.get_vocab_size(), bool)
            letters = byte_letters()  # the vocabulary's letter for each byte
            self.single[[i for t, i in library.get_vocab().items() if letters.get(t, 0) > 127]] = True
            self.ids = lambda text: library.encode(text, add_special_tokens=False).ids

    def measures(self, texts: list[str], chars: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tokens, characters per token, share of single bytes, entropy from 0 to 1) of each text; nan where
        there is no token. Entropy is Shannon's of the text's token counts over that of as many different tokens."""
        n = len(texts)
        lists = [np.array(self.ids(t), np.int64) for t in texts]
        count = np.fromiter(map(len, lists), np.int64, n)
        ids = np.concatenate([*lists, np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(n), count)
        single = np.bincount(owner, weights=self.single[ids], minlength=n)
        pairs, times = np.unique(owner * len(self.single) + ids, return_counts=True)
        spread = np.bincount(pairs // len(self.single), weights=times * np.log2(times), minlength=n)
        with np.errstate(divide="ignore", invalid="ignore"):
            whole = np.log2(count)
            entropy = np.where(count > 1, (whole - spread / count) / whole, 1.0)
            return count, np.where(count > 0, chars / count, np.nan), np.where(count > 0, single / count, np.nan), np.where(count > 0, entropy, np.nan)


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def repeated_lines(text: str) -> int:
    """Lines (split at line feeds) that hold a word and equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def plain_counts(texts: list[str], window: int = 5) -> tuple[np.ndarray, ...]:
    """(characters, words, characters in words, symbols, repeated lines, words in windows found twice) of each text."""
    n = len(texts)
    raw = [x.encode() for x in texts]
    data = np.frombuffer(b"".join([*(x + b"\n" for x in raw)]), np.uint8)
    size = np.fromiter(map(len, raw), np.int64, n)
    start = np.cumsum(size + 1) - size - 1
    whole = (data & 0xC0) != 0x80
    sums = lambda marks: np.add.reduceat(marks, start, dtype=np.int64) if n else np.zeros(0, np.int64)
    words = word_hashes(texts)
    count = np.diff(words.starts)
    lines = np.fromiter(map(repeated_lines, texts), np.int64, n)
    repeats = np.zeros(n, np.int64)
    h, owner = words.hashes, words.owner
    if len(h) >= window:
        first = np.flatnonzero(owner[: len(h) - window + 1] == owner[window - 1 :])
        value = owner[first].astype(np.uint64)
        for i in range(window):
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + h[first + i])
        _, of, times = np.unique(value, return_inverse=True, return_counts=True)
        edges = np.zeros(len(h) + 1, np.int64)
        found = first[times[of] > 1]
        edges[found] += 1
        np.subtract.at(edges, found + window, 1)
        repeats = np.bincount(owner, weights=np.cumsum(edges[:-1]) > 0, minlength=n).astype(np.int64)
    return sums(whole) - 1, count, sums(whole & ~_BLANK[data]), sums(_SYMBOL[data]), lines, repeats


def fertility_measures(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str | None = "lang", paths: list[str] | None = None) -> DataFrame:
    """One row per row of `docs`: the key, language (that column, else the script), n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words and, for vocabulary i from 0, tokens_i, chars_per_token_i, byte_share_i, entropy_i.

    Whole texts are measured. Null texts count as empty and have null measures. Null and repeated keys
    pass through. language: a column of `docs` (None: the script alone); its nulls take the script.
    paths: vocabulary files on every executor (.tiktoken, .model, .json). One narrow pass."""
    bound_batches(docs.sparkSession)
    paths = paths or [tokenizer_path(x) for x in VOCABULARIES]
    body = F.coalesce(F.col(text), F.lit(""))
    group = F.coalesce(F.col(language).cast("string"), script_of(body)) if language else script_of(body)
    kept = docs.select(F.col(key).alias("_key"), group.alias("_group"), body.alias("_text"))
    long, real = T.LongType(), T.DoubleType()
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("language", T.StringType())]
    fields += [T.StructField(c, long) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    for i in range(len(paths)):
        fields += [T.StructField(f"tokens_{i}", long), *(T.StructField(f"{m}_{i}", real) for m in MEASURES)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "_text", 4 << 20):
            texts = batch.column("_text").to_pylist()
            chars, *counts = plain_counts(texts)
            columns = [batch.column("_key"), batch.column("_group"), *(pa.array(c, pa.int64()) for c in counts)]
            for path in paths:
                tokens, *found = pieces(path).measures(texts, chars)
                columns += [pa.array(tokens, pa.int64()), *(pa.array(x, pa.float64(), mask=np.isnan(x)) for x in found)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return kept.mapInArrow(measure, T.StructType(fields))


def size_class() -> Column:
    """The binary order of a text's tokens in the first vocabulary: measures depend on the size."""
    return F.when(F.col("tokens_0") > 0, F.floor(F.log2("tokens_0")).cast("int")).otherwise(-1)


def rejection_bands(
    measured: DataFrame, by: list[str], names: list[str], fences: float = 3.0, low: float = 0.2, high: float = 1.0, share: float | None = None
) -> DataFrame:
    """For each group (`by`): texts and, for each measure of `names`, middle_, low_ and high_, outside of which a text is rejected.

    A band ends `fences` interquartile ranges beyond the quartiles, but at least `low` of the median below it and
    `high` of the median above it, so many equal texts do not narrow it to nothing. Of shares of bytes these are parts of 1,
    and above the median it is `share` (None: `high`), since a share is never more than 1. Quartiles are approximate by at most a thousandth of the group's rows; sketches are merged
    before the shuffle, so a group may hold any part of all rows."""
    found = measured.filter("tokens_0 > 0").groupBy(*by)
    found = found.agg(F.count(F.lit(1)).alias("texts"), *[F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(m) for m in names])
    out = []
    for m in names:
        first, middle, third = (F.col(m)[i] for i in range(3))
        gap, of_bytes = fences * (third - first), m.startswith("byte_share")
        unit, above = (F.lit(1.0), high if share is None else share) if of_bytes else (middle, high)
        out += [middle.alias(f"middle_{m}"), F.least(first - gap, middle - low * unit).alias(f"low_{m}"), F.greatest(third + gap, middle + above * unit).alias(f"high_{m}")]
    return found.select(*by, "texts", *out)


@cleaned
def fertility_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", language: str | None = "lang", paths: list[str] | None = None,
    fences: float = 3.0, low: float = 0.2, high: float = 1.0, room: float = 1.0, fewest_words: int = 10, repeat_percent: int = 20, share: float = 0.2,
) -> DataFrame:
    """Every row's measures, base_failed, the measures outside their band (`reasons`, empty for most) and kept.

    base_failed: fewer than `fewest_words` words, or more than `repeat_percent` percent of the words in
    five-word windows found twice. Characters per token (both sides) and shares of single bytes (too many) are
    held against the bands of the text's language; as a mean over n tokens varies, a text of n tokens may
    lie room / sqrt(n) of the median (of 1 for shares) further out. Entropy depends on the size: it is held
    against texts of the language with as many tokens, up to a factor of two, and rejects where it is too low.
    A text without a token has no measure outside; an empty table gives an empty one. One pass over
    texts; what it measures (numbers alone) is written, bands are one small row a language and size. See
    `fertility_measures` and `rejection_bands`."""
    n = len(paths) if paths else len(VOCABULARIES)
    measured = written(fertility_measures(docs, key, text, language, paths).withColumn("size_class", size_class()), "measures")
    means, spreads = [f"{m}_{i}" for i in range(n) for m in MEASURES[:2]], [f"{MEASURES[2]}_{i}" for i in range(n)]
    bands = written(rejection_bands(measured, ["language"], means, fences, low, high, share), "bands")
    sized = written(rejection_bands(measured, ["language", "size_class"], spreads, fences, low, high), "bands")
    held = join_to_one(measured, bands, {"language": "language"}, "texts", "left")
    held = join_to_one(held, sized, {"language": "language", "size_class": "size_class"}, "texts", "left")
    out = []
    for i in range(n):
        per, share, spread = (f"{m}_{i}" for m in MEASURES)
        wide = room / F.sqrt(f"tokens_{i}")
        off = F.col(f"middle_{per}") * wide
        out += [F.when((F.col(per) < F.col(f"low_{per}") - off) | (F.col(per) > F.col(f"high_{per}") + off), per)]
        out += [F.when(F.col(share) > F.col(f"high_{share}") + wide, share), F.when(F.col(spread) < F.col(f"low_{spread}"), spread)]
    failed = (F.col("n_words") < fewest_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    held = held.withColumn("base_failed", failed).withColumn("reasons", F.array_compact(F.array(*out)))
    bounds = [c for c in (*bands.columns, *sized.columns) if c.startswith(("low_", "middle_", "high_"))]
    return held.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).drop("size_class", *bounds)
