"""Language identification: multinomial naive Bayes over hashed character n-grams.

Single letters and trigrams (a word's ends count as characters) are hashed to a fixed number of
buckets. Counts of all training texts are summed by language and bucket; the matrix of log
probabilities goes to every task, and texts are scored there batch by batch in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, forget_units
from .token_counts import slices

#: Buckets of n-grams, and most entries of the matrix of log probabilities (64 MB): 512 languages with these buckets.
BUCKETS, MOST_ENTRIES = 1 << 15, 1 << 24
#: Characters that are worked on at once, bytes of texts, and scores of texts by language.
PART, SLICE, SCORES = 1 << 18, 512 << 10, 1 << 22


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case form of each code point that is a letter; a space for all others."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def hashed(low: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams about each letter of `low` but its first and last character, and
    where these letters are: a trigram's bucket and the letter's own, alternately."""
    word = np.flatnonzero(low[1:-1] != 32)
    a, b, c = (low[word + i].astype(np.uint64) for i in range(3))
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)
    three, one = mix((a << np.uint64(42)) ^ (b << np.uint64(21)) ^ c), mix(b ^ np.uint64(1 << 62))
    return np.stack([three, one], 1).ravel(), np.repeat(word, 2)


def _codes(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def gram_parts(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of all n-grams of the texts, part by part: short texts together, about PART
    characters at once, and a longer one in parts that know the characters beside them."""
    group: list[int] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        bucket, at = hashed(_codes(" ".join(["", *[texts[i] for i in group], ""])), buckets)
        owner = np.repeat(group, [len(texts[i]) + 1 for i in group])
        return bucket, owner[at]

    for i, x in enumerate(texts):
        if len(x) > PART:
            for at in range(0, len(x), PART):
                bucket, where = hashed(_codes((x[at - 1] if at else " ") + (x[at : at + PART + 1] + " ")[: PART + 1]), buckets)
                yield bucket, np.full(len(where), i)
            continue
        if size + len(x) > PART:
            yield joined()
            group, size = [], 0
        group.append(i)
        size += len(x) + 1
    if group:
        yield joined()


def grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of the texts, and the text that it is in."""
    parts = list(gram_parts(texts, buckets)) or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


@dataclass
class LanguageModel:
    """Names of the languages, their log priors, and log probabilities by language and bucket."""

    names: list[str]
    prior: np.ndarray
    log: np.ndarray

    @property
    def buckets(self) -> int:
        return self.log.shape[1]

    def score(self, texts: list[str]) -> tuple[list[str], list[float], list[float | None]]:
        """The most likely language of each text, its probability, and the mean log likelihood of
        the text's n-grams under the language that gives the highest; `und`, 0 and None where no
        letter. Where no language was learned, texts with letters are as likely as an even draw.
        N-grams are counted by (text, bucket) first; these sparse counts meet one language's row
        after another, so memory grows with the part (PART), not with languages."""
        buckets = self.buckets
        total, size = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), np.int64)
        for bucket, owner in gram_parts(texts, buckets):
            if not len(owner):
                continue
            key, n = np.unique(owner * buckets + bucket, return_counts=True)
            owner, bucket = key // buckets, key % buckets
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            at = owner[starts]
            for k, row in enumerate(self.log):
                total[at, k] += np.add.reduceat(row[bucket] * n, starts)
            size[at] += np.add.reduceat(n, starts)
        letters = size > 0
        even = -float(np.log(buckets))
        likely = total.max(axis=1) / np.maximum(size, 1) if self.names else np.full(len(texts), even)
        likely = [x if ok else None for x, ok in zip(likely.tolist(), letters, strict=True)]
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts), likely
        total += self.prior
        best = total.argmax(axis=1)
        p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.names[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], np.where(letters, p, 0.0).tolist(), likely


def train_language(docs: DataFrame, text: str = "text", lang: str = "lang", alpha: float = 0.1, buckets: int = BUCKETS, most_entries: int = MOST_ENTRIES) -> LanguageModel:
    """The model of all rows whose text and language are not null. Each task sums its own counts;
    only sums by language and bucket are shuffled, and the matrix (at most most_entries numbers)
    comes to the driver. Ties between languages go to the first by name. Rows that repeat count each;
    without rows the model has no names. More than most_entries / buckets languages raise: nothing
    changes with their number."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text")).dropna()
    most = most_entries // buckets
    documents = {r[0]: r[1] for r in rows.groupBy("_lang").count().limit(most + 1).collect()}
    if len(documents) > most:
        raise ValueError(f"more than {most} languages")
    names = sorted(documents)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_units()
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                texts, langs = batch.column("_text").to_pylist(), batch.column("_lang").to_pylist()
                for name in sorted(set(langs)):
                    if name not in held and len(held) >= 64:
                        yield from out()
                        held.clear()
                    n = held.setdefault(name, np.zeros(buckets, np.int64))
                    for bucket, _ in gram_parts([t for t, k in zip(texts, langs, strict=True) if k == name], buckets):
                        n += np.bincount(bucket, minlength=buckets)
        yield from out()

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((len(names), buckets))
    if sums.num_rows:
        place = {x: i for i, x in enumerate(names)}
        n[[place[x] for x in sums.column("lang").to_pylist()], sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    log = np.log((n + alpha) / (n.sum(axis=1, keepdims=True) + alpha * buckets))
    total = sum(documents.values()) or 1
    return LanguageModel(names, np.log([documents[x] / total for x in names]), log.astype(np.float32))


def predict_language(
    docs: DataFrame, model: LanguageModel, text: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score", likely_out: str | None = None
) -> DataFrame:
    """All columns of `docs` and the predicted language and its score (0 to 1), from the whole
    text alone; with likely_out, also the mean log likelihood of the text's n-grams under the
    language that gives the highest. Null texts and such without a letter: `und`, 0, null. The new
    columns replace any of the same names. One narrow pass."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    langs = len(model.names)
    new = [lang_out, score_out, *([likely_out] if likely_out else [])]
    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in new}]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = rows.limit(0).withColumn(lang_out, F.lit("")).withColumn(score_out, F.lit(0.0))
    schema = (schema.withColumn(likely_out, F.lit(None).cast("double")) if likely_out else schema).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_units()
        for whole in batches:
            for batch in slices(whole, text, SLICE, max(1, SCORES // max(1, langs))):
                names, score, likely = shared.value.score([x or "" for x in batch.column(text).to_pylist()])
                found = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(likely, pa.float64())][: len(new)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *new])

    return rows.mapInArrow(predict, schema)
