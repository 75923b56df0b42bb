"""Toxicity categories by a chain of linear classifiers.

Each category's logistic model sees which words of a learned vocabulary a text has, and the
probabilities that the models before it in the chain give. In training these probabilities are
out of fold: each comes from a model that has not seen the row. Words are chosen by how much more
often they stand in rows of a category. Training rows are a bounded sample; every text is scored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cleaned, written
from .near_dup import near_duplicates
from .token_counts import slices

#: Defaults: most rows of the training sample, most words of the vocabulary.
SAMPLE_ROWS, WORDS = 12_000, 4096
#: Fewest rows that a word is in, folds.
FEWEST_ROWS, FOLDS = 5, 3
#: Words of a shingle and the similarity (percent) of near copies in the training sample.
SHINGLE, NEAR = 5, 80
#: Lengths of the beginnings of words that count as words.
STEMS = (5, 6, 7)
#: Least surprise (chi-square) of a word of the vocabulary.
SURPRISE = 20.0
EDGES = ".,;:!?()[]{}\"'`´*#$%&|<>=+-_/\\~^@…«»“”‘’"


def words_of(text: str | None) -> set[str]:
    """The different words of a whole text, lower-cased, without marks at their ends, and the
    beginnings of longer words (marked `^`): a stem shows in forms that training has not seen."""
    words = {w.strip(EDGES) for w in set((text or "").lower().split())} - {""}
    return words.union(*({"^" + w[:k] for w in words if len(w) > k} for k in STEMS))


@dataclass
class Chain:
    """Categories in order, the vocabulary, and each category's weights (bias, words, earlier ones)."""

    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Row by category."""
        found = [[self.vocabulary[w] for w in words_of(x) & self.vocabulary.keys()] for x in texts]
        rows = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        at = np.array([i for x in found for i in x], np.int64)
        return self.run(rows, at, len(texts))

    def run(self, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.weights)))
        for c, w in enumerate(self.weights):
            out[:, c] = predicted(w, rows, at, out[:, :c], len(self.vocabulary))
        return out


def predicted(w: np.ndarray, rows: np.ndarray, at: np.ndarray, earlier: np.ndarray, words: int) -> np.ndarray:
    z = w[0] + np.bincount(rows, weights=w[1 + at], minlength=len(earlier)) + earlier @ w[1 + words :]
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: np.ndarray, at: np.ndarray, earlier: np.ndarray, y: np.ndarray, words: int, penalty: float = 1.0, steps: int = 300) -> np.ndarray:
    """Logistic regression with an L2 penalty, by accelerated gradient steps."""
    n, w = len(y), np.zeros(1 + words + earlier.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    width = np.bincount(rows, minlength=n).max(initial=0) + earlier.shape[1] + 1
    rate, last = 4.0 / (width * n / 4 + penalty), w
    rate = min(rate, 4.0 / (max(1, np.bincount(at, minlength=words).max(initial=1)) + n * 0.25 + penalty) * 8)
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - last)
        off = predicted(ahead, rows, at, earlier, words) - y
        slope = np.concatenate([[off.sum()], np.bincount(at, weights=off[rows], minlength=words), earlier.T @ off])
        slope[1:] += penalty * ahead[1:]
        last, w = w, ahead - rate * slope
    return w


def out_of_fold(row: np.ndarray, at: np.ndarray, earlier: np.ndarray, y: np.ndarray, fold: np.ndarray, words: int) -> np.ndarray:
    """Each row's probability by a model of the rows of all other folds."""
    out = np.zeros(len(y))
    for f in range(FOLDS):
        inside = fold != f
        number = np.cumsum(inside) - 1
        use = inside[row]
        w = fit(number[row[use]], at[use], earlier[inside], y[inside], words)
        out[~inside] = predicted(w, row, at, earlier, words)[~inside]
    return out


@cleaned
def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(words, each category): the sample that a chain is learned from.

    Rows whose key hashes below sample_rows / rows, so about `sample_rows` rows at most, the same ones
    on each run. Rows with a null key, label or text are not used; of labels that repeat a key the
    greatest counts. Of near copies (five-word shingles, similarity 0.8 on the full sets) with the same
    labels, the one with the smallest key stays: else the words of a text with many copies look telling.
    Rows that repeat a key and a text count once."""
    own = labels.select(F.col(key).alias("_key"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    own = own.groupBy("_key").agg(*[F.max(c).alias(c) for c in categories])
    share = min(1.0, sample_rows / max(1, own.count()))
    own = own.filter((F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) / F.lit(1 << 20)) < share) if share < 1 else own
    seen = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).dropna().join(own, "_key")

    kept = written(seen.select("_key", "_text", *categories).distinct().withColumn("_row", F.monotonically_increasing_id()), "labelled")
    groups = near_duplicates(kept, key="_row", text="_text", words=SHINGLE, percent=NEAR).select("_row", "component_id")
    first = kept.join(groups, "_row").groupBy("component_id", *categories).agg(F.min(F.struct("_key", "_row")).alias("_first"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", 1 << 20):
                held = pa.array([sorted(words_of(x)) for x in batch.column("_text").to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([held, *[batch.column(c) for c in categories]], names=["words", *categories])

    rows = kept.join(first.select("_first._row"), "_row", "left_semi").select("_text", *categories)
    return rows.mapInArrow(split, "words array<string>, " + ", ".join(f"`{c}` int" for c in categories))


def train_chain(
    docs: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, vocabulary_words: int = WORDS
) -> Chain:
    """Learns a chain from rows of `labels` (key and a 0/1 column for each category, in the chain's
    order) that have a text, by a bounded sample of about `sample_rows` of them (`training_rows`) and
    the `vocabulary_words` most telling of their words. Without rows of both kinds a category's
    probability is constant."""
    rows = written(training_rows(docs, labels, categories, key, text, sample_rows).withColumn("_fold", F.pmod(F.xxhash64("words"), F.lit(FOLDS)).cast("int")), "training")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    n = totals["n"]
    word = rows.select(F.explode("words").alias("word"), *categories).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories])

    def surprise(c: str):  # squared deviation from the rate of the category, in units of its variance
        rate = (totals[c] or 0) / max(1, n)
        spread = max(rate * (1 - rate), 1e-9)
        return F.pow(F.col(c) - F.col("n") * F.lit(rate), F.lit(2)) / (F.col("n") * F.lit(spread))

    strong = word.filter(F.col("n") >= FEWEST_ROWS).withColumn("_s", F.greatest(*[surprise(c) for c in categories], F.lit(0.0)))
    chosen = strong.filter(F.col("_s") >= SURPRISE).orderBy(F.desc("_s"), "word").limit(vocabulary_words).select("word").collect()
    vocabulary = {r[0]: i for i, r in enumerate(chosen)}
    listed = F.array_intersect("words", F.lit(list(vocabulary))) if vocabulary else F.array().cast("array<string>")
    data = rows.select(listed.alias("words"), "_fold", *categories).toArrow().combine_chunks()
    chain = Chain(list(categories), vocabulary)
    lists = data.column("words").combine_chunks() if data.num_rows else pa.array([], pa.list_(pa.string()))
    row = np.repeat(np.arange(data.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    at = pc.index_in(lists.flatten(), pa.array(list(vocabulary), pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    fold = data.column("_fold").to_numpy().astype(np.int64)
    earlier = np.zeros((data.num_rows, 0))
    for c in categories:
        y = data.column(c).to_numpy().astype(float)
        out = out_of_fold(row, at, earlier, y, fold, len(vocabulary))
        chain.weights.append(fit(row, at, earlier, y, len(vocabulary)))
        earlier = np.column_stack([earlier, out])
    return chain


def predict_chain(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key and p_<category> for each category. Null and empty texts are
    texts without words. One narrow pass; the model is bounded by its vocabulary."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    names = [key, *[f"p_{c}" for c in chain.categories]]
    schema = rows.select(F.col(key), *[F.lit(0.0).alias(c) for c in names[1:]]).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                p = shared.value.probabilities(batch.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(x) for x in p.T]], names=names)

    return rows.mapInArrow(predict, schema)
