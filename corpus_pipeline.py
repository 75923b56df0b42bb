"""A corpus pipeline of five stages: from `documents` to token shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. `run`
writes what a stage returns to the shared folder and reads it again for the next one, so a lost
executor costs one stage's tasks at most. All stages but the last return the columns of
`documents`. Each row is a document of its own: the stages decide by row, not by doc_id, which may
repeat or be null."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import scratch_path, table, written
from lexloom.llm.decontam import contaminated
from lexloom.llm.language import predict_language, train_language
from lexloom.llm.mixing import marks, mix_plan, repeated, words_in
from lexloom.llm.near_dup import near_duplicates
from lexloom.llm.token_store import read_token_shards, write_token_shards


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under names c0, c1, ... and the name that each column of `documents` has there: so no column of
    theirs, however it is called, meets one that a stage makes."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(reversed(docs.columns), reversed(names), strict=True))


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of `numbered` documents under their own names."""
    return rows.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


#: Score from which a prediction replaces a `lang` that it contradicts.
SURE = 0.99
#: How far (in nats an n-gram) a text may fall below an even draw of n-gram buckets. Clean text lies
#: nats above the even draw, random letters below; a model of a few hundred letters rejects nothing.
SLACK = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language and names it in `lang`.

    The model is learned from all rows with a `lang` and a letter. A text goes if it is null, has no
    letter, or is less likely under every learned language than an even draw (SLACK). `lang` becomes
    the prediction where it is null, or where the prediction differs with a score of SURE or more.
    Where nothing could be learned, all texts with a letter stay as they are."""
    rows, c = numbered(docs)
    model = train_language(rows.filter(F.col(c["text"]).rlike(r"\p{L}")), c["text"], c["lang"])
    found = predict_language(rows, model, c["text"], lang_out="_pred", score_out="_score", likely_out="_likely")
    found = found.filter(F.col("_likely") >= -math.log(model.buckets) - SLACK)
    if model.names:
        given = F.when(F.col("_score") < SURE, F.col(c["lang"]))
        found = found.withColumn(c["lang"], F.coalesce(given, F.col("_pred")))
    return named(found, docs)


#: Most files whose names go to all tasks.
MOST_FILES = 100_000


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own (`_row`) and a hash of all columns (`_hash`). Rows of Parquet files have
    the number of their file and their place in it, which are the same however often they are read; other
    rows (and those of more than MOST_FILES files) are numbered once and written."""
    whole = F.xxhash64(*docs.columns).alias("_hash")
    try:
        placed = docs.select("*", whole, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_index"))
        files = [r[0] for r in docs.select(F.col("_metadata.file_path")).distinct().limit(MOST_FILES + 1).collect()]
    except AnalysisException:  # no file's rows
        files = None
    if files is None or len(files) > MOST_FILES:
        return written(docs.select("*", whole, F.monotonically_increasing_id().alias("_row")), "keyed")
    names = docs.sparkSession.createDataFrame(list(enumerate(sorted(files))), "_file long, _path string")
    row = F.col("_file") * (1 << 40) + F.col("_index")
    return placed.join(F.broadcast(names), "_path").withColumn("_row", row).select(*docs.columns, "_hash", "_row")


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, similarity 0.8): the one with
    the smallest id, null ids last. Each row counts by its own text, whatever its id."""
    rows, c = numbered(docs)
    rows = keyed(rows)
    groups = near_duplicates(rows, key="_row", text=c["text"], words=5, percent=80).select("_row", "component_id")
    order = F.struct(F.col(c["doc_id"]).isNull(), c["doc_id"], "_hash", "_row")
    kept = rows.select("_row", order.alias("_order")).join(groups, "_row").groupBy("component_id").agg(F.min("_order").alias("_one")).select("_one._row")
    # the rows that go are few against those that stay; written, their size is known before the join
    gone = written(groups.select("_row").join(kept, "_row", "left_anti"), "gone")
    return named(rows.join(gone, "_row", "left_anti"), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a benchmark item, whatever their id."""
    rows, c = numbered(docs)
    rows = keyed(rows)
    held = written(contaminated(rows.select("_row", F.col(c["text"]).alias("text")), table(spark, sf_dir, "benchmark"), key="_row").select("_row").distinct(), "held")
    return named(rows.join(held, "_row", "left_anti"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as the mix of sources by weight has it: 0 to 3 times. Rows are picked
    by what is in them, and identical rows are alike, so reruns agree. Texts are in no shuffle."""
    rows, c = numbered(docs)
    rows = keyed(rows)
    rows = rows.withColumns(marks(words_in(F.col(c["text"])), F.col(c["source"]), F.xxhash64(F.lit(7), "_hash")))
    cuts, _ = mix_plan(written(rows.select("_source", "_src", "_size", "_number", "_part", "_row"), "sizes"))
    taken = repeated(rows, cuts).filter("repeats > 0")
    taken = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return named(taken, docs)


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents as shards and reads them back: a row per document."""
    folder = scratch_path(spark, "pipeline-shards")
    write_token_shards(docs, folder, end_id=2)
    return read_token_shards(spark, folder)


STAGES = [("language", language), ("near_dup", near_dup), ("decontaminate", decontaminate), ("mix", mix), ("token_store", token_store)]

#: SQL can express neither the language model nor the tokenizer; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
