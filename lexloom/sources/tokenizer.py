"""Tokenizer files as tables: vocab, merges, special tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _whole(spark: SparkSession, path: str, tokenizer_id: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.lit(tokenizer_id).alias("tokenizer_id"), F.col("value").alias("body"))


def split_merges(rows: DataFrame) -> DataFrame:
    """(tokenizer_id, pos, pair array) to merges numbered from 0; entries that are no pair go."""
    good = rows.filter("size(pair) = 2")
    number = F.expr("row_number() over (partition by tokenizer_id order by pos) - 1").cast("int")
    return good.select("tokenizer_id", number.alias("idx"), F.col("pair")[0].alias("left"), F.col("pair")[1].alias("right"), F.concat(F.col("pair")[0], F.col("pair")[1]).alias("merged"))


def read_tokenizer_json(spark: SparkSession, path: str, tokenizer_id: str) -> tuple[DataFrame, DataFrame]:
    """(vocab, merges) of a tokenizer.json; merges as `left right` strings or as pairs."""
    body = _whole(spark, path, tokenizer_id)
    vocab = body.select("tokenizer_id", F.explode(F.from_json(F.get_json_object("body", "$.model.vocab"), "map<string,bigint>")).alias("token", "id"))
    listed = F.try_variant_get(F.parse_json("body"), "$.model.merges", "array<variant>")
    each = body.select("tokenizer_id", F.posexplode(listed).alias("pos", "m"))
    kind = F.schema_of_variant("m")
    pair = F.when(kind == "STRING", F.split(F.variant_get("m", "$", "string"), " ", 2)).when(kind == "ARRAY<STRING>", F.try_variant_get("m", "$", "array<string>"))
    return vocab, split_merges(each.select("tokenizer_id", "pos", pair.alias("pair")))


def read_vocab_json(spark: SparkSession, path: str, tokenizer_id: str) -> DataFrame:
    """Tokens and ids of a vocab.json."""
    return _whole(spark, path, tokenizer_id).select("tokenizer_id", F.explode(F.from_json("body", "map<string,bigint>")).alias("token", "id"))


def read_merges_txt(spark: SparkSession, path: str, tokenizer_id: str) -> DataFrame:
    """Merges of a merges.txt: blank lines and such that begin with # are no rules."""
    lines = _whole(spark, path, tokenizer_id).select("tokenizer_id", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter("line <> '' and not startswith(line, '#')")
    return split_merges(lines.select("tokenizer_id", "pos", F.split("line", " ", 2).alias("pair")))


def check_unique_ids(vocab: DataFrame) -> DataFrame:
    """The vocabulary, of which two tokens with one id are an error when read."""
    seen = F.count(F.lit(1)).over(Window.partitionBy("tokenizer_id", "id"))
    return vocab.withColumn("_n", seen).filter(F.assert_true(F.col("_n") == 1, F.lit("two tokens have the same id")).isNull()).drop("_n")


def read_special_tokens(spark: SparkSession, paths: list[str], tokenizer_id: str) -> DataFrame:
    """(tokenizer_id, role, literal) from config files, later files over earlier ones: keys that end in
    `_token` (text or an object with content) and extra_special_tokens (object or list)."""
    out = None
    for priority, path in enumerate(paths):
        doc = _whole(spark, path, tokenizer_id)
        top = doc.select("tokenizer_id", F.explode(F.from_json("body", "map<string,string>")).alias("k", "v"))
        literal = lambda v: F.when(F.trim(v).startswith("{"), F.get_json_object(v, "$.content")).otherwise(v)
        roles = top.filter("endswith(k, '_token')").select("tokenizer_id", F.col("k").alias("role"), literal(F.col("v")).alias("literal"))
        extra = top.filter("k = 'extra_special_tokens'")
        named = extra.filter("startswith(trim(v), '{')").select("tokenizer_id", F.explode(F.from_json("v", "map<string,string>")).alias("role", "x")).select("tokenizer_id", "role", literal(F.col("x")).alias("literal"))
        listed = extra.filter("startswith(trim(v), '[')").select("tokenizer_id", F.posexplode(F.from_json("v", "array<string>")).alias("i", "x"))
        listed = listed.select("tokenizer_id", F.concat(F.lit("extra_special_tokens["), F.col("i").cast("string"), F.lit("]")).alias("role"), literal(F.col("x")).alias("literal"))
        part = roles.unionByName(named).unionByName(listed).filter("literal is not null").withColumn("priority", F.lit(priority))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("tokenizer_id", "role").agg(F.max_by("literal", "priority").alias("literal"))
