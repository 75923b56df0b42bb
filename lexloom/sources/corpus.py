"""Corpora and prompts from text, JSON lines (both also gzipped) and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LINE_END, blank, strip


def json_text(line: Column) -> Column:
    """The string at `text` of a JSON object; anything else is an error when read."""
    value = F.try_variant_get(F.try_parse_json(line), "$.text", "variant")
    good = F.schema_of_variant(value) == "STRING"
    return F.when(F.coalesce(good, F.lit(False)), F.variant_get(value, "$", "string")).otherwise(F.raise_error(F.concat(F.lit("no text in: "), F.left(line, F.lit(80)))))


def read_corpus(spark: SparkSession, *paths: str, keep_empty: bool = True) -> DataFrame:
    """(path, text): one row per line that is not blank; lines of .jsonl files give their text,
    others themselves without white space at the ends. keep_empty: an empty JSON text is a row."""
    rows = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), "value").filter(~blank(F.col("value")))
    rows = rows.select("path", F.when(F.col("path").rlike(r"(?i)\.jsonl(\.gz)?$"), json_text(F.col("value"))).otherwise(strip(F.col("value"))).alias("text"))
    return rows if keep_empty else rows.filter("text <> ''")


def read_parquet_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """Texts of Parquet files; a null text is an error when read."""
    rows = spark.read.parquet(*paths).select("text")
    return rows.select(F.coalesce("text", F.raise_error(F.lit("a row has no text"))).alias("text"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 1, text) of a JSON lines file of prompts, lines as str.splitlines() has them."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", LINE_END)).alias("i", "line"))
    return lines.filter(~blank(F.col("line"))).select((F.col("i") + 1).alias("line_no"), json_text(F.col("line")).alias("text"))


def select_prompts(spark: SparkSession, given: list[str], from_file: DataFrame | None, default: str) -> DataFrame:
    """Prompts of the file if there is one, else those given that are not empty, else the default."""
    if from_file is not None:
        return from_file.select("text")
    kept = [x for x in given if x] or [default]
    return spark.createDataFrame([(x,) for x in kept], "text string")
