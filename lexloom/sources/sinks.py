"""Writers of merges, mappings and comparison rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merges_text(rules: DataFrame, header: str | None = "#version: 0.2") -> DataFrame:
    """(tokenizer_id, body): the rules of a tokenizer as the text of a merges file, by `place`."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "left", "right"))), lambda r: F.concat_ws(" ", r["left"], r["right"]))
    return rules.groupBy("tokenizer_id").agg(F.concat(F.lit(header + "\n" if header else ""), F.array_join(lines, "\n"), F.lit("\n")).alias("body"))


def merges_json(rules: DataFrame) -> DataFrame:
    """(tokenizer_id, body): the rules as a JSON list of pairs, by `place`."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("place", "left", "right"))), lambda r: F.array(r["left"], r["right"]))
    return rules.groupBy("tokenizer_id").agg(F.to_json(pairs).alias("body"))


def write_comparison(rows: DataFrame, summary: DataFrame, path: str, only_mismatches: bool = False, mismatch: str = "any_mismatch", order: str | None = None) -> None:
    """Rows and then the summary as JSON lines with nulls written out, the summary as the last line of the
    last file. only_mismatches: rows whose column `mismatch` is true; order: rows by this column, so that
    files in the order of their names hold rows in this order."""
    kept = rows.filter(F.coalesce(mismatch, F.lit(False))) if only_mismatches else rows
    options = {"ignoreNullFields": "false"}
    lines = kept.select(F.lit(0).alias("_last"), (F.col(order) if order else F.lit(0)).alias("_order"), F.to_json(F.struct(*kept.columns), options).alias("value"))
    two = summary.select(F.lit(1).alias("_last"), F.lit(None).cast(lines.schema["_order"].dataType).alias("_order"), F.to_json(F.struct(F.struct(*summary.columns).alias("summary")), options).alias("value"))
    both = lines.unionByName(two).repartitionByRange("_last", "_order").sortWithinPartitions("_last", "_order")
    both.select("value").write.mode("errorifexists").text(path)


def mismatch_lines(rows: DataFrame, summary: DataFrame, mismatch: str = "any_mismatch") -> DataFrame:
    """(value) the rows that mismatch and the summary as JSON lines, for a screen."""
    options = {"ignoreNullFields": "false"}
    one = rows.filter(F.coalesce(mismatch, F.lit(False))).select(F.to_json(F.struct(*rows.columns), options).alias("value"))
    return one.unionByName(summary.select(F.to_json(F.struct(F.struct(*summary.columns).alias("summary")), options).alias("value")))
