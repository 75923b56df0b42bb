"""Nested JSON as a table of paths: taken apart, compared, changed by joins, and put together again.

A document is exploded level by level (as many rounds as the deepest document has levels) into nodes: its key,
the path of steps, and the JSON text of what is there. A step is `k` and a key of an object, or `i` and a place in a
list with ten digits, so sorted paths have a document's order, keys by name. Containers
with something in them have no text of their own: they are what lies below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled

#: Names of ids and literals of tokens, and of a vocabulary's sizes. Fixed values.
ID_NAME, LITERAL_NAME = r"_token_id$", r"(_token|^content|^tokens)$"
SIZE_NAMES = ("vocab_size", "vocab_size_per_layer_input")
DECODER = "added_tokens_decoder"
#: Parts over which leaves are spread that ask for no id.
SPREAD = 1024


def leaves(docs: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """key, path, text: the values of each JSON document that are no container, or an empty one. A null document has
    no row; one that is no JSON is an error."""
    level = docs.filter(F.col(body).isNotNull()).select(*key, F.array().cast("array<string>").alias("path"), F.parse_json(F.col(body)).alias("v"))
    out = None
    while True:
        kind = F.schema_of_variant("v")
        text = F.to_json(F.col("v"))
        inner = (kind.startswith("OBJECT") | kind.startswith("ARRAY")) & ~text.isin("{}", "[]")
        level = settled(level.withColumn("_inner", inner))
        here = level.filter("not _inner").select(*key, "path", F.to_json("v").alias("text"))
        out = here if out is None else out.unionByName(here)
        deeper = level.filter("_inner")
        if deeper.isEmpty():
            return out
        below = deeper.lateralJoin(deeper.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value")))
        step = F.when(F.col("_key").isNotNull(), F.concat(F.lit("k"), "_key")).otherwise(F.concat(F.lit("i"), F.lpad(F.col("_pos").cast("string"), 10, "0")))
        level = below.select(*key, F.array_append("path", step).alias("path"), F.col("_value").alias("v"))


def quoted(name: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.array(name))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def container(parts: Column) -> Column:
    """The text of a list or an object from its sorted steps and their texts (s, t)."""
    name = lambda p: F.substring(p["s"], F.lit(2), F.length(p["s"]))
    object_ = F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda p: F.concat(quoted(name(p)), F.lit(":"), p["t"])), ","), F.lit("}"))
    list_ = F.concat(F.lit("["), F.array_join(F.transform(parts, lambda p: p["t"]), ","), F.lit("]"))
    return F.when(parts[0]["s"].startswith("k"), object_).otherwise(list_)


def assembled(nodes: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """key, body: documents from their leaves, keys by name, without white space. What has no leaf is not there."""
    deepest = nodes.agg(F.max(F.size("path"))).first()[0] or 0
    level = nodes.filter(F.size("path") == deepest).select(*key, "path", "text")
    for depth in range(deepest, 0, -1):
        part = F.struct(F.element_at("path", -1).alias("s"), F.col("text").alias("t"))
        whole = level.groupBy(*key, F.slice("path", 1, depth - 1).alias("path")).agg(F.array_sort(F.collect_list(part)).alias("_p"))
        level = whole.select(*key, "path", container(F.col("_p")).alias("text")).unionByName(nodes.filter(F.size("path") == depth - 1).select(*key, "path", "text"))
    return level.select(*key, F.col("text").alias(body))


def differences(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """key, path (steps joined by `/`), text_a, text_b of the leaves that two tables of leaves do not share."""
    named = lambda rows, name: rows.select(*key, F.array_join("path", "/").alias("path"), F.col("text").alias(name))
    out = named(a, "text_a").join(named(b, "text_b"), [*key, "path"], "full_outer")
    return out.filter(~F.col("text_a").eqNullSafe(F.col("text_b")))


def remapped(nodes: DataFrame, key: list[str], ids: DataFrame, literals: DataFrame, size: Column | None = None, plan: str | None = None) -> DataFrame:
    """Leaves under a new vocabulary.

    ids: old_id, new_id (null: gone); literals: token, new_token (null: gone); plan: a column of `key` that both have as
    well, where documents belong to several vocabularies. Numbers under names that end with `_token_id`, alone
    or in a list, and the keys of added_tokens_decoder get their new ids; one without an entry is an error. Strings
    under `*_token`, `content` and `tokens` get their new names, where they have one. What is gone goes: an entry
    of a list, a value, and the whole object around a `content`. size: the new vocabulary's, for its sizes.
    Without `plan` both tables are one vocabulary's (some 10^5 rows) and are broadcast."""
    on = [plan] if plan else []
    name = F.try_element_at(F.filter("path", lambda s: s.startswith("k")), F.lit(-1))
    rows = nodes.withColumn("_n", F.substring(name, F.lit(2), F.length(name)))
    at = F.array_position("path", f"k{DECODER}").cast("int")
    entry = F.when(at > 0, F.get(F.col("path"), at))
    rows = rows.withColumn("_entry", F.when(entry.rlike("^k[0-9]+$"), F.substring(entry, F.lit(2), F.length(entry)).cast("long")))
    own = F.when(F.col("_n").rlike(ID_NAME) & F.col("text").rlike("^-?[0-9]+$"), F.col("text").cast("long"))
    string = F.when(F.col("_n").rlike(LITERAL_NAME) & F.col("text").startswith('"'), F.try_variant_get(F.try_parse_json("text"), "$", "string"))
    rows = rows.withColumn("_id", own).withColumn("_literal", string)
    held = lambda tag: ids.select(*on, F.col("old_id").alias(f"_{tag}"), F.col("new_id").alias(f"_new_{tag}"), F.lit(True).alias(f"_known_{tag}"))
    for tag, table in (("id", held("id")), ("entry", held("entry")), ("literal", literals.select(*on, F.col("token").alias("_literal"), F.col("new_token").alias("_new_literal"), F.lit(True).alias("_known_literal")))):
        if plan is None:  # one vocabulary's table: every document asks for the same few ids
            rows = rows.join(F.broadcast(table), f"_{tag}", "left")
        else:  # most leaves ask for nothing; they are spread over all tasks
            spread = F.when(F.col(f"_{tag}").isNull(), F.pmod(F.xxhash64(*key, "path"), F.lit(SPREAD))).otherwise(0)
            rows = rows.withColumn("_spread", spread).join(table.withColumn("_spread", F.lit(0).cast("long")), [*on, f"_{tag}", "_spread"], "left").drop("_spread")
    lost = lambda tag: F.col(f"_{tag}").isNotNull() & F.col(f"_known_{tag}").isNull()
    gone = lambda tag: F.coalesce(F.col(f"_known_{tag}") & F.col(f"_new_{tag}").isNull(), F.lit(False))
    sure = F.when(lost("id"), F.col("_id")).when(lost("entry"), F.col("_entry"))
    text = F.when(sure.isNotNull(), F.raise_error(F.concat(F.lit("no entry for id "), sure.cast("string"))))
    text = text.when(F.col("_new_id").isNotNull(), F.col("_new_id").cast("string")).when(F.col("_new_literal").isNotNull(), quoted(F.col("_new_literal")))
    if size is not None:
        text = text.when(F.col("_n").isin(*SIZE_NAMES), size.cast("string"))
    path = F.when(F.col("_new_entry").isNotNull(), F.transform("path", lambda s, i: F.when(i == at, F.concat(F.lit("k"), F.col("_new_entry").cast("string"))).otherwise(s))).otherwise(F.col("path"))
    rows = rows.withColumn("_text", text.otherwise(F.col("text"))).withColumn("_off", gone("id") | gone("entry") | gone("literal"))
    # the whole object around a `content` that is gone: a document's such paths meet its leaves once
    around = rows.filter((F.col("_n") == "content") & gone("literal")).select(*key, F.slice("path", 1, F.size("path") - 1).alias("_around"))
    around = around.groupBy(*key).agg(F.collect_set("_around").alias("_around"))
    inside = F.exists("_around", lambda p: F.slice("path", F.lit(1), F.size(p)) == p)
    kept = rows.filter("not _off").join(around, key, "left").filter(~F.coalesce(inside, F.lit(False)))
    return kept.select(*key, path.alias("path"), F.col("_text").alias("text"))
