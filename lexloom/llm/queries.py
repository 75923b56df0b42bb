"""The registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cleaned, scratch_path, table
from .decontam import contaminated
from .fertility import fertility_rules
from .fill_middle import fill_middle, restored
from .language import predict_language, train_language
from .mixing import mix_sources
from .near_dup import near_duplicates
from .prefix_trie import numbered_turns, prefix_trie
from .substrings import remove_repeats
from .token_counts import token_prefixes
from .token_store import read_token_shards, write_token_shards
from .top_k import exact_top_k
from .toxicity import predict_chain, train_chain
from .url_rules import judge_urls


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all vectors to each whose id is divisible by 50."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies that every document is in."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, and whether they are over 512."""
    counts = token_prefixes(table(spark, sf_dir, "documents"), keep_steps=False)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 35 words that stand elsewhere too."""
    return remove_repeats(table(spark, sf_dir, "documents"), window=35)


def held_out(key: Column) -> Column:
    """Whether a document is left out of training: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train_language(docs.filter(~held_out(F.col("doc_id"))))
    found = predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written as shards in the shared folder and read back."""
    folder = scratch_path(spark, "token-shards")
    write_token_shards(table(spark, sf_dir, "documents"), folder, end_id=2)
    return read_token_shards(spark, folder)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents, and how often, a mix of all sources by weight takes."""
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of low quality and, after it in the chain, of toxicity."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    found = predict_chain(docs, train_chain(docs, labels, ["low_quality", "toxic"]))
    return found.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


#: The rules of the contract: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, the items, and where."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))


@cleaned
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun with the first turns of its hundred's first one."""
    turns = numbered_turns(table(spark, sf_dir, "conversations"))
    lent = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = turns.select("conv_id").distinct()
    hundred = F.col("conv_id") - F.col("conv_id") % 100
    heads = turns.filter((F.col("conv_id") == hundred) & (F.col("pos") <= 5)).withColumnRenamed("conv_id", "_hundred")
    given = convs.withColumn("_hundred", hundred).join(heads, "_hundred").filter(F.col("pos") <= lent)
    own = turns.filter(F.col("pos") > lent)
    return prefix_trie(own.unionByName(given.select(*own.columns)), convs)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in its middle, and whether its text comes back."""
    made = fill_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), back)


def op13_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the quality rules say of every document."""
    return fertility_rules(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_near_dup": op2_near_dup,
    "op3_token_counts": op3_token_counts,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language": op5_language,
    "op6_token_store": op6_token_store,
    "op7_toxicity": op7_toxicity,
    "op8_url_rules": op8_url_rules,
    "op9_mix_sources": op9_mix_sources,
    "op10_decontaminate": op10_decontaminate,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fill_middle": op12_fill_middle,
    "op13_fertility": op13_fertility,
}

_OP1_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
_OP8_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), fits AS (
  SELECT *, host = 'com' OR host LIKE '%.com' AS is_com, host = 'example.com' OR host LIKE '%.example.com' AS is_example,
         host = 'www.example.com' OR host LIKE '%.www.example.com' AS is_www, host = 'net' OR host LIKE '%.net' AS is_net FROM named
), ruled AS (
  SELECT page_id, host, path,
    CASE WHEN is_www AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN is_example AND path LIKE '/en/%' THEN 'example.com/en/'
         WHEN is_com AND path LIKE '/%' THEN 'com/' WHEN is_net AND path LIKE '/es/%' THEN 'net/es/'
         WHEN is_net AND path LIKE '/fr/%' THEN 'net/fr/' END AS rule FROM fits
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
_OP11_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS hundred, xor(4294967295, list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(a, b)),
    CAST(4294967295 AS BIGINT))) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)
), mixed AS (
  SELECT c.conv_id, 0 AS k, pos, role, text FROM c JOIN t ON t.conv_id = c.hundred AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k, pos) AS d, sha256(length(role) || ':' || role || text) AS said, length(text) AS chars FROM mixed
), rows_ AS (
  SELECT conv_id, d, chars, string_agg(said, ',') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM placed UNION ALL SELECT conv_id, 0, 0, '' FROM c
), nodes AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM rows_ GROUP BY d, path
), kids AS (
  SELECT r.path, count(*) AS n FROM nodes x JOIN rows_ r ON r.conv_id = x.conv_id AND r.d = x.d - 1 GROUP BY r.path
), known AS (
  SELECT x.*, coalesce(k.n, 0) AS n_children FROM nodes x LEFT JOIN kids k ON k.path = x.path
), below AS (
  SELECT r.path, sum((x.n_convs - 1) * x.chars) AS saved, count(*) FILTER (WHERE x.n_children = 0) AS leaves FROM known x JOIN rows_ r ON r.conv_id = x.conv_id AND r.d <= x.d GROUP BY r.path
), stops AS (
  SELECT conv_id, max(d) AS d FROM rows_ GROUP BY conv_id
), ends AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM rows_ JOIN stops USING (conv_id, d) GROUP BY path
)
SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM known x JOIN below b ON b.path = x.path LEFT JOIN ends e ON e.path = x.path
  LEFT JOIN rows_ r ON r.conv_id = x.conv_id AND r.d = x.d - 1 LEFT JOIN nodes u ON u.path = r.path
"""
_OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), n AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS g FROM t
), c AS (
  SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 100 THEN 'plain' WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""

ORACLE_SQL: dict[str, str] = {
    "op1_top_k": _OP1_SQL,
    "op8_url_rules": _OP8_SQL,
    "op11_prefix_trie": _OP11_SQL,
    "op12_fill_middle": _OP12_SQL,
}
