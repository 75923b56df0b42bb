"""Each registered query of the subpackage on the smallest tables, beside its SQL or brute force."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lexloom.llm import queries as Q
from lexloom.llm.token_counts import tokenizer_path

from .test_near_text import brute_components, brute_removal


@pytest.fixture(scope="module")
def docs(spark, sf):
    return sorted((r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages", "conversations", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(Q.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = lambda data: sorted(tuple(map(str, r)) for r in data)
    got = Q.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())


def test_near_dup(spark, sf, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in Q.op2_near_dup(spark, sf).collect()}
    assert got == brute_components([(i, t) for i, t, _, _ in docs], 4)


def test_token_counts(spark, sf, docs, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in Q.op3_token_counts(spark, sf).collect()}
    n = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t, _, _ in docs}
    assert got == {i: (len((t or "").encode()), n[i], n[i] > 512) for i, t, _, _ in docs}


def test_substring_dedup(spark, sf, docs):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in Q.op4_substring_dedup(spark, sf).collect())
    assert got == brute_removal([(i, t) for i, t, _, _ in docs], 35) and any(r[2] for r in got)


def test_language(spark, sf, docs):
    got = {r.doc_id: r for r in Q.op5_language(spark, sf).collect()}
    assert len(got) == len(docs) and {r.held_out for r in got.values()} == {True, False}
    for i, t, lang, _ in docs:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in docs if got[i].held_out and lang is not None]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_token_store(spark, sf, docs, library):
    at, want = 0, {}
    for i, t, _, _ in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op6_token_store(spark, sf).collect()} == want


def test_toxicity(spark, sf, docs):
    got = Q.op7_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _, _, _ in docs]
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 and r.toxic == (r.p_toxic >= 0.5) for r in got)


def test_mix(spark, sf, docs):
    got = {r.doc_id: r for r in Q.op9_mix_sources(spark, sf).collect()}
    words = {i: len([w for w in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]) for i, t, _, _ in docs}
    size, taken = Counter(), Counter()
    for i, _, _, s in docs:
        size[s] += words[i]
        taken[s] += got[i].taken
        assert got[i]["size"] == words[i] and got[i].taken <= 3 * words[i]
    assert all(got[i].source_size == size[s] and abs(taken[s] - got[i].target) <= max(words.values()) and got[i].target <= 3 * size[s] for i, _, _, s in docs)
    assert math.isclose(sum({s: got[i].target for i, _, _, s in docs}.values()), sum(size.values()))


def test_decontaminate(spark, sf, docs):
    got = {(r.doc_id, r.item_id) for r in Q.op10_decontaminate(spark, sf).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plain = {(i, k) for i, t, _, _ in docs for k, u in items if u and t and u.lower() in t.lower()}
    assert plain <= got and plain


def test_very_long_texts(spark):
    from lexloom.llm.decontam import contaminated
    from lexloom.llm.mixing import mix_sources
    from lexloom.llm.substrings import remove_repeats

    item = "one item of ten words that stands in a text"
    words = [f"w{i}" for i in range(120_000)]
    texts = {1: " ".join(words), 2: " ".join(words[50_000:50_100]), 3: item + " " + "x" * 500_000, 4: None}
    docs = spark.createDataFrame([(k, t, "s", 0) for k, t in texts.items()], "doc_id long, text string, source string, n_removed int")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs, window=35).collect())
    assert got == brute_removal(list(texts.items()), 35)
    assert {(r.doc_id, r.item_id, r.start) for r in contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()} == {(3, 7, 0)}
    assert {r.doc_id: r["size"] for r in mix_sources(docs).collect()} == {1: 120_000, 2: 100, 3: 11, 4: 0}


def test_repeated_rules(spark):
    from lexloom.llm.url_rules import judge_urls

    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block"), ("COM", "/", "allow"), ("com", "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    assert [(r.rule, r.verdict) for r in judge_urls(pages, rules).collect()] == [("com/", "allow")]
