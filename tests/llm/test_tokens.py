import random
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from lexloom.llm import token_store as S
from lexloom.llm.byte_bpe import library_ids, prefix_counts
from lexloom.llm.token_budget import longest_prefix, tokens_within
from lexloom.llm.token_counts import token_prefixes, tokenizer_path
from lexloom.llm.wavelet import WaveletMatrix

PATH = tokenizer_path()
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "ll", "é", "日本", "12", "$", "<|endoftext|>", "<|end", "　", "\x85", "\x1c", "don't", "...", " the", "🎉", "\r\n", "A" * 9, "  x"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(PARTS), max_size=8).map("".join) | st.text(max_size=12))
def test_units_and_prefixes_are_exact(library, text):
    assert np.frombuffer(library_ids(PATH).batch([text])[0], "<u4").tolist() == ids_of(library, text)
    got = np.cumsum(np.frombuffer(prefix_counts(PATH).batch([text])[0], "<i2"), dtype=int).tolist()
    assert got == [len(ids_of(library, text[:j])) for j in range(1, len(text) + 1)]


def test_token_prefixes_cases(spark, library):
    long = " ".join(random.Random(1).choice(["alpha", "beta", "gamma's", "x" * 40]) for _ in range(30000))
    texts = [None, "", "   ", "one two", "one two", "a <|endoftext|> b", long, "no" * 5000]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = sorted(((r.n_bytes, r.n_tokens, bytes(r.steps)) for r in token_prefixes(docs).collect()))
    assert [(b, n) for b, n, _ in got] == sorted((len((t or "").encode()), len(ids_of(library, t or ""))) for t in texts)
    assert token_prefixes(docs.limit(0)).count() == 0
    counts = token_prefixes(docs.filter("doc_id = 5"))
    row = counts.select(tokens_within(F.col("steps"), F.lit(3)).alias("w"), longest_prefix(F.col("steps"), F.lit(3)).alias("p")).first()
    assert row.w == len(ids_of(library, "a <"))
    assert len(ids_of(library, texts[5][: row.p])) <= 3


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (64, 2), (1000, 50), (5000, 70000)):
        v = rng.integers(0, top, n)
        w = WaveletMatrix.from_bytes(WaveletMatrix.build(v).to_bytes())
        assert (w.decode() == v).all()
        if n:
            at = rng.integers(0, n, 50)
            assert (w.access(at) == v[at]).all()
            x = int(v[0])
            places = np.flatnonzero(v == x)
            assert (w.select(x, np.arange(len(places))) == places).all()
            assert w.rank(np.array([x]), np.array([n]))[0] == len(places)
            with pytest.raises(IndexError):
                w.select(x, np.array([len(places)]))


def test_token_store_round_trip(spark, library, tmp_path):
    rows = [(5, "five five"), (None, "null key"), (1, None), (3, ""), (2, "two " * 3000), (2, "again"), (2, "again"), (9, "x <|endoftext|>")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, start int")
    folder = str(tmp_path / "s")
    S.write_token_shards(docs, folder, shard_ids=100)
    got = S.read_token_shards(spark, folder, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 2, 3, 5, 9]
    want = sorted((k if k is not None else -1, ids_of(library, t or "") + [2]) for k, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    stream = [x for r in got for x in r.ids]
    assert {r["id"]: r.n for r in S.count_ids(spark, folder, [2, stream[0], 50000]).collect()}[2] == stream.count(2)
    assert sorted(r["at"] for r in S.find_id(spark, folder, 2).collect()) == [i for i, x in enumerate(stream) if x == 2]
    assert {r["at"]: r["id"] for r in S.ids_at(spark, folder, [0, 7, 99999999]).collect()} == {0: stream[0], 7: stream[7]}
    S.write_token_shards(docs.limit(0), str(tmp_path / "e"))
    assert S.read_token_shards(spark, str(tmp_path / "e")).count() == 0


def test_long_unbroken_words(library):
    import time

    rng = random.Random(5)
    table = prefix_counts(PATH)
    for text in ("".join(rng.choices("abcdefghij", k=700)), "no" * 400, "a" * 900, "é" * 300 + "日本" * 150, "".join(rng.choices("ABCDEFabcdef0123456789+/", k=600))):
        piece = text.encode()
        assert (table.long_counts(piece) == table.by_bytes([piece])[0]).all()
        got = np.cumsum(np.frombuffer(table.batch([text])[0], "<i2"), dtype=int)
        assert [got[j - 1] for j in range(1, len(text), 97)] == [len(ids_of(library, text[:j])) for j in range(1, len(text), 97)]
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    began = time.process_time()
    steps = np.frombuffer(table.batch([text])[0], "<i2")
    assert time.process_time() - began < 30 and int(steps.sum(dtype=np.int64)) == len(ids_of(library, text))


def test_unit_table_and_texts_of_edges_alone(library):
    import pyarrow as pa

    from lexloom.llm import byte_bpe as B
    from lexloom.llm.unit_table import UnitTable, name_hashes

    for texts in (["a \n"], ["", " "], ["\n \n", "x"]):  # no unit of these goes into a table
        assert [np.frombuffer(x, "<u4").tolist() for x in B.LibraryIds(PATH).batch(texts)] == [ids_of(library, t) for t in texts]
    names = pa.array(["", "a", "b", "ab", "ba", "é" * 70, "a" * 9000])
    first, second = name_hashes(names)
    assert len(set(zip(first.tolist(), second.tolist()))) == len(names)
    many = pa.array([f"n{i}" * (i % 90) for i in range(30_000)] + ["x" * 5000])
    whole, alone = name_hashes(many), [name_hashes(many.slice(i, 1)) for i in (0, 1, 7, 12_345, 29_999, 30_000)]
    assert all((int(whole[k][i]) == int(x[k][0])) for i, x in zip((0, 1, 7, 12_345, 29_999, 30_000), alone) for k in (0, 1))
    assert (name_hashes(names.slice(2, 4))[0] == first[2:6]).all() and len(name_hashes(names.slice(0, 0))[0]) == 0
    table, values, rng = UnitTable("<u4"), [[], [1], [2, 3], [4], [5, 6, 7], [], [8]], random.Random(2)
    order = rng.sample(range(7), 7)
    for part in (order[:3], order[3:5], order[5:]):
        table.add(first[part], second[part], np.array([len(values[i]) for i in part], np.int32), np.array([x for i in part for x in values[i]], "<u4"))
    at = table.find(first, second)
    size, data = table.taken(at)
    assert size.tolist() == list(map(len, values)) and data.tolist() == [x for v in values for x in v]
    assert (table.find(first, second + np.uint64(1)) == -1).all()


def test_units_after_a_change_of_generations(library, monkeypatch):
    from lexloom.llm import byte_bpe as B

    monkeypatch.setattr(B, "KEPT_UNITS", 20)
    store, rng = B.LibraryIds(PATH), random.Random(3)
    for _ in range(12):
        texts = [" ".join(rng.choice(["alpha", "be", "gamma", "δέλτα"]) + str(rng.randint(0, 30)) for _ in range(20)) for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in store.batch(texts)] == [ids_of(library, t) for t in texts]
