import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lexloom.llm.common import table, written
from lexloom.llm.token_counts import tokenizer_path

NAMES = [name for name, _ in corpus_pipeline.STAGES]


def test_stages_are_named():
    assert NAMES == ["language", "near_dup", "decontaminate", "mix", "token_store"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_on_its_own_input(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    docs = table(spark, sf, "documents")
    bench = table(spark, sf, "benchmark").collect()
    extra = spark.createDataFrame(
        [(10_000_000, None, "en", "src0", 0), (10_000_001, "12 34 --", "en", "src0", 8), (10_000_002, "clean words of a text " + bench[0].text + " go on", "en", "src1", 1)], docs.schema
    )
    now = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, now, sf), f"test-{name}")
        before, after = {r.doc_id for r in now.select("doc_id").collect()}, [r.doc_id for r in out.select("doc_id").collect()]
        if name != "token_store":
            assert out.columns == docs.columns
        if name == "language":
            assert before - set(after) == {10_000_000, 10_000_001}
        if name == "near_dup":
            exact = now.groupBy("text").agg(F.min("doc_id").alias("d")).count()
            assert len(after) == len(set(after)) <= exact and min(before) in after
        if name == "decontaminate":
            assert 10_000_002 not in after
            texts = {r.text.lower() for r in bench}
            assert not any(t in r.text.lower() for r in out.select("text").collect() for t in texts)
        if name == "mix":
            assert set(after) <= before and max(after.count(x) for x in set(after)) <= 3
        if name == "token_store":
            texts = {r.doc_id: r.text for r in now.select("doc_id", "text").collect()}
            at = 0
            for r in sorted(out.collect(), key=lambda r: r.start):
                ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
                assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
                at += len(ids)
        now = out


def test_run_twice_agrees(spark, sf):
    rows = lambda: sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    first = rows()
    assert first and first == rows()


def test_odd_documents(spark, sf, tmp_path):
    docs = spark.createDataFrame([(None, "some words here", None, None, None), (1, None, None, None, None), (2, "", "en", None, 0), (3, "the only text", None, "a", 1), (3, "the only text", None, "a", 1)], table(spark, sf, "documents").schema)
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, sf).count() <= 3 * 5


def test_language_decides_by_the_prediction(spark, sf):
    schema = table(spark, sf, "documents").schema
    words = {"en": "the cat and this other house with that garden".split(), "de": "der hund und dieses andere haus mit jenem garten".split()}
    text = lambda lang, k: " ".join(words[lang][(k * k + i * (k + 1)) % 9] for i in range(12))
    rows = [(k, text(lang, k), lang, "s", 0) for lang in words for k in range(60)]
    odd = [(1000, text("de", 5), None, "s", 0), (1001, text("de", 7), "en", "s", 0), (1002, "xq zvwkj qqxz jvvk zxqj wvkx", None, "s", 0), (1003, "42 --", "en", "s", 0), (1004, None, "de", "s", 0), (1005, "дом", None, "s", 0)]
    docs = spark.createDataFrame(rows + odd, schema)
    got = {(r.doc_id, r.text): r.lang for r in corpus_pipeline.language(spark, docs, sf).collect()}

    # brute force: counts of letters and trigrams in plain Python, by the buckets of grams()
    import math
    from collections import Counter

    from lexloom.llm.language import BUCKETS, grams

    count = {lang: Counter() for lang in words}
    number = Counter()
    for _, t, lang, _, _ in rows + odd:
        if t and lang and any(c.isalpha() for c in t):
            count[lang].update(grams([t], BUCKETS)[0].tolist())
            number[lang] += 1
    want = {}
    for key, t, lang, _, _ in rows + odd:
        own = grams([t or ""], BUCKETS)[0].tolist()
        if own:
            log = {x: sum(math.log((count[x][g] + 0.1) / (count[x].total() + 0.1 * BUCKETS)) for g in own) for x in words}
            whole = {x: log[x] + math.log(number[x] / number.total()) for x in words}
            best = max(sorted(words), key=lambda x: whole[x])
            sure = 1 / sum(math.exp(v - whole[best]) for v in whole.values()) >= corpus_pipeline.SURE
            if max(log.values()) / len(own) >= -math.log(BUCKETS) - corpus_pipeline.SLACK:
                want[key, t] = best if lang is None or sure else lang
    assert got == want
    assert got[odd[0][:2]] == got[odd[1][:2]] == "de"
    assert {k for k, _ in got} & {1002, 1003, 1004, 1005} == set()


def test_language_with_nothing_learned(spark, sf):
    rows = [(1, "clean words", None, "s", 0), (2, "--", None, "s", 0), (3, None, "en", "s", 0), (4, "42", "en", "s", 0)]
    docs = spark.createDataFrame(rows, table(spark, sf, "documents").schema)
    assert [tuple(r) for r in corpus_pipeline.language(spark, docs, sf).collect()] == rows[:1]


def texts_of(n, size=30):
    return [" ".join(f"w{k}x{i}" for i in range(size)) for k in range(n)]


def test_near_dup_decides_by_row(spark, sf):
    a, b, c, d, e = texts_of(5)
    near = a + " more"
    rows = [(1, a), (1, a), (None, a), (1, b), (2, near), (2, c), (None, d), (None, d), (None, d), (7, e), (None, e), (3, c), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], table(spark, sf, "documents").schema)
    got = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.near_dup(spark, docs, sf).collect())
    assert got == sorted([("1", a), ("1", b), ("2", c), ("None", d), ("7", e), ("4", "None"), ("4", "None")])


def test_decontaminate_decides_by_row(spark, sf):
    item = table(spark, sf, "benchmark").first().text
    rows = [(1, "before " + item + " after"), (1, "a clean text of some words"), (None, item), (None, "another clean text of words"), (2, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], table(spark, sf, "documents").schema)
    assert sorted(r.n_chars for r in corpus_pipeline.decontaminate(spark, docs, sf).collect()) == [1, 3, 4, 5]


def test_mix_decides_by_row(spark, sf):
    rows = [(k % 3 or None, " ".join(["w"] * (1 + k % 7)), "en", f"s{k % 2}", k) for k in range(300)]
    rows += [(None, "the same words", "en", "s0", -1)] * 90 + [(5, "the same words", "en", "s1", -2)] * 90
    docs = spark.createDataFrame(rows, table(spark, sf, "documents").schema)
    take = lambda df: sorted(map(str, corpus_pipeline.mix(spark, df, sf).collect()))
    got = corpus_pipeline.mix(spark, docs, sf).collect()
    words = {s: sum(len(r.text.split()) for r in got if r.source == s) for s in ("s0", "s1")}
    size = {s: sum(len(t.split()) for _, t, _, own, _ in rows if own == s) for s in ("s0", "s1")}
    for s, weight in (("s0", 5), ("s1", 2)):
        assert abs(words[s] - sum(size.values()) * weight / 7) <= 2 and words[s] <= 3 * size[s]
    assert max(sum(r.n_chars == k for r in got) for k in range(300)) <= 3
    assert sorted(map(str, got)) == take(docs.repartition(5, "text", "n_chars")) == take(docs.orderBy("n_chars"))


def test_keys_of_rows(spark, tmp_path):
    docs = spark.range(0, 1000, numPartitions=7).selectExpr("id % 3 as doc_id", "concat('t', id % 5) as text")
    docs.write.parquet(str(tmp_path / "d"))
    for rows in (docs, spark.read.parquet(str(tmp_path / "d"))):
        for frame in (rows, rows.limit(0)):
            keys = corpus_pipeline.keyed(frame)
            assert keys.columns == ["doc_id", "text", "_hash", "_row"]
            first, again = (sorted(map(tuple, keys.collect())) for _ in range(2))
            assert first == again and len({r[3] for r in first}) == len(first) == frame.count()
    held = corpus_pipeline.keyed(spark.read.parquet(str(tmp_path / "d")))
    assert sorted(map(tuple, held.repartition(3).collect())) == sorted(map(tuple, held.collect()))


CLASHING = "_row _hash _path _index _file _pred _score _likely _size _src _source _part _number _order _copy _last passes repeats component_id c0 c1 _text words _key _metadata_".split()


def test_columns_of_any_name_come_through(spark, sf, tmp_path):
    docs = table(spark, sf, "documents").filter("doc_id < 40")
    odd = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    odd.coalesce(1).write.parquet(str(tmp_path / "odd"))
    rows = spark.read.parquet(str(tmp_path / "odd"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf)
        got = out.collect()
        assert out.columns == rows.columns and got and all(r[c] == f"{c}-{r.doc_id}" for r in got for c in CLASHING)


def test_a_failed_operator_leaves_no_table(spark, tmp_path):
    from pathlib import Path

    from lexloom.llm.common import cleaned, shared_dir

    @cleaned
    def fails(rows):
        written(rows, "left-behind")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        fails(spark.range(3))
    assert not list(Path(shared_dir(spark).removeprefix("file:")).glob("left-behind*"))
    assert written(spark.range(3), "kept").count() == 3
