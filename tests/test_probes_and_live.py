import gzip
import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import compare as C
from lexloom.operators import probes as O
from lexloom.plans import surgery as U
from lexloom.sources import corpus as SC
from lexloom.sources import maps as SM
from lexloom.sources import metrics as SME
from lexloom.sources import tokenizer as ST
from lexloom.streaming.live import tail_metrics


def rules_of(spark, pairs):
    return spark.createDataFrame([("s", i, a, b, a + b) for i, (a, b) in enumerate(pairs)], "tokenizer_id string, idx int, left string, right string, merged string")


def test_probes(spark):
    rules = rules_of(spark, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc"), ("c", "c"), ("x" * 50, "y" * 50)])
    pairs = {(r.idx, r.other_idx, r.text) for r in O.critical_pairs(rules).collect()}
    assert pairs == {(0, 1, "abc"), (1, 4, "bcc"), (2, 4, "abcc"), (4, 4, "ccc")}
    assert {(r.idx, r.other_idx) for r in O.critical_pairs(rules, partners=1).collect()} == {(0, 1), (1, 4)}
    got = {r.text: (r.kind, r.idx) for r in O.probes(rules, longest=20).collect()}
    assert got["abc"] == ("result", 2) and got["ccc"] == ("run", 4) and got["cccc"] == ("run", 4) and got[" abc"] == ("pair", 0) and got["abcc"] == ("pair", 2)
    assert got["aabc"] == ("double", 3) and got["ababc"] == ("double", 2) and got["abcabc"] == ("double", 2) and max(map(len, got)) <= 20
    vocab = spark.createDataFrame([("s", "b"), ("s", "a"), ("t", "q")], "tokenizer_id string, token string")
    texts = {(r.tokenizer_id, r.no): r.text for r in O.random_probes(vocab, 50, 4, 7).collect()}
    assert texts == {(r.tokenizer_id, r.no): r.text for r in O.random_probes(vocab.repartition(3), 50, 4, 7).collect()} and len(texts) == 100
    assert all(set(t) <= (set("ab") if k == "s" else {"q"}) and 1 <= len(t) <= 4 for (k, _), t in texts.items()) and len(set(texts.values())) > 10
    assert O.random_probes(vocab, 0, 4, 7).count() == 0


def test_broken_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"step": 1}\n{"st\n{"step": 3}\n')
    with pytest.raises(Exception, match="broken"):
        SME.read_metrics(spark, str(path), ["loss"], tolerant=True).collect()
    with pytest.raises(Exception):
        SME.read_metrics(spark, str(path), ["loss"]).collect()


def test_rolled_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text('{"step": 1, "loss": 2.5}\n{"step": 2, "lo')
    seen = []
    run = lambda: tail_metrics(spark, str(tmp_path / "in"), ["loss"], str(tmp_path / "cp"), lambda df, n: seen.append([r.step for r in df.collect()])).awaitTermination()
    run()
    assert seen == [[1]]
    (tmp_path / "in" / "1.json").write_text('{"step": 3}\n{"st\n{"step": 4}\n')
    with pytest.raises(Exception):
        run()


def test_append_and_corpora(spark, tmp_path):
    rows = spark.createDataFrame([(i, "m", float(i)) for i in range(10)], "step long, mix string, loss double")
    log = str(tmp_path / "log")
    assert SME.read_batches(spark, log, ["loss"]).count() == 0
    for batch, part in ((0, "step < 5"), (1, "step >= 5"), (1, "step >= 5")):  # the second one comes twice
        SME.append_metrics(rows.filter(part), log, batch, every=3)
    broken = rows.withColumn("loss", F.when(F.col("step") == 9, F.raise_error(F.lit("lost")).cast("double")).otherwise(0.0))
    with pytest.raises(Exception, match="lost"):
        SME.append_metrics(broken, log, 2, every=3)
    assert sorted(r.step for r in SME.read_batches(spark, log, ["loss"]).collect()) == [0, 3, 6, 9]
    SME.append_metrics(rows.filter("step = 9"), log, 2, every=3)
    assert sorted(r.step for r in SME.read_batches(spark, log, ["loss"]).collect()) == [0, 3, 6, 9, 9]
    with gzip.open(tmp_path / "c.JSONL.gz", "wt") as f:
        f.write('{"text": "x"}\n\n{"text": ""}\n')
    with gzip.open(tmp_path / "d.txt.gz", "wt") as f:
        f.write(" one \n\t\n")
    paths = [str(tmp_path / n) for n in ("c.JSONL.gz", "d.txt.gz")]
    assert sorted(r.text for r in SC.read_corpus(spark, *paths).collect()) == ["", "one", "x"]
    assert sorted(r.text for r in SC.read_corpus(spark, *paths, keep_empty=False).collect()) == ["one", "x"]
    spark.createDataFrame([("a",), ("b",)], "text string").write.parquet(str(tmp_path / "p"))
    assert SC.read_parquet_corpus(spark, str(tmp_path / "p")).count() == 2
    spark.createDataFrame([(None,)], "text string").write.parquet(str(tmp_path / "q"))
    with pytest.raises(Exception, match="no text"):
        SC.read_parquet_corpus(spark, str(tmp_path / "q")).collect()
    pick = lambda *a: [r.text for r in SC.select_prompts(spark, *a).collect()]
    assert pick(["", "q"], None, "d") == ["q"] and pick([""], None, "d") == ["d"]
    assert pick(["q"], spark.createDataFrame([("f",)], "text string"), "d") == ["f"]
    (tmp_path / "vocab.json").write_text('{"a": 0, "b": 1}')
    assert {(r.token, r.id) for r in ST.read_vocab_json(spark, str(tmp_path / "vocab.json"), "t").collect()} == {("a", 0), ("b", 1)}
    assert SM.read_token_groups(spark, None)["added_tokens"] == []
    (tmp_path / "ids.json").write_text('{"1": 0, "2": 0}')
    with pytest.raises(ValueError):
        SM.read_id_mapping(spark, str(tmp_path / "ids.json"))
    (tmp_path / "merges.json").write_text('{"model": {"vocab": {}, "merges": ["a b", ["c", "d"], ["x"], "odd", "e f g", "[ x", [1, 2]]}}')
    got = [(r.left, r.right) for r in ST.read_tokenizer_json(spark, str(tmp_path / "merges.json"), "t")[1].orderBy("idx").collect()]
    assert got == [("a", "b"), ("c", "d"), ("e", "f g"), ("[", "x")]


def test_scored_answers(spark):
    pairs = spark.createDataFrame([(0, "a", "a"), (1, "yes it is", "it is so"), (2, "p", "q")], "k int, answer_a string, answer_b string")
    alike = lambda a, b: F.when(a == b, 1.0).otherwise(0.5)
    got = {r.k: (r.is_candidate, r.judge_match, r.close_match) for r in C.scored(pairs, alike, lambda a, b: a.startswith("yes"), "k").collect()}
    assert got == {0: (False, None, True), 1: (True, True, True), 2: (True, False, False)}
    assert {r.judge_match for r in C.scored(pairs, alike, None, "k").collect()} == {None}


def test_model_surgery(spark):
    rows = [("model.language_model.embed", i, [float(i), 1.0]) for i in range(3)] + [("model.vision_tower.w", 0, [9.0]), ("model.language_model.norm", 0, [5.0])]
    tensors = spark.createDataFrame(rows, "name string, r long, values array<double>")
    mapping = spark.createDataFrame([(0, 2), (2, 0)], "old_id long, new_id long")
    added = spark.createDataFrame([(3, 1), (3, 2)], "new_id long, old_id long")
    out = {(r.name, r.r): r["values"] for r in U.reindex_model(tensors, ["model.language_model.embed"], mapping, 4, 2, added, text_only=True).collect()}
    assert out == {("model.embed", 0): [2.0, 1.0], ("model.embed", 1): [0.0, 0.0], ("model.embed", 2): [0.0, 1.0], ("model.embed", 3): [1.5, 1.0], ("model.norm", 0): [5.0]}
    assert U.reindex_model(tensors, ["model.language_model.embed"], mapping, 4, 2).count() == 6
    dense = spark.createDataFrame([(f"l.mlp.{x}_proj.weight", 0, [1.0]) for x in ("gate", "up", "down")] + [("l.norm", 0, [2.0])], tensors.schema)
    names = {r.name for r in U.upcycle_model(dense, ["l"], 1, 1, 2).collect()}
    assert names == {"l.norm", "l.experts.gate_up_proj", "l.experts.down_proj", "l.router.proj.weight", "l.router.scale"}
    assert json.dumps(sorted(names))
