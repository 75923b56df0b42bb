import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexloom.functions import numeric as N
from lexloom.functions import text as X
from lexloom.operators import compare as C
from lexloom.operators import corpus as P
from lexloom.operators import losses as L
from lexloom.operators import metrics as M
from lexloom.operators import tensors as T
from lexloom.operators.ordinal import with_ordinal
from lexloom.sources import corpus as SC
from lexloom.sources import maps as SM
from lexloom.sources import metrics as SME
from lexloom.sources import sinks as SS
from lexloom.sources import tokenizer as ST


def test_normalize(spark):
    df = spark.createDataFrame([("Straße　 \x1cX ",), ("ﬁ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.normalize(F.col("t"))).collect()] == ["strasse x", "fi", None, ""]
    assert [r[0] for r in df.select(X.blank(F.col("t"))).collect()] == [False, False, True, True]


@pytest.mark.parametrize("use", ["normalize", "flags"])
def test_batches_of_long_texts_are_bounded(spark, use):
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        rows = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("a"), 200_000).alias("answer_a"))
        rows = rows.select("answer_a", F.col("answer_a").alias("answer_b"), F.lit(1.0).alias("semantic_similarity"))
        X.normalize(F.col("answer_a")) if use == "normalize" else C.flags(rows)
        size = F.pandas_udf(lambda x: pd.Series([len(x)] * len(x)), "int")
        assert rows.select(size("answer_a").alias("n")).agg(F.max("n")).first()[0] <= 11
    finally:
        if held is not None:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", held)



def test_lists_are_compared_within_their_row(spark, sf):
    from lexloom import queries as Q

    rows = [(1, ["a", "b"], ["a", "c", "d"]), (2, None, ["x"]), (3, ["y", None], ["y", None]), (4, [], None), (5, ["z"], [None])]
    docs = spark.createDataFrame(rows, "k int, a array<string>, b array<string>")
    sides = [docs.select("k", F.posexplode(c).alias("pos", "v")) for c in "ab"]
    want = sorted(map(tuple, C.misaligned(*sides, ["k", "pos"], "v").collect()), key=str)
    assert sorted(map(tuple, C.misaligned_lists(docs, ["k"], "a", "b").collect()), key=str) == want and len(want) == 4
    plan = Q.token_misalignment(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_literals(spark):
    df = spark.createDataFrame([("<eos><e><pad>",)], "t string")
    assert df.select(X.replace_literals(F.col("t"), {"<e>": "E", "<eos>": "<end>"}, ["<pad>"])).first()[0] == "<end>E"


def test_logit_rows(spark):
    rows = spark.createDataFrame([(0, 0, 1, [1.0, 2.0], [1.5, 2.5]), (0, 1, 1, [0.0, 0.0], [0.5, 0.5]), (0, 2, 0, [9.0, 9.0], [0.0, 0.0])], "k int, pos int, m int, a array<double>, b array<double>")
    r = C.logit_rows(rows, "k", mask="m").first()
    assert (r.token_count, r.max_diff, r.mean_diff, r.rms_diff, r.all_close) == (2, 0.5, 0.5, 0.5, False)
    empty = C.logit_summary(C.logit_rows(rows.limit(0), "k", mask="m")).first()
    assert (empty.total, empty.max_diff, empty.mean_diff) == (0, 0.0, 0.0)


def test_summary_and_alignment(spark):
    rows = spark.createDataFrame(
        [(True, True, True, True, None, 1.0), (False, True, True, True, None, 0.98), (False, False, False, True, True, 0.31)],
        "match boolean, normalized_match boolean, semantic_match boolean, close_match boolean, judge_match boolean, semantic_similarity double",
    )
    s = C.summary(rows).first()
    assert (s.total, s.match_count, s.normalized_match_count, s.semantic_match_count, s.close_match_count, s.judge_match_count, s.judged_count) == (3, 1, 2, 2, 3, 1, 1)
    assert s.mean_similarity == pytest.approx(2.29 / 3)
    assert C.summary(rows.limit(0)).first().mean_similarity == 0.0
    a, b = (spark.createDataFrame(x, "key string, value string") for x in ([("p", "1"), ("q", "2")], [("p", "1"), ("q", "3"), ("r", None)]))
    d = C.config_differences(a, b).first()
    assert (d.n_different, d.first_keys) == (1, ["q"])
    with pytest.raises(Exception, match="counterpart"):
        C.zip_answers(a, b.select("key", F.col("value").alias("w")), "key").collect()


def test_steps_and_schedule(spark):
    n = spark.createDataFrame([("ind", 10), ("ood", 4)], "stream string, examples long")
    assert P.resolve_steps(n, {"ind": 0.5, "ood": 0.5}, 2.0, 8).agg(F.max("steps")).first()[0] == 5
    with pytest.raises(Exception, match="no share"):
        P.resolve_steps(n, {"ind": 1.0}, 1.0, 8).collect()
    docs = spark.createDataFrame([(i, "ind" if i < 5 else "ood") for i in range(8)], "id long, s string")
    out = {r.id: (r.batch_no, r.micro_batch) for r in P.schedule(docs, "id", F.col("s"), {"ind": 1, "ood": 1}, 2).collect()}
    assert out == {0: (0, 0), 1: (0, 0), 2: (1, 2), 3: (1, 2), 4: (2, 4), 5: (0, 1), 6: (0, 1), 7: (1, 3)}


def test_ordinal_over_ranges(spark):
    df = spark.range(100).select((F.col("id") * 7).alias("k"), (F.col("id") % 3).alias("g"))
    got = with_ordinal(df, "k", ["g"], ranges=5).collect()
    for g in range(3):
        own = sorted((r.k, r.ordinal) for r in got if r.g == g)
        assert [o for _, o in own] == list(range(len(own)))


def test_pad(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, [5])], "b int, ids array<int>")
    got = sorted((r.b, r.ids, r["mask"]) for r in P.pad(df, "ids", ["b"], most=2).collect())
    assert got == [(0, [1, 2], [1, 1]), (0, [4, 0], [1, 0]), (1, [5], [1])]
    left = sorted((r.b, r.ids, r["mask"]) for r in P.pad(df, "ids", ["b"], left=True).collect())
    assert left[1] == (0, [1, 2, 3], [1, 1, 1]) and left[0] == (0, [0, 0, 4], [0, 0, 1])


def test_rates(spark):
    steps = spark.createDataFrame([(i,) for i in range(1, 7)], "s int")
    got = [r[0] for r in steps.select(N.learning_rate(F.col("s"), 1.0, 1e-8, 2, 6)).collect()]
    assert got[:2] == [0.5, 1.0] and got == sorted(got[:2]) + sorted(got[2:], reverse=True) and got[-1] == pytest.approx(1e-8)
    assert spark.range(1).select(N.anneal_scale(F.lit(1), 4)).first()[0] == pytest.approx(0.75)


def test_anneal_and_limits(spark):
    rows = spark.createDataFrame([("r", 1, 0.051), ("r", 2, 0.05), ("r", 3, None), ("r", 4, float("nan"))], "r string, s int, l double")
    got = [(r.progress, r.bias_scale) for r in M.anneal(rows, "l", 4, 0.05, 0, "s", ["r"]).orderBy("s").collect()]
    assert [p for p, _ in got] == [0, 1, 1, 1] and got[2][1] == pytest.approx(0.75)
    flat = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", None)], "k string, v double")
    r = M.trimmed_limits(flat, "v", ["k"]).collect()
    assert [(x.k, x.low, x.high) for x in r] == [("a", pytest.approx(1.9), pytest.approx(2.1))]


def test_losses(spark):
    logits = [[0.1, 0.2, 0.3], [1.0, 0.0, -1.0], [0.5, 0.5, 0.5], [0.0, 0.0, 0.0]]
    rows = spark.createDataFrame([("k", i, t, v, m) for i, (t, v, m) in enumerate(zip([0, 1, 2, 0], logits, [1, 1, 1, 0]))], "k string, p int, t int, v array<double>, m int")
    want = sum(math.log(sum(map(math.exp, logits[i]))) - logits[i][t] for i, t in ((0, 1), (1, 2)))
    r = L.next_token_loss(rows, "k", "p", "t", "v", "m").first()
    assert r.loss_sum == pytest.approx(want) and r.tokens == 2
    pair = spark.createDataFrame([([1.0, 2.0, 0.5, -1.0], [0.0, 1.0, 1.0, 0.0])], "t array<double>, s array<double>")
    soft = lambda v: [math.exp(x) / sum(map(math.exp, v)) for x in v]
    kl = lambda t, s: sum(p * math.log(p / q) for p, q in zip(soft(t), soft(s)))
    got = pair.select(L.kl_divergence(F.col("t"), F.col("s")), L.kl_divergence(F.col("t"), F.col("s"), [0, 2])).first()
    assert got[0] == pytest.approx(kl([1.0, 2.0, 0.5, -1.0], [0.0, 1.0, 1.0, 0.0])) and got[1] == pytest.approx(kl([1.0, 0.5], [0.0, 1.0]))


def test_tensors(spark):
    rows = spark.createDataFrame([(i, [2.0 * i, 2.0 * i + 1]) for i in range(3)], "r long, values array<double>")
    mapping = spark.createDataFrame([(0, 0), (1, 1), (2, 3)], "old_id long, new_id long")
    assert {r.r: r["values"] for r in T.reindex_rows(rows, mapping, 4, 2).collect()} == {0: [0.0, 1.0], 1: [2.0, 3.0], 2: [0.0, 0.0], 3: [4.0, 5.0]}
    src = spark.createDataFrame([(7, 0), (7, 1), (7, 1)], "new_id long, old_id long")
    assert T.added_rows(rows, src).first()["values"] == pytest.approx([4 / 3, 7 / 3])
    assert T.pad_and_stack(rows, 3, 4, 2).count() == 8
    pairs = spark.createDataFrame([("w", 0, 0, [1.0, 2.0]), ("w", 1, 0, [2.0, 4.0])], "name string, e int, r int, values array<double>")
    g = T.expert_gap(pairs, ["name"]).first()
    assert (g.mean_abs, g.mean_sq, g.entries) == (1.5, 2.5, 2)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one \n\n two\n")
    (tmp_path / "b.jsonl").write_text('{"text": "x"}\n{"text": ""}\n')
    got = sorted(r.text for r in SC.read_corpus(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.jsonl")).collect())
    assert got == ["", "one", "two", "x"]
    (tmp_path / "bad.jsonl").write_text('{"text": 5}\n')
    with pytest.raises(Exception, match="no text"):
        SC.read_corpus(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "p.jsonl").write_text('{"text": "x"} \n\n{"text": "y"}\n')
    assert [(r.line_no, r.text) for r in SC.read_prompts(spark, str(tmp_path / "p.jsonl")).orderBy("line_no").collect()] == [(1, "x"), (4, "y")]
    (tmp_path / "t.json").write_text('{"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b", ["ab", "c"], "odd"]}}')
    vocab, merges = ST.read_tokenizer_json(spark, str(tmp_path / "t.json"), "t")
    assert {(r.token, r.id) for r in vocab.collect()} == {("a", 0), ("b", 1), ("ab", 2)}
    (tmp_path / "m.txt").write_text("#version: 0.2\na b\n\nab c\n")
    assert [(r.idx, r.left, r.right) for r in ST.read_merges_txt(spark, str(tmp_path / "m.txt"), "t").orderBy("idx").collect()] == [(0, "a", "b"), (1, "ab", "c")]
    (tmp_path / "c1.json").write_text('{"pad_token": "<pad>", "bos_token": {"content": "<s>"}}')
    (tmp_path / "c2.json").write_text('{"pad_token": "<p2>", "extra_special_tokens": ["<i>"]}')
    assert {r.role: r.literal for r in ST.read_special_tokens(spark, [str(tmp_path / "c1.json"), str(tmp_path / "c2.json")], "t").collect()} == {"pad_token": "<p2>", "bos_token": "<s>", "extra_special_tokens[0]": "<i>"}
    (tmp_path / "log.jsonl").write_text('{"step": 1, "loss": 2.5}\n{"step": 2, "lo')
    assert [(r.step, r.loss, r.eval) for r in SME.read_metrics(spark, str(tmp_path / "log.jsonl"), ["loss", "eval"], tolerant=True).collect()] == [(1, 2.5, None)]
    (tmp_path / "map.json").write_text('{"delete": ["a", "a"]}')
    with pytest.raises(ValueError):
        SM.read_token_map(spark, str(tmp_path / "map.json"))
    rules = merges.withColumn("place", F.col("idx"))
    assert SS.merges_text(rules.filter("idx = 0")).first().body == "#version: 0.2\na b\n"
    with pytest.raises(Exception, match="same id"):
        ST.check_unique_ids(spark.createDataFrame([("t", "a", 1), ("t", "b", 1)], "tokenizer_id string, token string, id long")).collect()


def test_streams(spark, tmp_path):
    from lexloom.streaming.live import tail_metrics

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("".join(f'{{"step": {i}, "loss": {0.01 * i}}}\n' for i in range(1, 9)))
    seen = []
    q = tail_metrics(spark, str(tmp_path / "in"), ["loss"], str(tmp_path / "cp"), lambda df, n: seen.append(df.count()))
    q.awaitTermination()
    (tmp_path / "in" / "1.json").write_text('{"step": 9, "loss": 1.0}\n')
    tail_metrics(spark, str(tmp_path / "in"), ["loss"], str(tmp_path / "cp"), lambda df, n: seen.append(df.count())).awaitTermination()
    assert seen == [8, 1]
