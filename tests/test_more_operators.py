"""Operators without a registered query, and errors that a query cannot show."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lexloom.functions import numeric as N
from lexloom.functions import text as X
from lexloom.operators import compare as C
from lexloom.operators import corpus as P
from lexloom.operators import losses as L
from lexloom.operators import merges as G
from lexloom.operators import metrics as M
from lexloom.operators import parameters as W
from lexloom.operators import tensors as T
from lexloom.operators.encode import same_encoding
from lexloom.operators.ordinal import running_total, with_ordinal
from lexloom.session import session


def test_session(spark):
    assert session() is spark or session().sparkContext is spark.sparkContext


def test_ordinals_of_sparse_repeated_and_null_keys(spark):
    rows = [(k * k * 1_000_003, "a" if k % 3 else None, k) for k in range(300)] + [(None, "a", 1), (None, None, 2), (7, "a", 3), (7, "a", 4)]
    df = spark.createDataFrame(rows, "k long, g string, n long")
    got = with_ordinal(df, "k", ["g"], ranges=16).collect()
    assert len(got) == len(rows)
    for g in ("a", None):
        own = sorted((-1 if r.k is None else r.k, r.ordinal) for r in got if r.g == g)
        assert sorted(o for _, o in own) == list(range(len(own)))
        assert [k for k, _ in sorted(own, key=lambda x: x[1])] == [k for k, _ in own]
    total = running_total(df.filter("g = 'a' and k is not null"), "k", [], F.col("n"), "before", ranges=8).orderBy("before").collect()
    assert total[0].before == 0 and total[-1].before + total[-1].n == sum(r.n for r in total)
    assert with_ordinal(df.limit(0), "k").count() == 0
    doubles = spark.createDataFrame([(x / 7,) for x in range(50)], "v double")
    assert sorted((r.v, r.ordinal) for r in with_ordinal(doubles, "v", ranges=4).collect()) == [(x / 7, x) for x in range(50)]


def test_rolling_mean_over_parts(spark):
    rows = [("s" if i % 4 else "t", i, None if i % 5 == 0 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, i long, v double")
    got = {(r.s, r.i): r.m for r in M.rolling_mean(df, "v", 4, "i", ["s"], "m", part=7).collect()}
    assert len(got) == 400
    for s in "st":
        own = [(i, v) for k, i, v in rows if k == s]
        for n, (i, _) in enumerate(own):
            held = [v for _, v in own[max(0, n - 3) : n + 1] if v is not None]
            assert got[s, i] == (pytest.approx(sum(held) / len(held)) if held else None)
    assert M.rolling_mean(df, "v", 1, "i", ["s"], "m").filter("not (m <=> v)").count() == 0


def test_quantiles_with_ties(spark):
    values = [1.0, 2.0, 4.0, 8.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0)] * 50 + [("b", 5.0)] + [("c", None), (None, 9.0)], "k string, v double")
    got = {r.k: (r.q, r.top) for r in M.quantiles(df, "v", ["k"], {"q": 0.25, "top": 1.0}).collect()}
    assert got == {"a": (1.75, 8.0), "b": (3.0, 5.0), None: (9.0, 9.0)}


def test_encoding_counts(spark):
    docs = spark.createDataFrame([(1, "xyzabc  abc"), (2, None), (3, " \n"), (4, "xyz　q")], "d long, t string")
    rank = {p: i for i, p in enumerate([("x", "y"), ("a", "b"), ("ab", "c"), ("xy", "z")])}
    other = {("a", "b"): 0}
    got = {r.d: (r.n_tokens, r.same) for r in same_encoding(docs, "d", "t", rank, rank).collect()}
    assert got == {1: (3, True), 2: (0, True), 3: (0, True), 4: (2, True)}
    assert {r.d: r.same for r in same_encoding(docs, "d", "t", rank, other).collect()}[1] is False


def test_pooling_and_alignment(spark):
    rows = spark.createDataFrame([(0, 1, [3.0, 0.0]), (0, 1, [0.0, 3.0]), (0, 0, [99.0, 99.0]), (1, 0, [5.0, 5.0])], "t int, m int, v array<double>")
    got = {r.t: r.v for r in C.masked_mean(rows, ["t"], "v", "m", 2).collect()}
    assert got[0] == pytest.approx([math.sqrt(0.5)] * 2) and got[1] == [0.0, 0.0]
    a = spark.createDataFrame([(0, 0, 5), (0, 1, 6)], "p int, i int, id int")
    assert C.aligned(a, a, ["p", "i"], "id").count() == 2
    for b in ([(0, 0, 5)], [(0, 0, 5), (0, 1, 7)], [(0, 0, 5), (0, 1, 6), (0, 2, 1)]):
        with pytest.raises(Exception, match="token ids"):
            C.aligned(a, spark.createDataFrame(b, a.schema), ["p", "i"], "id").collect()
    one, two = (spark.createDataFrame(x, "token string, id long") for x in ([("a", 0), ("b", 1)], [("a", 0), ("b", 2), ("c", 3)]))
    assert tuple(C.vocabulary_differences(one, two).first()) == (2, False) and tuple(C.vocabulary_differences(one, one).first()) == (0, True)


def test_steps(spark):
    n = spark.createDataFrame([("ind", 10), ("ood", 4)], "stream string, examples long")
    assert P.planned_steps(n, {"ind": 0.5, "ood": 0.5}, 7, 8).first().steps == 7
    assert P.planned_steps(n, {"ind": 0.5, "ood": 0.5}, -2, 8).first().steps == 5
    with pytest.raises(ValueError):
        P.planned_steps(n, {}, 0, 8)
    with pytest.raises(Exception, match="no examples"):
        P.resolve_steps(spark.createDataFrame([("ind", 0)], n.schema), {"ind": 1.0}, 1.0, 8).collect()


def test_endless_corpus(spark):
    paths = ["a", "b", "c"]
    lines = spark.createDataFrame([(0, 0, "a0"), (0, 1, " "), (0, 2, "a1"), (1, 5, "b0"), (2, 1, None)], "path_no int, line_no long, text string")
    orders = P.path_orders(paths, 3, seed=4)
    assert orders == P.path_orders(paths, 3, seed=4) and all(sorted(o) == [0, 1, 2] for o in orders)
    rows = P.cycle_examples(lines, 3, orders).orderBy("example_no").collect()
    texts = {0: ["a0", "a1"], 1: ["b0"], 2: []}
    assert [r.text for r in rows] == [t for o in orders for p in o for t in texts[p]]
    assert [r.example_no for r in rows] == list(range(9))
    saved = json.loads(json.dumps(P.position(paths, 4, batch=2, done=2)))
    rest = P.resume(P.cycle_examples(lines, 3, orders), saved, paths, 4).orderBy("example_no")
    assert [r.text for r in rest.collect()] == [r.text for r in rows][4:]
    for other in ((["a", "b"], 4), (paths, 5)):
        with pytest.raises(ValueError):
            P.resume(lines, saved, *other)
    with pytest.raises(ValueError):
        P.cycle_examples(lines.filter("text = ' '"), 1, orders)
    assert P.resume_schedule(["ind", "ood"], ["ind", "ood"], 3) == (1, True)
    assert P.resume_schedule(["ind"], ["ind", "ood"], 3) == (0, False)


def test_fixed_width(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4])], "b int, ids array<int>")
    got = sorted((r.b, r.ids, r["mask"]) for r in P.pad(df, "ids", [], most=2, fixed=True).collect())
    assert got == [(0, [1, 2], [1, 1]), (1, [4, 0], [1, 0])]
    with pytest.raises(ValueError):
        P.pad(df, "ids", [], fixed=True)


def test_runs_and_lines(spark):
    df = spark.createDataFrame([("s", i, f) for i, f in enumerate([True, True, False, True, None, True])], "s string, i int, f boolean")
    assert [r.group for r in M.groups_of_runs(df, "f", "i", ["s"]).orderBy("i").collect()] == [0, 0, -1, 1, -1, 2]
    rec = spark.createDataFrame([(3, "1ind/0ood", 2.5, None, float("inf"), 1e-4)], "step long, mix string, lm_loss double, eval_lm_loss double, grad_norm double, learning_rate double")
    assert rec.select(M.training_line(rec)).first()[0] == "step=3 mix=1ind/0ood loss=2.5000 lm=2.5000 lr=1.00e-04"
    assert M.series(rec, ["step"], ["absent"]).count() == 0


def test_routing(spark):
    rows = spark.createDataFrame([("ind", 0, 0.5, 0.25, 1), ("ind", 1, 0.0, 0.75, 0)], "s string, router int, prob double, unbiased double, weight int")
    assert tuple(M.routing_averages(rows, ["s"]).first()) == ("ind", 0.25, 0.5, -0.25, 0.5)
    loss = M.route_loss(rows.withColumnRenamed("prob", "target_prob"), ["s"]).first().route_loss
    assert loss == pytest.approx(-math.log(0.5) - math.log(1e-8))
    assert M.routing_averages(rows.limit(0), ["s"]).count() == 0


def test_small_expressions(spark):
    one = spark.range(1)
    assert tuple(one.select(N.frozen_scale(F.lit(1.0), F.lit(4.0)), N.frozen_scale(F.lit(0.0), F.lit(4.0)), N.gibibytes(F.lit(1 << 31)), N.headroom(F.lit(5), F.lit(9)), N.headroom(F.lit(None).cast("int"), F.lit(9))).first()) == (0.25, 0.0, 2.0, 0, None)
    assert one.select(N.rms_norm(F.array(F.lit(3.0), F.lit(4.0)), 0.0)).first()[0] == pytest.approx([3 / math.sqrt(12.5), 4 / math.sqrt(12.5)])
    assert tuple(one.select(L.mean_loss(F.lit(6.0), F.lit(3)), L.mean_loss(F.lit(0.0), F.lit(0))).first()) == (2.0, 0.0)
    said = spark.createDataFrame([("Yes.",), ("yesterday",), (" No",), (None,)], "r string")
    assert [r[0] for r in said.select(X.judge_says_yes(F.col("r"))).collect()] == [True, True, False, None]
    assert "First answer:\nA" in one.select(X.judge_prompt(F.lit("P"), F.lit("A"), F.lit("B"))).first()[0]


def test_parameters(spark):
    rows = spark.createDataFrame([("m.router.w", [2, 4], "a"), ("m.experts.w", [2, 3, 4], "b"), ("m.embed", [9, 4], "c"), ("m.tied", [9, 4], "c"), ("m.norm", [4], "d")], "name string, shape array<int>, storage string")
    routed = W.route(rows, {"router": 0.1, "masked": 0.2, "standard": 0.3}, ["m.embed"], decay=0.5)
    assert {r.name: (r["class"], r.rate, r.weight_decay) for r in routed.collect()} == {
        "m.router.w": ("router", 0.1, 0.5), "m.experts.w": ("standard", 0.3, 0.5), "m.embed": ("masked", 0.2, 0.5), "m.tied": ("frozen", 0.0, 0.5), "m.norm": ("frozen", 0.0, 0.0)}
    assert {(r.rate, tuple(r.names), r.parameters) for r in W.optimizer_groups(routed).collect()} == {(0.1, ("m.router.w",), 8), (0.2, ("m.embed",), 36), (0.3, ("m.experts.w",), 24)}
    assert W.unique_parameters(rows).first().parameters == 8 + 24 + 36 + 4
    grads = spark.createDataFrame([("g", [3.0]), ("g", [4.0]), ("h", None)], "g string, values array<double>")
    assert {r.g: r.grad_norm for r in W.gradient_norm(grads, ["g"]).collect()} == {"g": 5.0, "h": None}


def test_tensor_surgery(spark):
    assert (T.reindex_axis([10, 4], 7), T.reindex_axis([4, 10], 7), T.reindex_axis([9], 7)) == (0, 1, 0)
    for shape in ([10, 10], [4, 4], []):
        with pytest.raises(ValueError):
            T.reindex_axis(shape, 7)
    rows = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(5)], "r long, values array<double>")
    mapping = lambda pairs: spark.createDataFrame(pairs, "old_id long, new_id long")
    got = {r.r: r["values"][0] for r in T.permute_rows(rows, mapping([(4, 0), (1, 1)])).collect()}
    assert got == {0: 4.0, 1: 1.0, 2: 0.0, 3: 2.0, 4: 3.0}
    assert T.permute_rows(rows, mapping([(4, 0), (1, 1)]), keep_rest=False).count() == 2
    for bad in ([(4, 0), (1, 2)], [(4, 0), (4, 1)], [(4, 0), (1, 0)], [(9, 0)]):
        with pytest.raises(Exception, match="permutation"):
            T.permute_rows(rows, mapping(bad)).collect()
    assert T.permute_mapped_columns(rows, {1: 0}, 2).filter("r = 3").first()["values"] == [-3.0, 3.0]
    with pytest.raises(ValueError):
        T.permute_mapped_columns(rows, {1: 1}, 2)
    with pytest.raises(Exception, match="outside"):
        T.checked_mask(rows, spark.createDataFrame([(5,)], "id long"), 5).collect()
    dense = spark.createDataFrame([("l.mlp.gate_proj.weight", 0, [1.0, 2.0]), ("l.mlp.up_proj.weight", 0, [3.0, 4.0]), ("l.mlp.down_proj.weight", 1, [5.0])], "name string, r long, values array<double>")
    out = {(r.name, r.e, r.r): r["values"] for r in T.dense_to_experts(dense, "l", 3, 2, 2).collect()}
    assert out["l.experts.gate_up_proj", 1, 0] == [1.0, 2.0, 0.0] and out["l.experts.gate_up_proj", 0, 2] == [3.0, 4.0, 0.0] and out["l.experts.gate_up_proj", 0, 3] == [0.0] * 3
    assert out["l.experts.down_proj", 1, 1] == [5.0, 0.0] and out["l.router.scale", 0, 0] == [1.0] * 3 and len(out) == 8 + 6 + 2 + 1
    with pytest.raises(Exception, match="larger"):
        T.dense_to_experts(dense, "l", 1, 2, 2).collect()
    assert T.rename(spark.createDataFrame([("model.language_model.a",), ("model.audio_tower.b",)], "name string"), r"^model\.language_model\.", "model.", drop=r"\.audio_").collect() == [("model.a",)]


def test_own_order_and_names(spark):
    rules = spark.createDataFrame([("s", i, a, b, a + b) for i, (a, b) in enumerate([("x", "y"), ("a", "b"), ("c", "d")])], "tokenizer_id string, idx int, left string, right string, merged string")
    got = [r.idx for r in G.ordered(rules, G.edges(rules), lambda r: -ord(r[1])).orderBy("place").collect()]
    assert got == [0, 2, 1]
    assert [r.idx for r in G.ordered(rules, G.edges(rules), lambda r: 0).orderBy("place").collect()] == [0, 1, 2]
    assert set(G.ORDERS) >= {"good", "original"} and all(G.sort_key(name) for name in G.ORDERS)
    links = spark.createDataFrame([("s", 0, "a", "b", "ab"), ("s", 1, "b", "b", "bb"), ("s", 2, "b", "c", "bc"), ("s", 3, "c", "z", "cz")], rules.schema)
    assert {(r.idx, r.next_idx) for r in G.chains(links).collect()} == {(0, 1), (1, 2), (2, 3)}


def test_run_plans():
    from lexloom.plans.runs import check_options, recipe

    check_options({"rate": 0.5, "steps": None, "all": True}, {"rate": (0, 1), "steps": (1, None), "absent": (0, 1)}, [("all", "some")])
    for options, ranges, groups in (({"rate": 2}, {"rate": (0, 1)}, []), ({"n": 0}, {"n": (1, None)}, []), ({"a": 1, "b": 1}, {}, [("a", "b")])):
        with pytest.raises(ValueError):
            check_options(options, ranges, groups)
    assert json.loads(recipe({"b": 1, "a": None}, {"ind": ["y", "x"]})) == {"options": {"a": None, "b": 1}, "sources": {"ind": ["x", "y"]}}


def test_words_are_encoded_where_the_text_is(spark):
    docs = spark.createDataFrame([(1, "ab\x1cab  ba"), (1, "ab"), (2, None), (3, " 　")], "d int, t string")
    out = same_encoding(docs, "d", "t", {("a", "b"): 0}, {("a", "b"): 0, ("b", "a"): 1})
    assert {r.d: (r.n_tokens, r.same) for r in out.collect()} == {1: (5, False), 2: (0, True), 3: (0, True)}
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()  # no row a word
