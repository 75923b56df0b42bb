"""Many tokenizers beside one at a time, nested JSON beside Python, masks and experts beside numpy."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import attention as A
from lexloom.operators import json_paths as J
from lexloom.operators import rewrite as R
from lexloom.plans import many as Y
from lexloom.plans.sanitize import Edits, sanitize


def tokenizer(seed):
    """(vocabulary, rules, special tokens) of random words."""
    rng = random.Random(seed)
    tokens, rules = list("abcdefg"), []
    while len(rules) < 25:
        pair = (rng.choice(tokens), rng.choice(tokens))
        if pair not in rules and len("".join(pair)) < 7:
            rules.append(pair)
            if "".join(pair) not in tokens:
                tokens.append("".join(pair))
    specials = ["<pad>", "<s>", "</s>"]
    return specials + tokens, rules, specials


def edits_of(seed, vocab, rules):
    """Edits that may be made: what is renamed or kept is not deleted along with something else."""
    rng = random.Random(seed * 7)
    deleted = [x for x in vocab if len(x) == 3 and x.isalpha()][:1]
    gone = set(deleted)
    for a, b in rules:
        if a in gone or b in gone:
            gone.add(a + b)
    renamed = next((x for x in vocab if len(x) == 2 and x not in gone), None)
    add = ["".join(rng.choices("abcdefg", k=k)) for k in (3, 5)]
    add = [x for i, x in enumerate(add) if x not in gone and x != renamed and x not in add[:i]]
    return Edits(delete=deleted, rename={renamed: renamed.upper()} if renamed and seed % 2 else {}, add=add, keep_special=["<s>"] if seed % 3 else None, rename_special={"</s>": "<end>"} if seed % 3 == 2 else {}, order="good")


def test_many_equal_one_at_a_time(spark):
    made, vocab_rows, rule_rows, special_rows, plan_rows = {}, [], [], [], []
    for seed in range(5):
        vocab, rules, specials = tokenizer(seed)
        edits = edits_of(seed, vocab, rules) if seed else Edits(order="good")
        made[f"t{seed}"] = (vocab, rules, specials, edits)
        vocab_rows += [(f"t{seed}", t, i) for i, t in enumerate(vocab)]
        rule_rows += [(f"t{seed}", i, a, b, a + b) for i, (a, b) in enumerate(rules)]
        special_rows += [(f"t{seed}", t) for t in specials]
        for name, items in (("delete", edits.delete), ("add", edits.add), ("rename", edits.rename), ("keep_special", edits.keep_special or []), ("rename_special", edits.rename_special)):
            plan_rows += [(f"t{seed}", name, i, t, items[t] if isinstance(items, dict) else None) for i, t in enumerate(items)]
    vocab = spark.createDataFrame(vocab_rows, "tokenizer_id string, token string, id long")
    rules = spark.createDataFrame(rule_rows, "tokenizer_id string, idx int, left string, right string, merged string")
    done = Y.sanitize_many(vocab, rules, spark.createDataFrame(special_rows, "tokenizer_id string, token string"), spark.createDataFrame(plan_rows, Y.PLAN))
    all_rules, remap = done.rules.collect(), done.remap.collect()
    starts, groups = Y.initializer_table(done).collect(), {r.tokenizer_id: r for r in Y.group_table(done).collect()}
    for t in ("t0", "t1", "t2", "t4"):
        specials, edits = made[t][2:]
        one = sanitize(vocab.filter(F.col("tokenizer_id") == t), rules.filter(F.col("tokenizer_id") == t), specials, edits)
        assert [(r.left, r.right, r.merged) for r in sorted(all_rules, key=lambda r: r.place) if r.tokenizer_id == t] == [(r.left, r.right, r.merged) for r in one.rules.orderBy("place").collect()]
        assert {(r.token, r.old_id, r.new_id) for r in remap if r.tokenizer_id == t} == {(r.token, r.old_id, r.new_id) for r in one.remap.collect()}
        assert {r.new_id: r.old_ids for r in starts if r.tokenizer_id == t} == one.initializers
        requested = [r.token for r in done.requested.filter((F.col("tokenizer_id") == t) & ~F.col("ignored")).orderBy("seq").collect()]
        want = R.token_groups(one.remap, list(one.added), one.requested, one.specials).first()
        g = groups[t]
        assert requested == one.requested and (g.original_ids, g.added_ids, g.requested_ids, g.intermediate_ids) == (want.original_ids, want.added_ids, want.requested_ids, want.intermediate_ids)
        assert sorted(g.special_ids) == sorted(want.special_ids)
    files = {(r.tokenizer_id, r.name): r.body for r in Y.file_bodies(done).collect()}
    assert list(json.loads(files["t1", "vocab.json"]).values()) == list(range(len(json.loads(files["t1", "vocab.json"])))) and files["t1", "merges.txt"].startswith("#version: 0.2\n")


@pytest.mark.parametrize("row,problem", [
    (("delete", "nope", None), "not in the vocabulary"), (("delete", "<s>", None), "delete and special"), (("rename", "a", "b"), "target exists"),
    (("rename", "<s>", "x"), "rename and special"), (("add", "<s>", None), "add and special"), (("keep_special", "a", None), "not special"),
    (("rename_special", "<s>", "a"), "name is taken"), (("odd", "a", None), "no such action"),
])
def test_conflicts(spark, row, problem):
    vocab, rules, specials = tokenizer(1)
    rows = spark.createDataFrame([("t", t, i) for i, t in enumerate(vocab)], "tokenizer_id string, token string, id long")
    plan = spark.createDataFrame([("t", row[0], 0, row[1], row[2])], Y.PLAN)
    marked = spark.createDataFrame([("t", t) for t in specials], "tokenizer_id string, token string")
    assert any(problem in r.problem for r in Y.plan_conflicts(rows, marked, plan).collect())
    with pytest.raises(R.PlanError, match="t: "):
        Y.sanitize_many(rows, spark.createDataFrame([("t", 0, "a", "b", "ab")], "tokenizer_id string, idx int, left string, right string, merged string"), marked, plan)


def test_nested_json_there_and_back(spark):
    rng = random.Random(2)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.35:
            return {rng.choice(["a", "b\"", "ü", "k/1", "", "x y"]) + str(i): value(depth - 1) for i in range(rng.randint(0, 4))}
        if depth and kind < 0.6:
            return [value(depth - 1) for _ in range(rng.randint(0, 12))]
        return rng.choice([None, True, 3, -1.5, "text", "q\"\\\n", "", 10**15])

    docs = [value(6) for _ in range(40)] + [{}, [], 5, "s", None]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, None)], "i int, body string")
    nodes = J.leaves(rows, ["i"])
    back = {r.i: json.loads(r.body) for r in J.assembled(nodes, ["i"]).collect()}
    assert back == dict(enumerate(docs))
    assert J.differences(nodes, nodes, ["i"]).count() == 0
    assert J.assembled(J.leaves(rows.limit(0), ["i"]), ["i"]).count() == 0


def test_nested_remap_equals_the_plan_in_python(spark):
    body = {
        "vocab_size": 8, "bos_token_id": 6, "eos_token_id": [7, 5], "pad_token": "<pad>", "eos_token": "<eos>", "architectures": ["<pad>"], "kept": [],
        "text_config": {"vocab_size_per_layer_input": 8, "decoder_start_token_id": 6, "deep": [{"unk_token_id": 0}, {"content": "<pad>", "flag": True}]},
        "added_tokens_decoder": {"7": {"content": "<eos>"}, "5": {"content": "<pad>", "x": [1]}, "6": {"content": "<bos>"}}, "tokens": ["<eos>", "<pad>", "z"],
    }
    plan = R.ConfigPlan({6: 0, 7: 1, 0: 2}, {"<eos>": "<end>"}, frozenset({"<pad>"}), frozenset({5}), 7)
    ids = spark.createDataFrame([(6, 0), (7, 1), (0, 2), (5, None)], "old_id long, new_id long")
    literals = spark.createDataFrame([("<eos>", "<end>"), ("<pad>", None)], "token string, new_token string")
    rows = spark.createDataFrame([(1, json.dumps(body))], "i int, body string")
    got = J.assembled(J.remapped(J.leaves(rows, ["i"]), ["i"], ids, literals, F.lit(7)), ["i"]).first().body
    assert json.loads(got) == plan.config(body)
    with pytest.raises(Exception, match="no entry for id 9"):
        J.remapped(J.leaves(rows.select("i", F.lit('{"a_token_id": 9}').alias("body")), ["i"]), ["i"], ids, literals).collect()
    two = spark.createDataFrame([(1, "p", '{"a_token_id": 6}'), (2, "q", '{"a_token_id": 6}')], "i int, vocab string, body string")
    keyed = ids.withColumn("vocab", F.lit("p")).unionByName(spark.createDataFrame([(6, 60, "q")], "old_id long, new_id long, vocab string"))
    own = J.remapped(J.leaves(two, ["i", "vocab"]), ["i", "vocab"], keyed, literals.withColumn("vocab", F.lit("p")), plan="vocab")
    assert {r.i: r.text for r in own.collect()} == {1: "0", 2: "60"}


@pytest.mark.parametrize("left,right", [(1, 0), (5, 0), (3, 4), (0, 3), (1, 1), (40, 2), (0, 0), (0, 1)])
def test_window_runs(spark, left, right):
    rng = random.Random(left * 10 + right)
    places = {s: sorted(rng.sample(range(60), 25)) for s in "ab"}
    rows = spark.createDataFrame([(s, p) for s, ps in places.items() for p in ps], "s string, p int")
    got = {(r.s, r.p): (r.first_key, r.last_key, r.n_keys) for r in A.window_runs(rows, ["s"], "p", left, right).collect()}
    want = {}
    for s, ps in places.items():
        for q in ps:
            seen = [k for k in ps if 0 <= q - k < left or 0 < k - q < right]
            if seen:
                want[s, q] = (seen[0], seen[-1], len(seen))
    assert got == want


def test_group_runs(spark):
    groups = [-1, 0, 0, 1, 1, 1, -1, 0, 0, 2]
    rows = spark.createDataFrame([("a", i, g) for i, g in enumerate(groups)] + [("b", 0, None)], "s string, p int, g int")
    got = {(r.s, r.p, r.first_key, r.last_key) for r in A.group_runs(rows, ["s"], "p", "g").collect()}
    seen = {(q, k) for _, q, a, b in got for k in range(a, b + 1)}
    assert seen == {(q, k) for q, g in enumerate(groups) for k, h in enumerate(groups) if g == h and g >= 0}
    assert len(got) == 4 * 2 + 3 + 1


@pytest.mark.parametrize("activation", list(A.ACTIVATIONS))
def test_experts(spark, activation):
    rng = np.random.default_rng(3)
    tokens, hidden, width, n = 60, 5, 7, 3
    x, gate_up, down = rng.normal(size=(tokens, hidden)), rng.normal(size=(n, 2 * width, hidden)), rng.normal(size=(n, hidden, width))
    routes = [(t, int(e), float(w)) for t in range(tokens - 1) for e, w in zip(rng.permutation(n)[:2] if t % 4 else [0], rng.uniform(size=2))]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    flat = lambda m: [(e, r, m[e, r].tolist()) for e in range(n) for r in range(m.shape[1])]
    for block in (3, 7):
        blocks = A.expert_blocks(frame(flat(gate_up), "e int, r int, values array<double>"), frame(flat(down), "e int, r int, values array<double>"), width, block)
        out = A.experts(frame([(t, v.tolist()) for t, v in enumerate(x)], "t int, values array<double>"), frame(routes, "t int, e int, weight double"), blocks, activation, rows=16)
        got = {r.t: r["values"] for r in out.collect()}
        want = {}
        for t, e, w in routes:
            g, u = np.split(gate_up[e] @ x[t], 2)
            want[t] = want.get(t, 0) + w * (down[e] @ (A.ACTIVATIONS[activation](g) * u))
        assert got.keys() == want.keys() and all(np.allclose(got[t], want[t]) for t in want)


def test_remapping_makes_no_row_a_prefix(spark):
    nodes = spark.createDataFrame([(1, ["ka_token_id"], "3"), (1, ["kx", "kcontent"], '"g"'), (1, ["kx", "ky"], "1"), (2, ["kx", "ky"], "1")], "i int, path array<string>, text string")
    ids = spark.createDataFrame([(3, 5)], "old_id long, new_id long")
    out = J.remapped(nodes, ["i"], ids, spark.createDataFrame([("g", None)], "token string, new_token string"))
    assert sorted((r.i, r.path, r.text) for r in out.collect()) == [(1, ["ka_token_id"], "5"), (2, ["kx", "ky"], "1")]
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
