import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lexloom.operators import merges as G
from lexloom.operators import rewrite as R
from lexloom.operators.encode import merge_word
from lexloom.plans.sanitize import Edits, sanitize, summary, summary_lines

# Golden values of a small vocabulary: tokens by id, pairs in order. Fixed values.
TOKENS = ["<pad>", "x", "y", "a", "b", "c", "z", "xy", "ab", "abc", "xyz"]
PAIRS = [("x", "y"), ("a", "b"), ("ab", "c"), ("xy", "z")]


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([("s", t, i) for i, t in enumerate(TOKENS)], "tokenizer_id string, token string, id long")


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([("s", i, a, b, a + b) for i, (a, b) in enumerate(PAIRS)], "tokenizer_id string, idx int, left string, right string, merged string")


def test_order_and_ids(spark, vocab, rules):
    order = [r.idx for r in G.ordered(rules, G.edges(rules), "good").orderBy("place").collect()]
    assert order == [1, 0, 2, 3]
    done = sanitize(vocab, rules, ["<pad>"], Edits())
    assert [r.token for r in done.vocab.orderBy("id").collect()] == ["<pad>", "a", "b", "c", "x", "y", "z", "ab", "xy", "abc", "xyz"]
    assert {r.old_id: r.new_id for r in done.remap.collect()} == {0: 0, 1: 4, 2: 5, 3: 1, 4: 2, 5: 3, 6: 6, 7: 8, 8: 7, 9: 9, 10: 10}


def test_delete_and_add(spark, vocab, rules):
    done = sanitize(vocab, rules, ["<pad>"], Edits(delete=["ab"], add=["ayz", "a"]))
    assert {r.token for r in done.gone.collect()} == {"ab", "abc"}
    assert [r.token for r in done.vocab.orderBy("id").collect()] == ["<pad>", "a", "b", "c", "x", "y", "z", "yz", "ayz", "xy", "xyz"]
    assert [(r.left, r.right) for r in done.rules.orderBy("place").collect()] == [("y", "z"), ("a", "yz"), ("x", "y"), ("xy", "z")]
    assert done.initializers == {7: [2, 6], 8: [3, 2, 6]}
    assert done.requested == ["ayz"] and done.ignored == ["a"]
    row = summary(done, vocab, rules).first()
    assert (row.tokens_before, row.tokens_after, row.rules_before, row.rules_after) == (11, 11, 4, 4)
    assert (row.tokens_deleted_total, row.deleted_tokens, row.deleted_merge_pairs, row.original_merges_deleted) == (2, ["ab", "abc"], ["a b", "ab c"], 2)
    assert (row.requested_tokens_added_total, row.intermediate_added_tokens, row.synthetic_merge_pairs, row.existing_ignored_tokens) == (1, ["yz"], ["y z", "a yz"], ["a"])
    assert "Requested tokens added total: 1" in summary_lines(row.asDict()) and "Deleted tokens: ab, abc" in summary_lines(row.asDict())


def test_rename(spark, vocab, rules):
    done = sanitize(vocab, rules, ["<pad>"], Edits(rename={"ab": "AB"}))
    assert {(r.left, r.right, r.merged) for r in done.rules.collect()} == {("a", "b", "AB"), ("x", "y", "xy"), ("AB", "c", "abc"), ("xy", "z", "xyz")}


@pytest.mark.parametrize("add,pairs", [("zab", [("a", "b"), ("z", "ab")]), ("zAB", [("z", "AB")]), ("ABcx", [("c", "x"), ("AB", "cx")])])
def test_rename_with_add(vocab, rules, add, pairs):
    done = sanitize(vocab, rules, ["<pad>"], Edits(rename={"ab": "AB"}, add=[add]))
    tokens = {r.token for r in done.vocab.collect()}
    assert add in tokens and "AB" in tokens and ("ab" in tokens) == (add == "zab")
    held = {(r.left, r.right) for r in done.rules.collect()}
    assert set(pairs) <= held and len(done.made) == len([p for p in pairs if p != ("a", "b")])


def test_a_deleted_token_that_an_addition_needs_again(vocab, rules):
    done = sanitize(vocab, rules, ["<pad>"], Edits(delete=["ab"], add=["abz"]))
    made = [(r.left, r.right) for r in done.rules.orderBy("place").collect()]
    tokens = {r.token for r in done.vocab.collect()}
    assert "abz" in tokens and all(a in tokens and b in tokens and a + b in tokens for a, b in made)


def test_special_plan(vocab, rules, spark):
    more = vocab.unionByName(spark.createDataFrame([("s", "<bos>", 11), ("s", "<eos>", 12)], vocab.schema))
    done = sanitize(more, rules, ["<pad>", "<bos>", "<eos>"], Edits(keep_special=["<eos>"], rename_special={"<bos>": "<pad>"}))
    assert [r.token for r in done.vocab.orderBy("id").collect()][:3] == ["<pad>", "<eos>", "a"]
    assert done.dropped_special == ["<pad>"] and done.kept_special == {"<bos>": "<pad>", "<eos>": "<eos>"}
    row = summary(done, more, rules).first()
    assert (row.special_tokens_kept, row.special_tokens_renamed, row.special_tokens_dropped) == (2, 1, 1)
    for bad in (Edits(keep_special=["a"]), Edits(rename_special={"<bos>": "x", "<eos>": "x", "<pad>": "y"}), Edits(keep_special=["<pad>"], rename_special={"<bos>": "<pad>"}), Edits(keep_special=["<bos>"], rename_special={"<bos>": "q"}), Edits(rename_special={"<bos>": "a"})):
        with pytest.raises(R.PlanError):
            sanitize(more, rules, ["<pad>", "<bos>", "<eos>"], bad)


def test_special_token_made_by_a_rule(vocab, rules):
    with pytest.raises(Exception, match="made by a rule"):
        sanitize(vocab, rules, ["xy"], Edits()).remap.collect()


@pytest.mark.parametrize("edits", [Edits(delete=["nope"]), Edits(delete=["ab"], add=["ab"]), Edits(delete=["<pad>"]), Edits(rename={"a": "b"}), Edits(add=["aq"]), Edits(add=["zz", "zz"]), Edits(rename={"a": "<pad>"}), Edits(rename={"a": "A"}, add=["A"]), Edits(rename={"a": "A", "b": "A"}), Edits(rename={"<pad>": "p"})])
def test_bad_edits(vocab, rules, edits):
    with pytest.raises(ValueError):
        sanitize(vocab, rules, ["<pad>"], edits)


def test_reduction(spark):
    links = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("a", 1, 2), ("b", 0, 1), ("b", 1, 2), ("b", 0, 4), ("b", 2, 4)], "tokenizer_id string, src int, dst int")
    kept = {(r.tokenizer_id, r.src, r.dst) for r in G.reduce_edges(links).collect()}
    assert kept == {("a", 0, 1), ("a", 1, 2), ("b", 0, 1), ("b", 1, 2), ("b", 2, 4)}


@pytest.mark.parametrize("block", [1, 3, 16, 4096])
def test_reduction_in_blocks_equals_all_paths(spark, block):
    rng = random.Random(9)
    links = {(t, *sorted(rng.sample(range(40), 2))) for t in "ab" for _ in range(70)}
    reach = {}
    for t, s, d in sorted(links, key=lambda x: -x[1]):
        reach.setdefault((t, s), set()).update({d} | reach.get((t, d), set()))
    for t, s, d in sorted(links, key=lambda x: -x[1]):
        for e in [x for u, a, x in links if (u, a) == (t, s)]:
            reach[t, s] |= {e} | reach.get((t, e), set())
    want = {(t, s, d) for t, s, d in links if not any((t, o, d) in links and o in reach[t, s] for o in range(40) if o != s)}
    got = G.reduce_edges(spark.createDataFrame(sorted(links), "tokenizer_id string, src int, dst int"), block=block).collect()
    assert {(r.tokenizer_id, r.src, r.dst) for r in got} == want and len(got) == len(want)


def test_cycle_seed_and_unknown_order(spark, rules):
    circle = spark.createDataFrame([("s", 0, 1), ("s", 1, 0)], "tokenizer_id string, src int, dst int")
    with pytest.raises(Exception, match=r"circle: (x y \(0\) -> a b \(1\)|a b \(1\) -> x y \(0\))"):
        G.ordered(rules, circle, "good").collect()
    two = spark.createDataFrame([("s", 0, 1), ("s", 1, 0), ("s", 1, 2), ("s", 2, 3), ("s", 3, 2)], "tokenizer_id string, src int, dst int")
    with pytest.raises(Exception, match=r"circle: (x y \(0\) -> a b \(1\)|a b \(1\) -> x y \(0\))\n?"):
        G.ordered(rules, two, "good").collect()
    assert sorted(G.circle({2, 3, 7}, {2: [3], 3: [2, 7]})) == [2, 3]
    assert G.circle({1, 4, 6}, {1: [4], 4: [6], 6: [1]}) in ([1, 4, 6], [4, 6, 1], [6, 1, 4])
    with pytest.raises(ValueError):
        G.ordered(rules, circle, "good", seed=1)
    with pytest.raises(ValueError):
        G.sort_key("nope")


def test_synthesis():
    assert G.synthesize("ayz", set("ayz")) == [("y", "z"), ("a", "yz")]
    assert G.synthesize("abab", {"a", "b", "ab"}) == [("ab", "ab")]
    with pytest.raises(ValueError):
        G.synthesize("aq", {"a"})


def test_encode():
    rank = {p: i for i, p in enumerate(PAIRS)}
    assert merge_word("xyzabc", rank) == ["xyz", "abc"]


def merge_all(text, rank):
    """One pair at a time, all its places from the left."""
    parts = list(text)
    while pairs := [p for p in zip(parts, parts[1:]) if p in rank]:
        best, out = min(pairs, key=rank.get), []
        while parts:
            size = 2 if tuple(parts[:2]) == best else 1
            out.append("".join(parts[:size]))
            parts = parts[size:]
        parts = out
    return parts


def test_words_with_any_ranks():
    rng = random.Random(4)
    for _ in range(300):
        tokens, pairs = list("abc"), []
        for _ in range(rng.randint(0, 12)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            pairs.append(pair)
            tokens.append("".join(pair))
        pairs = list(dict.fromkeys(pairs))
        if rng.random() < 0.5:  # also ranks that come before those of their parts
            rng.shuffle(pairs)
        rank = {p: i for i, p in enumerate(pairs)}
        word = "".join(rng.choices("abcd", k=rng.randint(0, 40)))
        assert merge_word(word, rank) == merge_all(word, rank)


def test_a_real_vocabulary_and_a_long_word():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=k)) for k in (1, 2, 30, 400)] + ["a" * 97, "internationalization"]
    for word in words:
        assert merge_word(word, rank) == library.encode(word).tokens
    long = "".join(rng.choices("etaoinshrdlu", k=100_000))
    began = time.perf_counter()
    assert "".join(merge_word(long, rank)) == long and time.perf_counter() - began < 20


def test_specials_and_configs(spark):
    specials = spark.createDataFrame([("<bos>",), ("<eos>",), ("<pad>",)], "literal string")
    acts = {r.literal: (r.action, r.new_literal) for r in R.special_actions(specials, ["<bos>"], {"<eos>": "<end>"}).collect()}
    assert acts == {"<bos>": ("keep", "<bos>"), "<eos>": ("rename", "<end>"), "<pad>": ("drop", None)}
    body = '{"vocab_size": 8, "bos_token_id": 6, "eos_token_id": [7], "pad_token_id": 5, "pad_token": "<pad>", "eos_token": "<eos>", "architectures": ["<pad>", "<eos>"], "extra_special_tokens": ["<pad>", {"content": "<eos>"}], "text_config": {"vocab_size_per_layer_input": 8, "decoder_start_token_id": 6}, "added_tokens_decoder": {"7": {"content": "<eos>"}, "5": {"content": "<pad>"}, "x": {"content": "<eos>"}, "6": {"content": "<bos>"}}, "added_tokens_encoder": {"<pad>": 5}}'
    rows = spark.createDataFrame([(body,), (None,)], "body string")
    plan = R.ConfigPlan({6: 0, 7: 1, 0: 2}, {"<eos>": "<end>"}, frozenset({"<pad>"}), frozenset({5}), 7)
    out = [r.body for r in R.remap_configs(rows, plan).collect()]
    got = json.loads(out[0])
    assert got == {
        "vocab_size": 7, "bos_token_id": 0, "eos_token_id": [1], "eos_token": "<end>", "architectures": ["<pad>", "<eos>"], "extra_special_tokens": [{"content": "<end>"}],
        "text_config": {"vocab_size_per_layer_input": 7, "decoder_start_token_id": 0}, "added_tokens_decoder": {"0": {"content": "<bos>"}, "1": {"content": "<end>"}}}
    assert list(got["added_tokens_decoder"]) == ["0", "1"] and out[1] is None
    with pytest.raises(R.PlanError):
        plan.config({"bos_token_id": 99})
    post = {"type": "T", "special_tokens": {"<eos>": {"id": 7, "ids": [7], "tokens": ["<eos>"]}, "<pad>": {"id": 5, "ids": [5], "tokens": ["<pad>"]}}, "single": [{"token": "<eos>"}]}
    assert plan.post_processor(post) == {"type": "T", "special_tokens": {"<end>": {"id": 1, "ids": [1], "tokens": ["<end>"]}}, "single": [{"token": "<end>"}]}
    assert plan.added_tokens([{"id": 7, "content": "<eos>"}, "odd", {"id": 5, "content": "<pad>"}, {"id": 6, "content": "<bos>"}]) == [{"id": 0, "content": "<bos>"}, {"id": 1, "content": "<end>"}, "odd"]


def test_derived_configs(spark):
    whole = {"model_type": "m", "_name_or_path": "p", "text_config": {"hidden_size": 8, "intermediate_size": 16, "use_double_wide_mlp": True, "num_kv_shared_layers": 2}}
    text = json.loads(R.text_only_config(json.dumps(whole)))
    assert text["model_type"] == R.TEXT_MODEL_TYPE and text["_name_or_path"] == "p" and text["hidden_size"] == 8 and "text_config" not in text
    with pytest.raises(R.PlanError):
        R.text_only_config("{}")
    assert json.loads(R.text_only_tokenizer_config('{"image_token": "<i>", "pad_token": "<p>"}')) == {"pad_token": "<p>"}
    moe = json.loads(R.expert_config(json.dumps(whole), 2, 1))
    assert (moe["num_experts"], moe["top_k_experts"], moe["moe_intermediate_size"]) == (2, 1, 32) and "use_double_wide_mlp" not in moe
    assert json.loads(R.expert_config('{"intermediate_size": 4, "use_double_wide_mlp": true}', 3, 3))["moe_intermediate_size"] == 4
    with pytest.raises(R.PlanError):
        R.expert_config('{"intermediate_size": 4}', 2, 3)
    small = json.loads(R.small_config('{"num_hidden_layers": 4, "layer_types": [1, 2, 3, 4], "num_key_value_heads": 4, "other": [1]}', 2, 12, 6, 24))
    assert small == {"num_hidden_layers": 2, "layer_types": [1, 2], "num_key_value_heads": 3, "other": [1], "hidden_size": 12, "num_attention_heads": 6, "head_dim": 2, "intermediate_size": 24}
    with pytest.raises(R.PlanError):
        R.small_config("{}", 1, 10, 3, 4)


def test_groups_and_mapping(spark):
    remap = spark.createDataFrame([("s", "a", 3, 0), ("s", "b", 10, 1), ("s", "ab", 11, 2)], "tokenizer_id string, token string, old_id long, new_id long")
    g = R.token_groups(remap, ["ab"], ["ab"], ["b"]).first()
    assert (g.original_ids, g.added_ids, g.requested_ids, g.intermediate_ids, g.special_ids) == ([0, 1], [2], [2], [], [1])
    assert R.mapping_json(remap, F.col("token") == "ab").first().body == '{"3":0,"10":1}'
