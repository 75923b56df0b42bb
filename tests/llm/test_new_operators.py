"""Prefix trie, fill-in-the-middle and fertility rules beside brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import fertility, fill_middle
from lexloom.llm.byte_automaton import BREAK, CHAR, ROW, SENTINEL, UNIT, automaton, scan
from lexloom.llm.hot_keys import join_to_one
from lexloom.llm.prefix_trie import PRIMES, end_digests, numbered_turns, prefix_trie
from lexloom.llm.running import running_sums

# --- prefix trie ----------------------------------------------------------------------------


def brute_trie(convs):
    """convs: id to list of (role, text). All nodes as tuples."""
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    out = set()
    for path, inside in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if q)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in inside if len(convs[c]) == len(path))))
        up = min(members[path[:-1]]) if path else None
        out.add((min(inside), len(path), up, len(inside), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes_of(frame):
    rows = [tuple(r) for r in frame.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def talks(seed, n=60):
    rng = random.Random(seed)
    said = [("user", "hi"), ("user", "hé 日本"), ("bot", "hi"), ("", "userhi"), ("bot", ""), ("user", "x" * 30)]
    out = {}
    for c in rng.sample(range(-50, 500), n):
        base = list(out[rng.choice(list(out))]) if out and rng.random() < 0.6 else []
        out[c] = base[: rng.randint(0, len(base))] + [rng.choice(said) for _ in range(rng.randint(0 if base else 1, 4))]
    return {c: t for c, t in out.items() if t}


@pytest.mark.parametrize("primes", [PRIMES, ((11, 3), (7, 5)), ((3, 2), (2, 1))])
def test_trie_equals_brute_force_also_where_fingerprints_collide(spark, primes):
    convs = talks(len(primes[0]) + primes[0][0] % 5)
    rows = [(c, i, r or None, t or None, "clash") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(2).shuffle(rows)
    turns = numbered_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, digest string").repartition(5))
    assert nodes_of(prefix_trie(turns, primes=primes)) == brute_trie(convs)


def test_trie_orders_and_edges(spark):
    schema = "conv_id long, turn int, role string, text string"
    rows = [(1, 5, "u", "b"), (1, None, "u", "z"), (1, None, "u", "a"), (1, 5, "u", "b"), (2, None, None, None), (None, 1, "u", "x"), (3, 1, "", "")]
    turns = numbered_turns(spark.createDataFrame(rows, schema))
    convs = spark.createDataFrame([(1,), (2,), (3,), (9,), (8,)], "conv_id long")
    want = {1: [("u", "a"), ("u", "z"), ("u", "b"), ("u", "b")], 2: [("", "")], 3: [("", "")], 9: [], 8: []}
    assert nodes_of(prefix_trie(turns, convs)) == brute_trie(want)
    assert nodes_of(prefix_trie(turns.limit(0), convs)) == brute_trie(dict.fromkeys(want, []))
    assert prefix_trie(turns.limit(0)).count() == 0


def test_trie_of_one_conversation_over_many_tasks(spark):
    rows = [(7, i, "u", f"t{i}") for i in range(3000)] + [(c, i, "u", f"t{i}") for c in range(10, 410) for i in range(3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(6)
    got = nodes_of(prefix_trie(numbered_turns(frame)))
    chars = lambda a, b: sum(len(f"t{i}") for i in range(a, b))
    assert len(got) == 3001
    root, three = next(x for x in got if x[1] == 0), next(x for x in got if x[1] == 3)
    assert root[:7] == (7, 0, None, 401, 1, 1, 400 * chars(0, 3)) and three[:7] == (7, 3, 7, 401, 1, 1, 400 * chars(2, 3))
    assert three[7] == hashlib.sha256(",".join(map(str, range(10, 410))).encode()).hexdigest()
    assert all(x[2] == 7 and x[3] == 1 and x[6] == 0 for x in got if x[1] > 3)


def test_end_digests_of_many_ids(spark):
    ends = spark.range(30_000).select(F.col("id").alias("conv_id"), F.lit(2).cast("long").alias("d"), (F.col("id") % 7 == 0).cast("long").alias("fp"), F.lit("").alias("split"))
    got = {r.fp: r.ends_sha256 for r in end_digests(ends.repartition(9)).collect()}
    want = {k: hashlib.sha256(",".join(str(i) for i in range(30_000) if (i % 7 == 0) == bool(k)).encode()).hexdigest() for k in (0, 1)}
    assert got == want


def test_running_sums_over_tasks(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, 40]), i, rng.randint(0, 50)) for i in range(4000)]
    frame = spark.createDataFrame(rows, "k long, o int, v long").withColumn("m", F.col("v")).repartition(7)
    got = {(r.k, r.o): (r.run_v, r.run_m) for r in running_sums(frame, "k", [F.col("o")], {"v": None, "m": 13}, ["o"], "t").collect()}
    so_far, want = Counter(), {}
    for k, o, v in sorted(rows):
        so_far[k] += v
        want[k, o] = (so_far[k], so_far[k] % 13)
    assert got == want
    assert running_sums(frame.limit(0), "k", [F.col("o")], {"v": None}, [], "t").count() == 0


def test_join_to_one_with_hot_and_missing_keys(spark):
    many = spark.createDataFrame([(0, i) for i in range(5000)] + [(i, i) for i in range(1, 4)] + [(None, 9), (77, 9)], "k long, v long")
    one = spark.createDataFrame([(0, "hot", 5000), (1, "a", 1), (2, "b", 1), (3, "c", 1)], "k long, name string, n long")
    inner = Counter(r.name for r in join_to_one(many, one, {"k": "k"}, "n").collect())
    assert inner == {"hot": 5000, "a": 1, "b": 1, "c": 1}
    left = Counter(r.name for r in join_to_one(many, one, {"k": "k"}, "n", "left").collect())
    assert left == inner + Counter({None: 2})


# --- fill in the middle ---------------------------------------------------------------------

LETTERS = st.lists(st.sampled_from(["a", "\n", "é", "日", "\U0001f600", "<", "P", ">", "<P>", "<S", "M>", " ", "\r", "\x00"]), max_size=40).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=6), st.integers(0, 3))
def test_automaton_marks(texts, times):
    texts = [t * 20**times if len(t) * 20**times < 9 * ROW else t for t in texts]
    joined = b"".join([bytes([BREAK]), *(t.encode() + bytes([BREAK]) for t in texts)])
    marks, at = scan(np.frombuffer(joined, np.uint8), automaton(fill_middle.SENTINELS)), 1
    for t in texts:
        part = marks[at : at + len(t.encode())]
        assert (part & CHAR).astype(bool).sum() == len(t)
        assert np.flatnonzero(part & UNIT).tolist() == [len(t[: m.start()].encode()) for m in re.finditer(r"[^\n]*\n|[^\n]+", t)]
        assert np.flatnonzero(part & SENTINEL).tolist() == [len(t[: m.end()].encode()) - 1 for m in re.finditer("<[PSM]>", t)]
        assert marks[at + len(t.encode())] == 0
        at += len(t.encode()) + 1


def brute_cut(key, text, seed=7, rate=100, spm=50, sentinels=("<P>", "<S>", "<M>")):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in sentinels) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    p, s, m = sentinels
    out = s + suffix + p + prefix + m + middle if h[3] % 100 < spm else p + prefix + s + suffix + m + middle
    return n, "spm" if h[3] % 100 < spm else "psm", len(prefix), len(middle), out


@pytest.mark.parametrize("options", [{}, {"seed": 1, "rate": 60, "spm": 10}, {"sentinels": ("<|pre|>", "<|süf|>", "\x01")}])
def test_fill_middle(spark, options):
    rng = random.Random(5)
    texts = [None, "", "\n", "\n\n", "one line", "a <P> b\nc", "a\r\nb\x0bc", "<|pre|>\n", "日本\n" * 30_000, "<" * 20 + "\nS>\n", "ends with <\n<S"]
    texts += ["".join(rng.choice(["ab", "é", "\n", "<", "S", ">", "\U0001f600"]) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    rows = [(None if i == 3 else i // 2, t, "clash", 1) for i, t in enumerate(texts)]
    made = fill_middle.fill_middle(spark.createDataFrame(rows, "doc_id long, text string, form string, output int"), **options)
    back = fill_middle.restored(F.col("output"), F.col("form"), options.get("sentinels", fill_middle.SENTINELS))
    got = Counter((r.doc_id, (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output), r.back) for r in made.withColumn("back", back).collect())
    assert got == Counter((k, brute_cut(k, t, **options), t or "") for k, t, *_ in rows)
    assert {g[1][1] for g in got} == {"plain", "psm", "spm"}


def test_fill_middle_edges(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert fill_middle.fill_middle(empty).count() == 0
    for wrong in (("<P>", "<P>", "<M>"), ("<P>", "x<P>", "<M>"), ("", "a", "b"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            fill_middle.fill_middle(empty, sentinels=wrong)


# --- fertility ------------------------------------------------------------------------------


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeat = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(text), len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat)


PIECES = ["a", "b c ", " d", "\n", "x y z v w ", "\t", "#", "é日", "　", "a b c d e\n", "a b c d e f\n", "<|>", "\x0b", "\x85"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=5))
def test_plain_counts(texts):
    got = list(zip(*(c.tolist() for c in fertility.plain_counts(texts))))
    assert got == [brute_counts(t) for t in texts]


@pytest.mark.parametrize("name", [*fertility.VOCABULARIES, "byte_bpe_50k.json"])
def test_measures_equal_the_libraries(name):
    import base64

    import public_tokenizers

    path = public_tokenizers.path(name)
    texts = ["", "one two two", "日本語テスト 𓀀", "line\nline\nline", "ö" * 50, "word " * 300]
    if name.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        ids, single = [library.encode_ordinary(t) for t in texts], lambda i: (b := library.decode_single_token_bytes(i)) and len(b) == 1 and b[0] > 127
    elif name.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, single = [library.encode(t) for t in texts], lambda i: library.is_byte(i) and int(library.id_to_piece(i)[3:5], 16) > 127
    else:
        import tokenizers

        library = tokenizers.Tokenizer.from_file(path)
        ids, single = [library.encode(t).ids for t in texts], lambda i: library.decode([i]) == "�" and len(library.id_to_token(i)) == 1
    tokens, per, share, even = fertility.pieces(path).measures(texts, np.array([len(t) for t in texts]))
    for i, (t, x) in enumerate(zip(texts, ids)):
        assert tokens[i] == len(x)
        if not x:
            assert math.isnan(per[i]) and math.isnan(share[i]) and math.isnan(even[i])
            continue
        h = -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())
        assert per[i] == pytest.approx(len(t) / len(x)) and share[i] == pytest.approx(sum(map(single, x)) / len(x))
        assert even[i] == pytest.approx(h / math.log2(len(x)) if len(x) > 1 else 1.0)


def test_scripts(spark):
    said = {"plain words": "Latin", "Это русский text": "Cyrillic", "日本 語": "Han", "12 !!": "None", "ñandú": "Latin", "かな": "Kana", "": "None", "αβ ab": "Latin"}
    rows = spark.createDataFrame([(t,) for t in said], "text string")
    assert {r.text: r.s for r in rows.select("text", fertility.script_of(F.col("text")).alias("s")).collect()} == said


def test_fertility_rules(spark):
    rng = random.Random(4)
    words = "the and of language model sentence clean water river mountain people other which during between small house".split()
    clean = [" ".join(rng.choices(words, k=rng.randint(20, 200))) + "." for _ in range(300)]
    symbols = [" ".join(w + rng.choice(["$$$", "%%%", "&&&", "###"]) for w in rng.choices(words, k=100)) for _ in range(5)]
    copies = [clean[0]] * 400
    other = [None, "", "few words only", "same words again and again " * 40, "x" * 100_000 + " " + clean[1], "日本語 " * 20]
    texts = clean + symbols + copies + other
    rows = [(None if i == 5 else i % 700, t, None if i % 9 == 0 else "en", 1, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, low_entropy_0 string").repartition(3)
    got = fertility.fertility_rules(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        _, n_words, word_chars, n_symbols, n_dup, n_repeat = brute_counts(t or "")
        same = [r for r in by[rows[i][0]] if (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, word_chars, n_symbols, n_dup, n_repeat)]
        assert same and all(r.base_failed == (n_words < 10 or 100 * n_repeat > 20 * n_words) for r in same)
        assert all(r.kept == (not r.base_failed and not r.reasons) for r in same)
        if t in clean[:300] and not same[0].base_failed:
            assert all(r.kept for r in same)
        if t in symbols:
            assert all("chars_per_token_0" in r.reasons and not r.kept for r in same)
    assert fertility.fertility_rules(docs.limit(0)).count() == 0
    alone = fertility.fertility_rules(docs.drop("lang"), language=None, paths=[fertility.tokenizer_path("byte_bpe_50k.json")])
    assert {r.language for r in alone.collect()} == {"Latin", "Han", "None"}


def test_too_many_single_bytes_are_rejected(spark):
    rng = random.Random(6)
    words = "the and of language model sentence clean water river mountain people other which during between small house".split()
    clean = [" ".join(rng.choices(words, k=rng.randint(60, 200))) + "." for _ in range(300)]
    long = "international responsibility administration understanding communication representatives organization professional".split()
    # as many characters a token as clean texts have, but a third of the tokens are bytes of signs that the vocabulary has not
    strange = [" ".join(w + ("𓀀" if k % 5 < 1 else "") for k, w in enumerate(rng.choices(long, k=150))) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(clean + strange)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r.doc_id: r for r in fertility.fertility_rules(docs).collect()}
    assert all(got[i].kept for i in range(300) if not got[i].base_failed)
    for i in range(300, 305):
        assert not got[i].base_failed and not got[i].kept and got[i].reasons[0].startswith("byte_share")


def test_bands_are_quartiles_with_slack(spark):
    values = sorted(random.Random(8).gauss(4, 0.2) for _ in range(101))
    rows = [("a", 100, v, 0.1, 0.5) for v in values] + [("b", 100, 4.0, 0.0, 1.0)]
    frame = spark.createDataFrame(rows, "language string, tokens_0 long, chars_per_token_0 double, byte_share_0 double, entropy_0 double")
    bands = {r.language: r for r in fertility.rejection_bands(frame, ["language"], ["chars_per_token_0", "byte_share_0", "entropy_0"], fences=4.0, low=0.1, high=0.5).collect()}
    q1, q2, q3 = values[25], values[50], values[75]
    assert bands["a"].texts == 101 and bands["a"].low_chars_per_token_0 == pytest.approx(min(q1 - 4 * (q3 - q1), 0.9 * q2), abs=0.05)
    assert bands["a"].high_byte_share_0 == pytest.approx(0.6) and bands["b"].high_chars_per_token_0 == pytest.approx(6.0)
    assert bands["b"].low_entropy_0 == pytest.approx(0.9)


def test_registered_rules(spark, sf):
    from lexloom.llm import queries as Q

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in Q.op13_fertility(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t)[1:]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and (not r.kept or not r.base_failed)
    passed = [r for r in got.values() if not r.base_failed]
    assert sum(r.kept for r in passed) >= 0.9 * len(passed)


def test_many_languages_have_the_same_buckets(spark):
    from lexloom.llm.language import BUCKETS, predict_language, train_language

    rng = random.Random(12)
    words = {f"l{k}": ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(12)] for k in range(300)}
    rows = [(k, i, " ".join(rng.choices(w, k=30))) for k, w in words.items() for i in range(3)]
    docs = spark.createDataFrame(rows, "lang string, i int, text string")
    model = train_language(docs.filter("i < 2"))
    few = train_language(docs.filter("i < 2 and lang in ('l1', 'l2')"))
    assert model.buckets == few.buckets == BUCKETS and len(model.names) == 300
    assert np.array_equal(model.log[model.names.index("l2")], few.log[1])
    found = predict_language(docs.filter("i = 2"), model).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 290
    with pytest.raises(ValueError, match="languages"):
        train_language(docs, most_entries=299 * BUCKETS)


def test_top_k_takes_several_shards_a_task(spark):
    from lexloom.llm.top_k import exact_top_k

    rng = np.random.default_rng(5)
    points = rng.normal(size=(700, 6))
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in exact_top_k(frame, F.col("vec_id") % 50 == 0, k=4, shard_rows=20, leaf_rows=5).collect()}
    whole = np.floor(256 * points).astype(np.int64)
    want = {}
    for q in range(0, 700, 50):
        best = sorted(((-int(whole[q] @ whole[i]), i) for i in range(700) if i != q))[:4]
        want |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert got == want
