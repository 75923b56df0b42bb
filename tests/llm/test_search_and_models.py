import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import mixing, queries
from lexloom.llm.language import predict_language, train_language
from lexloom.llm.top_k import exact_top_k
from lexloom.llm.toxicity import fit, out_of_fold, predict_chain, train_chain, training_rows
from lexloom.llm.url_rules import BlockedBloom, judge_urls, listed_pages


LONG = (1 << 63) - 1


def brute(rows, k):
    vecs = [(i, [int(np.floor(np.float64(256 * float(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(256 * float(x)) for x in v)]
    asked = {}
    for i, v in vecs:
        if i % 50 == 0:
            asked[i] = max(asked.get(i, v), v)
    out = []
    for q, a in asked.items():
        hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vecs if i != q and len(b) == len(a))[:k]
        out += [(q, n + 1, i, max(-LONG, min(LONG, -s))) for n, (s, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("shard,leaf", [(4096, 32), (40, 4), (7, 2)])
def test_top_k_is_exact(spark, shard, leaf):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * (1 + i % 3)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 460)]  # ties
    rows += [(100, rows[3][1]), (101, rows[100][1]), (101, rows[100][1])]  # repeated keys
    rows += [(1000, None), (1050, [1.0] * 7 + [float("nan")]), (1100, [None] * 8), (1150, [1.0, 2.0]), (1151, [3.0, -2.0]), (1152, [5.0]), (None, [0.0] * 8), (1200, []), (1201, []), (1250, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in exact_top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard, leaf_rows=leaf).collect())
    assert got == brute(rows, 5)
    assert exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("size", [3e6, 1e9, 1e20, 1e37])
def test_top_k_of_large_numbers(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i, [size] * 8 + [k / 256]) for i, k in ((0, 1), (1, 1), (2, 2), (50, 2))]
    rows += [(i, (rng.normal(size=9) * size).tolist()) for i in range(100, 260)] + [(1300, [-size] * 9), (1301, [1e306] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in exact_top_k(df, F.col("vec_id") % 50 == 0, shard_rows=30, leaf_rows=4).collect())
    assert got == brute(rows, 5)


def test_ball_tree_cuts_leaves():
    from lexloom.llm.top_k import BallTree

    rng = np.random.default_rng(3)
    points = np.floor(rng.normal(size=(4000, 6)) * 20 + 4000 * rng.integers(-3, 4, (4000, 1)))
    tree = BallTree(np.arange(4000), points, leaf=16)
    assert len(tree.levels) == 9
    queries = points[:50]
    best, owner, visited = tree.search(np.arange(50), queries, 5, np.full(50, -np.inf))
    exact = queries @ points.T
    exact[np.arange(50), np.arange(50)] = -np.inf
    for i in range(50):
        want = sorted((-s, j) for j, s in enumerate(exact[i]))[:5]
        assert [(-s, j) for s, j in zip(best[i], owner[i])] == want
    assert visited < 50 * 256 / 4
    again, _, fewer = tree.search(np.arange(50), queries, 5, best[:, -1])
    assert (again == best).all() and fewer <= visited


@pytest.mark.parametrize("size", [1, 1e7, 1e12])
def test_ball_tree_takes_a_leaf_for_many_queries(monkeypatch, size):
    """Vectors in all directions rule out no leaf: each is taken in a few rounds, not once for every query's place of it."""
    from lexloom.llm import top_k

    rng = np.random.default_rng(4)
    points = rng.normal(size=(1024, 48))
    points = np.floor(points / np.linalg.norm(points, axis=1)[:, None] * 256 * size)
    points[900:] = points[0]  # ties
    keys, taken, plain = rng.permutation(1024), [0], top_k.products

    def counted(a, b, kind):
        taken[0] += 1
        return plain(a, b, kind)

    monkeypatch.setattr(top_k, "products", counted)
    best, owner, _ = top_k.BallTree(keys, points, leaf=16).search(keys[::5], points[::5], 5, np.full(205, -np.inf))
    assert taken[0] <= 64 * 7
    for i in range(0, 205, 8):
        want = sorted((-sum(int(x) * int(y) for x, y in zip(points[5 * i], p)), j) for j, p in zip(keys, points) if j != keys[5 * i])[:5]
        assert [(-int(s), j) for s, j in zip(best[i], owner[i])] == want


def test_language(spark):
    rng = random.Random(2)
    words = {"en": ["the", "and", "house", "thing"], "de": ["der", "und", "straße", "ding"], "fr": ["le", "été", "chose", "avoir"]}
    rows = [(i, " ".join(rng.choices(words[x], k=30)), x) for i, x in enumerate(list(words) * 40)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    model = train_language(docs.filter(~queries.held_out(F.col("doc_id"))))
    got = predict_language(docs, model).collect()
    assert [r.lang_pred for r in got] == [r.lang for r in got] and all(0 <= r.lang_score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 --- !!"), (4, "und " * 400000)], "doc_id long, text string")
    assert [r.lang_pred for r in predict_language(odd, model).collect()] == ["und", "und", "und", "de"]
    none = train_language(docs.limit(0))
    assert [r.lang_pred for r in predict_language(odd, none).collect()] == ["und"] * 4


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op5_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_toxicity_chain(spark):
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad, low = rng.random() < 0.2, rng.random() < 0.3
        text = rng.choices(plain, k=40) + ["Vile!"] * bad + ["JUNK"] * low
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(low), int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "w1 " * 200000 + "vile")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (900, None, 1)], "doc_id long, low int, toxic int")
    got = {r.doc_id: r.p_toxic for r in predict_chain(docs, train_chain(docs, marks, ["low", "toxic"])).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, _, t in labels)
    assert got[900] < 0.5 and got[901] < 0.5 and got[902] >= 0.5
    empty = train_chain(docs, marks.limit(0), ["low", "toxic"])
    assert predict_chain(docs, empty).count() == 903


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = train_chain(docs, labels.filter("doc_id % 4 <> 2"), ["low_quality", "toxic"])
    got = predict_chain(docs, chain).join(labels.filter("doc_id % 4 = 2"), "doc_id").collect()
    hits = sum(r.p_toxic >= 0.5 and r.toxic == 1 for r in got)
    recall, precision = hits / sum(r.toxic for r in got), hits / sum(r.p_toxic >= 0.5 for r in got)
    print("toxic: recall", recall, "precision", precision, "rows", len(got))
    low = sum(r.p_low_quality >= 0.5 and r.low_quality == 1 for r in got)
    print("low quality: recall", low / sum(r.low_quality for r in got), "precision", low / max(1, sum(r.p_low_quality >= 0.5 for r in got)))
    assert recall >= 0.8 and precision >= 0.9


def test_training_drops_only_near_copies_with_the_same_labels(spark):
    line = " ".join(f"s{i}" for i in range(12))  # one shingle of it is every text's least
    text = lambda k: line + " " + " ".join(f"t{k}x{i}" for i in range(40))
    docs = spark.createDataFrame([(k, text(k % 10) + " end" * (k // 10)) for k in range(30)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 10 < 5), int(k == 25)) for k in range(30)], "doc_id long, low int, toxic int")
    rows = training_rows(docs, marks, ["low", "toxic"]).collect()
    assert len(rows) == 11  # ten different texts, and the copy with labels of its own
    assert sum(r.toxic for r in rows) == 1


def test_chain_probabilities_are_out_of_fold():
    rng = np.random.default_rng(5)
    n, words = 120, 40
    x = rng.random((n, words)) < 0.3
    row, at = np.nonzero(x)
    fold = rng.integers(0, 3, n)
    y = (rng.random(n) < 0.5).astype(float)
    got = out_of_fold(row, at, np.zeros((n, 0)), y, fold, words)
    for f in range(3):
        inside = np.flatnonzero(fold != f)
        r, a = np.nonzero(x[inside])
        w = fit(r, a, np.zeros((len(inside), 0)), y[inside], words)
        outside = np.flatnonzero(fold == f)
        z = w[0] + x[outside] @ w[1 : 1 + words]
        assert np.allclose(got[outside], 1 / (1 + np.exp(-z)))


def test_toxicity_odd_rows(spark):
    rows = [(1, "good text of words"), (1, "good text of words"), (2, None), (3, ""), (None, "vile words here"), (4, "vile words here " * 20_000)]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, p_toxic double, words int")
    marks = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (4, 1, 1), (4, 1, 1), (5, 1, 1), (None, 1, 1), (3, None, 1)], "doc_id long, low int, toxic int")
    chain = train_chain(docs, marks, ["low", "toxic"])
    got = predict_chain(docs, chain)
    assert got.columns == ["doc_id", "p_low", "p_toxic"] and got.count() == 6
    assert {r.toxic for r in training_rows(docs, marks, ["low", "toxic"]).filter("low = 0").collect()} == {1}  # the greatest label
    assert predict_chain(docs.limit(0), chain).count() == 0


def test_bloom_has_no_false_negative():
    rng = np.random.default_rng(4)
    keys = rng.integers(-(1 << 62), 1 << 62, 5000)
    bloom = BlockedBloom.sized(len(keys))
    bloom.add(keys)
    assert bloom.has(keys).all()
    assert bloom.has(rng.integers(-(1 << 62), 1 << 62, 20000)).mean() < 0.02


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Com", "http://a.com/", "http://EXAMPLE.com/en/x?q#f", "http://www.example.com/en/1", "x://m.www.example.com/en/", "http://x.net/es/", "http://net/fr/1", "http://anet/fr/1", "http://a.org/", "http://a.com/" + "p" * 100000, "a://b.com/x://c.net/es/", "http://example.com?x/en/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: r for r in judge_urls(pages, rules).collect()}
    assert len(got) == len(urls) + 1
    want = [None, None, None, None, "com/", "example.com/en/", "www.example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, "com/", "com/", None, "com/"]
    assert [got[i].rule for i in range(len(want))] == want
    assert [got[i].verdict for i in (0, 4, 5, 6, 8, 10)] == ["allow", "allow", "block", "allow", "block", "allow"]
    assert (got[5].host, got[5].path, got[3].path, got[0].host) == ("example.com", "/en/x", "", "")
    assert {r.verdict for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert judge_urls(pages.limit(0), rules).count() == 0
    listed = spark.createDataFrame([("https://www.a.com",), ("https://www.a.com",), (None,)], "url string")
    assert sorted(r.page_id for r in listed_pages(pages, listed).collect()) == [3, 4, 15]


def test_fill_budget():
    rng = random.Random(5)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 400), 12))
        counts = [rng.randint(1, 9) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randint(0, total)
        take = mixing.fill_budget(lengths, counts, budget)
        assert all(0 <= take[n] <= c for n, c in zip(lengths, counts))
        size = sum(n * k for n, k in take.items())
        base = {n: c * budget // total for n, c in zip(lengths, counts)}  # the share in proportion
        reach, rest = {0}, budget - sum(n * k for n, k in base.items())
        for n, c in zip(lengths, counts):
            reach = {r + n * k for r in reach for k in range(c - base[n] + 1) if r + n * k <= rest}
        assert all(take[n] >= base[n] for n in lengths) and budget - size == rest - max(reach)


def test_fill_budget_uses_all_lengths():
    lengths = list(range(10, 4000, 10)) + [4003]
    take = mixing.fill_budget(lengths, [1] * len(lengths), 50_003)
    assert sum(n * k for n, k in take.items()) == 50_003 and take[4003] == 1


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["s0", "s1", "s2", None])) for i in range(600)]
    rows += [(600, None, "s0"), (None, "a b c", "s1"), (5, "a b", "s1"), (5, "a b", "s1")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(x for x in size if x is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, budget = {}, set(order), sum(size.values())
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if budget * weight[s] / whole > 3 * size[s]]
        target |= {s: 3.0 * size[s] for s in over} if over else {s: budget * weight[s] / whole for s in free}
        budget -= sum(3 * size[s] for s in over)
        free = free - set(over) if over else set()
    taken = {}
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 2 for s in order)
    again = sorted((str(r.doc_id), r.taken) for r in mixing.mix_sources(docs.repartition(7)).collect())
    assert again == sorted((str(r.doc_id), r.taken) for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_fill_budget_with_long_documents_only():
    assert mixing.fill_budget([70_000, 71_000, 72_000], [1, 1, 1], 100_000) == {70_000: 0, 71_000: 0, 72_000: 1}
    rng = random.Random(8)
    for _ in range(20):
        lengths = sorted(rng.sample(range(mixing.FIT_WORDS + 1, 4 * mixing.FIT_WORDS), 9))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)))
        take = mixing.fill_budget(lengths, counts, budget)
        rest = budget - sum(n * k for n, k in take.items())
        assert rest >= 0 and all(0 <= take[n] <= c for n, c in zip(lengths, counts))
        assert not any(take[n] < c and n <= rest for n, c in zip(lengths, counts))


def test_language_equals_brute_force(spark, monkeypatch):
    """Counts of letters and trigrams and their logarithms in plain Python, for a hundred languages,
    with ties, texts in parts and repeated rows."""
    import math
    from collections import Counter

    from lexloom.llm import language

    monkeypatch.setattr(language, "PART", 16)
    rng = random.Random(12)
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)] + list("äéñß")
    rows = []
    for k in range(100):
        own = rng.choices(letters, k=6)
        rows += [("".join(rng.choices([*own, " ", " ", "-"], k=rng.randint(1, 60))), f"l{k:02d}") for _ in range(4)]
    rows += [("same words", "tie b"), ("same words", "tie a"), rows[0], ("12 --", "l00"), (None, "l01"), ("abc", None)]
    model = train_language(spark.createDataFrame(rows, "text string, lang string"))

    def features(text):
        low = "".join(c.lower() if c.isalpha() else " " for c in f" {text or ''} ")
        for i in range(1, len(low) - 1):
            if low[i] != " ":
                yield low[i - 1 : i + 2]
                yield low[i]

    def bucket(f):
        a, b, c = f if len(f) == 3 else ("\0", f, "\0")
        x = (ord(a) << 42 ^ ord(b) << 21 ^ ord(c)) if len(f) == 3 else ord(b) ^ 1 << 62
        return (x * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - (model.buckets.bit_length() - 1))

    count, number = {}, Counter()
    for text, lang in rows:
        if text is not None and lang is not None:
            number[lang] += 1
            count.setdefault(lang, Counter()).update(map(bucket, features(text)))
    asked = [None, "", "??", "same words", *[t for t, _ in rows[:60]], " ".join(t for t, _ in rows[:90])]
    got = model.score([x or "" for x in asked])
    for text, name, score, likely in zip(asked, *got):
        own = [bucket(f) for f in features(text)]
        if not own:
            assert (name, score, likely) == ("und", 0.0, None)
            continue
        log = {x: sum(math.log((n[g] + 0.1) / (n.total() + 0.1 * model.buckets)) for g in own) for x, n in count.items()}
        whole = {x: v + math.log(number[x] / number.total()) for x, v in log.items()}
        best = max(sorted(whole), key=whole.get)
        assert name == best or abs(whole[name] - whole[best]) < 1e-3 * len(own)
        assert likely == pytest.approx(max(log.values()) / len(own), abs=1e-4)
        assert score == pytest.approx(1 / sum(math.exp(v - whole[best]) for v in whole.values()), abs=1e-3)
    assert model.score(["same words"])[0] == ["tie a"]


def test_language_memory_does_not_grow_with_languages():
    import tracemalloc

    from lexloom.llm.language import LanguageModel

    text = " ".join(random.Random(3).choices(["lorem", "ipsum", "dolor", "sit", "amet", "straße"], k=80_000))
    peak = []
    for names in (2, 100):
        model = LanguageModel([f"l{k}" for k in range(names)], np.zeros(names), np.random.default_rng(1).normal(size=(names, 1 << 15)).astype(np.float32))
        model.score(["warm"])
        tracemalloc.start()
        model.score([text])
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < 1.1 * peak[0] + (1 << 20)
