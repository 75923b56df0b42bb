import collections
import hashlib
import random
import re

import pytest

from lexloom.llm import decontam, near_dup, substrings
from lexloom.llm.fm_index import FMIndex
from lexloom.llm.graph import components

VOCAB = [f"w{i}" for i in range(400)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def sets_of(text, n):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def corpus(seed, n=150):
    """Chains of edited copies, exact copies, short texts, repeated passages."""
    rng = random.Random(seed)
    rows, passage = [], rng.choices(VOCAB, k=60)
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.35:
            w = words_of(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(VOCAB)
        elif kind < 0.5:
            w = rng.choices(VOCAB, k=rng.randint(0, 30)) + passage + rng.choices(VOCAB, k=rng.randint(0, 30))
        elif kind < 0.6:
            w = rng.choices(VOCAB[:3], k=rng.randint(1, 6))
        else:
            w = rng.choices(VOCAB, k=rng.randint(20, 120))
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "same " * 400), (n + 4, "A B c d e"), (n + 5, "a b C d e")]
    return rows


def brute_components(rows, n):
    sets = {i: sets_of(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, words=4).collect()}
    assert got == brute_components(rows, 4)


def near_copies(seed, n, size=150, most=9):
    """A text and n copies with up to `most` words each replaced, dropped or put in, some by a word
    that other copies got too; links and texts just below the similarity are many."""
    rng = random.Random(seed)
    base, rows = [f"b{i}" for i in range(size)], []
    for i in range(n):
        w = base[:]
        for _ in range(rng.randint(1, most)):
            k, new = rng.randrange(len(w)), rng.choice(["x", "y", f"u{i}x{rng.random()}"])
            w[k : k + rng.randint(0, 1)] = [new] * rng.randint(0, 1)
        rows.append((i, " ".join(w)))
    return rows


def test_links_of_a_large_group_of_near_copies(spark):
    import numpy as np

    rows = near_copies(7, 2000)
    sets = [sets_of(t, 4) for _, t in rows]
    number = {s: k for k, s in enumerate({s for x in sets for s in x})}
    at = np.zeros((len(rows), len(number)), np.float32)
    for i, x in enumerate(sets):
        at[i, [number[s] for s in x]] = 1
    both, n = (at @ at.T).astype(int), at.sum(axis=1).astype(int)
    link = 100 * both >= 80 * (n[:, None] + n[None] - both)
    root = np.arange(len(rows))
    while True:
        low = np.where(link, root[None], len(rows)).min(axis=1)
        if (low == root).all():
            break
        root = low
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, words=4).collect()}
    assert got == dict(enumerate(root.tolist())) and 20 < len(set(got.values())) < 1980


def test_near_duplicates_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dup.near_duplicates(docs).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "3", True), ("None", "None", True)]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    docs = spark.createDataFrame([(5, a), (5, b), (4, a), (9, b + " more"), (2, c), (7, "a " * 300_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect()) == [(2, 2), (4, 4), (5, 4), (5, 4), (7, 7), (9, 4)]


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 130))


def test_fm_index():
    import numpy as np

    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 600)
    start = np.arange(600 - 9)
    got = FMIndex(text).repeated(text, start, 9)
    seen = collections.Counter(tuple(text[i : i + 9]) for i in range(592))
    assert got.tolist() == [seen[tuple(text[i : i + 9])] > 1 for i in start]


def brute_removal(rows, n):
    seen = collections.Counter()
    for _, t in rows:
        w = words_of(t)
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed,spans", [(1, 2000), (2, 2)])
def test_substrings_equal_brute_force(spark, monkeypatch, seed, spans):
    monkeypatch.setattr(substrings, "SHARD_SPANS", spans)  # 2: common anchors are dealt over shards
    rows = [*corpus(seed), (None, "x y " * 30), (3, corpus(seed)[3][1]), (3, corpus(seed)[3][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    got = substrings.remove_repeats(docs, window=35, with_text=True).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removal(rows, 35)
    assert all(sum(s.words for s in r.removed) == r.n_removed and hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(VOCAB, k=rng.choice([1, 3, 5, 9, 20, 45])))) for i in range(25)]
    items += [(25, None), (26, ""), (27, items[3][1]), (28, "rep " * 12), (5, items[6][1]), (5, items[6][1]), (5, items[6][1] + " tail"), (None, items[7][1])]
    rows = []
    for i in range(120):
        w = rng.choices(VOCAB, k=rng.randint(0, 60))
        if rng.random() < 0.7:
            own = words_of(rng.choice(items)[1])
            for _ in range(rng.randint(0, 2)):
                if len(own) > 6:
                    k = rng.randrange(len(own))
                    own[k : k + rng.randint(0, 1)] = [rng.choice(VOCAB)] * rng.randint(0, 1)
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() for x in own]
        rows.append((i, " ".join(w) if rng.random() < 0.9 else ", ".join(w) + "!"))
    rows += [(200, None), (201, ""), (202, items[3][1]), (None, items[3][1]), (203, "rep " * 300), (202, items[4][1])]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    shingles = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([tuple(w)] if w else [])
    split = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    want = {}
    for d, t in rows:
        for i, u in items:
            w, own = split(t), split(u)
            if not w or not own:
                continue
            n = min(5, len(own))
            a, b = shingles(w, n), shingles(own, n)
            for s in range(max(1, len(a) - len(b) + 1)):
                x, y = collections.Counter(a[s : s + len(b)]), collections.Counter(b)
                both = sum((x & y).values())
                sim = both / (sum(x.values()) + sum(y.values()) - both)
                if 100 * both >= 80 * (sum(x.values()) + sum(y.values()) - both):
                    want[d, i] = max(want.get((d, i), 0), round(sim, 6))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(docs, bench).collect()}
    assert got == want and len(want) > 20
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_fm_index_of_weights_and_lengths():
    import numpy as np

    rng = np.random.default_rng(4)
    pieces = [rng.integers(1, 4, rng.integers(3, 20)) for _ in range(80)]
    times = rng.integers(1, 3, 80)
    text = np.concatenate([np.append(p, 0) for p in pieces])
    index = FMIndex(text, 32, np.concatenate([np.full(len(p) + 1, k) for p, k in zip(pieces, times)]))
    seen = collections.Counter()
    for p, k in zip(pieces, times):
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                seen[tuple(p[i:j])] += int(k)
    begin = np.cumsum([0, *[len(p) + 1 for p in pieces]])[:-1]
    start = np.concatenate([b + np.arange(len(p)) for b, p in zip(begin, pieces)])
    length = np.array([rng.integers(1, e + 1) for p in pieces for e in range(len(p), 0, -1)])
    assert index.twice(text, start, length).tolist() == [seen[tuple(text[a : a + n])] > 1 for a, n in zip(start, length)]


def test_recall_of_the_radius(spark):
    """How many windows at the similarity asked for (or as little above it as a size allows) lie within
    the radius: items of every size from 9 to 60 shingles, 300 windows each."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = []
    for m in range(9, 61, 3):
        both = -(-80 * 2 * m // 180)
        for _ in range(300):
            a = [rng.getrandbits(63) for _ in range(m)]
            rows.append((m, a, a[:both] + [rng.getrandbits(63) for _ in range(m - both)]))
    df = spark.createDataFrame(rows, "m int, a array<bigint>, b array<bigint>")
    apart = F.bit_count(decontam.simhash(F.col("a")).bitwiseXOR(decontam.simhash(F.col("b"))))
    found = df.select("m", apart.alias("d")).groupBy("m").agg(F.avg((F.col("d") <= decontam.RADIUS).cast("int")).alias("recall"), F.max("d").alias("most"), F.avg("d").alias("mean")).orderBy("m").collect()
    print([(r.m, round(r.recall, 4), r.most, round(r.mean, 1)) for r in found])
    assert min(r.recall for r in found) >= 0.99 and sum(r.recall for r in found) >= 0.998 * len(found)


def test_blocks_meet_every_pair_within_the_radius(spark):
    from pyspark.sql import functions as F

    rng = random.Random(10)
    pairs = []
    for i in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randint(0, 30)):
            b ^= 1 << k
        pairs.append((i, a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    df = spark.createDataFrame(pairs, "i int, a bigint, b bigint")
    one = df.select("i", F.explode(decontam.block_keys(F.col("a"))).alias("k")).select("i", "k.number", "k.bits")
    two = df.select("i", F.explode(decontam.block_keys(F.col("b"))).alias("k"))
    two = two.select("i", "k.number", F.explode(F.transform(decontam.flips(decontam.RADIUS), lambda x: x.bitwiseXOR(F.col("k.bits")))).alias("bits"))
    met = {r.i for r in one.join(two, ["i", "number", "bits"]).select("i").distinct().collect()}
    assert met >= {i for i, a, b in pairs if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= decontam.RADIUS}
    assert len(met) < 300


def test_long_windows_equal_brute_force(spark):
    head = [f"h{i}" for i in range(80)]
    tails = [[f"t{k}x{i}" for i in range(60)] for k in (0, 1, 2)]
    rows = [(k, " ".join([f"u{k}", *head, *tails[k * k % 5 % 3], f"v{k}"])) for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.remove_repeats(docs, window=100).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removal(rows, 100)


def test_fm_index_of_long_windows():
    import numpy as np

    rng = np.random.default_rng(2)
    head, tails = rng.integers(1, 9, 90), rng.integers(1, 9, (3, 40))
    text = np.concatenate([np.concatenate([[k % 7 + 1], head, tails[k % 3], [0]]) for k in range(24)])
    start = np.array([k * 132 + i for k in range(24) for i in range(131 - 100 + 1)])
    seen = collections.Counter(tuple(text[i : i + 100]) for i in start)
    assert FMIndex(text, depth=100).repeated(text, start, 100).tolist() == [seen[tuple(text[i : i + 100])] > 1 for i in start]
