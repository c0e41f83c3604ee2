"""Wide fingerprints at anchors against comparing all pairs of texts."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_tables import jaccard_shingles, kept_by_jaccard, planted_copies

from trailmark.llm import anchored


def many_copies(rng):
    """Pairs of texts of likeness 0.8 to 0.97, and groups of copies."""
    vocabulary = [f"w{k}" for k in range(5000)]
    docs = []
    for i in range(250):
        words = rng.choices(vocabulary, k=rng.choice([80, 200, 700]))
        docs.append((10 * i, " ".join(words)))
        for k in range(rng.choice([1, 1, 3])):
            copy = list(words)
            for at in rng.sample(range(len(words)), max(1, int(len(words) * rng.uniform(0.003, 0.022)))):
                copy[at] = rng.choice(vocabulary).upper()
            docs.append((10 * i + k + 1, "\t".join(copy)))
    return docs


def test_nine_in_ten_links_are_found_and_none_below(spark):
    docs = many_copies(random.Random(8))
    sets = {t: jaccard_shingles(t) for _, t in docs}
    near = set()
    for k, (i, t) in enumerate(docs):
        for j, u in docs[max(0, k - 4) : k]:
            if i // 10 == j // 10 and 5 * len(sets[t] & sets[u]) >= 4 * len(sets[t] | sets[u]):
                near.add((j, i))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = anchored.similar_groups(table, F.unhex(F.md5("text")), F.col("doc_id")).collect()
    root = {r.doc_id: r.root for r in found}
    assert len(near) > 250 and sum(root[a] == root[b] for a, b in near) >= 0.95 * len(near)
    # by groups nothing is joined that no chain of links joins
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        parent[find(a)] = find(b)
    together = {}
    for i, r in root.items():
        assert together.setdefault(r, find(i)) == find(i)


def test_groups_of_planted_copies(spark):
    docs = planted_copies()
    kept = Counter(map(tuple, anchored.keep_one_per_group(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()))
    want = Counter(kept_by_jaccard(docs))
    assert sum((kept & want).values()) >= 0.9 * len(want) and len(kept) <= 1.1 * len(want)


def test_a_large_group_gives_links_in_proportion(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(900)}" for _ in range(400)]
    docs = []
    for i in range(600):
        copy = list(words)
        copy[rng.randrange(400)] = f"x{i}"
        docs.append((i, " ".join(copy), "r"))
    table = spark.createDataFrame(docs, "doc_id long, text string, root string")
    kept = anchored.keep_one_per_group(table).collect()
    assert [tuple(r) for r in kept] == [docs[0]]


def test_odd_rows(odd, none, spark):
    kept = anchored.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 5, 6, 8, 9]
    assert anchored.keep_one_per_group(none).count() == 0
    # one doc_id on two unlike texts: both stay; no doc_id at all: one of equal texts stays
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n"), (None, "o p q"), (None, "o p Q"), (None, None), (None, " ")]
    left = anchored.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert Counter(r.doc_id for r in left) == {1: 2, None: 2}


def test_parts_that_differ_by_a_bit_meet_at_a_home():
    home, at = anchored._HOME, [set(g) for g in anchored._GUESTS]
    assert len(anchored._WORDS) == 16
    for x in range(128):
        assert bin(x ^ int(home[x])).count("1") <= 1
        for y in [x] + [x ^ 1 << k for k in range(7)]:
            assert int(home[x]) in at[y] and int(home[y]) in at[x]


def test_more_texts_get_more_free_bits_and_parts():
    plans = [anchored.cover(n) for n in (0, 10**3, 10**6, 10**7, 10**9)]
    assert plans == sorted(plans, key=lambda p: (p.free, p.parts)) and len({p.free for p in plans}) > 2
    assert all(1 - (1 - (0.8484**7 + 7 * 0.1516 * 0.8484**6) * 0.8484**p.free) ** p.parts > 0.955 for p in plans)


def test_bits_differ_with_the_angle():
    rng = np.random.default_rng(0)
    shares = []
    for _ in range(30):
        all_ = rng.integers(-(1 << 62), 1 << 62, 1000)
        a, b = all_[:900], all_[100:]
        x, y = (anchored.fingerprint(np.unique(s), 8) for s in (a, b))
        shares.append(sum(bin(int(p ^ q) & (1 << 64) - 1).count("1") for p, q in zip(x, y, strict=True)) / 512)
    assert abs(np.mean(shares) - anchored.cover(10).differ) < 0.015


def _texts(rng):
    """Pairs of texts just at the likeness or just below it, passages that many share, and chains of copies of copies."""
    vocabulary = [f"w{k}" for k in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for i in range(220):
        words = rng.choices(vocabulary, k=rng.choice([7, 30, 120, 300, 500]))
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = passage
        texts.append(words)
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, round(len(words) / 5 * rng.uniform(0.1, 0.14)))):
            other[at] = f"x{rng.randrange(10**9)}"
        texts.append(other)
        if i % 4 == 0:
            for _ in range(3):
                other = list(other)
                for at in rng.sample(range(len(other)), max(1, round(len(other) / 5 * 0.1))):
                    other[at] = f"x{rng.randrange(10**9)}"
                texts.append(other)
    return [" ".join(t) for t in texts]


def test_groups_are_those_of_all_pairs(spark):
    texts = _texts(random.Random(4))
    sets = [jaccard_shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in enumerate(sets):
        for b in range(a):
            if 5 * len(s & sets[b]) >= 4 * len(s | sets[b]):
                parent[find(a)] = find(b)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {}
    for r in anchored.similar_groups(table, F.unhex(F.md5("text")), F.col("doc_id")).collect():
        found.setdefault(r.root, set()).add(r.doc_id)
    want = {}
    for i in range(len(texts)):
        want.setdefault(find(i), set()).add(i)
    assert len(want) < len(texts) - 100
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def _sent(plan):
    """What the plan's broadcasts send, each with all below it."""
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            yield "\n".join(lines[k:end])


def test_no_table_of_anchors_fingerprints_or_texts_is_broadcast(spark, monkeypatch):
    """Spark sizes what a function makes as what it is given, so the anchors of a table that is small on disk would be sent."""
    plans, keep = [], anchored.stored

    def stored(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(anchored, "stored", stored)
    table = spark.createDataFrame(many_copies(random.Random(8)), "doc_id long, text string").repartition(4)
    last = anchored.keep_one_per_group(table)
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 12 and any("MapInArrow" in p for p in plans)
    sent = [x for p in plans for x in _sent(p)]
    assert not [x for x in sent if "MapInArrow" in x or "Generate" in x or "fp#" in x or "text#" in x]
