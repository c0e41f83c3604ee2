"""Links of the vector graph against comparing all pairs; no link may be below the bound, nine in ten must be found."""

import math
from collections import Counter

import numpy as np
import pytest

from trailmark.llm import vector_graph as vg


def by_brute_force(rows):
    """(n_links, component_id, kept) of every row, all pairs compared."""
    x, group = [], []
    for _, v, label in rows:
        good = label is not None and v is not None and all(y is not None and math.isfinite(y) for y in v) and any(v)
        x.append(np.array(v, float) / np.linalg.norm(v) if good else None)
        group.append((label, len(v)) if good else None)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for g in {y for y in group if y}:
        at = [i for i, y in enumerate(group) if y == g]
        m = np.array([x[i] for i in at])
        for a, b in zip(*np.nonzero(m @ m.T >= 0.98), strict=True):
            if a != b:
                links[at[a]] += 1
                parent[find(at[a])] = find(at[b])
    least = {}
    for i, (k, *_) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    ids = [least.get(find(i)) for i in range(len(rows))]
    return [(k, n, c, k is not None and k == c) for (k, *_), n, c in zip(rows, links, ids, strict=True)]


def planted(rng, n, labels, dim=24):
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        label = int(rng.integers(labels))
        rows.append((int(i), v.tolist(), label))
        for k in range(int(rng.choice([0, 0, 0, 2, 12]))):
            w = v + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.14, 0.2])
            rows.append((10_000 + 20 * i + k, (w * rng.choice([1, 7.5])).tolist(), int(rng.integers(labels)) if rng.random() < 0.1 else label))
    return rows


@pytest.mark.parametrize("size", [1024, 60])
def test_links_equal_comparing_all_pairs(monkeypatch, spark, size):
    monkeypatch.setattr(vg, "SHARD", size)
    monkeypatch.setattr(vg, "FIT", 200)
    monkeypatch.setattr(vg, "CHUNK", 150)
    rng = np.random.default_rng(13)
    rows = planted(rng, 500, 3)
    rows += [(50_000 + i, rows[7][1], rows[7][2]) for i in range(150)]  # copies of one vector
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = {r.vec_id: r for r in vg.near_duplicates(table).collect()}
    want = by_brute_force(rows)
    assert len(got) == len(want)
    seen, all_ = sum(got[k].n_links for k, *_ in want), sum(n for _, n, *_ in want)
    assert all(got[k].n_links <= n and got[k].component_id >= c for k, n, c, _ in want)
    assert seen >= 0.99 * all_ and sum(got[k].component_id == c for k, _, c, _ in want) >= 0.99 * len(want)
    assert all_ > 150 * 149 and len({c for *_, c, _ in want}) > 300


def test_odd_vectors_and_empty_tables(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 0), (2, one, 0), (2, one, 0), (3, one, None), (4, one, 1), (None, one, 0), (None, [9.0, 9.0, 1.0], 0), (None, [9.0, 9.0, 1.0], 0),
        (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0), (8, [1.0, float("nan"), 3.0], 0),
        (9, [1.0, float("inf"), 3.0], 0), (10, [2.0, 4.0, 6.0], 0), (11, [1.0, 2.0], 0), (12, [1.0, 2.0, 3.0, 0.0], 0), (13, [], 0), (14, [], 0),
        (15, [1e-300, 2e-300, 3e-300], 0), (16, [1e300, 2e300, 3e300], 0), (17, [-0.0, 5.0, 0.0], 2), (18, [0.0, 5.0, -0.0], 2), (None, None, None),
    ]
    schema = "vec_id long, embedding array<double>, label int"
    table = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS node", "2 AS cell", "3 AS v", "4 AS copies", "5 AS n_links")
    got = Counter(tuple(r) for r in vg.near_duplicates(table.repartition(3)).collect())
    plain = [(k, None if v is None else [y if y is None or abs(y) > 1e-200 and abs(y) < 1e200 or not math.isfinite(y) or y == 0 else y * 1e300 if abs(y) < 1 else y / 1e300 for y in v], la) for k, v, la in rows]
    assert got == Counter(by_brute_force(plain))
    assert vg.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_neighbours_lead_to_every_row():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    lists = vg.pruned(x)
    near = np.full((len(x), max(map(len, lists))), -1)
    for i, own in enumerate(lists):
        near[i, : len(own)] = own
        assert i not in own and len(own) <= 2 * vg.DEGREE
    places, like = vg.greedy(x, near, np.array([0]), x, 32)
    assert np.mean([i in p for i, p in enumerate(places.tolist())]) > 0.97
    exact = np.sort(x @ x.T, axis=1)[:, -5:]
    assert np.mean(np.sort(like, axis=1)[:, -5:] >= exact - 1e-12) > 0.9


def test_few_found_links_widen_the_beam(monkeypatch, spark):
    beams = []
    monkeypatch.setattr(vg, "audit", lambda *a: beams.append(1) or (0.5 if len(beams) == 1 else 1.0))
    rows = planted(np.random.default_rng(1), 30, 1)
    vg.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).count()
    assert len(beams) == 2


def test_the_audit_counts_what_was_missed(spark):
    rows = planted(np.random.default_rng(2), 60, 1)
    nodes = [("a", b"%16d" % i, np.array(v).tobytes()) for i, v, _ in rows]
    want = {b"%16d" % k: n for k, n, *_ in by_brute_force(rows)}
    table = spark.createDataFrame(nodes, "cell string, node binary, v binary")
    for share in (1, 0):
        found = spark.createDataFrame([(k, n * share) for k, n in want.items()], "node binary, hits long")
        assert vg.audit(table, found, "<f8", queries=len(rows)) == share


def test_shards_are_not_handed_what_is_unlike(monkeypatch, spark):
    """What a shard gets beyond its own nodes follows the like pairs, not all neighbours; pairs over shards still link."""
    monkeypatch.setattr(vg, "SHARD", 60)
    monkeypatch.setattr(vg, "FIT", 200)
    kept, keep = {}, vg.stored

    def stored(df, label):
        kept[label] = keep(df, label)
        return kept[label]

    monkeypatch.setattr(vg, "stored", stored)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 24))
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    rows += [(1000 + i, (x + rng.normal(size=24) * 0.02).tolist(), 1) for i, x in enumerate(v[:100])]
    found = vg.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"))
    assert found.agg({"n_links": "sum"}).first()[0] >= 198
    lists = kept["lists"]
    assert sum(len(r[1]) for r in lists.collect()) < 600
