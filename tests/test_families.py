"""Families as classes against brute force: no link lost, none added, and rows in proportion to the codes."""

import random
from collections import defaultdict
from itertools import combinations

import pytest

from trailmark.operators import families, lookup

LIMIT = 12


def flip(words, rng, n):
    out = list(words)
    for at in rng.sample(range(320), n):
        out[at // 64] ^= 1 << at % 64
    return out


def text(words):
    return "-".join(f"{w:016X}" for w in words)


def links_of(codes):
    """Distinct codes that share a frame and are at most LIMIT bits apart."""
    out = set()
    for (a, x), (b, y) in combinations(sorted(codes.items()), 2):
        if any(i == j for i, j in zip(x, y, strict=True)) and sum((i ^ j).bit_count() for i, j in zip(x, y, strict=True)) <= LIMIT:
            out.add((a, b))
    return out


def expanded(folded):
    """All links that the classes stand for; fails if any comes twice."""
    inside = defaultdict(list)
    for r in folded.members.collect():
        inside[r.class_id].append(r.code)
    found = [p for codes in inside.values() for p in combinations(codes, 2)]
    found += [(a, b) for r in folded.links.collect() for a in inside[r.class_a] for b in inside[r.class_b]]
    found += [(r.q_code, r.r_code) for r in folded.pairs.collect()]
    ordered = [tuple(sorted(p)) for p in found]
    assert len(ordered) == len(set(ordered))
    return set(ordered)


def frame_of(spark, codes, copies=1):
    rows = [(f"{t}:{k}", t, k) for t in codes for k in range(copies)]
    return spark.createDataFrame(rows, "video_hash string, perceptual_hash string, first_seen int")


@pytest.fixture(scope="module")
def mixed():
    """Families of several widths, black first frames (more than a bucket holds unsliced), equal edits."""
    rng = random.Random(11)
    out = []
    for i in range(90):
        words = [rng.getrandbits(64) for _ in range(5)]
        if i % 10:
            words[0] = 0
        if i % 4 == 0:
            words[1] = 0
        out.append(words)
        out += [flip(words, rng, n) for n in (1, 3, 6, 7, 12)]
        out.append([w ^ 1 for w in words])  # no frame in common with the first
        out.append([words[0], *[w ^ 1 for w in words[1:4]], words[4]])
    return {text(w): w for w in out}


def test_classes_stand_for_all_links(spark, mixed):
    folded = families.fold_families(frame_of(spark, mixed))
    assert expanded(folded) == links_of(mixed)
    assert {r.code for r in folded.members.collect()} == set(mixed)


def test_small_slices_change_nothing(spark, mixed, monkeypatch):
    monkeypatch.setattr(families, "SLICED_FROM", 1)
    some = dict(list(mixed.items())[:240])
    assert expanded(families.fold_families(frame_of(spark, some))) == links_of(some)


def test_near_equal_codes_are_rows_in_proportion(spark):
    rng = random.Random(2)
    center = [rng.getrandbits(64) for _ in range(5)]
    codes = {text(w): w for w in [flip(center, rng, rng.choice([1, 2, 3])) for _ in range(1500)]}
    folded = families.fold_families(frame_of(spark, codes))
    rows = folded.members.count() + folded.links.count() + folded.pairs.count()
    links = links_of(codes)
    assert expanded(folded) == links
    assert len(links) > 500 * len(codes)
    assert rows < 6 * len(codes)


def test_facts_and_components(spark, mixed):
    folded = families.fold_families(frame_of(spark, mixed, 2))
    links, near = links_of(mixed), defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    facts = families.family_facts(frame_of(spark, mixed, 2), folded, ["first_seen", "video_hash"]).collect()
    assert len(facts) == len(mixed)
    for r in facts:
        family = near[r.perceptual_hash] | {r.perceptual_hash}
        assert (r.n_links, r.members) == (len(family) - 1, 2 * len(family))
        assert tuple(r["first"]) == (0, min(f"{c}:0" for c in family))
    label = {c: c for c in mixed}
    for _ in mixed:
        lower = {c: min([label[c], *[label[o] for o in near[c]]]) for c in mixed}
        if lower == label:
            break
        label = lower
    assert {r.node: r.component for r in families.folded_components(folded).collect()} == label


def test_other_layouts_nulls_and_empty_tables(spark, mixed):
    odd = ["ABCD", "ABCE", "ABCD-1", "xyz", "xyzzy", ""]
    table = frame_of(spark, [*list(mixed)[:40], *odd]).union(frame_of(spark, [None]))
    some = table.where("perceptual_hash is not null")
    want = {
        (r.q_code, r.r_code)
        for r in lookup.near_duplicate_pairs(some, some, LIMIT, "family").where("q_code < r_code").collect()
    }
    assert expanded(families.fold_families(table)) == want
    none = families.fold_families(table.limit(0))
    assert [d.count() for d in none] == [0, 0, 0]
    assert families.folded_components(none).count() == 0
