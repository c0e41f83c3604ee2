"""Banded near-duplicate matching against brute force, with and without hot bands."""

import random

import pytest
from pyspark.sql import functions as F

from trailmark.functions import bits
from trailmark.operators import lineage, lookup


def flip(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(5)] ^= 1 << rng.randrange(64)
    return out


def text(words):
    return "-".join(f"{w:016X}" for w in words)


def distance(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b))


@pytest.fixture(scope="module")
def hashes():
    """A third shares black first frames, half of those also a second one; near copies of all."""
    rng = random.Random(5)
    out = []
    for i in range(60):
        words = [rng.getrandbits(64) for _ in range(5)]
        if i % 3 == 0:
            words[0] = 0
        if i % 6 == 0:
            words[1] = 0
        out.append(words)
        out += [flip(words, rng, n) for n in (1, 4, 9, 12)]
    return out


def frame(spark, hashes):
    rows = [(f"{i:04d}", text(w)) for i, w in enumerate(hashes)]
    return spark.createDataFrame(rows, "video_hash string, perceptual_hash string")


def brute(hashes, threshold):
    codes = {text(w): w for w in hashes}
    return {
        (a, b, distance(x, y))
        for a, x in codes.items()
        for b, y in codes.items()
        if any(p == q for p, q in zip(x, y)) and distance(x, y) <= threshold
    }


@pytest.mark.parametrize("hot_pairs", [0, 20, 10**9])
@pytest.mark.parametrize("mode,threshold", [("cache", 10), ("family", 12)])
def test_pairs_equal_brute_force(spark, hashes, mode, threshold, hot_pairs):
    df = frame(spark, hashes)
    got = lookup.near_duplicate_pairs(df, df, threshold, mode, hot_pairs=hot_pairs).collect()
    assert len(got) == len({(r.q_code, r.r_code) for r in got})
    assert {tuple(r) for r in got} == brute(hashes, threshold)


def test_shared_black_frames_make_no_hot_slice(spark):
    """All codes share three of five frames: no (band, slice) key holds more than a small part of them."""
    rng = random.Random(5)
    rows = [("0" * 16 + "-" + "0" * 16 + "-" + "0" * 16 + "-" + f"{rng.getrandbits(64):016x}-{rng.getrandbits(64):016x}",) for _ in range(2000)]
    codes = spark.createDataFrame(rows, "code string")
    slices = lookup._remainder_slices(F.col("code"), F.lit(0), 5, 11)
    keys = codes.select(F.posexplode(slices).alias("i", "v")).groupBy("i", "v").count()
    assert keys.agg(F.max("count")).first()[0] < 100
    assert keys.select("i").distinct().count() == 11


def test_codes_in_another_layout_are_kept(spark, hashes):
    short = [text(w)[: 16 * 3 + 2] for w in hashes[:6]]
    rows = [(str(i), h) for i, h in enumerate(short + [text(w) for w in hashes[:6]])]
    df = spark.createDataFrame(rows, "video_hash string, perceptual_hash string")
    for hot in (0, 10**9):
        got = {(r.q_code, r.r_code) for r in lookup.near_duplicate_pairs(df, df, hot_pairs=hot).collect()}
        assert {(h, h) for h in short} <= got


def test_candidate_counts_equal_brute_force(spark, hashes):
    left, right = hashes[::2], hashes[::3]
    got = {
        r.perceptual_hash: r.candidates
        for r in lookup.lsh_candidates(frame(spark, left), frame(spark, right)).collect()
    }
    codes = {text(w): w for w in right}
    want = {}
    for w in left:
        n = sum(any(p == q for p, q in zip(w, v)) for v in codes.values())
        if n:
            want[text(w)] = n
    assert got == want


@pytest.mark.parametrize("large", [0, 3, 10**6])
def test_candidates_make_a_row_a_band_and_full_values_no_pairs(spark, hashes, large):
    """Values of few and of very many codes: counts by brute force, however full a value may be."""
    rng = random.Random(3)
    left = hashes[::2] + [[0, rng.choice([0, 1]), rng.choice([5, 6, 7]), rng.getrandbits(64), 9] for _ in range(40)]
    right = hashes[::3] + [[rng.choice([0, 4]), rng.choice([0, 1]), rng.choice([5, 6]), 1, rng.choice([9, 8])] for _ in range(60)]
    right += [[rng.getrandbits(64) for _ in range(4)] + [9] for _ in range(20)]
    known = {text(w): w for w in right}
    want = {}
    for w in left:
        met = [[p == q for p, q in zip(w, v, strict=True)] for v in known.values()]
        if any(map(any, met)):
            want[text(w)] = (sum(map(any, met)), sum(map(any, zip(*met, strict=True))))
    got = lookup.lsh_candidates(frame(spark, left), frame(spark, right), large=large)
    assert {r.perceptual_hash: (r.candidates, r.bands_hit) for r in got.collect()} == want


def test_more_bands_than_sets_of_bands_could_be_made_of(spark, hashes):
    """Twenty bands: a row for every set of them would be a million rows a code."""
    df = frame(spark, hashes[:20])
    got = {r.perceptual_hash: r.bands_hit for r in lookup.lsh_candidates(df, df, num_bands=20).collect()}
    assert got == {text(w): 20 for w in hashes[:20]}


def test_tiers(spark, hashes):
    stored = frame(spark, hashes[:20])
    near = flip(hashes[0], random.Random(1), 2)
    rows = [("0003", text(hashes[3])), ("new1", text(hashes[4])), ("new2", text(near)), ("new3", "F" * 16)]
    asked = spark.createDataFrame(rows, "video_hash string, perceptual_hash string")
    got = {r.video_hash: r for r in lookup.tiered_lookup(asked, stored).collect()}
    assert (got["0003"].cache_hit_type, got["0003"].perceptual_distance) == ("exact", None)
    assert (got["new1"].matched_hash, got["new1"].perceptual_distance) == ("0004", 0)
    assert got["new2"].cache_hit_type == "perceptual" and got["new2"].perceptual_distance <= 2
    assert got["new3"].cache_hit_type == "miss"


def test_parents_of_copies_and_near_copies(spark, hashes):
    rng = random.Random(9)
    codes = [text(w) for w in hashes]
    rows = [(f"{i:04d}", rng.choice(codes), rng.randrange(50)) for i in range(400)]
    rows = [(v, c, f"2024-01-{1 + d // 24:02d} {d % 24:02d}:00:00") for v, c, d in rows]
    df = spark.createDataFrame(rows, "video_hash string, perceptual_hash string, t string")
    df = df.select("video_hash", "perceptual_hash", F.col("t").cast("timestamp_ntz").alias("first_seen"))
    words = {text(w): w for w in hashes}
    want = {}
    for v, c, t in rows:
        best = [
            (distance(words[c], words[o]), ot, ov)
            for ov, o, ot in rows
            if (ot, ov) < (t, v)
            and distance(words[c], words[o]) <= 12
            and any(p == q for p, q in zip(words[c], words[o]))
        ]
        want[v] = min(best)[2] if best else None
    for hot in (0, 10**9):
        got = {r.video_hash: r.parent_hash for r in lineage.assign_parents(df, hot_pairs=hot).collect()}
        assert got == want


def test_generations_roots_and_cycles(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", "gone"), ("y", "x")]
    df = spark.createDataFrame(links, "video_hash string, parent_hash string")
    got = {r.video_hash: (r.root_hash, r.generation) for r in lineage.generations(df).collect()}
    assert got == {
        "a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("a", 3), "e": ("a", 4),
        "x": ("x", 0), "y": ("x", 1),
    }
    traced = [
        (r.step, r.ancestor_hash)
        for r in lineage.trace_to_origin(df, df.where("video_hash = 'e'"), 3).orderBy("step").collect()
    ]
    assert traced == [(1, "d"), (2, "c"), (3, "b")]
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], df.schema)
    with pytest.raises(ValueError):
        lineage.generations(ring, max_rounds=5)


def test_components_of_a_long_chain(spark):
    names = [f"{i:03d}" for i in range(60)]
    order = names[:]
    random.Random(3).shuffle(order)
    edges = list(zip(order, order[1:])) + [("p", "q")]
    df = spark.createDataFrame(edges, "a string, b string")
    nodes = spark.createDataFrame([(n,) for n in names + ["p", "q", "z"]], "node string")
    got = {r.node: r.component for r in lineage.family_components(df, nodes).collect()}
    assert {got[n] for n in names} == {"000"}
    assert (got["p"], got["q"], got["z"]) == ("p", "p", "z")


def test_distance_properties(spark, hashes):
    rng = random.Random(2)
    rows = [(text(rng.choice(hashes)), text(rng.choice(hashes))) for _ in range(80)]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    words = {text(w): w for w in hashes}
    for r in df.select(
        a, b, bits.hamming(a, b).alias("ab"), bits.hamming(b, a).alias("ba"),
        bits.hamming(a, a).alias("aa"), bits.hamming(a, b, "family").alias("f"),
        bits.hamming(a, b, "average").alias("m"), bits.similarity_score(a, b).alias("s"),
    ).collect():
        d = distance(words[r.a], words[r.b])
        assert (r.ab, r.ba, r.aa, r.f) == (d, d, 0, d)
        assert r.m == pytest.approx(d / 5) and r.s == pytest.approx(1 - d / 320)


def test_distance_of_malformed_hashes(spark):
    rows = [("ZZ-0F", "0F-0F"), ("0F", "0F-0F"), ("", "0F"), ("xyz", "xyw"), ("FFFFFFFFFFFFFFFF", "0")]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        bits.hamming(a, b), bits.hamming(a, b, "family"), bits.hamming(a, b, "average")
    ).collect()
    assert [tuple(r) for r in got] == [
        (64, 2, None),
        (64, 4, None),
        (64, 0, None),
        (64, 1, None),
        (64, 64, 64.0),
    ]


@pytest.mark.parametrize("num_bands", [1, 3, 5, 7, 20])
def test_bands_equal_integer_cuts(spark, hashes, num_bands):
    df = frame(spark, hashes[:8])
    for r in df.select("perceptual_hash", bits.lsh_bands(F.col("perceptual_hash"), num_bands).alias("b")).collect():
        string = "".join(f"{int(h, 16):064b}" for h in r.perceptual_hash.split("-"))
        n = len(string)
        want = [
            format(int(string[i * n // num_bands : (i + 1) * n // num_bands], 2), "X")
            for i in range(num_bands)
        ]
        assert list(r.b) == want
