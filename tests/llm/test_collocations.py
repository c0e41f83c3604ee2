"""Phrase counts and scores against plain counting; filters and packing against what went in."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import collocations as co

BREAK = re.compile("[.,;:!?\x0a-\x0d]")
WORD = re.compile("[^\x20\x09]+")


def phrases_of(docs, longest):
    found, totals = Counter(), Counter()
    for lang, text in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in BREAK.split(lowered):
            words = WORD.findall(piece)
            totals[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    found[lang or "und", tuple(words[i : i + m])] += 1
    return found, totals


def collocations_of(docs, least, longest):
    f, totals = phrases_of(docs, longest)
    often = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = set()
    for (lang, words), a in often.items():
        m = len(words)
        longer = [v for (la, w), v in often.items() if la == lang and len(w) > m and any(w[i : i + m] == words for i in range(len(w) - m + 1))]
        if any(100 * v >= 100 * a for v in longer):
            continue
        cuts = [(1000 * a * totals[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, m)]
        score, k = min(cuts)
        out.add((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], totals[lang], k, score))
    return out


@pytest.mark.parametrize(("letters", "least"), [("ab", 3), ("a", 2), ("abcdefghijkl", 4)])
def test_collocations_equal_plain_counting(monkeypatch, spark, odd, letters, least):
    random.seed(len(letters))
    monkeypatch.setattr(co, "BLOCK_WORDS", 200)
    monkeypatch.setattr(co, "RANGE_WORDS", 500)
    docs = []
    for _ in range(120):
        words = random.choices(letters, k=random.randint(0, 40))
        at = random.randint(0, len(words))
        words[at:at] = random.choice([[], ["New", "york", "city"], ["in", "order", "to", "see", "More", "of"], ["\x01x", "é", "\x01x", "É"]])
        docs.append((random.choice(["en", "de", None]), "".join(w + random.choice([" ", " ", " \t", ". ", "\n", " ;"]) for w in words)))
    docs += [tuple(r) for r in odd.select("lang", "text").collect()]
    table = spark.createDataFrame(docs, "lang string, text string").select("*", *[F.lit(1).alias(c) for c in ("block", "word", "ids", "f", "n")])
    got = co.collocations(co.count_phrases(table.repartition(4), F.col("lang"), least=least)).collect()
    want = collocations_of(docs, least, 5)
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 3


def test_empty_tables_and_rare_words(spark, none):
    for docs in (none, spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")):
        counted = co.count_phrases(docs, F.col("lang"))
        assert counted.grams.count() == 0 and co.collocations(counted).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 9, 25, 26, 40])
@pytest.mark.parametrize("words", [2, 3, 4, 5])
def test_packing_and_filters_lose_nothing(bits, words):
    rng = np.random.default_rng(bits)
    packing = co.Packing(words, bits)
    given = [rng.integers(1, 1 << bits, 3000, dtype=np.uint64) if bits > 1 else np.ones(3000, np.uint64) for _ in range(words)]
    packed = packing.pack(given)
    permuted = packing.permute(packed)
    assert all((x < np.uint64(1 << packing.width)).all() for x in permuted)
    assert all((a == b).all() for a, b in zip(packing.unpack(packing.restore(permuted)), given, strict=True))
    limbs, times, place = packing.counted(permuted)
    assert all((x[place] == y).all() for x, y in zip(limbs, permuted, strict=True)) and times.sum() == 3000
    assert len(set(zip(*[x.tolist() for x in limbs], strict=True))) == len(times)
    times = times + rng.choice([0, 254, 255, 1 << 40], len(times))
    for wanted in (1, 3, 16):
        skipped = packing.ranges(wanted)
        of = (limbs[0] >> np.uint64(packing.width - skipped)).tolist()
        back = Counter()
        for at in set(of):
            own = np.array(of) == at
            data = co.written([x[own] for x in limbs], times[own], packing.width, skipped)
            got, counts = co.read(data, packing.limbs, packing.width, skipped)
            back.update(dict(zip(zip(*[x.tolist() for x in got], strict=True), counts.tolist(), strict=True)))
        assert back == Counter(dict(zip(zip(*[x.tolist() for x in limbs], strict=True), times.tolist(), strict=True)))


def test_filters_are_compact():
    rng = np.random.default_rng(1)
    packing = co.Packing(3, 20)
    limbs, times, _ = packing.counted(packing.permute(packing.pack([rng.integers(1, 1 << 20, 200_000, dtype=np.uint64) for _ in range(3)])))
    assert len(co.written(limbs, times, packing.width, 0)) < 9 * len(times)


def test_scores_are_exact_beyond_64_bits(spark):
    random.seed(4)
    rows = [(random.randint(1, 10**12), random.randint(10**11, 10**13)) for _ in range(50)]
    rows = [(a, n, a + random.randrange(10**6), a + random.randrange(10**3)) for a, n in rows] + [(100, 100, 100, 100), (7, 10, 10, 7)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select("*", co.cut_score().alias("s")).collect()
    assert all(r.s == 1000 * r.a * r.n // (r.l * r.r) for r in got)


def test_long_texts_are_cut_where_nothing_changes(monkeypatch, spark):
    monkeypatch.setattr(co, "BLOCK_WORDS", 100_000)
    text = "alpha beta gamma " * 120_000 + "\n" + "x" * 3_000_000 + " alpha beta"
    counted = co.count_phrases(spark.createDataFrame([("en", text)], "lang string, text string"), F.col("lang"))
    found = {tuple(r.ids): r.f for r in counted.grams.collect()}
    ids = {r.word: r.id for r in counted.words.collect()}
    assert found[ids["alpha"], ids["beta"]] == 120_001 and found[ids["gamma"], ids["alpha"]] == 119_999
    assert len(found) == 15 and found[tuple(ids[w] for w in "alpha beta gamma alpha beta".split())] == 119_999
