"""The filter audit against every document walked through every order."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from trailmark.llm import filter_audit

WORD = re.compile("[^\x20\x09-\x0d]+")
MARKS = ("good_lost", "toxic_lost")


def failed(doc_id, text, docs):
    """letters of the filters that the row fails, by their definitions"""
    text = text or ""
    words = WORD.findall(text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    out += "D" if re.search("[#$%&*|]", text) else ""
    twin = any(doc_id is not None and i is not None and i < doc_id and (t or "") == text for i, t, *_ in docs)
    return out + ("E" if twin else "")


def by_brute_force(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = [(la or "", failed(i, t, docs), i in good, i in toxic) for i, t, la in docs]
    removed, out = Counter(), Counter()
    for order in permutations("ABCDE"):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                hits = [r for r in rows if r[0] == part and f in r[1]]
                left = [r for r in left if f not in r[1]]
                alone = sum(r[1] == f for r in hits)
                key = (part, "".join(order), step, f)
                out[key] = [len(left), len(gone), len(hits) - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                removed[part, f] += len(gone)
    return {k[:3]: [*v, removed[k[0], k[3]]] for k, v in out.items()}


def audited(docs, labels):
    marks = dict(zip(MARKS, (F.col("quality") == 1, F.col("toxic") == 1), strict=True))
    counts = filter_audit.failure_counts(docs, labels, marks, F.col("lang"))
    rows = [tuple(r) for r in filter_audit.interactions(counts, "ABCDE", MARKS).collect()]
    got = {r[:3]: list(r[3:]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_intervals_name_the_step_of_every_order():
    for k in (1, 3, 5):
        orders = list(permutations(range(k)))
        for mask in range(1, 1 << k):
            steps = {}
            for step, first, past in filter_audit.removal_intervals(mask, k):
                for rank in range(first, past):
                    assert rank not in steps
                    steps[rank] = step
            assert [steps[r] for r in range(len(orders))] == [next(s for s, f in enumerate(o, 1) if mask >> f & 1) for o in orders]


def test_audit_equals_brute_force(spark, odd, none):
    random.seed(11)
    docs, texts = [], []
    for i in range(150):
        words = random.choices([f"w{k}" for k in range(random.choice([20, 900]))], k=random.choice([3, 199, 200, 260]))
        words += random.choices(["#", "A", "x&y", "LOUD"], k=random.choice([0, 0, 1, 30]))
        texts.append(" ".join(words) if random.random() < 0.6 or not texts else random.choice(texts))
        docs.append((random.choice([i, i, 7, None]), texts[-1], random.choice(["en", "de", None, ""])))
    docs += [tuple(r) for r in odd.select("doc_id", "text", "lang").collect()]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1, None])) for i in [*range(100), 5, 7, 7, None]]
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = rows.select("*", *[F.lit("x").alias(c) for c in ("part", "mask", "n", "key", "digest", "toxic_lost")])
    want = by_brute_force(docs, labels)
    assert audited(rows.repartition(5), label_rows) == want and len(want) == 600 * len({la or "" for _, _, la in docs})
    assert audited(rows.limit(0), label_rows) == {} == audited(none, label_rows.limit(0))
    assert audited(rows, label_rows.limit(0)) == by_brute_force(docs, [])


def test_the_limits_of_the_text_filters():
    assert filter_audit.text_mask(b"a " * 200, 400) == 2 and filter_audit.text_mask(b"", 0) == 1
    assert filter_audit.text_mask(b"AAA" + b"a" * 97, 100) == 1 and filter_audit.text_mask(b"AAAA" + b"a" * 96, 100) == 5
    assert filter_audit.text_mask(b" ".join([b"%d" % k for k in range(100)] * 2), 0) == 0


def test_counts_of_any_number_of_filters(spark):
    random.seed(3)
    rows = [(random.choice(["p", None]), random.randrange(8), random.randrange(1 << 40), 1, "y") for _ in range(40)]
    counts = spark.createDataFrame(rows, "part string, mask int, n long, seen long, step string")
    got = filter_audit.interactions(counts.fillna("", ["part"]), "XYZ", ("seen",)).collect()
    assert len(got) == 2 * 6 * 3
    for r in got:
        at = ["XYZ".index(x) for x in r.filter_order]
        gone = [x for x in rows if (x[0] or "") == r.part and next((s for s, f in enumerate(at, 1) if x[1] >> f & 1), 0) == r.step]
        assert (r.removed, r.seen) == (sum(x[2] for x in gone), len(gone))
    with pytest.raises(ValueError):
        filter_audit.interactions(counts, "BA")
