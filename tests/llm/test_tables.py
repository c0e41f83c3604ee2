"""Operators on whole tables: duplicates, top-k, mixing, languages, tool calls, the pipeline."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from trailmark.llm import language, mixing, shingles, simhash, substrings, toolcalls, topk
from trailmark.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(rows):
    return Counter(tuple(r) for r in rows)


# substrings


def kept_by_brute_force(docs, window):
    owners = defaultdict(set)
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        for k in range(len(w) - window + 1):
            owners[tuple(w[k : k + window])].add(i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and any(o is not None and o < i for o in owners[tuple(w[k : k + window])]):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "a"])
def test_repeats_equal_brute_force(spark, letters):
    random.seed(len(letters))
    passage = random.choices(letters, k=30)
    docs = []
    for i in range(60):
        own = random.choices(letters, k=random.randint(0, 40))
        at = random.randint(0, len(own))
        docs.append((random.choice([i, 5, None]), " ".join(own[:at] + (passage[random.randint(0, 9) :] if i % 3 else []) + own[at:])))
    docs += [(70, None), (71, ""), docs[0], docs[-1]]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = plain(substrings.remove_repeats(table, window=6, prefix=2).select("doc_id", "n_words", "n_removed", "kept").collect())
    assert got == kept_by_brute_force(docs, 6)


def test_repeats_of_odd_rows(odd, none):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = substrings.remove_repeats(odd).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert plain(got) == kept_by_brute_force(docs, 50)
    assert substrings.remove_repeats(none).count() == 0


# near duplicates


def simhash_by_definition(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints):
    """component of each row by comparing all pairs"""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                parent[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(ids))]


def test_fingerprints_and_components_equal_brute_force(spark, odd, none):
    random.seed(6)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = []
    for i in range(40):
        words = random.choices(vocabulary, k=random.choice([1, 2, 3, 400]))
        docs.append((i * 10, " ".join(words)))
        if len(words) == 400:
            for k in (1, 2, 3):
                words[random.randrange(400)] = "Changed"
                docs.append((i * 10 - k, " ".join(words).upper() if k == 2 else "\t".join(words)))
    docs += [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "fp", "component_id").collect()
    prints = [simhash_by_definition(t) for _, t in docs]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = Counter(zip([i for i, _ in docs], signed, classes([i for i, _ in docs], prints), strict=True))
    assert plain(got) == want
    assert simhash.near_duplicates(none).count() == 0


def test_every_anchor_pair_is_found(spark):
    random.seed(7)
    prints = set()
    for _ in range(60):
        x = random.getrandbits(64)
        for _ in range(15):
            prints.add(x - (1 << 64) if x >> 63 else x)
            for _ in range(random.choice([1, 2, 3])):
                x ^= 1 << random.randrange(64)
    listed = sorted(prints)
    want = {(a, b) for k, a in enumerate(listed) for b in listed[k + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in listed], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5001), (5001, 5000), (7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert len({roots[k] for k in range(201)}) == 1 and len({roots[1000 + k] for k in range(300)}) == 1
    assert len(set(roots.values())) == 3 and len(roots) == 201 + 300 + 2


def test_rounds_of_few_links_are_few_tasks(spark):
    """However many partitions a shuffle has: the driver keeps a record of each task."""
    rng = random.Random(3)
    edges = [(k, rng.randrange(k)) for k in range(1, 2000)] + [(9000, 9001 + k) for k in range(2000)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(8)
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("components", "components")
        roots = {r.node: r.root for r in components(table, "a", "b").collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(roots) == 4001 and len(set(roots.values())) == 2 and roots[0] == roots[1999] != roots[9000]
    seen = sc.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("components") for s in seen.getJobInfo(j).stageIds}
    done = [x for x in map(seen.getStageInfo, stages) if x]
    assert done and sum(x.numCompletedTasks for x in done) < 1200


def test_one_of_each_group_stays(odd, none):
    kept = simhash.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    prints = [simhash_by_definition(r.text) for r in rows]
    assert len(set(prints)) == len(prints)
    assert {r.doc_id for r in rows} >= {1, 5, 2, 8, 9} and 7 not in {r.doc_id for r in rows}
    assert simhash.keep_one_per_group(none).count() == 0


def jaccard_shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def kept_by_jaccard(docs):
    """(doc_id, text) of the row that stays of each group, by comparing all pairs; doc_ids are set."""
    texts = sorted({t for _, t in docs})
    sets = [jaccard_shingles(t) for t in texts]
    edges = defaultdict(set)
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if 5 * len(x & y) >= 4 * len(x | y):
                edges[a].add(b)
                edges[b].add(a)
    root = {}
    for a in range(len(texts)):
        todo = [a]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = a
                todo += edges[k]
    at = {t: root[k] for k, t in enumerate(texts)}
    least = {}
    for i, t in docs:
        row = (i, hashlib.md5(f"{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest(), t)
        least[at[t]] = min(least.get(at[t], row), row)
    return sorted((i, t) for i, _, t in least.values())


def planted_copies():
    """Texts with copies of likeness 0.6 to 1, single words changed, and chains of copies of copies."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    docs = []
    for i in range(12):
        words = rng.choices(vocabulary, k=rng.choice([9, 60, 400]))
        docs.append((100 * i, " ".join(words)))
        for k in range(1, 9):
            copy = list(words)
            for at in rng.sample(range(len(words)), max(1, k * len(words) // 250)):
                copy[at] = rng.choice(vocabulary)
            docs.append((100 * i + k, " ".join(copy)))
            if k % 3 == 0:
                words = copy
        docs.append((100 * i + 50, " ".join([*words[: len(words) * 9 // 10], *rng.choices(vocabulary, k=3)])))
    return docs


@pytest.mark.parametrize("common", [8, 1])
def test_near_copies_of_four_fifths_go(monkeypatch, spark, common):
    monkeypatch.setattr(shingles, "COMMON", common)
    monkeypatch.setattr(shingles, "SAMPLE", 32 if common > 1 else 2)
    docs = planted_copies()
    kept = simhash.keep_one_per_group(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    want = kept_by_jaccard(docs)
    assert sorted(map(tuple, kept)) == want and 12 < len(want) < len(docs)


# top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, v) for i, v in enumerate(rng.integers(-3, 4, (300, 5)).astype(float).tolist())]
    vectors += [(50, [1.0] * 5), (7, [2.0] * 5), (7, [2.0] * 5), (None, [9.0] * 5), (400, None), (401, [1.0, None]), (402, [float("nan")] * 5)]
    vectors += [(450, [float("inf")] * 5), (500, []), (501, [3.0]), (502, [-0.001] * 5)]
    table = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<double>, score int")
    usable = [(i, np.floor(256 * np.array([*v, *[0.0] * (5 - len(v))]))) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for k in (5, 400):
        got = topk.top_k(table, F.col("vec_id") % 50 == 0, k).collect()
        want = []
        for q in sorted({i for i, _ in usable if i % 50 == 0}):
            a = min((list(np.floor(256 * np.array(v))) for i, v in vectors if i == q))
            a = np.array([*a, *[0.0] * (5 - len(a))])
            scored = sorted((-int(a @ v), i) for i, v in usable if i != q)[:k]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
        assert plain(got) == Counter(want)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_top_k_in_several_blocks_and_beyond_doubles(monkeypatch, spark):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    vectors = [(i * 10, (v * 1e6).tolist()) for i, v in enumerate(rng.standard_normal((90, 4)))]
    vectors.append((5, [2.0**60, 0.0, 0.0, 0.0]))
    got = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 3).collect()
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors]
    want = []
    for q, a in whole:
        if q % 50 == 0:
            scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, v, strict=True)))), i) for i, v in whole if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:3])]
    assert plain(got) == Counter(want)


# mixing


def mix_by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return Counter(con.execute(mixing.MIX_SQL).fetchall())


def test_mix_equals_sql_and_holds_its_bounds(spark, odd, none):
    random.seed(8)
    rows = [(i, "w " * random.randint(0, 30), random.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(400)]
    rows += [tuple(r) for r in odd.select("doc_id", "text", "source").collect()] + [rows[3]]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix(table)
    got = out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")).collect()
    assert plain(got) == mix_by_sql(rows)
    assert plain(got) == plain(mixing.mix(table.repartition(2)).selectExpr("doc_id", "size", "source_size", "target", "copies * size").collect())
    taken = defaultdict(int)
    for r in out.collect():
        assert 0 <= r.copies <= 2
        taken[r.source, r.target] += r.copies * r.size
    most = max(len(WORD.findall(t or "")) for _, t, _ in rows)
    assert all(abs(n - target) <= 2 * most for (_, target), n in taken.items())
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mixed_documents_are_the_copies(odd):
    numbers = mixing.mix(odd).agg(F.sum("copies")).first()[0]
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == numbers
    assert set(map(tuple, mixed.collect())) <= set(map(tuple, odd.collect()))


# languages


def test_held_out_accuracy(spark):
    out = language.op8_language_id(spark, "/root/testdata/sf0.01")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = out.join(lang, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert held[0] >= 0.98 and 0 <= held[1] <= held[2] <= 1
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out.limit(50).collect())


def test_languages_of_odd_rows(spark, odd, none):
    texts = {"en": "the cat sat on the mat and", "de": "der Hund und die Katze sind", "fr": "le chat est sur la table et", "xx": "zzq qqz zqz qzq"}
    rows = [(la, f"{t} {k} {t[k % 9 :]}") for la, t in texts.items() for k in range(20)] + [(None, "the"), ("en", None), ("en", "123")]
    model = language.train(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(x for m in model.members.values() for x in m) == ["de", "en", "fr", "xx"]
    assert model.predict(["the cat and the", "qzq zzq", "12 34", None, ""])[0] == ["en", "xx", "und", "und", "und"]
    got = language.identify(odd, model).select("text", "lang_pred", "lang_score").collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    kept = language.drop_unidentified(odd)
    assert kept.columns == odd.columns
    assert kept.count() == sum(any(c.isalpha() for c in r.text or "") for r in odd.collect())
    assert language.drop_unidentified(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert language.drop_unidentified(unlabelled).count() == odd.count()
    empty = language.train(none.select("lang", "text"))
    assert empty.predict(["abc"]) == (["und"], [0.0])
    one = language.train(spark.createDataFrame([("en", "abc")], "lang string, text string"))
    assert one.predict(["xyz"]) == (["en"], [1.0])


def test_long_texts_are_counted_whole(monkeypatch):
    text = "Straße und 12 Häuser, le chat " * 40
    whole = language.features(text)
    monkeypatch.setattr(language, "RUN", 100)
    assert np.abs(whole - language.features(text)).max() < 0.05


# tool calls

SCHEMAS = {"f": {"a": ("integer", True), "b": ("number", False), "it's": ("string", False)}, "g": {}}


def test_calls_are_linked_ordered_and_validated(spark):
    calls = [
        ("c", "1", 5, "f", '{"b": 1.50, "a": 3, "it\'s": "x"}', "2"),
        ("c", "2", 3, "f", '{"a": "3"}', None),
        ("c", "3", 1, "f", '{"z": {"y": [1, {"d": 1, "c": 2}]}, "b": "1"}', "1"),
        ("c", "4", 0, "h", "[1]", "9"),
        ("c", "5", 7, "g", "{", "6"),
        ("c", "6", 8, "g", "{}", "5"),
        ("c", "7", 9, "g", "[1]", None),
        ("c", "7", 2, "g", None, None),
        ("c", None, 4, "g", "{}", None),
        (None, "1", 4, "g", "{}", None),
        ("d", "1", 0, "g", "{}", None),
    ]
    results = [("c", "1", 6, 'é "q"\n'), ("c", "1", 7, "later"), ("c", "2", 2, None), ("c", "x", 9, "?"), (None, None, 1, "n")]
    c = spark.createDataFrame(calls, "conv_id string, call_id string, turn long, name string, arguments string, waits_for string")
    r = spark.createDataFrame(results, "conv_id string, call_id string, turn long, content string")
    messages = [("c", 0, "system", "be brief"), ("c", 0, "system", "be brief"), ("e", None, None, None), (None, 3, "tool", "")]
    m = spark.createDataFrame(messages, "conv_id string, turn long, role string, content string")
    c, r, m = (x.selectExpr("*", "1 AS depth", "2 AS least", "3 AS status", "4 AS pos") for x in (c, r, m))
    every = toolcalls.link_calls(c, r, SCHEMAS, m).collect()
    said = [x for x in every if x.status == "message"]
    assert sorted(x.line for x in said) == ['{"content":"","role":"tool"}', *['{"content":"be brief","role":"system"}'] * 2, "{}"]
    assert len(every) == len(calls) + len(results) + len(messages) - 2  # two pairs are one row each
    again = {x.status: x for x in every if x.status.startswith("repeated")}
    assert (again["repeated call"].turn, again["repeated call"].problems, again["repeated call"].depth) == (9, ["arguments: not an object"], 0)
    assert again["repeated result"].line == '{"content":"later","id":"1"}' and again["repeated result"].depth == 1
    assert sorted(x.position for x in every if x.conv_id == "c") == list(range(13))
    out = [x for x in toolcalls.link_calls(c, r, SCHEMAS).collect() if not x.status.startswith("repeated")]
    by = {(x.conv_id, x.call_id): x for x in out if x.conv_id and x.call_id}
    assert len(out) == 12 and len(by) == 9
    assert [by["c", k].depth for k in "1234567"] == [1, 0, 2, 0, None, None, 0]
    assert [by["c", k].status for k in "1234567x"] == ["linked", "result before call", *["no result"] * 5, "no call"]
    assert by["c", "2"].position < by["c", "1"].position < by["c", "3"].position < by["c", "5"].position
    assert (by["c", "1"].n_results, by["c", "7"].n_calls, by["c", "x"].n_calls) == (2, 2, 0)
    assert by["c", "1"].problems == []
    assert by["c", "2"].problems == ["a: not integer"]
    assert by["c", "3"].problems == ["a: missing", "b: not number", "z: unknown"]
    assert by["c", "4"].problems == ["arguments: not an object", "waits for unknown 9"]
    assert by["c", "5"].problems == ["arguments: not JSON"] and by["c", "7"].turn == 2
    assert by["c", "3"].line == '{"arguments":{"b":"1","z":{"y":[1,{"c":2,"d":1}]}},"id":"3","name":"f","waits_for":"1"}'
    assert json.loads(by["c", "1"].line) == {"arguments": {"a": 3, "b": 1.5, "it's": "x"}, "content": 'é "q"\n', "id": "1", "name": "f", "waits_for": "2"}
    assert sorted(x.status for x in out if not (x.conv_id and x.call_id)) == ["no id"] * 3
    assert toolcalls.link_calls(c.limit(0), r.limit(0), SCHEMAS, m.limit(0)).count() == 0


def test_repeated_calls_and_results_all_come_out(spark):
    call = ("c", "1", 3, "g", "{}", None)
    c = spark.createDataFrame([call] * 40 + [("c", "1", 4, "g", "{}", "1")], "conv_id string, call_id string, turn long, name string, arguments string, waits_for string")
    r = spark.createDataFrame([("c", "1", 5, None)] * 3, "conv_id string, call_id string, turn long, content string")
    out = Counter(x.status for x in toolcalls.link_calls(c, r, SCHEMAS).collect())
    assert out == {"linked": 1, "repeated call": 40, "repeated result": 2}


def test_every_turn_is_in_a_row(spark):
    sf_dir = "/root/testdata/sf0.01"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = contract.queries()["op7_chat_formatting"](spark, sf_dir)
    linked = rows.filter("status IN ('linked', 'result before call')").count()
    assert rows.count() + linked == turns.count()


def test_depths_of_a_long_chain(spark):
    rows = [("c", str(k), str(k - 1) if k else None) for k in range(300)] + [("c", "s", "s"), ("c", "t", "s")]
    out = {r.call_id: r.depth for r in toolcalls.depths(spark.createDataFrame(rows, "conv_id string, call_id string, waits_for string")).collect()}
    assert all(out[str(k)] == k for k in range(300)) and out["s"] is None and out["t"] is None


def test_calls_use_no_python(spark):
    table = contract.queries()["op7_chat_formatting"](spark, "/root/testdata/sf0.001")
    assert "Python" not in table._jdf.queryExecution().executedPlan().toString()


# the pipeline


def test_stages_and_their_columns(spark, odd, none):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "SimHash near-dedup", "secret scans", "mixing sources to target weights", "SentencePiece encoding and decoding",
    ]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.schema.names == table.schema.names, name
            out.count()


def test_pipeline_rows_come_from_the_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    out = contract.queries()["pipeline"](spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert out and all(r.exact for r in out)
    texts = {hashlib.md5(docs[r.doc_id].text.encode()).digest() for r in out}
    assert len(texts) == len({r.doc_id for r in out})
