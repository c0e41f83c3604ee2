"""The stored band index and the registry of deltas: what is read, what is written, and the rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailmark.operators import lookup, registry
from trailmark.session import scratch_path
from trailmark.sources import band_index, registry_store
from trailmark.streaming import jobs

HEX = "0123456789ABCDEF"


def code_of(rng):
    return "-".join("".join(rng.choices(HEX, k=16)) for _ in range(5))


def flipped(rng, code, bits):
    frames = [int(f, 16) for f in code.split("-")]
    for at in rng.sample(range(320), bits):
        frames[at // 64] ^= 1 << at % 64
    return "-".join(f"{f:016X}" for f in frames)


def apart(a, b):
    return sum(bin(int(x, 16) ^ int(y, 16)).count("1") for x, y in zip(a.split("-"), b.split("-"), strict=True))


def best_by_brute_force(queries, known, threshold=10):
    out = []
    for h, code in queries:
        if any(h == k for k, _ in known):
            out.append((h, h, "exact", None))
            continue
        near = []
        for k, other in known:
            bands = set(zip(range(5), code.split("-"), strict=True)) & set(zip(range(5), other.split("-"), strict=True))
            if bands and apart(code, other) <= threshold:
                near.append((apart(code, other), k))
        d, k = min(near, default=(None, None))
        out.append((h, k, "perceptual" if near else "miss", d))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    known = [(f"k{i:04d}", code_of(rng)) for i in range(400)]
    known += [(f"z{i:04d}", c) for i, (_, c) in enumerate(known[:20])]  # other items of the same code
    queries = [(f"q{i}", flipped(rng, rng.choice(known)[1], rng.choice([0, 1, 4, 9, 12]))) for i in range(60)]
    return known, [*queries, known[5], ("new", code_of(rng))]


SCHEMA = "video_hash string, perceptual_hash string"


def test_index_equals_brute_force_and_the_plain_lookup(spark, items):
    known, queries = items
    table, asked = spark.createDataFrame(known, SCHEMA), spark.createDataFrame(queries, SCHEMA)
    path = scratch_path(spark, "index")
    assert band_index.append(table, path) == 0
    got = rows_of(band_index.lookup(asked, path))
    assert got == best_by_brute_force(queries, known) == rows_of(lookup.tiered_lookup(asked, table))
    assert len({k for *_, k, _ in got}) == 3


def test_an_append_makes_new_rows_visible_and_may_run_twice(spark, items):
    known, queries = items
    path, asked = scratch_path(spark, "index"), spark.createDataFrame(queries, SCHEMA)
    assert {r[2] for r in rows_of(band_index.lookup(asked, path))} == {"miss"}
    for part in (0, 1, 2):
        for _ in range(2):
            band_index.append(spark.createDataFrame(known[part::3], SCHEMA), path, part)
        seen = [x for k in range(part + 1) for x in known[k::3]]
        assert rows_of(band_index.lookup(asked, path)) == best_by_brute_force(queries, seen)
    # a version that isn't listed yet is not seen
    bands = spark.read.parquet(f"{path}/bands").where("version = 0").drop("version")
    bands.withColumn("first_hash", F.lit("0")).write.partitionBy("band_index", "part").parquet(f"{path}/bands/version=9")
    assert rows_of(band_index.lookup(asked, path)) == best_by_brute_force(queries, known)


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply("numFiles").value()


def test_a_lookup_reads_its_own_bands_only(spark, items):
    known, queries = items
    path = scratch_path(spark, "index")
    band_index.append(spark.createDataFrame(known, SCHEMA), path)
    codes = spark.createDataFrame(queries[:3], SCHEMA).selectExpr("perceptual_hash AS code")
    asked = band_index._band_rows(codes, 5)
    folders = asked.select("band_index", "part").distinct().count()
    every = band_index._read(spark, path, "bands", band_index._BANDS)
    some = band_index._read(spark, path, "bands", band_index._BANDS).where(band_index._folders(asked, "band_index", "part"))
    assert 0 < files_read(some) <= folders <= 18 < files_read(every) / 4


def test_odd_items_in_the_index(spark):
    path = scratch_path(spark, "index")
    rows = [("a", "not a code"), ("b", None), (None, "0000000000000001-0000000000000002"), ("c", "")]
    band_index.append(spark.createDataFrame(rows, SCHEMA), path)
    asked = spark.createDataFrame([("x", "not a code"), ("b", None), (None, None), ("y", None), ("x", "not a code")], SCHEMA)
    got = rows_of(band_index.lookup(asked, path))
    assert got == sorted([("x", "a", "perceptual", 0)] * 2 + [("b", "b", "exact", None), (None, None, "miss", None), ("y", None, "miss", None)], key=str)
    band_index.append(spark.createDataFrame([], SCHEMA), path)
    assert band_index.lookup(asked.limit(0), path).count() == 0 and band_index.versions(spark, path) == [0, 1]


def test_streamed_lookup_sees_appends_between_runs(spark, items):
    known, queries = items
    index, path, out, place = (scratch_path(spark, x) for x in ("index", "in", "out", "place"))

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
        return rows_of(jobs.stream_tiered_lookup(stream, None, output=out, checkpoint=place, index=index))

    band_index.append(spark.createDataFrame(known[:200], SCHEMA), index)
    early = best_by_brute_force(queries[:30], known[:200])
    assert run(queries[:30]) == early
    band_index.append(spark.createDataFrame(known[200:], SCHEMA), index)
    assert run(queries[30:]) == sorted(early + best_by_brute_force(queries[30:], known), key=str)


# the registry of deltas

ARRIVALS = "video_hash string, perceptual_hash string, is_deepfake boolean, confidence double, lipsync_score double, fact_check_score double, seen_at timestamp_ntz, event_id bigint"


def arrivals(rng, n, hashes, first=0):
    start = datetime(2024, 1, 1)
    return [
        (rng.choice(hashes), rng.choice(["p", None]), rng.random() < 0.5, rng.choice([rng.random(), None]), rng.random(), None, start + timedelta(seconds=first + k), first + k)
        for k in range(n)
    ]


def folded(spark, rows):
    return registry.fold_batch(spark.createDataFrame(rows, ARRIVALS))


def test_deltas_equal_upserts_one_after_another(spark):
    rng = random.Random(5)
    hashes = [f"{rng.randrange(1 << 24):06x}" for _ in range(300)]
    out, want, schema = scratch_path(spark, "registry"), None, None
    for version in range(6):
        batch = arrivals(rng, 200, hashes, 1000 * version)
        rows = folded(spark, batch)
        if want is None:
            schema, want = rows.schema, registry.upsert_registry(rows.where("false"), spark.createDataFrame(batch, ARRIVALS))
        else:
            want = registry.upsert_registry(want, spark.createDataFrame(batch, ARRIVALS))
        want = spark.createDataFrame(want.collect(), want.schema)
        for _ in range(1 + version % 2):  # a batch may run twice
            registry_store.append(rows, out, version)
        assert rows_of(registry_store.read(spark, out, schema)) == rows_of(want.select(*registry_store.COLUMNS))
        if version in (2, 4):
            before = rows_of(registry_store.read(spark, out, schema))
            assert registry_store.compact(spark, out, schema)
            assert rows_of(registry_store.read(spark, out, schema)) == before
            assert not registry_store.compact(spark, out, schema)


def test_a_batch_writes_its_own_rows_and_compaction_leaves_quiet_buckets(spark):
    rng = random.Random(6)
    hashes = [f"{k:02x}{rng.randrange(1 << 20):05x}" for k in range(256) for _ in range(20)]
    out = scratch_path(spark, "registry")
    first = folded(spark, arrivals(rng, 5, hashes) + [(h, "p", True, 0.5, 0.5, None, datetime(2023, 1, 1), -1) for h in hashes])
    registry_store.append(first, out, -1)
    assert len(registry_store.compact(spark, out, first.schema)) == 256
    registry_store.append(folded(spark, arrivals(rng, 40, hashes[:20], 100)), out, 0)
    registry_store.append(folded(spark, arrivals(rng, 3, hashes[40:60], 200)), out, 1)
    assert spark.read.parquet(f"{out}/rows").where("version = 0").count() <= 20
    before = rows_of(registry_store.read(spark, out, first.schema))
    # of the two buckets with deltas, one has few
    assert registry_store.compact(spark, out, first.schema) == ["00"]
    assert rows_of(registry_store.read(spark, out, first.schema)) == before
    assert spark.read.parquet(f"{out}/base").where("version = 1").select("bucket").distinct().count() == 1
    # another compaction of the same state adds buckets and loses none
    assert registry_store.compact(spark, out, first.schema, share=0.01) == ["02"]
    assert rows_of(registry_store.read(spark, out, first.schema)) == before


def test_streams_compact_when_many_deltas_wait(spark):
    path, out, place = (scratch_path(spark, x) for x in ("in", "out", "place"))
    rows = arrivals(random.Random(7), 12, ["aa1", "bb2"])
    for k in range(4):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], ARRIVALS).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", 1).parquet(path)
    none = folded(spark, [])
    got = jobs.stream_upsert_registry(stream, none, output=out, checkpoint=place, most_deltas=2)
    assert sum(r.detection_count for r in got.collect()) == 12 and registry_store.pending(spark, out) == 0


def test_an_empty_store_and_rows_without_a_hash(spark):
    out = scratch_path(spark, "registry")
    schema = folded(spark, []).schema
    assert not registry_store.exists(spark, out) and registry_store.read(spark, out, schema).count() == 0
    assert registry_store.compact(spark, out, schema) == []
    registry_store.append(folded(spark, []), out, 0)
    registry_store.append(folded(spark, [(None, "p", True, 0.5, 0.5, None, datetime(2023, 1, 1), 1)]), out, 1)
    assert [r.detection_count for r in registry_store.read(spark, out, schema).collect()] == [1]


def test_a_registry_does_not_depend_on_the_order_of_its_batches(spark):
    """Batches that come newest first, with and without a compaction, give what all rows at once give."""
    rng = random.Random(9)
    hashes = [f"{rng.randrange(1 << 24):06x}" for _ in range(40)]
    rows = [r for k in range(5) for r in arrivals(rng, 60, hashes, 1000 * k)]
    batches = [sorted(rows, key=lambda r: (r[6], r[7]), reverse=True)[k::5] for k in (0, 3, 1)] + [rows[:0]]
    batches += [sorted((r for r in rows if not any(r in b for b in batches)), key=lambda r: (r[6], r[7]), reverse=True)]
    known = spark.createDataFrame([(hashes[0], "p", True, 9.0, 9.0, None, datetime(2023, 1, 1), -1)], ARRIVALS)
    want = rows_of(registry.upsert_registry(registry.fold_batch(known), spark.createDataFrame(rows, ARRIVALS)))
    for most in (16, 0):
        path, out, place = (scratch_path(spark, x) for x in ("in", "out", "place"))
        for batch in batches:
            spark.createDataFrame(batch, ARRIVALS).coalesce(1).write.mode("append").parquet(path)
            stream = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", 1).parquet(path)
            got = jobs.stream_upsert_registry(stream, registry.fold_batch(known), output=out, checkpoint=place, most_deltas=most)
        assert got.columns == registry_store.COLUMNS and rows_of(got) == want


def test_lookups_send_no_side_to_the_driver(spark):
    """A micro-batch must not broadcast what the index has: however many there are, nothing goes through the driver."""
    rng = random.Random(10)
    index = scratch_path(spark, "index")
    known = spark.createDataFrame([(f"{k:03x}", code_of(rng)) for k in range(50)], SCHEMA)
    band_index.append(known, index)
    codes = known.select(F.col("perceptual_hash").alias("code"))
    for found in (band_index.stored_hashes(known, index), band_index.candidates(codes, index)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
