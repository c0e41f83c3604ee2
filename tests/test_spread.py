"""Running values: the split for hot keys must not change results; ledger scenarios."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trailmark.operators import registry, spread
from trailmark.operators.runs import ranked, running, with_slots
from trailmark.plans import derived


def rows_of(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("run_rows", [20, 100, 10**6])
def test_split_keys_give_the_same_events(spark, sf_dir, run_rows):
    s = derived.campaigns(spark, sf_dir)
    plain = Window.partitionBy("video_hash").orderBy("ts", "event_id")
    by_country = Window.partitionBy("video_hash", "country").orderBy("ts", "event_id")
    want = s.select(
        "event_id",
        F.row_number().over(plain).cast("bigint").alias("spread_count"),
        F.lag("country").over(plain).alias("previous_country"),
        (F.row_number().over(by_country) == 1).alias("is_new_country"),
    ).withColumn("k", F.lit(1))
    got = spread.first_country_events(s, run_rows).select(
        "event_id", "spread_count", "previous_country", "is_new_country", F.lit(1).alias("k")
    )
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("run_rows", [40])
def test_split_keys_give_the_same_results_everywhere(spark, sf_dir, run_rows):
    s = derived.campaigns(spark, sf_dir)
    for operator in (
        spread.detection_sequence,
        spread.same_ip_reuploads,
        spread.new_country_spread,
        spread.viral_milestones,
    ):
        assert rows_of(operator(s, run_rows=run_rows)) == rows_of(operator(s)), operator
    few = lambda n: spread.city_escalation(s, 2, run_rows=n)
    assert rows_of(few(run_rows)) == rows_of(few(10**6))
    lineage = derived.item_lineage(spark, sf_dir)
    assert rows_of(registry.family_rank(lineage, run_rows)) == rows_of(registry.family_rank(lineage))
    box = derived.outbox(spark, sf_dir)
    split = registry.batch_chunks(box, 3, run_rows)
    assert rows_of(split) == rows_of(registry.batch_chunks(box, 3))


def test_slots_are_bounded_by_rows(spark):
    """One key, and one time for all rows: no slot holds more than a few times its share."""
    df = spark.range(4000).select(F.lit("a").alias("k"), F.lit(5).alias("s"), F.col("id"), F.lit("x").alias("c"))
    slots = with_slots(df, ["k"], ["s", "id"], 200)
    sizes = [r["count"] for r in slots.groupBy("_slot").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 1000
    got = running(df, ["k"], ["s", "id"], row_number="n", distinct=("c", "new", "seen"), run_rows=200)
    assert got.where("n = id + 1 AND seen = 1 AND new = (id = 0)").count() == 4000


@pytest.mark.parametrize("run_rows", [None, 7])
def test_pages_and_eviction(spark, run_rows):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("id"), F.lit(1).alias("t"))
    ids = lambda out: sorted(r.id for r in out.collect())
    assert ids(registry.page(df, ["t", "id"], 40, 5, run_rows)) == [40, 41, 42, 43, 44]
    assert ids(registry.page(df, ["t", "id"], 98, 5, run_rows)) == [98, 99]
    assert ids(registry.page(df, ["t", "id"], 100, 5, run_rows)) == []
    assert ids(registry.evict_oldest(df, ["t", "id"], 3, run_rows)) == [97, 98, 99]
    assert ids(registry.evict_oldest(df.limit(0), ["t", "id"], 3)) == []


def test_running_values_of_null_keys(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "k string, id bigint")
    got = running(df, ["k"], ["id"], row_number="n", lag={"before": "id"}).collect()
    assert sorted((r.k or "", r.id, r.n, r.before or 0) for r in got) == [("", 1, 1, 0), ("", 2, 2, 1), ("a", 3, 1, 0)]


def test_running_min_and_lag_over_slots(spark):
    rows = [("a", s, s, (s * 7) % 11) for s in range(0, 3000, 100)]
    df = spark.createDataFrame(rows, "k string, s bigint, id bigint, v bigint")
    got = running(
        df, ["k"], ["s", "id"], running_min={"low": "v"},
        lag={"before": "v"}, row_number="n", run_rows=1,
    ).orderBy("n").collect()
    low, before = None, None
    for i, r in enumerate(got):
        low = r.v if low is None else min(low, r.v)
        assert (r.n, r.low, r.before) == (i + 1, low, before)
        before = r.v


@pytest.mark.parametrize("slot_seconds", [50, 120, 86_400])
def test_trailing_counts_equal_brute_force(spark, slot_seconds):
    seconds = [0, 3, 3, 49, 50, 51, 99, 100, 149, 150, 151, 240, 500]
    df = spark.createDataFrame([("v", s) for s in seconds], "video_hash string, seconds bigint")
    got = {
        r.seconds: r.events_in_window
        for r in spread.trailing_counts(df, ["video_hash"], 50, slot_seconds).collect()
    }
    assert got == {t: sum(t - 50 <= s <= t for s in seconds) for t in set(seconds)}


SCHEMA = (
    "event_id bigint, ts timestamp_ntz, seconds bigint, video_hash string, ip_hash string, "
    "country string, city string, is_deepfake boolean, confidence double"
)


def ledger(spark, places, ips=None):
    rows = []
    for i, (country, city) in enumerate(places):
        ip = ips[i] if ips else f"ip{i}"
        rows.append((i, f"2024-01-01 00:{i:02d}:00", i * 60, "v", ip, country, city, True, 0.85))
    df = spark.createDataFrame(
        [(r[0], r[1], *r[2:]) for r in rows], SCHEMA.replace("timestamp_ntz", "string")
    )
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_same_ip_second_upload(spark):
    s = ledger(spark, [("US", "NY"), ("US", "NY")], ["a", "a"])
    (hit,) = spread.same_ip_reuploads(s).collect()
    assert (hit.upload_count, hit.seconds_since_first) == (2, 60)


def test_new_country_but_not_new_city(spark):
    s = ledger(spark, [("US", "NY"), ("US", "LA"), ("UK", "London"), ("US", "NY")])
    (hit,) = spread.new_country_spread(s).collect()
    assert (hit.previous_country, hit.country, hit.unique_countries) == ("US", "UK", 2)


def test_tenth_event_is_a_milestone(spark):
    s = ledger(spark, [(f"C{i}", "x") for i in range(11)])
    (hit,) = spread.viral_milestones(s).collect()
    assert (hit.spread_count, hit.unique_countries) == (10, 10)


def test_redetection_number(spark):
    s = ledger(spark, [("US", "NY")] * 3)
    got = [(r.detection_no, r.event_kind) for r in spread.detection_sequence(s).orderBy("event_id").collect()]
    assert got == [(1, "registered"), (2, "redetected"), (3, "redetected")]


def test_running_distinct_of_many_values_over_slots(spark):
    """A key with tens of thousands of cities: first flags and counts follow the rows, and no array travels."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("video_hash"),
        F.lit("A").alias("country"),
        F.when(F.col("id") % 97 > 0, F.pmod(F.xxhash64("id"), F.lit(40_000)).cast("string")).alias("city"),
        F.floor(F.col("id") / 3).alias("ts"),
        F.col("id").alias("event_id"),
    )
    got = spread.running(
        rows, ["video_hash", "country"], spread.ORDER, distinct=("city", "new", "seen"), run_rows=4_000
    )
    assert "collect_" not in got._jdf.queryExecution().toString()
    plain = rows.toPandas().sort_values(["video_hash", "ts", "event_id"])
    plain["new"] = ~plain.duplicated(["video_hash", "city"])
    plain["seen"] = plain.groupby("video_hash")["new"].cumsum()
    want = plain.set_index("event_id")[["new", "seen"]].sort_index()
    have = got.toPandas().set_index("event_id")[["new", "seen"]].sort_index()
    assert len(have) == len(want) and (have.to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("kind", ["bigint", "double", "timestamp_ntz", "string"])
def test_pages_put_only_their_ranges_in_order(spark, kind, monkeypatch):
    second = F.when(F.col("id") % 50 > 0, F.when(F.col("id") % 3 > 0, F.pmod(F.xxhash64("id"), F.lit(900))).otherwise(F.lit(400)))
    value = F.expr("TIMESTAMP_NTZ'2024-01-01'") + F.make_dt_interval(secs=second) if kind == "timestamp_ntz" else second.cast(kind)
    df = spark.range(9_000).select(value.alias("ts"), F.col("id").alias("event_id"))
    want = [r.event_id for r in df.orderBy("ts", "event_id").collect()]
    held = []
    monkeypatch.setattr(registry, "ranked", lambda rows, *rest: held.append(rows.count()) or ranked(rows, *rest))
    for offset, limit in [(0, 10), (50, 200), (170, 30), (2500, 400), (5000, 7), (8995, 20), (9000, 5), (20_000, 5), (0, 9_000)]:
        held.clear()
        got = registry.page(df, ["ts", "event_id"], offset, limit, run_rows=500)
        assert sorted(r.event_id for r in got.collect()) == sorted(want[offset : offset + limit])
        if kind != "string" and limit < 100 and offset < 9_000:
            assert held[0] <= (3_100 if 2_000 < offset < 6_000 else 500)  # a third of the rows have one time
    for keep in (0, 1, 400, 5000, 8_900, 9_000, 10_000):
        got = registry.evict_oldest(df, ["ts", "event_id"], keep, run_rows=500)
        assert sorted(r.event_id for r in got.collect()) == sorted(want[max(0, 9_000 - keep) :])
    assert registry.page(df.limit(0), ["ts", "event_id"], 0, 5).isEmpty()
