"""Custom state decided in order of event time, whatever files the rows come in."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailmark import schemas
from trailmark.operators import alerts, spread
from trailmark.plans import derived
from trailmark.plans.stream_book import ROCKS
from trailmark.session import scratch_path
from trailmark.streaming import jobs

SHAPE = "event_id bigint, ts timestamp_ntz, video_hash string, ip_hash string, country string, seconds bigint"
KEYS = ["event_id", "kind", "previous_country", "country", "number", "detail"]


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def rows_of(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def row(event, second, country="A", ip="i", item="v"):
    at = datetime(2024, 1, 1) + timedelta(seconds=second)
    return event, at, item, ip, country, 1704067200 + second


def heartbeat(second, item="v"):
    return None, *row(0, second, item=item)[1:]


def files(spark, *parts):
    path = scratch_path(spark, "in")
    for part in parts:
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path, schema=SHAPE):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def shuffled(spark):
    """Sightings of five items, dealt to files at random within the lateness, and a heartbeat behind them."""
    rows = derived.campaigns(spark, "/root/testdata/sf0.001")
    path = scratch_path(spark, "shuffled")
    late = 86_400
    first, last = rows.agg(F.min("seconds"), F.max("seconds")).first()
    part = F.floor((F.col("seconds") - first + F.pmod(F.xxhash64("event_id"), F.lit(late))) / ((last - first + late) / 3))
    for k in range(4):
        rows.where(part == k).orderBy(F.xxhash64("event_id", F.lit(k))).coalesce(1).write.mode("append").parquet(path)
    end = rows.limit(1).withColumns({"event_id": F.lit(None).cast("bigint"), "ts": F.lit("2030-01-01").cast("timestamp_ntz")})
    end.coalesce(1).write.mode("append").parquet(path)
    return path, rows


def test_shuffled_files_give_the_findings_of_the_batch_operators(spark, shuffled):
    path, rows = shuffled
    found = jobs.stream_spread_events(stream(spark, path, schemas.SIGHTINGS), lateness="1 day")
    got = jobs.run_to_table(found, "findings")
    moved = spread.new_country_spread(rows).selectExpr("event_id", "'spread'", "previous_country", "country", "unique_countries", "null")
    again = spread.same_ip_reuploads(rows).selectExpr("event_id", "'reupload'", "null", "null", "upload_count", "seconds_since_first")
    viral = spread.viral_milestones(rows).selectExpr("event_id", "'viral'", "null", "null", "spread_count", "unique_countries")
    assert rows_of(got.select(*KEYS)) == rows_of(moved.union(again).union(viral))


def test_shuffled_files_give_the_alerts_of_the_batch_operator(spark, shuffled):
    path, rows = shuffled
    columns = ["video_hash", F.col("platform").alias("alert_type"), "seconds", "event_id"]
    # the heartbeat is of every key's stream
    arrivals = stream(spark, path, schemas.SIGHTINGS).select("ts", *columns)
    got = jobs.run_to_table(jobs.stream_alerts(arrivals, 7200, lateness="1 day"), "alerts")
    want = alerts.alert_cooldown(rows.select(*columns), default_seconds=7200)
    assert rows_of(got.where("not late").drop("late")) == rows_of(want.select("video_hash", "alert_type", "seconds", "event_id"))
    assert got.where("late").isEmpty()


def test_three_late_rows_are_kept_and_counted(spark):
    path = files(
        spark,
        [row(1, 0, "A"), row(2, 900, "B")],
        [row(3, 5000, "C")],
        [row(4, 6000, "D")],
        [row(5, 10, "X"), row(6, 20, "Y"), row(7, 899, "Z", "j"), row(8, 5500, "E")],
        [heartbeat(50_000)],
    )
    got = jobs.run_to_table(jobs.stream_spread_events(stream(spark, path), lateness="10 minutes"), "late").collect()
    late = {r.event_id: (r.country, r.detail) for r in got if r.kind == "late"}
    assert late == {5: ("X", 890), 6: ("Y", 880), 7: ("Z", 1)}  # behind the last decided one, at 900
    # row 8 came behind row 4, but none later than itself had been decided
    assert {r.event_id: (r.previous_country, r.number) for r in got if r.kind == "spread"} == {
        2: ("A", 2), 3: ("B", 3), 8: ("C", 4), 4: ("E", 5)
    }


def test_rows_wait_over_a_restart(spark):
    path, out, place = files(spark, [row(2, 50, "B"), row(1, 0, "A")]), scratch_path(spark, "out"), scratch_path(spark, "place")

    def run():
        return jobs.run_to_table(jobs.stream_spread_events(stream(spark, path), lateness="10 minutes"), "x", out, place)

    assert run().isEmpty()
    spark.createDataFrame([row(3, 25, "C"), heartbeat(9000)], SHAPE).coalesce(1).write.mode("append").parquet(path)
    found = {r.event_id: (r.previous_country, r.number) for r in run().collect() if r.kind == "spread"}
    assert found == {3: ("A", 2), 2: ("C", 3)}
    assert run().count() == 4  # with the reuploads of one source


def test_a_quiet_item_is_forgotten_and_its_old_rows_stay_late(spark):
    path = files(
        spark,
        [row(1, 0, "A"), row(2, 10, "B")],
        [heartbeat(20_000, "w")],
        [heartbeat(30_000, "w")],
        [row(3, 5, "C"), row(4, 29_990, "A"), row(5, 29_995, "B")],
        [heartbeat(40_000, "w")],
    )
    found = jobs.stream_spread_events(stream(spark, path), lateness="10 seconds", forget_seconds=3600)
    got = jobs.run_to_table(found, "forget").collect()
    assert sorted((r.event_id, r.kind, r.number) for r in got if r.kind == "spread") == [(2, "spread", 2), (5, "spread", 2)]
    assert [r.event_id for r in got if r.kind == "late"] == [3]


def test_late_rows_of_built_in_operators_are_kept_and_counted(spark):
    path = files(
        spark,
        [row(1, 0), row(2, 4000)],
        [row(3, 9000)],
        [row(4, 10), row(5, 3000, item="w"), row(6, 8390), row(7, 8500)],
    )
    out, place = scratch_path(spark, "out"), scratch_path(spark, "place")

    def run():
        return jobs.late_rows(stream(spark, path), "late", "10 minutes", out, place)

    assert sorted((r.batch_id, r.event_id) for r in run().collect()) == [(2, 4), (2, 5), (2, 6)]
    assert {(r.video_hash, r.late_rows) for r in jobs.late_counts(run()).collect()} == {("v", 2), ("w", 1)}
    spark.createDataFrame([row(8, 20), row(9, 20_000)], SHAPE).coalesce(1).write.mode("append").parquet(path)
    assert sorted(r.event_id for r in run().collect()) == [4, 5, 6, 8]
    assert run().count() == 4


@pytest.mark.parametrize("order", [1, -1])
def test_corrected_windows_and_sessions_equal_those_of_the_table(spark, order):
    rows = derived.campaigns(spark, "/root/testdata/sf0.001")
    path = scratch_path(spark, "unordered")
    first, last = rows.agg(F.min("seconds"), F.max("seconds")).first()
    part = F.floor((F.col("seconds") - first) * 3 / (last - first + 1))
    for k in range(3)[::order]:
        rows.where(part == k).coalesce(1).write.mode("append").parquet(path)

    def arrivals():
        return stream(spark, path, schemas.SIGHTINGS)

    late = jobs.late_rows(arrivals())
    assert late.isEmpty() == (order == 1)
    keys = ["video_hash", "window_start", "window_end"]
    counted = jobs.run_updates(jobs.stream_velocity(arrivals()), keys, "velocity")
    got = jobs.corrected(counted, late, rows, jobs.stream_velocity, keys)
    assert rows_of(got) == rows_of(jobs.stream_velocity(rows).select(*got.columns))

    if order == -1:  # all that is older than the newest part is late, or comes with it
        bursts = lambda df: jobs.stream_reupload_bursts(df, least=2)
        closed = jobs.run_to_table(bursts(arrivals()), "bursts")
        got = jobs.corrected(closed, late, rows, bursts, ["video_hash", "ip_hash"])
        pairs = late.select("video_hash", "ip_hash").distinct()
        want = bursts(rows).join(pairs, ["video_hash", "ip_hash"], "left_semi")
        assert rows_of(got.join(pairs, ["video_hash", "ip_hash"], "left_semi").select(*want.columns)) == rows_of(want)


def test_sightings_find_the_last_detection_in_any_order(spark):
    rng, within = random.Random(4), 50
    found = [(i, rng.randrange(900), item) for i in range(120) for item in "ab"]
    found += [(500 + i, 300, "a") for i in range(40)]  # many in one second
    seen = [(1000 + i, rng.randrange(900), item) for i in range(150) for item in "abc"]

    def dealt(rows):
        parts = [[] for _ in range(4)]
        for event, second, item in rows:
            parts[min(3, (second + rng.randrange(200)) // 250)].append(row(event, second, item=item))
        return stream(spark, files(spark, *parts, [heartbeat(5000)]))

    out = jobs.stream_last_detection(dealt(found), dealt(seen), within, "600 seconds")
    got = {tuple(r) for r in jobs.run_to_table(out, "last").collect()}
    want = set()
    for event, second, item in seen:
        before = [(s, e) for e, s, i in found if i == item and s < second <= s + within]
        if before:
            want.add((item, "sighting", event, max(before)[1], len(before), False))
    assert got == want


def test_late_sides_are_given_out_and_old_detections_go(spark):
    found = files(spark, [row(1, 100)], [row(2, 2000)], [heartbeat(3000)], [row(3, 150)], [heartbeat(9001)])
    seen = files(spark, [row(10, 120), row(11, 100)], [row(12, 2050), row(13, 2051)], [heartbeat(3000)], [row(14, 130)], [heartbeat(9001)])
    out = jobs.stream_last_detection(stream(spark, found), stream(spark, seen), 50, "10 seconds")
    got = {tuple(r) for r in jobs.run_to_table(out, "last").collect()}
    assert {r for r in got if not r[-1]} == {("v", "sighting", 10, 1, 1, False), ("v", "sighting", 12, 2, 1, False)}
    assert {r[1:3] for r in got if r[-1]} == {("detection", 3), ("sighting", 14)}
    assert all(r[3:5] == (None, None) for r in got if r[-1])


def test_a_crowded_item_is_decided_slot_by_slot(spark, monkeypatch):
    """The rows of one item are many keys of state; detections at the end of a slot count in the next."""
    rng, within = random.Random(5), 20
    found = [(i, rng.randrange(1200)) for i in range(300)] + [(400 + k, second) for k, second in enumerate((119, 120, 239, 240, 100))]
    seen = [(1000 + i, rng.randrange(1200)) for i in range(600)] + [(2000 + k, second) for k, second in enumerate((120, 139, 140, 141, 240, 260))]
    rows = [files(spark, [row(e, s) for e, s in side], [heartbeat(9000)]) for side in (found, seen)]
    out = jobs.stream_last_detection(*[stream(spark, r) for r in rows], within, "2000 seconds")
    done = jobs.run_to_table(out, "slots")
    want = set()
    for event, second in seen:
        before = [(s, e) for e, s in found if s < second <= s + within]
        if before:
            want.add((event, max(before)[1], len(before), False))
    assert {(r.event_id, r.detection_id, r.detections, r.late) for r in done.collect()} == want
    # what one call of the state is given at most
    monkeypatch.setattr(jobs, "_decided", lambda rows, keys, *_: rows.groupBy(*keys).count())
    found, seen = (spark.read.schema(SHAPE).parquet(r) for r in rows)
    assert jobs.stream_last_detection(found, seen, within, "2000 seconds").agg(F.max("count")).first()[0] < 150
