"""Streams over several files, with a late row, against their batch twins."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trailmark.operators import alerts, registry, spread
from trailmark.plans import derived
from trailmark.plans.stream_book import ROCKS
from trailmark.session import scratch_path
from trailmark.streaming import jobs


@pytest.fixture(scope="module")
def parts(spark):
    """Sightings in five files by time."""
    rows = derived.sightings(spark, "/root/testdata/sf0.001")
    path = scratch_path(spark, "parts")
    (first, last) = rows.agg(F.min("seconds"), F.max("seconds")).first()
    step = (last - first) // 5 + 1
    for i in range(5):
        low = first + i * step
        part = rows.where((F.col("seconds") >= low) & (F.col("seconds") < low + step))
        part.coalesce(1).write.mode("append").parquet(path)
    return path, rows


def rows_of(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_counts_over_batches(spark, parts):
    path, rows = parts
    got = jobs.run_updates(
        jobs.stream_spread_counts(jobs.stream_sightings(spark, path)), ["video_hash"], "counts"
    )
    assert rows_of(got) == rows_of(jobs.stream_spread_counts(rows))


def test_cooldown_state_carries_over_batches(spark, parts):
    path, rows = parts
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    columns = ["video_hash", F.col("platform").alias("alert_type"), "seconds", "event_id"]
    dense = F.sha2((F.col("item") % 5).cast("string"), 256).alias("video_hash")
    try:
        stream = jobs.stream_sightings(spark, path).select(dense, *columns[1:])
        got = jobs.run_to_table(jobs.stream_alerts(stream, 7200), "alerts")
        want = alerts.alert_cooldown(rows.select(dense, *columns[1:]), default_seconds=7200)
        assert rows_of(got) == rows_of(want.select(*got.columns))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_registry_snapshots_over_batches(spark, parts):
    path, rows = parts
    shape = [
        "video_hash",
        F.lit("p").alias("perceptual_hash"),
        "is_deepfake",
        "confidence",
        F.col("confidence").alias("lipsync_score"),
        F.lit(None).cast("double").alias("fact_check_score"),
        F.col("ts").alias("seen_at"),
        "event_id",
    ]
    empty = registry.fold_batch(rows.select(*shape)).where("false")
    got = jobs.stream_upsert_registry(jobs.stream_sightings(spark, path).select(*shape), empty)
    want = registry.upsert_registry(empty, rows.select(*shape))
    assert rows_of(got.select(*want.columns)) == rows_of(want)


def test_first_countries_and_interval_join(spark, parts):
    path, rows = parts
    firsts = jobs.run_to_table(
        jobs.stream_first_countries(
            jobs.stream_sightings(spark, path).select("video_hash", "country")
        ),
        "firsts",
    )
    assert rows_of(firsts) == rows_of(rows.select("video_hash", "country").distinct())


def test_rows_behind_the_watermark_are_dropped(spark, parts):
    path, rows = parts
    late = scratch_path(spark, "late")
    (first, middle) = rows.agg(F.min("ts"), F.median("seconds")).first()
    # late rows are judged by the watermark of the batch before, so two files come first
    for half in (F.col("seconds") <= middle, F.col("seconds") > middle):
        rows.where(half).coalesce(1).write.mode("append").parquet(late)
    old = rows.limit(1).withColumn("ts", F.lit(first).cast("timestamp_ntz"))
    windows = jobs.stream_velocity(jobs.stream_sightings(spark, late))
    keys = ["video_hash", "window_start", "window_end"]
    base = jobs.run_updates(windows, keys, "velocity").agg(F.sum("events")).first()[0]
    old.coalesce(1).write.mode("append").parquet(late)
    again = jobs.run_updates(
        jobs.stream_velocity(jobs.stream_sightings(spark, late)), keys, "velocity"
    )
    assert again.agg(F.sum("events")).first()[0] == base


def on_rocks(spark, run):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def halves(spark, parts):
    """A folder with the first part of the rows, and a function that adds the rest."""
    _, rows = parts
    path = scratch_path(spark, "halves")
    middle = rows.agg(F.median("seconds")).first()[0]
    rows.where(F.col("seconds") <= middle).coalesce(1).write.mode("append").parquet(path)
    return path, lambda: rows.where(F.col("seconds") > middle).coalesce(1).write.mode("append").parquet(path)


def test_jobs_go_on_where_they_ended(spark, parts):
    path, more = halves(spark, parts)
    out, place = scratch_path(spark, "out"), scratch_path(spark, "place")

    def run():
        stream = jobs.stream_dedup(jobs.stream_sightings(spark, path).select("video_hash", "country"), ["video_hash", "country"])
        return jobs.run_to_table(stream, "restart", out, place)

    first = run().count()
    assert rows_of(run()) == rows_of(run()) and run().count() == first
    more()
    assert rows_of(run()) == rows_of(parts[1].select("video_hash", "country").distinct())
    with pytest.raises(ValueError):
        jobs.run_to_table(jobs.stream_sightings(spark, path), "x", output=out)


def test_counts_go_on_where_they_ended(spark, parts):
    path, more = halves(spark, parts)
    out, place = scratch_path(spark, "out"), scratch_path(spark, "place")

    def run():
        stream = jobs.stream_spread_counts(jobs.stream_sightings(spark, path))
        return jobs.run_updates(stream, ["video_hash"], "restart", out, place)

    run()
    more()
    assert rows_of(run()) == rows_of(jobs.stream_spread_counts(parts[1]))


def test_registry_goes_on_and_rewrites_touched_buckets_only(spark):
    shape = "video_hash string, perceptual_hash string, is_deepfake boolean, confidence double, lipsync_score double, fact_check_score double, seen_at timestamp_ntz, event_id bigint"
    at = lambda n: datetime(2024, 1, n)
    rows = [[("aa1", "p", True, 0.5, 0.5, None, at(1), 1), ("bb1", "p", False, 0.4, 0.4, None, at(2), 2)],
            [("aa1", "p", True, 0.9, 0.9, None, at(3), 3)]]
    path, out, place = (scratch_path(spark, x) for x in ("in", "out", "place"))
    empty = registry.fold_batch(spark.createDataFrame([], shape))

    def run():
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)
        return jobs.stream_upsert_registry(stream, empty, output=out, checkpoint=place)

    for batch in rows:
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").parquet(path)
        got = {r.video_hash: r for r in run().collect()}
    assert {h: r.detection_count for h, r in got.items()} == {"aa1": 2, "bb1": 1}
    assert {h: r.detection_count for h, r in ((r.video_hash, r) for r in run().collect())} == {"aa1": 2, "bb1": 1}
    listed = spark.read.parquet(f"{out}/versions").where("version = 1").collect()
    assert [r.bucket for r in listed] == ["aa"]


def test_a_batch_in_which_all_is_suppressed(spark):
    path = scratch_path(spark, "quiet")
    for rows in ([("h", "A", 0, 1), ("g", "A", 5, 2)], [("h", "A", 1, 3), ("g", "A", 6, 4)], [("h", "A", 500, 5)]):
        df = spark.createDataFrame(rows, "video_hash string, alert_type string, seconds bigint, event_id bigint")
        df.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = on_rocks(spark, lambda: jobs.run_to_table(jobs.stream_alerts(stream, 300), "quiet"))
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 5]


def test_findings_over_batches_equal_the_batch_operators(spark, parts):
    path, rows = parts
    dense = F.sha2((F.col("item") % 5).cast("string"), 256)
    got = on_rocks(
        spark,
        lambda: jobs.run_to_table(
            jobs.stream_spread_events(jobs.stream_sightings(spark, path).withColumn("video_hash", dense)), "findings"
        ),
    )
    rows = rows.withColumn("video_hash", dense)
    moved = spread.new_country_spread(rows).selectExpr("event_id", "'spread'", "previous_country", "country", "unique_countries", "null")
    again = spread.same_ip_reuploads(rows).selectExpr("event_id", "'reupload'", "null", "null", "upload_count", "seconds_since_first")
    viral = spread.viral_milestones(rows).selectExpr("event_id", "'viral'", "null", "null", "spread_count", "unique_countries")
    want = moved.union(again).union(viral)
    assert rows_of(got.select("event_id", "kind", "previous_country", "country", "number", "detail")) == rows_of(want)


def test_open_and_closed_sessions_are_all_sessions(spark, parts):
    path, rows = parts
    dense = F.sha2((F.col("item") % 5).cast("string"), 256)
    closed = jobs.run_to_table(
        jobs.stream_reupload_bursts(jobs.stream_sightings(spark, path).withColumn("video_hash", dense), least=2), "sessions"
    )
    stored = rows.withColumn("video_hash", dense)
    every = jobs.stream_reupload_bursts(stored, least=2)
    assert rows_of(closed.unionByName(jobs.open_sessions(stored, least=2))) == rows_of(every)
