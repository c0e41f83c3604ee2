"""Streaming queries, each run over all available input and read back from its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.plans import derived, media_book  # noqa: F401
from trailmark.plans.alert_book import _entries, cooldown_sql
from trailmark.plans.book import ORACLE, query
from trailmark.plans.oracle_views import register
from trailmark.session import scratch_path
from trailmark.sources import tables
from trailmark.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PARTS = 4
#: Rows that a file of a part has on average, so that large parts are written and read by many tasks.
FILE_ROWS = 100_000
_PARTS: dict[tuple[str, str], tuple[str, int]] = {}


def _written(rows, part, parts, path, files, by="event_id"):
    """Writes parts one after another, each as ``files`` files, so that a stream that takes so many sees one at a time.

    A stream takes files in order of their writing, but the files of one write are in no order: were they
    taken by themselves, a part that large tables make several files of would come in any order of time.
    """
    spark = rows.sparkSession
    before = 0
    for k in range(parts):
        # a session may deal out more partitions than asked for; more files would not be one micro-batch
        rows.where(part == k).repartition(files, F.xxhash64(by)).coalesce(files).write.mode("append").parquet(path)
        # a task without rows writes no file
        for _ in range(before + files - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)
        before += files


def _files(rows: int) -> int:
    return 1 + rows // (PARTS * FILE_ROWS)


def _parts(spark, d):
    """The events of the table again, in parts by time that are written one after another.

    Every query below sees the parts as micro-batches in order of time, however many files they have.
    Returns the folder and the number of files of a part.
    """
    key = (spark.sparkContext.applicationId, d)
    if key not in _PARTS:
        path = scratch_path(spark, "events-in")
        events = derived.table(spark, d, "events")
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        first, last, rows = events.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
        part = F.floor((at - F.lit(first)) * PARTS / F.lit(last - first + 1))
        _written(events, part, PARTS, path, _files(rows))
        _PARTS[key] = path, _files(rows)
    return _PARTS[key]


_SHUFFLED: dict[tuple[str, str], tuple[str, int, str]] = {}


def _shuffled(spark, d):
    """The events in parts by a time that is up to a whole part off, and a heartbeat behind them.

    Neighbouring parts overlap and the rows of a part lie in its files in no order. Returns the folder, the
    number of files of a part and the lateness that covers this.
    """
    key = (spark.sparkContext.applicationId, d)
    if key not in _SHUFFLED:
        path = scratch_path(spark, "events-shuffled")
        events = derived.table(spark, d, "events")
        second = F.unix_seconds(F.col("ts").cast("timestamp"))
        first, last, rows = events.agg(F.min(second), F.max(second), F.count(F.lit(1))).first()
        span = (last - first) // PARTS + 1
        part = F.floor((second - first + F.pmod(F.xxhash64("event_id"), F.lit(span))) / span)
        _written(events, part, PARTS + 1, path, _files(rows))
        later = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.lit(last + 2 * span + 2))
        beat = events.limit(1).withColumns({"event_id": F.lit(None).cast("bigint"), "ts": later})
        beat.write.mode("append").parquet(path)
        _SHUFFLED[key] = path, _files(rows), f"{2 * span} seconds"
    return _SHUFFLED[key]


def _stream(spark, d, dense=False, feed=None):
    path, files = feed or _parts(spark, d)
    events = jobs.stream_events(spark, path, files_per_trigger=files)
    rows = derived.sightings_from(events, derived.table(spark, d, "nation"))
    rows = rows.withColumn("seconds", derived.seconds_of())
    return _dense(rows) if dense else rows


def _dense(rows):
    item = (F.col("item") % 5).cast("int")
    return rows.withColumns({"item": item, "video_hash": F.sha2(item.cast("string"), 256)})


def _naive(column):
    """An instant as a zone-less timestamp in UTC, whatever the session's zone is."""
    micros = F.unix_micros(column)
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(
        secs=(micros / 1000000).cast("decimal(18,6)")
    )


@query("stream_sightings", """
SELECT event_id, video_hash, ip_hash, country, platform FROM sightings""")
def _(spark, d):
    path = scratch_path(spark, "sightings-in")
    derived.sightings(spark, d).repartitionByRange("ts").write.parquet(path)
    out = jobs.stream_sightings(spark, path, files_per_trigger=2)
    return jobs.run_to_table(
        out.select("event_id", "video_hash", "ip_hash", "country", "platform"), "sightings"
    )


@query("stream_spread_counts", """
SELECT video_hash, count(*) AS spread_count, min(ts) AS first_seen, max(ts) AS last_seen
FROM sightings GROUP BY 1""")
def _(spark, d):
    return jobs.run_updates(
        jobs.stream_spread_counts(_stream(spark, d)), ["video_hash"], "spread-counts"
    )


@query("stream_velocity", """
SELECT video_hash, w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS events
FROM (SELECT video_hash, time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(k * 10) AS w
      FROM campaigns, (SELECT unnest(range(6))::INT AS k)) GROUP BY 1, 2""")
def _(spark, d):
    keys = ["video_hash", "window_start", "window_end"]
    out = jobs.run_updates(jobs.stream_velocity(_stream(spark, d, True)), keys, "velocity")
    return out.select(
        "video_hash",
        _naive(F.col("window_start")).alias("window_start"),
        _naive(F.col("window_end")).alias("window_end"),
        "events",
    )


@query("stream_velocity_corrected", ORACLE["stream_velocity"])
def _(spark, d):
    """Windows over events in no order, of which many come late, and those of late events again from the table."""
    *feed, _ = _shuffled(spark, d)
    keys = ["video_hash", "window_start", "window_end"]
    arrivals = _stream(spark, d, True, feed).where("event_id is not null")
    counted = jobs.run_updates(jobs.stream_velocity(arrivals), keys, "velocity")
    late = jobs.late_rows(_stream(spark, d, True, feed).where("event_id is not null"))
    out = jobs.corrected(counted, late, _dense(derived.sightings(spark, d)), jobs.stream_velocity, keys)
    return out.select(
        "video_hash",
        _naive(F.col("window_start")).alias("window_start"),
        _naive(F.col("window_end")).alias("window_end"),
        "events",
    )


@query("stream_reupload_bursts", """
SELECT video_hash, ip_hash, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS uploads,
       max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) AS closed
FROM (SELECT *, sum(CASE WHEN gap < INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY video_hash, ip_hash
        ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
      FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY video_hash, ip_hash ORDER BY ts, event_id) AS gap FROM campaigns))
GROUP BY video_hash, ip_hash, s
HAVING count(*) >= 2""")
def _(spark, d):
    """Sessions that the stream has closed and those still open; sources with late rows again from the table."""
    def bursts(rows):
        return jobs.stream_reupload_bursts(rows, least=2)

    closed = jobs.run_to_table(bursts(_stream(spark, d, True)), "bursts")
    stored = _dense(derived.sightings(spark, d))
    out = closed.unionByName(jobs.open_sessions(stored, least=2))
    late = jobs.late_rows(_stream(spark, d, True))
    out = jobs.corrected(out, late, stored, bursts, ["video_hash", "ip_hash"])
    # to the microsecond, where the watermark that closes sessions has whole milliseconds
    ended = F.col("ts").cast("timestamp") - F.expr(f"INTERVAL {jobs.LATENESS}")
    mark = derived.table(spark, d, "events").agg(F.unix_micros(F.max(ended))).first()[0]
    out = out.withColumn("closed", F.unix_micros("session_end") <= F.lit(mark))
    return out.withColumns(
        {c: _naive(F.col(c)) for c in ("session_start", "session_end")}
    )


def _on_rocks(spark, run):
    """Runs a job under the state store that custom state needs, and sets the session back."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


register("stream_candidates", """
SELECT video_hash, platform AS alert_type, seconds, event_id FROM sightings WHERE is_deepfake""")


@query("stream_alerts", cooldown_sql("stream_candidates", "21600"))
def _(spark, d):
    *feed, lateness = _shuffled(spark, d)
    rows = _stream(spark, d, feed=feed).where("is_deepfake or event_id is null").select(
        "ts", "video_hash", F.col("platform").alias("alert_type"), "seconds", "event_id"
    )
    found = jobs.stream_alerts(rows, 21_600, lateness)
    return _on_rocks(spark, lambda: jobs.run_to_table(found, "alerts")).where("not late").drop("late")


@query("stream_spread_events", """
SELECT video_hash, event_id, 'reupload' AS kind, NULL AS previous_country, NULL AS country,
       upload_count AS number, seconds_since_first::BIGINT AS detail FROM reuploads
UNION ALL
SELECT video_hash, event_id, 'spread', previous_country, country, unique_countries, NULL
FROM spread_events WHERE is_new_country AND spread_count > 1
UNION ALL
SELECT video_hash, event_id, 'viral', NULL, NULL, spread_count, unique_countries
FROM spread_events WHERE spread_count IN (10, 50, 100) OR spread_count % 500 = 0""")
def _(spark, d):
    *feed, lateness = _shuffled(spark, d)
    found = jobs.stream_spread_events(_stream(spark, d, feed=feed), lateness=lateness)
    return _on_rocks(spark, lambda: jobs.run_to_table(found, "spread-events"))


@query("stream_tiered_lookup", ORACLE["tiered_lookup"])
def _(spark, d):
    items = derived.media_fingerprints(spark, d).select("video_hash", "perceptual_hash")
    path, files = scratch_path(spark, "arrivals"), _files(items.count())
    _written(items, F.pmod(F.hash("video_hash"), F.lit(PARTS)), PARTS, path, files, "video_hash")
    arrivals = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", files).parquet(path)
    return jobs.stream_tiered_lookup(arrivals, derived.registry(spark, d))


@query("stream_first_countries", """
SELECT DISTINCT video_hash, country FROM sightings""")
def _(spark, d):
    firsts = jobs.stream_first_countries(_stream(spark, d).select("video_hash", "country"))
    return jobs.run_to_table(firsts, "first-countries")


@query("stream_dedup", """
SELECT DISTINCT video_hash, ip_hash FROM sightings""")
def _(spark, d):
    rows = jobs.stream_dedup(_stream(spark, d), ["video_hash", "ip_hash"])
    return jobs.run_to_table(rows.select("video_hash", "ip_hash"), "dedup")


@query("stream_upsert_registry", """
SELECT coalesce(o.video_hash, n.video_hash) AS video_hash,
       coalesce(n.confidence, o.confidence) AS confidence,
       least(coalesce(o.fs, n.fs), coalesce(n.fs, o.fs)) AS first_seen,
       greatest(coalesce(o.fs, n.ls), coalesce(n.ls, o.fs)) AS last_seen,
       coalesce(o.n, 0) + coalesce(n.n, 0) AS detection_count
FROM (SELECT video_hash, confidence, first_seen - INTERVAL 1 DAY AS fs, 1 AS n FROM item_lineage WHERE generation > 1) o
FULL JOIN (SELECT video_hash, arg_max(confidence, (ts, event_id)) AS confidence, min(ts) AS fs, max(ts) AS ls,
                  count(*) AS n FROM sightings GROUP BY 1) n ON n.video_hash = o.video_hash""")
def _(spark, d):
    batch = _stream(spark, d).select(
        "video_hash",
        F.col("item").cast("string").alias("perceptual_hash"),
        "is_deepfake",
        "confidence",
        F.col("confidence").alias("lipsync_score"),
        F.lit(None).cast("double").alias("fact_check_score"),
        F.col("ts").alias("seen_at"),
        "event_id",
    )
    known = derived.item_lineage(spark, d).where("generation > 1").select(
        "video_hash",
        F.lit("").alias("perceptual_hash"),
        "is_deepfake",
        "confidence",
        F.col("confidence").alias("lipsync_score"),
        F.lit(None).cast("double").alias("fact_check_score"),
        F.expr("timestampadd(DAY, -1, first_seen)").alias("first_seen"),
        F.expr("timestampadd(DAY, -1, first_seen)").alias("last_seen"),
        F.lit(1).cast("bigint").alias("detection_count"),
    )
    out = jobs.stream_upsert_registry(batch, known)
    return out.select("video_hash", "confidence", "first_seen", "last_seen", "detection_count")


@query("stream_lookup", """
SELECT s.event_id, s.video_hash, l.first_seen AS known_since
FROM sightings s LEFT JOIN item_lineage l ON l.video_hash = s.video_hash AND l.generation > 1""")
def _(spark, d):
    known = derived.item_lineage(spark, d).where("generation > 1")
    found = jobs.stream_lookup(_stream(spark, d).select("event_id", "video_hash"), known)
    return jobs.run_to_table(found, "lookup").select("event_id", "video_hash", "known_since")


@query("stream_offline_replay", """
SELECT tx_type, id::VARCHAR AS payload_id, epoch(created_at)::DOUBLE AS timestamp FROM outbox""")
def _(spark, d):
    path = scratch_path(spark, "offline")
    tables.write_offline_queue(_entries(spark, d), path)
    rows = jobs.stream_offline_replay(spark, path).select(
        "tx_type", F.col("payload")["id"].alias("payload_id"), "timestamp"
    )
    return jobs.run_to_table(rows, "replay")


@query("stream_detection_sighting_join", """
SELECT a.video_hash, a.event_id AS detection_id, b.event_id
FROM sightings a JOIN sightings b ON b.video_hash = a.video_hash AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
WHERE a.is_deepfake""")
def _(spark, d):
    found = _stream(spark, d).where("is_deepfake")
    pairs = jobs.stream_detection_sighting_join(found, _stream(spark, d), "1 HOUR")
    return jobs.run_to_table(pairs, "interval-join")


@query("stream_last_detection", """
SELECT b.video_hash, b.event_id, arg_max(a.event_id, (a.seconds, a.event_id)) AS detection_id, count(*) AS detections
FROM campaigns a JOIN campaigns b ON b.video_hash = a.video_hash AND b.seconds > a.seconds AND b.seconds <= a.seconds + 3600
WHERE a.is_deepfake GROUP BY 1, 2""")
def _(spark, d):
    *feed, lateness = _shuffled(spark, d)
    found = _stream(spark, d, True, feed).where("is_deepfake or event_id is null")
    out = jobs.stream_last_detection(found, _stream(spark, d, True, feed), 3600, lateness)
    rows = _on_rocks(spark, lambda: jobs.run_to_table(out, "last-detection"))
    return rows.where("not late").drop("late", "kind")
