"""Sightings that follow detections: pairs at the edges of the time range and of the slots that they meet in."""

from pyspark.sql import functions as F

from trailmark.session import scratch_path
from trailmark.streaming import jobs


def rows_at(spark, seconds, first_id=0):
    at = [(first_id + i, "v", s) for i, s in enumerate(seconds)]
    rows = spark.createDataFrame(at, "event_id bigint, video_hash string, s double")
    return rows.withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("bigint"))).drop("s")


def test_every_pair_within_the_hour_comes_once(spark):
    """Also before 1970, on the edges of slots and with equal times."""
    seconds = [-7200.0, -3600.000001, -3600.0, -1.0, 0.0, 0.0, 0.000001, 3599.999999, 3600.0, 3600.000001, 5400.5, 7200.0, 9000.0]
    rows = rows_at(spark, seconds)
    found = jobs.stream_detection_sighting_join(rows, rows, "1 HOUR").collect()
    micros = [round(s * 1e6) for s in seconds]
    want = sorted((i, j) for i, a in enumerate(micros) for j, b in enumerate(micros) if a < b <= a + 3_600_000_000)
    assert sorted((r.detection_id, r.event_id) for r in found) == want


def test_rows_meet_by_slot_and_not_only_by_item(spark):
    """With the item as the only key, each row goes through all rows that the item has in state."""
    path = scratch_path(spark, "one-item")
    rows_at(spark, [86_400.0 + 60 * i for i in range(600)]).write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path)
    pairs = jobs.stream_detection_sighting_join(stream, stream, "1 HOUR")
    assert "seen_slot" in str(pairs._jdf.queryExecution().analyzed().toString())
    assert jobs.run_to_table(pairs, "one-item").distinct().count() == sum(min(60, 599 - i) for i in range(600))
