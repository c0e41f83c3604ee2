"""Rule files, media inventory, frame decoding and small decisions."""

import base64
import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trailmark.functions import arrays, decide
from trailmark.operators import alerts, lineage, registry, scoring, stats
from trailmark.sources import rules, tables


def test_rules_from_a_file_replace_defaults(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"global_thresholds": {"country_threshold": 2}}))
    got = {r.rule: r.threshold for r in rules.load_rules(spark, str(path)).collect()}
    assert got["country_threshold"] == 2 and got["spread_threshold"] == 50


def test_inventory_hashes_accepted_files_only(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"clip")
    (tmp_path / "b.txt").write_bytes(b"note")
    (tmp_path / "c.mov").write_bytes(b"x" * 100)
    found = tables.content_inventory(tables.media_files(spark, str(tmp_path)), max_bytes=50).collect()
    got = {r.path.rsplit("/", 1)[1]: (r.accepted, r.sha256) for r in found}
    assert got == {
        "a.mp4": (True, hashlib.sha256(b"clip").hexdigest()),
        "b.txt": (False, None),
        "c.mov": (False, None),
    }


def test_frames_are_decoded_up_to_the_limit(spark):
    good = base64.b64encode(b"pixels").decode()
    frames = [f"data:image/png;base64,{good}", good, "%%%"] + [good] * 20
    df = spark.createDataFrame([(1, frames)], "id int, frames array<string>")
    got = tables.decode_frame_batch(df).collect()
    assert [r.frame_no for r in got] == [0, 1, *range(3, 15)]
    assert all(bytes(r.frame) == b"pixels" for r in got)


def test_platforms_and_private_addresses(spark):
    df = spark.createDataFrame(
        [("https://www.youtube.com/x", "172.31.0.1"), ("http://netflix.com", "172.32.0.1"),
         ("https://u@m.x.com:80/", "::1"), ("not a url", "110.0.0.1")],
        "url string, ip string",
    )
    got = df.select(decide.platform_of(F.col("url")), decide.is_private_ip(F.col("ip"))).collect()
    assert [tuple(r) for r in got] == [
        ("YouTube", True), (None, False), ("X", True), (None, False),
    ]


def test_mutation_classes(spark):
    df = spark.createDataFrame([(d,) for d in (0, 1, 5, 6, 15, 16, 30, 31)], "d int")
    got = [r[0] for r in df.select(decide.classify_mutation(F.col("d"))).collect()]
    assert got == [
        "unknown_modification", "minor_compression", "minor_compression", "moderate_edit",
        "moderate_edit", "significant_modification", "significant_modification",
        "major_transformation",
    ]


def test_alert_and_geo_rules_from_files(spark, tmp_path):
    path = tmp_path / "alert.json"
    path.write_text(json.dumps({
        "cooldown": {"default_seconds": 60, "per_type": {"VIRAL": 30}},
        "severity_rules": {"reupload": {"critical_count": 20, "high_count": 9, "medium_count": 4, "low_count": 1}},
        "routing": {"LOW": ["pager"]},
        "escalation": {"escalate_after_minutes": 5},
    }))
    got = rules.load_alert_rules(spark, str(path))
    assert got["cooldown"]["default_seconds"] == 60
    assert (got["cooldown"]["per_type"]["VIRAL"], got["cooldown"]["per_type"]["REUPLOAD"]) == (30, 180)
    assert got["severity_rules"]["reupload"] == {"CRITICAL": 20, "HIGH": 9, "MEDIUM": 4}
    assert got["routing"]["LOW"] == ["pager"] and got["routing"]["MEDIUM"] == ["telegram"]
    assert got["escalation"] == {"escalate_after_minutes": 5, "escalation_channel": "email"}
    df = spark.createDataFrame([(3,), (4,), (25,)], "n int")
    named = [r[0] for r in df.select(alerts.rule_severity("reupload", F.col("n"), got)).collect()]
    assert named == ["LOW", "MEDIUM", "CRITICAL"]
    assert rules.ALERT_RULES["severity_rules"]["reupload"]["CRITICAL"] == 10

    path = tmp_path / "geo.json"
    path.write_text(json.dumps({
        "spread_detection": {"city_threshold": 2, "country_threshold": 9},
        "reupload_detection": {"rapid_window_seconds": 7},
        "watchlist": {"enabled": True, "regions": [{"name": "n", "countries": ["US", "IN"], "severity_boost": "HIGH"}]},
    }))
    got = rules.load_geo_rules(spark, str(path))
    assert (got["city_threshold"], got["rapid_window_seconds"], got["cluster_radius_km"]) == (2, 7, 50.0)
    assert got["watchlist"] == [("US", "HIGH"), ("IN", "HIGH")]


def test_one_sample_is_the_first(spark):
    df = spark.createDataFrame([(0,), (1,), (9,)], "n int")
    assert [r[0] for r in df.select(arrays.sample_indices(F.col("n"), 1)).collect()] == [[], [0], [0]]
    assert df.select(arrays.sample_indices(F.col("n"), 3)).collect()[2][0] == [0, 4, 8]


def test_batches_hold_waiting_registrations_only(spark):
    rows = [(i, kind, status, i, 1) for i, (kind, status) in enumerate(
        [("register_video", "queued"), ("lineage", "queued"), ("register_video", "confirmed"),
         ("register_video", "retrying"), ("register_video", "failed"), ("register_video", "queued")]
    )]
    box = spark.createDataFrame(rows, "id int, tx_type string, status string, created_at int, node int")
    got = sorted((r.id, r.chunk) for r in registry.batch_chunks(box, 2).collect())
    assert got == [(0, 0), (3, 0), (5, 1)]
    with pytest.raises(ValueError):
        registry.batch_chunks(box, 51)


def test_a_reply_without_verdict_is_no_missing_reply(spark):
    rows = [(0.5, 0.5, True, None), (0.5, 0.5, False, None), (0.5, 0.5, True, True)]
    df = spark.createDataFrame(rows, "avg_quality double, face_detection_rate double, reply_present boolean, reply_fake boolean")
    df = df.withColumns({c: F.lit(0.5) for c in ("reply_authenticity", "reply_confidence")}).withColumns(
        {"personality_detected": F.lit(False), "personality_category": F.lit(None).cast("string")}
    )
    got = [(r.analysis_method, r.fused_fake) for r in scoring.fuse_scores(df, "frames").collect()]
    assert got == [("personality_first", False), ("heuristic", False), ("personality_first", True)]


def test_trees_of_any_depth_and_cycles(spark):
    chain = [(f"{i:08d}", f"{i - 1:08d}" if i else None) for i in range(300)] + [("x", "gone"), ("r", None)]
    nodes = spark.createDataFrame(chain, "video_hash string, parent_hash string")
    families = nodes.select("video_hash", F.lit(1).alias("family_id"))
    rows = {r.video_hash: r for r in lineage.family_tree(nodes, families).collect()}
    assert len(rows) == 303 and rows["00000299"].generation == 299 and rows["Multiple Origins"].generation == -1
    assert rows["00000299"].path == "/".join(f"{i:08d}" for i in range(300))
    assert (rows["x"].generation, rows["x"].parent_hash, rows["x"].root_hash) == (0, None, "x")
    circle = spark.createDataFrame([("a", "b"), ("b", "a")], "video_hash string, parent_hash string")
    with pytest.raises(ValueError):
        lineage.generations(circle, max_rounds=5)


def test_reports_show_the_family(spark):
    item = "video_hash string, parent_hash string, generation int, first_seen timestamp_ntz, source_platform string, is_deepfake boolean, confidence double, mutations array<string>"
    day = lambda n: datetime(2024, 1, n)
    rows = [("o", None, 0, day(1), "X", False, 0.95, None), ("c", "o", 1, day(3), "Y", True, 0.912, ["heavy_compression"])]
    seen = [("c", day(3), 2, "Y"), ("o", day(1), 1, "X"), *[("o", day(4 + k), 3 + k, "Z") for k in range(5)]]
    items = spark.createDataFrame(rows, item)
    origins = spark.createDataFrame([("o", "o"), ("c", "o")], "video_hash string, origin_hash string")
    sizes = spark.createDataFrame([("o", 2), ("c", 2)], "video_hash string, family_members int")
    sightings = spark.createDataFrame(seen, "video_hash string, ts timestamp_ntz, event_id int, platform string")
    text = {r.video_hash: r.report for r in stats.forensic_report(items, origins, sizes, sightings).collect()}["c"]
    assert text.splitlines() == [
        "Video Hash: c...", "First Seen: 2024-01-03 00:00:00", "Platform: Y", "Status: DEEPFAKE DETECTED",
        "Verdict: HIGHLY LIKELY DEEPFAKE", "Confidence: 91.2%", "Origin Hash: o...", "Origin Date: 2024-01-01 00:00:00",
        "Origin Platform: X", "Current Generation: 1 (0 = original)", "Total Family Members: 2", "Detected Mutations:",
        "  * Heavy Compression", "  2024-01-01 | X            | Gen 0", "  2024-01-03 | Y            | Gen 1",
        "  2024-01-04 | Z            | Gen 0", "  2024-01-05 | Z            | Gen 0", "  2024-01-06 | Z            | Gen 0",
        "  ... and 2 more events",
    ]
