"""Cooldown against a plain sequential walk, and the ledger's alert scenarios."""

import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import alerts
from trailmark.sources.rules import GLOBAL_RULES

COLUMNS = "video_hash string, alert_type string, seconds bigint, event_id bigint"


def walk(rows, gap_of):
    kept, last = set(), {}
    for video, kind, second, event in sorted(rows, key=lambda r: (r[2], r[3])):
        gap = gap_of(kind)
        if gap <= 0 or (video, kind) not in last or second - last[video, kind] >= gap:
            kept.add((video, kind, second, event))
            last[video, kind] = second
    return kept


def test_three_alerts_in_overlapping_gaps(spark):
    rows = [("v", "GEO_SPREAD", s, s) for s in (0, 200, 400)]
    kept = alerts.alert_cooldown(spark.createDataFrame(rows, COLUMNS), default_seconds=300)
    assert sorted(r.seconds for r in kept.collect()) == [0, 400]


def test_cooldown_ends_exactly_at_the_gap(spark):
    rows = [("v", "A", s, s) for s in (1000, 1299, 1300, 1601)]
    kept = alerts.alert_cooldown(spark.createDataFrame(rows, COLUMNS), default_seconds=300)
    assert sorted(r.seconds for r in kept.collect()) == [1000, 1300, 1601]


@pytest.mark.parametrize("seed,group_rows", [(1, 100_000), (2, 50), (3, 7)])
def test_cooldown_equals_sequential_walk(spark, seed, group_rows):
    rng = random.Random(seed)
    gaps = {"A": 300, "B": 0, "C": 5000}
    rows, event = [], 0
    for _ in range(1500):
        # one hot key, dense stretches and slot borders
        video = rng.choice(["hot", "hot", "hot", "x", "y"])
        day = rng.randrange(4) * 86_400
        base = rng.choice([day, day + 86_000, day + rng.randrange(86_400)])
        event += 1
        rows.append((video, rng.choice("ABC"), base + rng.randrange(900), event))
    kept = alerts.alert_cooldown(
        spark.createDataFrame(rows, COLUMNS), gaps, default_seconds=300, group_rows=group_rows
    )
    got = [tuple(r) for r in kept.select("video_hash", "alert_type", "seconds", "event_id").collect()]
    assert len(got) == len(set(got))
    assert set(got) == walk(rows, gaps.__getitem__)


def test_first_detection_severity_policies(spark):
    df = spark.createDataFrame([(0.85,), (0.7,), (0.5,), (0.96,)], "c double")
    got = df.select(
        *[alerts.first_detection_severity(F.col("c"), p).alias(p) for p in ("ledger", "rules", "web")]
    ).collect()
    assert [tuple(r) for r in got] == [
        ("CRITICAL", "HIGH", "HIGH"),
        ("HIGH", "MEDIUM", "HIGH"),
        ("MEDIUM", "LOW", "HIGH"),
        ("CRITICAL", "CRITICAL", "CRITICAL"),
    ]
    with pytest.raises(ValueError):
        alerts.first_detection_severity(F.col("c"), "other")


def test_effective_rules_prefer_the_item_row(spark):
    items = spark.createDataFrame([("a",), ("b",)], "video_hash string")
    own = spark.createDataFrame(
        [("a", 1, 2, 3, 4, True)], "video_hash string, " + ", ".join(
            f"{k} {'boolean' if k == 'enabled' else 'int'}" for k in GLOBAL_RULES
        )
    )
    got = {r.video_hash: r for r in alerts.effective_rules(items, own).collect()}
    assert (got["a"].detection_threshold, got["a"].reupload_threshold) == (1, 4)
    assert (got["b"].detection_threshold, got["b"].reupload_threshold) == (100, 3)
    assert got["b"].enabled


def test_acknowledge_is_set_once(spark):
    log = spark.sql(
        "SELECT id AS alert_id, id = 'c' AS acknowledged, CAST(if(id = 'c', 9, NULL) AS BIGINT) "
        "AS acknowledged_by, CAST(NULL AS TIMESTAMP_NTZ) AS acknowledged_at "
        "FROM VALUES ('a'), ('b'), ('c') AS t(id)"
    )
    acks = spark.sql(
        "SELECT id AS alert_id, CAST(who AS BIGINT) AS acked_by, CAST(at AS TIMESTAMP_NTZ) AS acked_at "
        "FROM VALUES ('a', 1, '2024-01-02'), ('a', 2, '2024-01-01'), ('c', 3, '2024-01-01'), "
        "('nobody', 4, '2024-01-01') AS t(id, who, at)"
    )
    got = {r.alert_id: r for r in alerts.acknowledge(log, acks).collect()}
    assert len(got) == 3
    assert (got["a"].acknowledged, got["a"].acknowledged_by) == (True, 2)
    assert (got["b"].acknowledged, got["b"].acknowledged_by) == (False, None)
    assert (got["c"].acknowledged, got["c"].acknowledged_by) == (True, 9)


@pytest.mark.parametrize("slots, seed", [(1, 0), (2, 1), (3, 2)])
def test_cooldown_over_many_runs_of_slots(spark, monkeypatch, slots, seed):
    """Histories of weeks, in runs of a few slots: the runs' folded lists must chain exactly."""
    monkeypatch.setattr(alerts, "BLOCK_SLOTS", slots)
    rng = random.Random(seed)
    rows, number = [], 0
    for key, step in (("a", 3000), ("b", 40_000), ("c", 9000)):
        at = rng.randrange(100_000)
        while at < 30 * 86_400:
            rows.append((key, "A", at, number))
            number += 1
            at += rng.choice([1, step // 7, step, step * 2]) if rng.random() < 0.99 else 3 * 86_400
    for cooldown in (7000, 10_800):
        df = spark.createDataFrame(rows, "video_hash string, alert_type string, seconds bigint, event_id bigint")
        got = {r.event_id for r in alerts.alert_cooldown(df, default_seconds=cooldown).collect()}
        want, last = set(), {}
        for key, _, at, n in rows:
            if key not in last or at - last[key] >= cooldown:
                want.add(n)
                last[key] = at
        assert got == want
