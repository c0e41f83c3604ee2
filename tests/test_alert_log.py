"""The stored alert log: appends against one sequential walk, retries, order, acknowledgements and what is read."""

import random
import re
from datetime import datetime, timedelta

import pytest

from trailmark.operators.alerts import CANDIDATE_COLUMNS
from trailmark.session import scratch_path
from trailmark.sources.alert_log import AlertLog

GAPS = {"A": 300, "B": 0, "C": 5000}
SHAPE = (
    "alert_id string, video_hash string, alert_type string, severity string, message string, ts timestamp_ntz, "
    "seconds bigint, event_id bigint, ip_hash string, country string"
)


def candidates(spark, rows):
    at = datetime(2024, 1, 1)
    full = [(f"id{e}", v, k, "LOW", "m", at + timedelta(seconds=s), s, e, "", "") for v, k, s, e in rows]
    return spark.createDataFrame(full, SHAPE)


def walk(rows):
    kept, last = set(), {}
    for video, kind, second, event in sorted(rows, key=lambda r: (r[2], r[3])):
        if GAPS[kind] <= 0 or (video, kind) not in last or second - last[video, kind] >= GAPS[kind]:
            kept.add((video, kind, second, event))
            last[video, kind] = second
    return kept


def alerts_of(log, spark):
    got = [tuple(r) for r in log.read(spark).select("video_hash", "alert_type", "seconds", "event_id").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture
def log(spark):
    return AlertLog(scratch_path(spark, "alert-log"), GAPS)


def test_appends_equal_one_walk_and_retries_change_nothing(spark, log):
    rng = random.Random(8)
    # dense, so that cooldowns reach over the ends of spans; the last span is within one cooldown of two others
    rows = [(rng.choice(["hot", "hot", "x", "y"]), rng.choice("ABC"), rng.randrange(20_000), e) for e in range(900)]
    ends = [0, 7_000, 15_000, 16_000, 20_000]
    for version, (a, b) in enumerate(zip(ends, ends[1:])):
        part = candidates(spark, [r for r in rows if a <= r[2] < b])
        log.append(part, version)
        if version == 2:
            log.append(part, version)
    assert alerts_of(log, spark) == walk(rows)
    assert sum(v.n for v in log.versions(spark)) == len(walk(rows))


def test_an_append_reads_only_versions_within_the_longest_cooldown(spark, log):
    for version, second in enumerate([0, 50_000, 100_000]):
        log.append(candidates(spark, [("v", "C", second, version), ("v", "B", second + 10, 10 + version)]), version)
    past = log.carried(spark, 100_500, 3)
    plan = past._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*version#\d+L? = 2\)", plan), plan
    assert sorted(tuple(r) for r in past.collect()) == [("v", "B", 100_010), ("v", "C", 100_000)]


def test_candidates_behind_the_log_and_empty_appends(spark, log):
    none = candidates(spark, [])
    assert log.read(spark).count() == 0
    log.append(none, 0)
    log.append(candidates(spark, [("v", "A", 100, 1)]), 1)
    with pytest.raises(ValueError, match="behind the log"):
        log.append(candidates(spark, [("w", "A", 100, 3)]), 2)
    log.append(none, 2)
    log.append(candidates(spark, [("v", "A", 399, 4), ("v", "A", 400, 5), ("v", "A", 400, 6)]), 3)
    assert alerts_of(log, spark) == {("v", "A", 100, 1), ("v", "A", 400, 5)}
    assert [(v.first, v.last, v.n) for v in log.versions(spark)] == [(None, None, 0), (100, 100, 1), (None, None, 0), (399, 400, 1)]


def test_the_earliest_acknowledgement_holds(spark, log):
    shape, at = "alert_id string, acked_at timestamp_ntz, acked_by bigint", datetime(2024, 1, 2)
    log.acknowledge(spark.createDataFrame([("id1", at, 7), ("id9", at, 1), (None, at, 1)], shape), 0)
    log.append(candidates(spark, [("v", "A", 100, 1), ("w", "A", 100, 2)]), 0)
    earlier = spark.createDataFrame([("id1", at - timedelta(hours=1), 9), ("id1", at - timedelta(hours=1), 8)], shape)
    for _ in range(2):
        log.acknowledge(earlier, 1)
    rows = log.read(spark)
    assert set(rows.columns) == {*CANDIDATE_COLUMNS, "acknowledged", "acknowledged_by", "acknowledged_at"}
    got = {(r.alert_id, r.acknowledged, r.acknowledged_by, r.acknowledged_at) for r in rows.collect()}
    assert got == {("id1", True, 8, at - timedelta(hours=1)), ("id2", False, None, None)}
