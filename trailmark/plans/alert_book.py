"""Rule, alert, outbox and node queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from trailmark.operators import alerts, outbox, registry, spread, stats
from trailmark.plans import derived
from trailmark.plans.book import query, rounded
from trailmark.plans.oracle_views import register
from trailmark.session import cut_lineage, scratch_path
from trailmark.sources import rules as rule_source
from trailmark.sources import tables
from trailmark.sources.alert_log import AlertLog
from trailmark.sources.rules import ALERT_RULES

COOLDOWNS = ALERT_RULES["cooldown"]["per_type"]
SIX_HOURS = 21_600

register("item_rules", """
SELECT DISTINCT video_hash, CASE WHEN item % 10 = 0 THEN 40 ELSE 100 END AS detection_threshold,
       CASE WHEN item % 10 = 0 THEN 20 ELSE 50 END AS spread_threshold,
       CASE WHEN item % 10 = 0 THEN 3 ELSE 5 END AS country_threshold,
       CASE WHEN item % 10 = 0 THEN 2 ELSE 3 END AS reupload_threshold,
       true AS enabled FROM sightings""")


def _rules(spark, d):
    """Effective rules of all sighted items; every tenth item has a rule row of its own."""
    rows = derived.sightings(spark, d)
    own = rows.where("item % 10 = 0").select("video_hash").distinct()
    overrides = own.select(
        "video_hash",
        F.lit(40).alias("detection_threshold"),
        F.lit(20).alias("spread_threshold"),
        F.lit(3).alias("country_threshold"),
        F.lit(2).alias("reupload_threshold"),
        F.lit(True).alias("enabled"),
    )
    return alerts.effective_rules(rows, overrides)


@query("effective_rules", "SELECT * FROM item_rules")
def _(spark, d):
    return _rules(spark, d)


@query("load_rules", """
SELECT video_hash, 'country_threshold' AS rule, count(DISTINCT country) >= 5 AS reached FROM sightings GROUP BY 1
UNION ALL SELECT video_hash, 'detection_threshold', count(*) >= 90 FROM sightings GROUP BY 1
UNION ALL SELECT video_hash, 'spread_threshold', count(*) >= 40 FROM sightings GROUP BY 1""")
def _(spark, d):
    counts = derived.sightings(spark, d).groupBy("video_hash").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("country").alias("c")
    )
    measured = counts.select(
        "video_hash",
        F.inline(
            F.array(
                F.struct(F.lit("country_threshold").alias("rule"), F.col("c").alias("value")),
                F.struct(F.lit("detection_threshold").alias("rule"), F.col("n").alias("value")),
                F.struct(F.lit("spread_threshold").alias("rule"), F.col("n").alias("value")),
            )
        ),
    )
    path = scratch_path(spark, "rules")
    given = {"global_thresholds": {"detection_threshold": 90, "spread_threshold": 40}}
    spark.createDataFrame([(json.dumps(given),)], "value string").coalesce(1).write.text(path)
    # the broadcast side is the short list of thresholds
    return measured.join(F.broadcast(rule_source.load_rules(spark, path)), "rule").select(
        "video_hash", "rule", (F.col("value") >= F.col("threshold")).alias("reached")
    )


@query("threshold_crossings", """
SELECT e.event_id, e.video_hash, e.spread_count, e.unique_countries,
       spread_count % detection_threshold = 0 AS crosses_detection,
       spread_count % spread_threshold = 0 AS crosses_spread
FROM spread_events e JOIN item_rules r ON r.video_hash = e.video_hash
WHERE spread_count % detection_threshold = 0 OR spread_count % spread_threshold = 0""")
def _(spark, d):
    out = spread.threshold_crossings(derived.sightings(spark, d), _rules(spark, d))
    return out.select(
        "event_id", "video_hash", "spread_count", "unique_countries", "crosses_detection",
        "crosses_spread",
    )


def alert_sql(kind: str, severity: str, message: str, source: str, ip: bool, place: bool) -> str:
    return f"""
SELECT substr(sha256(video_hash || '|{kind}|' || event_id::VARCHAR), 1, 16) AS alert_id, video_hash,
       '{kind}' AS alert_type, {severity} AS severity, {message} AS message, ts, seconds, event_id,
       {'ip_hash' if ip else "''"} AS ip_hash, {'country' if place else "''"} AS country FROM {source}"""


register("first_fakes", """
SELECT *, greatest(0, least(10000, trunc(confidence * 100 * 100)::INT)) AS points FROM (
  SELECT *, row_number() OVER (PARTITION BY video_hash ORDER BY ts, event_id) AS rn
  FROM sightings WHERE is_deepfake) WHERE rn = 1""")
register("first_alerts", alert_sql(
    "FIRST_DETECTION",
    "CASE WHEN points >= 8000 THEN 'CRITICAL' WHEN points >= 6000 THEN 'HIGH' ELSE 'MEDIUM' END",
    "'New deepfake detected with ' || (points // 100)::VARCHAR || '% confidence from ' || country",
    "first_fakes", True, True))
register("reupload_hits", """
SELECT e.* FROM reuploads e JOIN item_rules r ON r.video_hash = e.video_hash
WHERE upload_count >= reupload_threshold""")
register("reupload_alerts", alert_sql(
    "REUPLOAD", "'HIGH'",
    "'Flagged video re-uploaded ' || upload_count::VARCHAR || ' times from same IP in ' || country",
    "reupload_hits", True, True))
register("geo_hits", """
SELECT e.* FROM spread_events e JOIN item_rules r ON r.video_hash = e.video_hash
WHERE is_new_country AND spread_count > 1 AND unique_countries >= country_threshold""")
register("geo_alerts", alert_sql(
    "GEO_SPREAD", "CASE WHEN unique_countries >= 10 THEN 'CRITICAL' ELSE 'HIGH' END",
    "'Deepfake spread from ' || previous_country || ' to ' || country || ' (' "
    "|| unique_countries::VARCHAR || ' countries total)'",
    "geo_hits", False, True))
register("count_hits", """
SELECT e.*, spread_count % detection_threshold = 0 AS cd, spread_count % spread_threshold = 0 AS cs
FROM spread_events e JOIN item_rules r ON r.video_hash = e.video_hash""")
register("threshold_alerts", alert_sql(
    "THRESHOLD", "'HIGH'", "'Video detected ' || spread_count::VARCHAR || ' times'",
    "count_hits WHERE cd", False, False))
register("viral_alerts", alert_sql(
    "VIRAL", "'CRITICAL'", "'Video spread to ' || spread_count::VARCHAR || ' locations across ' "
    "|| unique_countries::VARCHAR || ' countries'",
    "count_hits WHERE cs", False, False))
register("candidates", """
SELECT * FROM first_alerts UNION ALL SELECT * FROM reupload_alerts UNION ALL SELECT * FROM geo_alerts
UNION ALL SELECT * FROM threshold_alerts UNION ALL SELECT * FROM viral_alerts""")


def cooldown_sql(candidates: str, seconds: str) -> str:
    """Greedy suppression, one kept alert per step and key."""
    return f"""
SELECT h.* EXCLUDE (cd, rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY video_hash, alert_type, seconds ORDER BY event_id) AS rn
  FROM (SELECT *, {seconds} AS cd FROM {candidates})) h
WHERE cd = 0 OR (rn = 1 AND (video_hash, alert_type, seconds) IN (
  WITH RECURSIVE k AS (
    SELECT video_hash, alert_type, min(seconds) AS s FROM {candidates} GROUP BY 1, 2
    UNION ALL
    SELECT video_hash, alert_type, s FROM (
      SELECT k.video_hash, k.alert_type, min(c.seconds) AS s
      FROM k JOIN (SELECT DISTINCT video_hash, alert_type, seconds, {seconds} AS cd FROM {candidates}) c
        ON c.video_hash = k.video_hash AND c.alert_type = k.alert_type AND c.seconds >= k.s + c.cd
      WHERE c.cd > 0 GROUP BY 1, 2))
  SELECT video_hash, alert_type, s FROM k))"""


PER_TYPE = (
    "CASE alert_type WHEN 'FIRST_DETECTION' THEN 0 WHEN 'REUPLOAD' THEN 180 WHEN 'GEO_SPREAD' THEN 300 "
    "WHEN 'THRESHOLD' THEN 600 WHEN 'VIRAL' THEN 900 END"
)
register("alert_log", cooldown_sql("candidates", PER_TYPE))
COLUMNS = "alert_id, video_hash, alert_type, severity, message, ts, event_id, ip_hash, country"


def _show(df):
    return df.select(*COLUMNS.split(", "))


@query("first_detection_alerts", f"SELECT {COLUMNS} FROM first_alerts")
def _(spark, d):
    return _show(alerts.first_detection_alerts(derived.sightings(spark, d)))


@query("reupload_alerts", f"SELECT {COLUMNS} FROM reupload_alerts")
def _(spark, d):
    return _show(alerts.reupload_alerts(derived.sightings(spark, d), _rules(spark, d)))


@query("geo_spread_alerts", f"SELECT {COLUMNS} FROM geo_alerts")
def _(spark, d):
    return _show(alerts.geo_spread_alerts(derived.sightings(spark, d), _rules(spark, d)))


@query("threshold_alerts", f"SELECT {COLUMNS} FROM threshold_alerts")
def _(spark, d):
    return _show(alerts.threshold_alerts(derived.sightings(spark, d), _rules(spark, d)))


@query("viral_alerts", f"SELECT {COLUMNS} FROM viral_alerts")
def _(spark, d):
    return _show(alerts.viral_alerts(derived.sightings(spark, d), _rules(spark, d)))


@query("alert_cooldown", "SELECT alert_id, video_hash, alert_type, event_id FROM ("
       + cooldown_sql("candidates", str(SIX_HOURS)) + ")")
def _(spark, d):
    rows = alerts.all_candidates(derived.sightings(spark, d), _rules(spark, d))
    return alerts.alert_cooldown(rows, default_seconds=SIX_HOURS).select(
        "alert_id", "video_hash", "alert_type", "event_id"
    )


def _log(spark, d):
    return alerts.create_alerts(derived.sightings(spark, d), _rules(spark, d), COOLDOWNS)


@query("create_alerts", f"SELECT {COLUMNS}, false AS acknowledged FROM alert_log")
def _(spark, d):
    return _log(spark, d).select(*COLUMNS.split(", "), "acknowledged")


# acknowledgements: two for every alert of a fake item's country event, and one of an unknown id
register("acks", """
SELECT alert_id, seconds % 97 AS acked_by, ts + INTERVAL 1 HOUR AS acked_at FROM geo_alerts
UNION ALL SELECT alert_id, seconds % 89, ts + INTERVAL 2 HOUR FROM geo_alerts
UNION ALL SELECT 'unknown-' || event_id::VARCHAR, 1, ts FROM first_alerts""")


def _acks(spark, d):
    rows = derived.sightings(spark, d)
    geo = alerts.geo_spread_alerts(rows, _rules(spark, d))
    one = geo.select(
        "alert_id", (F.col("seconds") % 97).alias("acked_by"),
        F.expr("timestampadd(HOUR, 1, ts)").alias("acked_at"),
    )
    two = geo.select(
        "alert_id", (F.col("seconds") % 89).alias("acked_by"),
        F.expr("timestampadd(HOUR, 2, ts)").alias("acked_at"),
    )
    lost = alerts.first_detection_alerts(rows).select(
        F.concat(F.lit("unknown-"), F.col("event_id").cast("string")).alias("alert_id"),
        F.lit(1).cast("bigint").alias("acked_by"), F.col("ts").alias("acked_at"),
    )
    return one.unionByName(two).unionByName(lost)


register("acked", """
SELECT l.*, a.alert_id IS NOT NULL AS acknowledged, a.acked_by AS acknowledged_by, a.acked_at AS acknowledged_at
FROM alert_log l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY acked_at, acked_by) AS rn
  FROM acks) a ON a.alert_id = l.alert_id AND a.rn = 1""")


def _acked(spark, d):
    return alerts.acknowledge(_log(spark, d), _acks(spark, d))


@query("acknowledge", "SELECT alert_id, acknowledged, acknowledged_by, acknowledged_at FROM acked")
def _(spark, d):
    return _acked(spark, d).select(
        "alert_id", "acknowledged", "acknowledged_by", "acknowledged_at"
    )


@query("acknowledge_extended", "SELECT alert_id, acknowledged, acknowledged_by, acknowledged_at FROM acked")
def _(spark, d):
    """The same from a stored log that three spans of time and two sets of acknowledgements came into."""
    rows = cut_lineage(alerts.all_candidates(derived.sightings(spark, d), _rules(spark, d)))
    acks = cut_lineage(_acks(spark, d))
    log = AlertLog(scratch_path(spark, "alert-log"), COOLDOWNS)
    first, last = rows.agg(*[F.coalesce(f("seconds"), F.lit(0)) for f in (F.min, F.max)]).first()
    span = F.floor((F.col("seconds") - first) * 3 / (last - first + 1))
    for k in range(3):
        log.append(rows.where(span == k), k)
    by = F.pmod(F.xxhash64("alert_id", "acked_by"), F.lit(2))
    for k in range(2):
        log.acknowledge(acks.where(by == k), k)
    return log.read(spark).select("alert_id", "acknowledged", "acknowledged_by", "acknowledged_at")


@query("alert_counts", """
SELECT video_hash, count(*) AS total_alerts, count(*) FILTER (WHERE NOT acknowledged) AS unacknowledged_alerts
FROM acked GROUP BY 1""")
def _(spark, d):
    return alerts.alert_counts(_acked(spark, d))


AT = 1_706_659_200  # 2024-01-31 00:00:00 UTC


@query("auto_acknowledge", f"""
SELECT alert_id, NOT acknowledged AND {AT} - seconds > 172800 AND alert_type = 'THRESHOLD' AS auto_acknowledged
FROM acked""")
def _(spark, d):
    out = alerts.auto_acknowledge(_acked(spark, d), F.lit(AT))
    return out.select("alert_id", "auto_acknowledged")


@query("escalate", f"""
SELECT alert_id, CASE WHEN NOT acknowledged AND {AT} - seconds > 3600 THEN 'email' END AS escalate_to FROM acked""")
def _(spark, d):
    return alerts.escalate(_acked(spark, d), F.lit(AT)).select("alert_id", "escalate_to")


@query("rule_severity", """
SELECT event_id, CASE WHEN confidence * 100 >= 95 THEN 'CRITICAL' WHEN confidence * 100 >= 80 THEN 'HIGH'
         WHEN confidence * 100 >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS first_detection,
       CASE WHEN spread_count >= 10 THEN 'CRITICAL' WHEN spread_count >= 5 THEN 'HIGH'
         WHEN spread_count >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS reupload,
       CASE WHEN unique_countries >= 10 THEN 'CRITICAL' WHEN unique_countries >= 5 THEN 'HIGH'
         WHEN unique_countries >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS geo_spread FROM spread_events""")
def _(spark, d):
    rows = spread.first_country_events(derived.sightings(spark, d))
    return rows.select(
        "event_id",
        alerts.first_detection_severity(F.col("confidence"), "rules").alias("first_detection"),
        alerts.rule_severity("reupload", F.col("spread_count")).alias("reupload"),
        alerts.rule_severity("geo_spread", F.col("unique_countries")).alias("geo_spread"),
    )


@query("listener_messages", """
WITH t AS (SELECT *, 'Hash: ' || substr(video_hash, 1, 16) || '…' || chr(10) AS tag,
                  (floor((greatest(0, least(10000, trunc(confidence * 100 * 100)::INT)) + 5) / 10))::INT AS p,
                  'IP: ' || substr(ip_hash, 1, 16) || '…' AS src FROM spread_events)
SELECT event_id, 'DEEPFAKE_DETECTED' AS kind, 'HIGH' AS severity, '🚨 NEW DEEPFAKE DETECTED' || chr(10) || tag
  || 'Confidence: ' || (p // 10)::VARCHAR || '.' || (p % 10)::VARCHAR || '%' || chr(10) || 'Location: ' || city || ', ' || country AS message
FROM t WHERE spread_count = 1 AND is_deepfake
UNION ALL SELECT event_id, 'VIDEO_REDETECTED', 'MEDIUM', '🔁 VIDEO RE-DETECTED (#' || spread_count::VARCHAR || ')'
  || chr(10) || tag || 'New ' || src FROM t WHERE spread_count >= 3
UNION ALL SELECT event_id, 'SAME_IP_REUPLOAD', 'HIGH', '⚠️ SAME IP RE-UPLOAD' || chr(10) || 'Hash: '
  || substr(video_hash, 1, 16) || '…' || chr(10) || 'IP: ' || substr(ip_hash, 1, 16) || '…' || chr(10) || 'Upload #'
  || upload_count::VARCHAR || ' | Time since first: ' || seconds_since_first::VARCHAR || 's' FROM reuploads
UNION ALL SELECT event_id, 'GEO_SPREAD', CASE WHEN unique_countries >= 5 THEN 'CRITICAL' ELSE 'HIGH' END,
  '🌍 GEO SPREAD DETECTED' || chr(10) || tag || 'From: ' || previous_country || ' → ' || country || chr(10)
  || 'Unique countries: ' || unique_countries::VARCHAR FROM t WHERE is_new_country AND spread_count > 1
UNION ALL SELECT event_id, 'VIRAL_SPREAD', 'CRITICAL', '🔥 VIRAL SPREAD WARNING' || chr(10) || tag
  || 'Spread events: ' || spread_count::VARCHAR || chr(10) || 'Countries: ' || unique_countries::VARCHAR
FROM t WHERE spread_count IN (10, 50, 100) OR spread_count % 500 = 0""")
def _(spark, d):
    return alerts.listener_messages(derived.sightings(spark, d))


@query("notify_filter", """
SELECT alert_id, severity FROM first_alerts WHERE severity IN ('HIGH', 'CRITICAL')""")
def _(spark, d):
    rows = alerts.first_detection_alerts(derived.sightings(spark, d))
    return alerts.notify_filter(rows, "HIGH").select("alert_id", "severity")


ROUTES = """(SELECT * FROM (VALUES ('CRITICAL', 'telegram'), ('CRITICAL', 'discord'), ('CRITICAL', 'email'),
  ('HIGH', 'telegram'), ('HIGH', 'discord'), ('MEDIUM', 'telegram'), ('LOW', 'console')) v(sev, channel))"""


@query("route_channels", f"""
SELECT alert_id, severity, channel FROM first_alerts JOIN {ROUTES} ON sev = severity""")
def _(spark, d):
    rows = alerts.first_detection_alerts(derived.sightings(spark, d))
    return alerts.route_channels(rows).select("alert_id", "severity", "channel")


@query("deliver_plan", f"""
WITH g AS (SELECT alert_id, severity FROM first_alerts UNION ALL SELECT alert_id, severity FROM geo_alerts)
SELECT alert_id, severity, channel, alert_id || '/' || channel AS delivery_id
FROM g JOIN {ROUTES} ON sev = severity WHERE channel <> 'console'
UNION ALL SELECT alert_id, severity, 'console', alert_id || '/console' FROM g""")
def _(spark, d):
    rows = derived.sightings(spark, d)
    both = alerts.first_detection_alerts(rows).unionByName(
        alerts.geo_spread_alerts(rows, _rules(spark, d))
    )
    return alerts.deliver_plan(both).select("alert_id", "severity", "channel", "delivery_id")


@query("watchlist_boost", """
SELECT alert_id, severity, country, CASE
  WHEN n_regionkey = 1 OR severity = 'CRITICAL' THEN 'CRITICAL'
  WHEN n_regionkey = 0 OR severity = 'HIGH' THEN 'HIGH' ELSE severity END AS boosted_severity
FROM first_alerts JOIN nation ON n_name = country""")
def _(spark, d):
    # two monitored groups: the nations of two regions
    groups = derived.table(spark, d, "nation").where("n_regionkey <= 1").select(
        F.col("n_name").alias("country"),
        F.when(F.col("n_regionkey") == 0, "HIGH").otherwise("CRITICAL").alias("severity_boost"),
    )
    rows = alerts.first_detection_alerts(derived.sightings(spark, d))
    return alerts.watchlist_boost(rows, groups).select(
        "alert_id", "severity", "country", "boosted_severity"
    )


# ---- outbox ---------------------------------------------------------------------------------------


@query("route_outbox", """
SELECT id, tx_type, CASE tx_type WHEN 'register_video' THEN 'batchable' WHEN 'record_spread' THEN 'unknown'
  ELSE 'individual' END AS route FROM outbox""")
def _(spark, d):
    return outbox.route_outbox(derived.outbox(spark, d)).select("id", "tx_type", "route")


@query("pending_outbox", """
SELECT id, status, created_at FROM outbox WHERE status IN ('queued', 'retrying')
ORDER BY created_at, id LIMIT 100""")
def _(spark, d):
    return outbox.pending_outbox(derived.outbox(spark, d)).select("id", "status", "created_at")


@query("outbox_stats", "SELECT status, count(*) AS count FROM outbox GROUP BY status")
def _(spark, d):
    return outbox.outbox_stats(derived.outbox(spark, d))


@query("outbox_transition", """
SELECT id, CASE WHEN ok THEN 'confirmed' WHEN NOT ok AND retries + 1 >= 5 THEN 'failed'
            WHEN NOT ok THEN 'retrying' ELSE status END AS status,
       retries + CASE WHEN NOT ok THEN 1 ELSE 0 END AS retries, error
FROM (SELECT *, CASE WHEN status IN ('queued', 'retrying') THEN id % 2 = 0 END AS ok,
             CASE WHEN status IN ('queued', 'retrying') AND id % 2 = 1 THEN 'timeout' END AS error FROM outbox)""")
def _(spark, d):
    rows = derived.outbox(spark, d)
    sent = rows.where("status in ('queued', 'retrying')").select(
        "id",
        (F.col("id") % 2 == 0).alias("ok"),
        F.when(F.col("id") % 2 == 1, "timeout").alias("error"),
    )
    return outbox.outbox_transition(rows, sent).select("id", "status", "retries", "error")


@query("purge_completed", """
SELECT id, status FROM outbox WHERE NOT (status IN ('confirmed', 'failed')
  AND updated_at < TIMESTAMP '1998-01-01' - INTERVAL 24 HOUR)""")
def _(spark, d):
    now = F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'")
    return outbox.purge_completed(derived.outbox(spark, d), now).select("id", "status")


@query("retry_failed", """
SELECT id, CASE status WHEN 'failed' THEN 'queued' ELSE status END AS status,
       CASE status WHEN 'failed' THEN 0 ELSE retries END AS retries FROM outbox""")
def _(spark, d):
    return outbox.retry_failed(derived.outbox(spark, d)).select("id", "status", "retries")


@query("batch_chunks", """
SELECT id, node, ((row_number() OVER (PARTITION BY node ORDER BY created_at, id) - 1) // 3) AS chunk
FROM outbox WHERE status IN ('queued', 'retrying') AND tx_type = 'register_video'""")
def _(spark, d):
    return registry.batch_chunks(derived.outbox(spark, d), 3).select("id", "node", "chunk")


@query("read_offline_queue", """
SELECT tx_type, id::VARCHAR AS payload_id, epoch(created_at)::DOUBLE AS timestamp FROM outbox""")
def _(spark, d):
    path = scratch_path(spark, "offline")
    tables.write_offline_queue(_entries(spark, d), path)
    rows = tables.read_offline_queue(spark, path).orderBy("file_name", "timestamp")
    return rows.select("tx_type", F.col("payload")["id"].alias("payload_id"), "timestamp")


def _entries(spark, d):
    return derived.outbox(spark, d).select(
        "tx_type",
        F.create_map(F.lit("id"), F.col("id").cast("string")).alias("payload"),
        derived.seconds_of("created_at").cast("double").alias("timestamp"),
    )


@query("content_inventory", """
SELECT page_id, length, accepted, CASE WHEN accepted THEN sha256(html) END AS sha256
FROM (SELECT *, page_id % 3 <> 0 AND length <= 20000 AS accepted
      FROM (SELECT page_id, html, strlen(html) AS length FROM pages WHERE html IS NOT NULL))""")
def _(spark, d):
    ending = F.when(F.col("page_id") % 3 == 0, ".html").otherwise(".PNG")
    files = derived.table(spark, d, "pages").where("html is not null").select(
        "page_id",
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), ending).alias("path"),
        F.octet_length("html").cast("bigint").alias("length"),
        F.encode("html", "UTF-8").alias("content"),
    )
    found = tables.content_inventory(files, max_bytes=20_000)
    return found.select("page_id", "length", "accepted", "sha256")


# ---- nodes ----------------------------------------------------------------------------------------


@query("authorized_only", """
SELECT l_orderkey, l_linenumber, l_suppkey AS node FROM lineitem
WHERE l_suppkey = 1 OR l_suppkey IN (SELECT node FROM nodes WHERE is_active)""")
def _(spark, d):
    events = derived.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("node")
    )
    return stats.authorized_only(events, derived.nodes(spark, d), owner=1)


@query("active_nodes", """
SELECT node_type, count(*) FILTER (WHERE is_active) AS active_nodes FROM nodes GROUP BY 1""")
def _(spark, d):
    return stats.active_nodes(derived.nodes(spark, d))


@query("node_stats", """
SELECT l_suppkey AS node, count(*) AS videos_analyzed, count(*) FILTER (WHERE l_returnflag = 'R') AS deepfakes_found
FROM lineitem GROUP BY 1""")
def _(spark, d):
    rows = derived.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("node"), (F.col("l_returnflag") == "R").alias("is_deepfake")
    )
    return stats.node_stats(rows)


@query("peer_snapshot", """
SELECT count(*) AS total_peers, count(*) FILTER (WHERE role = 'host') AS hosts,
       count(*) FILTER (WHERE role = 'client') AS clients,
       round(coalesce(avg(latency_ms) FILTER (WHERE latency_ms > 0), 0), 6) AS avg_latency_ms,
       coalesce(max(latency_ms) FILTER (WHERE latency_ms > 0), 0) AS max_latency_ms,
       count(*) FILTER (WHERE age_seconds > 60) AS stale_peers FROM peers""")
def _(spark, d):
    return rounded(stats.peer_snapshot(derived.peers(spark, d)), "avg_latency_ms")
