"""The derived views again, written in DuckDB SQL on their own, for the value checks."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["sightings"] = """
SELECT e.event_id, e.ts, e.item, sha256(e.item::VARCHAR) AS video_hash, e.ip,
       sha256(e.ip) AS ip_hash, n.n_name AS country,
       n.n_name || '_C' || (e.user_id % 3)::VARCHAR AS city,
       CASE WHEN e.event_id % 17 <> 0 THEN (n.n_nationkey * 7 - 84)::DOUBLE END AS latitude,
       CASE WHEN e.event_id % 17 <> 0 THEN (n.n_nationkey * 14 - 168)::DOUBLE END AS longitude,
       e.event_type AS platform, least(1.0::DOUBLE, e.value / 100) AS confidence,
       e.item % 3 = 0 AS is_deepfake, floor(epoch(e.ts))::BIGINT AS seconds
FROM (SELECT *, json_extract(props, '$.k')::INT AS item,
             CASE WHEN user_id % 10 = 0 THEN '10.0.0.' ELSE '203.0.113.' END
               || user_id::VARCHAR AS ip FROM events) e
JOIN nation n ON n.n_nationkey = e.user_id % 25"""

VIEWS["campaigns"] = """
SELECT * EXCLUDE (item, video_hash), item % 5 AS item,
       sha256((item % 5)::VARCHAR) AS video_hash FROM sightings"""

VIEWS["item_lineage"] = """
SELECT video_hash,
       CASE WHEN item >= 10 THEN sha256((item // 3)::VARCHAR) END AS parent_hash,
       CASE WHEN item < 10 THEN 0 WHEN item < 30 THEN 1 WHEN item < 90 THEN 2
            WHEN item < 270 THEN 3 ELSE 4 END AS generation,
       ts AS first_seen, platform AS source_platform, is_deepfake, confidence,
       country AS origin_country, city AS origin_city, latitude AS origin_latitude,
       longitude AS origin_longitude, item % 10 AS family
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts, event_id) AS rn
      FROM sightings) WHERE rn = 1"""

VIEWS["geo"] = """
SELECT '203.0.113.' || u.user_id::VARCHAR AS ip, n_name AS country,
       'N' || n_nationkey::VARCHAR AS country_code, r_name AS region,
       n_name || '_C' || (u.user_id % 3)::VARCHAR AS city, 'UTC' AS timezone,
       CASE WHEN u.user_id % 2 = 0 THEN 'Even Net' END AS isp,
       (n_nationkey * 7 - 84)::DOUBLE AS latitude, (n_nationkey * 14 - 168)::DOUBLE AS longitude
FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 13 <> 0) u
JOIN nation ON n_nationkey = u.user_id % 25 JOIN region ON r_regionkey = n_regionkey"""

VIEWS["base_bits"] = """
SELECT vec_id, label, string_agg(CASE WHEN x > med THEN '1' ELSE '0' END, '' ORDER BY i) AS bits
FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS i,
             list_sort(embedding)[33] AS med FROM embeddings)
GROUP BY vec_id, label"""

VIEWS["media_frames"] = """
SELECT vec_id, label, variant, f,
       CASE WHEN f = variant
            THEN translate(substr(turned, 1, 3 * variant), '01', '10')
                 || substr(turned, 3 * variant + 1)
            ELSE turned END AS bits
FROM (SELECT vec_id, label, variant, f,
             substr(bits, 7 * f + 1) || substr(bits, 1, 7 * f) AS turned
      FROM base_bits, (SELECT unnest(range(4)) AS variant), (SELECT unnest(range(5)) AS f))"""

VIEWS["media_fingerprints"] = """
SELECT vec_id, label, variant, sha256('v' || vec_id::VARCHAR || '-' || variant::VARCHAR) AS video_hash,
       string_agg(hex, '-' ORDER BY f) AS perceptual_hash,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(((vec_id * 7
         + (CASE WHEN vec_id % 3 = 1 THEN 3 - variant ELSE variant END) * 13) % 1009)::INT) AS first_seen
FROM (SELECT vec_id, label, variant, f,
             string_agg(substr('0123456789ABCDEF', 1 + 8 * substr(bits, 4 * j + 1, 1)::INT
               + 4 * substr(bits, 4 * j + 2, 1)::INT + 2 * substr(bits, 4 * j + 3, 1)::INT
               + substr(bits, 4 * j + 4, 1)::INT, 1), '' ORDER BY j) AS hex
      FROM media_frames, (SELECT unnest(range(16)) AS j) GROUP BY ALL)
GROUP BY vec_id, label, variant"""

VIEWS["detections"] = """
SELECT *, ((vec_id * 37 + variant * 5) % 101) / 100 AS lipsync_score,
       CASE WHEN vec_id % 5 <> 0 THEN ((vec_id * 53 + 11) % 101) / 100 END AS fact_check_score,
       ((vec_id * 29 + variant) % 101) / 100 AS confidence,
       label % 3 = 0 AS is_deepfake, label % 4 = 0 AS celebrity_detected,
       ['HIGH', 'MEDIUM', 'LOW'][label % 3 + 1] AS risk,
       ['flag1', 'flag2', 'flag3'][1:label % 4] AS red_flags,
       CASE vec_id % 7 WHEN 0 THEN 'CONFIRMED_FAKE' WHEN 1 THEN 'CONFIRMED_REAL'
            ELSE 'UNKNOWN' END AS news_verdict,
       (vec_id % 50) / 10 AS processing_time
FROM media_fingerprints"""

VIEWS["registry"] = """
SELECT video_hash, perceptual_hash, vec_id, variant, is_deepfake, confidence, lipsync_score,
       fact_check_score, first_seen, first_seen + to_days((vec_id % 120)::INT) AS last_seen,
       vec_id % 5 + 1 AS detection_count
FROM detections WHERE vec_id % 2 = 0 OR variant = 0"""

VIEWS["media_hash"] = """
SELECT DISTINCT perceptual_hash FROM media_fingerprints"""

VIEWS["hash_frames"] = """
SELECT perceptual_hash, i, string_split(perceptual_hash, '-')[i + 1] AS frame
FROM media_hash, (SELECT unnest(range(5)) AS i)"""

VIEWS["hash_pairs"] = """
SELECT a AS left_hash, b AS right_hash, sum(d)::INT AS distance
FROM (SELECT a, b, i, bit_count(xor(('0x' || string_split(a, '-')[i + 1])::UBIGINT,
                                    ('0x' || string_split(b, '-')[i + 1])::UBIGINT)) AS d
      FROM (SELECT DISTINCT x.perceptual_hash AS a, y.perceptual_hash AS b
            FROM hash_frames x JOIN hash_frames y ON x.i = y.i AND x.frame = y.frame),
           (SELECT unnest(range(5)) AS i))
GROUP BY a, b"""

VIEWS["media_parents"] = """
SELECT m.video_hash, m.perceptual_hash, m.first_seen, p.parent_hash, p.distance
FROM media_fingerprints m
LEFT JOIN (SELECT c.video_hash, q.video_hash AS parent_hash, h.distance,
                  row_number() OVER (PARTITION BY c.video_hash
                    ORDER BY h.distance, q.first_seen, q.video_hash) AS rn
           FROM media_fingerprints c
           JOIN hash_pairs h ON h.left_hash = c.perceptual_hash AND h.distance <= 12
           JOIN media_fingerprints q ON q.perceptual_hash = h.right_hash
            AND (q.first_seen, q.video_hash) < (c.first_seen, c.video_hash)) p
  ON p.video_hash = m.video_hash AND p.rn = 1"""

VIEWS["media_tree"] = """
SELECT video_hash, parent_hash, first_seen, perceptual_hash, distance, root_hash, generation, path
FROM (WITH RECURSIVE t AS (
        SELECT video_hash, parent_hash, first_seen, perceptual_hash, distance,
               video_hash AS root_hash, 0 AS generation, substr(video_hash, 1, 8) AS path
        FROM media_parents WHERE parent_hash IS NULL
        UNION ALL
        SELECT c.video_hash, c.parent_hash, c.first_seen, c.perceptual_hash, c.distance,
               t.root_hash, t.generation + 1, t.path || '/' || substr(c.video_hash, 1, 8)
        FROM media_parents c JOIN t ON c.parent_hash = t.video_hash)
      SELECT * FROM t)"""

VIEWS["media_components"] = """
SELECT perceptual_hash, min(other) AS component
FROM (WITH RECURSIVE r AS (
        SELECT perceptual_hash, perceptual_hash AS other FROM media_hash
        UNION
        SELECT r.perceptual_hash, h.right_hash FROM r
        JOIN hash_pairs h ON h.left_hash = r.other AND h.distance <= 12)
      SELECT * FROM r)
GROUP BY perceptual_hash"""


def _reply_sql() -> str:
    head = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"

    def pick(by, *values):
        items = ", ".join(f"'{v}'" for v in values)
        return f"[{items}][{by} % {len(values)} + 1]"

    level = pick("doc_id", "LOW", "MEDIUM", "HIGH")
    yes = "CASE WHEN toxic = 1 THEN 'YES' ELSE 'NO' END"

    def n(m):
        return f"(doc_id % {m})::VARCHAR"

    layouts = {
        "artifact": [("SCORE: ", n(11)), ("REASONING: ", head), ("CONFIDENCE: ", level)],
        "celebrity": [
            ("CELEBRITY_DETECTED: ", pick("doc_id", "YES", "NO")),
            ("LIKELY_PERSON: ", pick("doc_id", "Unknown", "Ada Example", "Bo Sample")),
            ("NEWS_CONTEXT: ", head),
            ("RISK_LEVEL: ", level),
        ],
        "news": [
            ("NEWS_MATCHES: ", n(7)),
            ("SOURCES: ", pick("doc_id", "none", "alpha, beta", "gamma,, delta ,")),
            ("VERDICT: ", pick("doc_id", "CONFIRMED_REAL", "CONFIRMED_FAKE", "UNKNOWN")),
            ("REASONING: ", head),
            ("CONFIDENCE: ", level),
        ],
        "personality": [
            ("PERSON_IDENTIFIED: ", pick("doc_id", "YES", "NO")),
            ("IDENTITY: ", pick("doc_id", "Unknown Person", "Ada Example", "none", "Bo Sample")),
            ("CONFIDENCE: ", level),
            ("CATEGORY: ", pick("doc_id", "POLITICIAN", "BUSINESS", "SPORTS", "OTHER", "ALIEN")),
            ("REASONING: ", head),
        ],
        "verdict": [
            ("IS_DEEPFAKE: ", pick("doc_id", "YES", "NO", "UNCERTAIN")),
            ("CONFIDENCE: ", n(131)),
            ("AUTHENTICITY_SCORE: ", n(12) + " || '.5'"),
            ("REASONING: ", head),
            ("RED_FLAGS: ", pick("doc_id", "none", "blur, halo", "none detected", "jitter")),
            ("TECHNICAL_ARTIFACTS: ", pick("doc_id", "none found", "seams,noise")),
            ("CONTEXTUAL_ISSUES: ", pick("doc_id", "none", "wrong place, old clip")),
            ("ARTIFACTS_FOUND: ", pick("doc_id", "ringing, banding", "none")),
            ("RECOMMENDATION: ", pick("doc_id", "TRUST", "VERIFY", "REJECT")),
        ],
        "technical": [
            ("IS_DEEPFAKE: ", pick("(doc_id + 1)", "YES", "NO", "UNCERTAIN")),
            ("CONFIDENCE: ", n(97)),
            ("AUTHENTICITY_SCORE: ", n(9) + " || '.5'"),
            ("REASONING: ", head),
            ("ARTIFACTS_FOUND: ", pick("(doc_id + 1)", "seams, ghosting", "none", "halo")),
            ("RECOMMENDATION: ", pick("(doc_id + 1)", "TRUST", "VERIFY", "REJECT")),
        ],
        "verifier": [
            ("VERDICT: ", pick("doc_id", "REAL", "FAKE", "UNCERTAIN")),
            ("CONFIDENCE: ", n(101)),
            ("MANIPULATION_SCORE: ", n(11)),
            ("LIP_SYNC_ISSUES: ", yes),
            ("FACE_BLENDING_ARTIFACTS: ", pick("doc_id", "NO", "YES")),
            ("LIGHTING_INCONSISTENCIES: ", pick("quality", "YES", "NO")),
            ("TEMPORAL_ANOMALIES: ", pick("doc_id", "YES", "NO", "NO")),
            ("TEXTURE_ABNORMALITIES: ", pick("doc_id", "NO", "NO", "NO", "YES")),
            ("REASONING: ", head),
            ("DETAILED_ANALYSIS: ", head),
        ],
    }
    columns = []
    for name, fields in layouts.items():
        parts = []
        for i, (label, value) in enumerate(fields):
            line = f"'{label}' || {value} || chr(10)"
            if i == 1:
                line = f"CASE WHEN doc_id % 11 = 0 THEN '' ELSE {line} END"
            parts.append(f"({line})")
        whole = " || ".join(parts)
        columns.append(
            f"CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 13 = 0 THEN lower({whole}) "
            f"ELSE {whole} END AS {name}_reply"
        )
    return (
        "SELECT doc_id, " + ",\n".join(columns) + "\nFROM (SELECT d.doc_id, d.text, "
        "coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic "
        "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
    )


VIEWS["replies"] = _reply_sql()

VIEWS["frames"] = """
SELECT vec_id // 50 AS video_id, (vec_id % 50)::INT AS frame_idx,
       list_transform(embedding, lambda x: (x::DOUBLE + 1) * 127.5) AS pixels FROM embeddings"""

VIEWS["frame_pixels"] = """
SELECT video_id, frame_idx, unnest(range(64)) AS i, unnest(pixels) AS x FROM frames"""

VIEWS["outbox"] = """
SELECT o_orderkey AS id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'register_video' WHEN '2-HIGH' THEN 'spread_event'
            WHEN '3-MEDIUM' THEN 'lineage' WHEN '4-NOT SPECIFIED' THEN 'record_spread'
            ELSE 'check_thresholds' END AS tx_type,
       CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'retrying' ELSE 'queued' END
            WHEN 'F' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'confirmed' END
            ELSE 'pending' END AS status,
       (o_orderkey % 6)::INT AS retries, 5 AS max_retries,
       o_orderdate AS created_at, o_orderdate AS updated_at, o_custkey AS node
FROM orders"""

VIEWS["nodes"] = """
SELECT s_suppkey AS node, CASE WHEN s_nationkey % 2 = 0 THEN 'pi' ELSE 'laptop' END AS node_type,
       s_acctbal > 0 AS is_active FROM supplier"""

VIEWS["peers"] = """
SELECT s_suppkey AS peer, CASE WHEN s_nationkey % 2 = 0 THEN 'host' ELSE 'client' END AS role,
       greatest(0.0::DOUBLE, s_acctbal / 100) AS latency_ms, s_suppkey % 120 AS age_seconds
FROM supplier"""

VIEWS["uploads"] = """
SELECT doc_id, sha256(text) AS content_hash,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id::INT) AS seen_at, source
FROM documents"""


def register(name: str, sql: str) -> None:
    """Add a shared sub-query under a name other oracle queries can use."""
    VIEWS[name] = sql


def expand(sql: str) -> str:
    """Prefix a query with the CTEs of every derived view it mentions, dependencies first."""
    chain: list[str] = []

    def need(text: str, skip: str = "") -> None:
        for name, body in VIEWS.items():
            if name != skip and name not in chain and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                need(body, name)
                if name not in chain:
                    chain.append(name)

    need(sql)
    if not chain:
        return sql.strip()
    head = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in chain)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[len('WITH '):].strip()}"
    return f"WITH {head}\n{body}"
