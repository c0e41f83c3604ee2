"""Spread tracking queries over sightings."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions.decide import is_private_ip
from trailmark.operators import places, registry, spread, stats
from trailmark.plans import derived
from trailmark.plans.book import ORACLE, query, rounded
from trailmark.plans.oracle_views import register
from trailmark.session import scratch_path
from trailmark.sources.daily_sketches import DailySketches

register("numbered", """
SELECT *, row_number() OVER (PARTITION BY video_hash ORDER BY ts, event_id) AS spread_count,
       lag(country) OVER (PARTITION BY video_hash ORDER BY ts, event_id) AS previous_country,
       row_number() OVER (PARTITION BY video_hash, country ORDER BY ts, event_id) = 1 AS is_new_country
FROM sightings""")

register("spread_events", """
SELECT *, (sum(is_new_country::INT) OVER (PARTITION BY video_hash ORDER BY ts, event_id
            ROWS UNBOUNDED PRECEDING))::BIGINT AS unique_countries FROM numbered""")

register("reuploads", """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY video_hash, ip_hash ORDER BY ts, event_id) AS upload_count,
         seconds - min(seconds) OVER (PARTITION BY video_hash, ip_hash) AS seconds_since_first
  FROM sightings) WHERE upload_count >= 2""")


@query("detection_sequence", """
SELECT event_id, video_hash, spread_count AS detection_no,
       CASE WHEN spread_count = 1 THEN 'registered' ELSE 'redetected' END AS event_kind FROM numbered""")
def _(spark, d):
    return spread.detection_sequence(derived.sightings(spark, d)).select(
        "event_id", "video_hash", "detection_no", "event_kind"
    )


@query("same_ip_reuploads", """
SELECT event_id, video_hash, ip_hash, upload_count, seconds_since_first FROM reuploads""")
def _(spark, d):
    return spread.same_ip_reuploads(derived.sightings(spark, d)).select(
        "event_id", "video_hash", "ip_hash", "upload_count", "seconds_since_first"
    )


@query("new_country_spread", """
SELECT event_id, ts, video_hash, previous_country, country, unique_countries
FROM spread_events WHERE is_new_country AND spread_count > 1""")
def _(spark, d):
    return spread.new_country_spread(derived.sightings(spark, d)).select(
        "event_id", "ts", "video_hash", "previous_country", "country", "unique_countries"
    )


@query("viral_milestones", """
SELECT event_id, video_hash, spread_count, unique_countries FROM spread_events
WHERE spread_count IN (10, 50, 100) OR spread_count % 500 = 0""")
def _(spark, d):
    return spread.viral_milestones(derived.sightings(spark, d)).select(
        "event_id", "video_hash", "spread_count", "unique_countries"
    )


@query("rapid_spread", """
SELECT DISTINCT item, seconds, n AS events_in_window
FROM (SELECT item, seconds, count(*) OVER (PARTITION BY item ORDER BY seconds
        RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM campaigns) WHERE n > 5""")
def _(spark, d):
    rows = derived.campaigns(spark, d)
    hashes = F.col("video_hash")
    out = spread.rapid_spread(rows.select("seconds", hashes), threshold=5)
    names = rows.select("video_hash", "item").distinct()
    return out.join(names, "video_hash").select("item", "seconds", "events_in_window")


@query("rapid_reupload", """
SELECT DISTINCT video_hash, ip_hash, seconds, n AS events_in_window
FROM (SELECT video_hash, ip_hash, seconds, count(*) OVER (PARTITION BY video_hash, ip_hash
        ORDER BY seconds RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW) AS n FROM campaigns)
WHERE n >= 2""")
def _(spark, d):
    out = spread.rapid_reupload(derived.campaigns(spark, d), threshold=2)
    return out.select("video_hash", "ip_hash", "seconds", "events_in_window")


@query("city_escalation", """
SELECT event_id, item, country, city, unique_cities FROM (
  SELECT *, (sum(is_new::INT) OVER (PARTITION BY item, country ORDER BY ts, event_id
             ROWS UNBOUNDED PRECEDING))::BIGINT AS unique_cities
  FROM (SELECT *, row_number() OVER (PARTITION BY item, country, city ORDER BY ts, event_id) = 1
               AS is_new FROM campaigns))
WHERE is_new AND unique_cities >= 3""")
def _(spark, d):
    out = spread.city_escalation(derived.campaigns(spark, d), threshold=3)
    return out.select("event_id", "item", "country", "city", "unique_cities")


@query("ip_upload_counts", """
SELECT video_hash, ip_hash, count(*) AS upload_count, min(ts) AS first_upload
FROM sightings GROUP BY video_hash, ip_hash""")
def _(spark, d):
    return spread.ip_upload_counts(derived.sightings(spark, d))


@query("country_counts", """
SELECT video_hash, country, count(*) AS spread_count FROM sightings GROUP BY video_hash, country""")
def _(spark, d):
    return spread.country_counts(derived.sightings(spark, d))


@query("unique_countries", """
SELECT video_hash, count(DISTINCT country) AS unique_countries FROM sightings GROUP BY video_hash""")
def _(spark, d):
    return spread.unique_countries(derived.sightings(spark, d))


def _sketched(spark, d):
    """Sightings' countries as daily sketches that two appends brought."""
    store = DailySketches(scratch_path(spark, "sketches"), "video_hash string", ("country",))
    rows = derived.sightings(spark, d).select("ts", "video_hash", "country")
    early = F.pmod(F.xxhash64("ts", "video_hash"), F.lit(3)) > 0
    store.append(rows.where(early), 0)
    store.append(rows.where(~early), 1)
    return store


@query("unique_countries_sketched", ORACLE["unique_countries"])
def _(spark, d):
    """Countries are few, so the sketches give the exact counts."""
    out = _sketched(spark, d).between(spark)
    return out.select("video_hash", F.col("unique_country").alias("unique_countries"))


@query("trailing_countries", """
SELECT a.video_hash, strftime(a.day, '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT b.country) AS unique_countries
FROM (SELECT DISTINCT video_hash, ts::DATE AS day FROM sightings) a
JOIN sightings b ON b.video_hash = a.video_hash AND b.ts::DATE BETWEEN a.day - 6 AND a.day GROUP BY 1, 2""")
def _(spark, d):
    out = _sketched(spark, d).trailing(spark, 7)
    return out.select("video_hash", F.col("day").cast("string").alias("day"), "events", F.col("unique_country").alias("unique_countries"))


@query("location_summary", """
SELECT country, city, count(*) AS spread_count, min(ts) AS first_seen, max(ts) AS last_seen
FROM sightings GROUP BY ROLLUP (country, city)""")
def _(spark, d):
    return spread.location_summary(derived.sightings(spark, d), with_totals=True)


@query("sightings_with_lineage", """
SELECT s.event_id, s.video_hash, l.generation, l.is_deepfake
FROM sightings s JOIN item_lineage l ON l.video_hash = s.video_hash""")
def _(spark, d):
    out = spread.sightings_with_lineage(derived.sightings(spark, d), derived.item_lineage(spark, d))
    return out.select("event_id", "video_hash", "generation", "is_deepfake")


@query("family_semi", """
SELECT event_id, video_hash FROM sightings
WHERE video_hash IN (SELECT video_hash FROM item_lineage WHERE generation > 0)""")
def _(spark, d):
    family = derived.item_lineage(spark, d).where("generation > 0")
    return spread.family_semi(derived.sightings(spark, d), family).select("event_id", "video_hash")


@query("spread_timeline", """
SELECT s.event_id, s.ts, s.video_hash, s.platform, l.generation, l.is_deepfake, s.country, s.city
FROM sightings s JOIN item_lineage l ON l.video_hash = s.video_hash WHERE l.is_deepfake""")
def _(spark, d):
    lineage = derived.item_lineage(spark, d)
    out = spread.spread_timeline(
        derived.sightings(spark, d), lineage, lineage.where("is_deepfake")
    )
    return out.select(
        "event_id", "ts", "video_hash", "platform", "generation", "is_deepfake", "country", "city"
    )


register("locations", """
SELECT 'origin' AS kind, substr(video_hash, 1, 12) || '...' AS short_hash, video_hash,
       first_seen AS ts, coalesce(source_platform, 'Direct Upload') AS platform,
       origin_country AS country, origin_city AS city, origin_latitude AS latitude,
       origin_longitude AS longitude, is_deepfake, generation,
       CASE WHEN is_deepfake THEN 'red' ELSE 'green' END AS marker_color
FROM item_lineage WHERE origin_latitude IS NOT NULL AND origin_longitude IS NOT NULL
UNION ALL
SELECT 'spread', substr(s.video_hash, 1, 12) || '...', s.video_hash, s.ts, s.platform, s.country,
       s.city, s.latitude, s.longitude, l.is_deepfake, l.generation,
       CASE WHEN l.is_deepfake THEN 'orange' ELSE 'blue' END
FROM sightings s JOIN item_lineage l ON l.video_hash = s.video_hash
WHERE s.latitude IS NOT NULL AND s.longitude IS NOT NULL""")


def _locations(spark, d):
    return spread.spread_locations(derived.sightings(spark, d), derived.item_lineage(spark, d))


@query("spread_locations", "SELECT * FROM locations")
def _(spark, d):
    return _locations(spark, d).orderBy("ts", "video_hash")


@query("spread_summary", """
SELECT count(*) AS total_locations, count(DISTINCT country) AS unique_countries,
       string_agg(DISTINCT country, ',' ORDER BY country) AS countries,
       count(*) FILTER (WHERE kind = 'origin') AS origin_count,
       count(*) FILTER (WHERE kind = 'spread') AS spread_count FROM locations""")
def _(spark, d):
    return spread.spread_summary(_locations(spark, d))


@query("generation_links", """
WITH loc AS (SELECT o.*, i.family FROM locations o
             JOIN item_lineage i ON i.video_hash = o.video_hash WHERE o.kind = 'origin'),
places AS (SELECT family, generation, latitude, longitude, bool_or(is_deepfake) AS fake,
                  count(*) AS events FROM loc
           WHERE latitude <> 0 AND longitude <> 0 GROUP BY ALL),
gens AS (SELECT family, generation, lead(generation) OVER (PARTITION BY family ORDER BY generation)
                AS next_generation FROM (SELECT DISTINCT family, generation FROM loc))
SELECT a.family, a.generation, g.next_generation, a.latitude AS from_latitude,
       a.longitude AS from_longitude, a.events AS from_events, b.latitude AS to_latitude,
       b.longitude AS to_longitude, b.events AS to_events,
       CASE WHEN b.fake THEN '#ff4757' ELSE '#2ed573' END AS color
FROM places a JOIN gens g ON g.family = a.family AND g.generation = a.generation
JOIN places b ON b.family = a.family AND b.generation = g.next_generation""")
def _(spark, d):
    families = derived.item_lineage(spark, d).select("video_hash", "family")
    origins = _locations(spark, d).where("kind = 'origin'").join(families, "video_hash")
    return spread.generation_links(origins).select(
        "family", "generation", "next_generation", "from_latitude", "from_longitude",
        "from_events", "to_latitude", "to_longitude", "to_events", "color",
    )


@query("geo_enrich", """
SELECT s.event_id, s.ip_hash,
       CASE WHEN k THEN coalesce(g.country, 'Unknown') ELSE 'India' END AS geo_country,
       CASE WHEN k THEN coalesce(g.country_code, 'XX') ELSE 'IN' END AS geo_country_code,
       CASE WHEN k THEN coalesce(g.region, '') ELSE 'Tamil Nadu' END AS geo_region,
       CASE WHEN k THEN coalesce(g.city, '') ELSE 'Vellore' END AS geo_city,
       CASE WHEN k THEN coalesce(g.timezone, '') ELSE 'Asia/Kolkata' END AS geo_timezone,
       CASE WHEN k THEN coalesce(g.isp, '') ELSE 'Local Network' END AS geo_isp,
       CASE WHEN k THEN coalesce(g.latitude, 0) ELSE 12.9692 END AS geo_latitude,
       CASE WHEN k THEN coalesce(g.longitude, 0) ELSE 79.1559 END AS geo_longitude
FROM (SELECT s.*, g.ip IS NOT NULL AND NOT starts_with(s.ip, '10.') AS k, g
      FROM sightings s LEFT JOIN geo g ON g.ip = s.ip) s""")
def _(spark, d):
    rows = derived.sightings(spark, d).select("event_id", "ip", "ip_hash")
    # fixed values: the place of addresses that are private or not listed
    fallback = {
        "country": "India", "country_code": "IN", "region": "Tamil Nadu", "city": "Vellore",
        "timezone": "Asia/Kolkata", "isp": "Local Network", "latitude": 12.9692, "longitude": 79.1559,
    }
    return stats.geo_enrich(rows, derived.geo(spark, d), is_private_ip(F.col("ip")), fallback)


@query("geo_cluster", """
WITH p AS (SELECT event_id, latitude AS la, longitude AS lo, 50.0::DOUBLE / 111.195::DOUBLE AS st
           FROM sightings WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
q AS (SELECT *, floor(la / st)::BIGINT AS r, (floor(la / st) + 0.5::DOUBLE) * st AS cla FROM p),
t AS (SELECT *, st / greatest(cos(radians(cla)), 0.01::DOUBLE) AS ls FROM q),
u AS (SELECT *, floor(lo / ls)::BIGINT AS c, (floor(lo / ls) + 0.5::DOUBLE) * ls AS clo FROM t)
SELECT event_id, r::VARCHAR || ':' || c::VARCHAR AS cell,
       round(asin(sqrt(pow(sin(radians(la - cla) / 2), 2) + cos(radians(la)) * cos(radians(cla))
         * pow(sin(radians(lo - clo) / 2), 2))) * 2 * 6371.0088::DOUBLE, 6) AS km_to_centre
FROM u""")
def _(spark, d):
    out = spread.geo_cluster(derived.sightings(spark, d))
    return rounded(out.select("event_id", "cell", "km_to_centre"), "km_to_centre")


@query("radius_clusters", """
WITH RECURSIVE k AS (SELECT 1000.0::DOUBLE / 6371.0088::DOUBLE AS angle),
p AS (SELECT event_id, floor(latitude / degrees(angle))::BIGINT AS r, longitude + 180 AS lo
      FROM sightings, k WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
w AS (SELECT r, least(greatest(abs(r), abs(r + 1)) * degrees(angle), 90) AS e, sin(angle / 2) AS h
      FROM (SELECT unnest(range(-12, 13)) AS r), k),
x AS (SELECT r, e, CASE WHEN e >= 90 OR cos(radians(e)) <= h THEN 360.0::DOUBLE
                        ELSE 2 * degrees(asin(h / cos(radians(e)))) END AS reach FROM w),
n AS (SELECT r, e, reach, greatest(floor(360 / reach), 1)::BIGINT AS n FROM x),
q AS (SELECT event_id, r, least(floor(lo / (360.0::DOUBLE / n)), n - 1)::BIGINT AS c FROM p JOIN n USING (r)),
cells AS (SELECT DISTINCT r, c, r::VARCHAR || ':' || c::VARCHAR AS cell, n, e, reach, 360.0::DOUBLE / n AS wide
          FROM q JOIN n USING (r)),
near AS (SELECT a.cell AS a, b.cell AS b FROM cells a, cells b, (SELECT unnest(range(-2, 3)) AS turn)
         WHERE (a.r = b.r AND abs(a.c - b.c + turn * a.n) <= 1)
            OR (abs(a.r - b.r) = 1 AND b.e <= a.e AND b.c + turn * b.n
                BETWEEN floor((a.c * a.wide - a.reach) / b.wide) AND floor(((a.c + 1) * a.wide + a.reach) / b.wide))),
linked AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reached AS (SELECT a, b FROM linked UNION SELECT l.a, d.b FROM linked l JOIN reached d ON d.a = l.b),
named AS (SELECT a, min(b) AS cluster FROM reached GROUP BY a)
SELECT event_id, cell, cluster FROM q JOIN cells USING (r, c) JOIN named ON a = cell""")
def _(spark, d):
    rows = derived.sightings(spark, d).select("event_id", "latitude", "longitude")
    return places.radius_clusters(rows, 1000.0).select("event_id", "cell", "cluster")


@query("recent_detections", """
SELECT event_id, ts, video_hash, is_deepfake FROM sightings ORDER BY ts DESC, event_id DESC LIMIT 20""")
def _(spark, d):
    out = registry.newest(derived.sightings(spark, d), ["ts", "event_id"], 20)
    return out.select("event_id", "ts", "video_hash", "is_deepfake")


@query("recent_alerts", """
SELECT event_id, ts, video_hash FROM sightings WHERE is_deepfake ORDER BY ts DESC, event_id DESC LIMIT 10""")
def _(spark, d):
    fakes = derived.sightings(spark, d).where("is_deepfake")
    return registry.newest(fakes, ["ts", "event_id"], 10).select("event_id", "ts", "video_hash")


@query("threat_timeline", """
SELECT ts, 'deepfake_detected' AS kind, round(confidence, 4) AS confidence,
       substr(video_hash, 1, 16) AS hash FROM sightings WHERE is_deepfake
ORDER BY ts DESC, event_id DESC LIMIT 50""")
def _(spark, d):
    fakes = derived.sightings(spark, d).where("is_deepfake")
    return registry.newest(fakes, ["ts", "event_id"], 50).select(
        "ts",
        F.lit("deepfake_detected").alias("kind"),
        F.round("confidence", 4).alias("confidence"),
        F.substring("video_hash", 1, 16).alias("hash"),
    )


@query("page", """
SELECT event_id, ts, video_hash FROM sightings ORDER BY ts, event_id LIMIT 50 OFFSET 100""")
def _(spark, d):
    rows = derived.sightings(spark, d).select("event_id", "ts", "video_hash")
    return registry.page(rows, ["ts", "event_id"], 100, 50)


@query("events_between", """
SELECT event_id, user_id, event_type FROM events
WHERE event_id BETWEEN 500 AND 1500""")
def _(spark, d):
    out = registry.events_between(derived.table(spark, d, "events"), 500, 1500)
    return out.select("event_id", "user_id", "event_type")


@query("evict_oldest", """
SELECT event_id, ts, video_hash FROM sightings ORDER BY ts DESC, event_id DESC LIMIT 1000""")
def _(spark, d):
    rows = derived.sightings(spark, d).select("event_id", "ts", "video_hash")
    return registry.evict_oldest(rows, ["ts", "event_id"], 1000)


@query("family_rank", """
SELECT video_hash, family, generation,
       row_number() OVER (PARTITION BY family ORDER BY generation, first_seen, video_hash) AS position,
       dense_rank() OVER (PARTITION BY family ORDER BY generation) AS generation_rank
FROM item_lineage""")
def _(spark, d):
    return registry.family_rank(derived.item_lineage(spark, d)).select(
        "video_hash", "family", "generation", "position", "generation_rank"
    )


@query("platform_distribution", """
SELECT CASE WHEN lower(platform) IN ('view', 'click', 'purchase') THEN lower(platform)
            ELSE 'upload' END AS platform, count(*) AS count FROM sightings GROUP BY 1""")
def _(spark, d):
    return stats.platform_distribution(
        derived.sightings(spark, d), ["view", "click", "purchase"]
    )


@query("daily_counters", """
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS scans_total,
       count(*) FILTER (WHERE spread_count = 1 AND is_deepfake) AS deepfakes_found,
       count(*) FILTER (WHERE spread_count > 1) AS cache_hits,
       count(*) FILTER (WHERE spread_count > 1) * 3000 AS time_saved_ms
FROM numbered GROUP BY 1""")
def _(spark, d):
    return _daily(spark, d).withColumn("day", F.col("day").cast("string"))


def _daily(spark, d):
    rows = derived.sightings(spark, d)
    firsts = rows.groupBy("video_hash").agg(
        F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event_id")
    )
    return stats.daily_counters(rows, firsts)


@query("weekly_totals", """
SELECT count(*) AS scans_total, count(*) FILTER (WHERE spread_count = 1 AND is_deepfake)
       AS deepfakes_found, count(*) FILTER (WHERE spread_count > 1) AS cache_hits,
       count(*) FILTER (WHERE spread_count > 1) * 3000 AS time_saved_ms
FROM numbered WHERE ts::DATE >= DATE '2024-01-24'""")
def _(spark, d):
    return stats.weekly_totals(_daily(spark, d), F.lit("2024-01-31").cast("date"))
