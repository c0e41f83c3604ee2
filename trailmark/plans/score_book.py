"""Decision, parsing, feature and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import arrays, decide, kernels, parsing
from trailmark.operators import scoring
from trailmark.plans import derived
from trailmark.plans.book import query, rounded
from trailmark.plans.oracle_views import register
from trailmark.sources import tables

# ---- scalar decisions -----------------------------------------------------------------------------


@query("clamp_scores", """
SELECT video_hash, greatest(0, least(1, confidence * 2 - 0.5::DOUBLE)) AS confidence,
       greatest(0, least(1, lipsync_score * 2 - 0.5::DOUBLE)) AS lipsync_score,
       CASE WHEN fact_check_score IS NOT NULL
            THEN greatest(0, least(1, fact_check_score * 2 - 0.5::DOUBLE)) END AS fact_check_score
FROM detections""")
def _(spark, d):
    # stretched beyond [0, 1] first, so that both ends are clamped
    names = ["confidence", "lipsync_score", "fact_check_score"]
    return derived.detections(spark, d).select(
        "video_hash", *[decide.clamp(F.col(c) * 2 - 0.5).alias(c) for c in names]
    )


@query("verdict", """
SELECT video_hash, CASE
  WHEN is_deepfake AND confidence >= 0.9 THEN 'HIGHLY LIKELY DEEPFAKE'
  WHEN is_deepfake AND confidence >= 0.7 THEN 'LIKELY DEEPFAKE'
  WHEN is_deepfake AND confidence >= 0.5 THEN 'POSSIBLY DEEPFAKE'
  WHEN is_deepfake THEN 'SUSPECTED DEEPFAKE (LOW CONFIDENCE)'
  WHEN confidence >= 0.9 THEN 'HIGHLY LIKELY AUTHENTIC' WHEN confidence >= 0.7 THEN 'LIKELY AUTHENTIC'
  WHEN confidence >= 0.5 THEN 'POSSIBLY AUTHENTIC' ELSE 'UNCLEAR - MANUAL REVIEW RECOMMENDED' END AS verdict
FROM detections""")
def _(spark, d):
    return derived.detections(spark, d).select(
        "video_hash", decide.verdict(F.col("is_deepfake"), F.col("confidence")).alias("verdict")
    )


@query("confidence_level", """
SELECT video_hash, CASE WHEN confidence >= 0.9 THEN 'VERY HIGH' WHEN confidence >= 0.7 THEN 'HIGH'
  WHEN confidence >= 0.5 THEN 'MEDIUM' WHEN confidence >= 0.3 THEN 'LOW' ELSE 'VERY LOW' END AS level
FROM detections""")
def _(spark, d):
    return derived.detections(spark, d).select(
        "video_hash", decide.confidence_level(F.col("confidence")).alias("level")
    )


@query("risk_level", """
SELECT video_hash, CASE WHEN celebrity_detected AND is_deepfake THEN 'CRITICAL'
  WHEN celebrity_detected THEN 'HIGH' WHEN is_deepfake AND confidence >= 0.7 THEN 'HIGH'
  WHEN is_deepfake THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM detections""")
def _(spark, d):
    level = decide.risk_level(F.col("celebrity_detected"), F.col("is_deepfake"), F.col("confidence"))
    return derived.detections(spark, d).select("video_hash", level.alias("risk_level"))


@query("is_private_ip", """
SELECT event_id, ip, starts_with(ip, '10.') AS is_private FROM sightings""")
def _(spark, d):
    return derived.sightings(spark, d).select(
        "event_id", "ip", decide.is_private_ip(F.col("ip")).alias("is_private")
    )


@query("client_ip", """
SELECT event_id, CASE event_id % 4 WHEN 3 THEN '127.0.0.1' ELSE ip END AS client_ip FROM sightings""")
def _(spark, d):
    which, ip = F.col("event_id") % 4, F.col("ip")
    return derived.sightings(spark, d).select(
        "event_id",
        decide.client_ip(
            F.when(which == 0, F.concat(F.lit(" "), ip, F.lit(" , 198.51.100.7"))).otherwise(""),
            F.when(which <= 1, ip),
            F.when(which <= 2, ip),
        ).alias("client_ip"),
    )


@query("scale_fixed", """
SELECT event_id, greatest(0, least(10000, trunc(confidence * 150 * 100)::INT)) AS basis_points,
       trunc(latitude * 1000000)::INT AS latitude_micro, trunc(longitude * 1000000)::INT AS longitude_micro,
       greatest(0, least(10000, trunc(confidence * 150 * 100)::INT)) / 100 AS percent,
       trunc(latitude * 1000000)::INT / 1000000 AS latitude
FROM sightings""")
def _(spark, d):
    points = decide.to_basis_points(F.col("confidence") * 150)
    micro = decide.to_micro_degrees(F.col("latitude"))
    return derived.sightings(spark, d).select(
        "event_id",
        points.alias("basis_points"),
        micro.alias("latitude_micro"),
        decide.to_micro_degrees(F.col("longitude")).alias("longitude_micro"),
        decide.from_basis_points(points).alias("percent"),
        decide.from_micro_degrees(micro).alias("latitude"),
    )


@query("unscale_fixed", """
SELECT event_id, greatest(0, least(10000, trunc(confidence * 100 * 100)::INT)) / 100 AS percent,
       trunc(latitude * 1000000)::INT / 1000000 AS latitude,
       trunc(longitude * 1000000)::INT / 1000000 AS longitude FROM sightings""")
def _(spark, d):
    degrees = lambda c: decide.from_micro_degrees(decide.to_micro_degrees(F.col(c)))
    points = decide.to_basis_points(F.col("confidence") * 100)
    return derived.sightings(spark, d).select(
        "event_id",
        decide.from_basis_points(points).alias("percent"),
        degrees("latitude").alias("latitude"),
        degrees("longitude").alias("longitude"),
    )


@query("validate_registration", """
SELECT video_hash, variant, CASE WHEN variant = 3 AND vec_id % 5 = 0 THEN 'invalid content hash'
  WHEN c > 10000 THEN 'confidence exceeds 10000' WHEN l > 10000 THEN 'lipsync score exceeds 10000'
  WHEN f > 10000 THEN 'fact-check score exceeds 10000' ELSE 'ok' END AS status
FROM (SELECT *, trunc(confidence * 12000)::INT AS c, trunc(lipsync_score * 11000)::INT AS l,
             trunc(fact_check_score * 10500)::INT AS f FROM detections)""")
def _(spark, d):
    points = lambda c, scale: (F.col(c) * scale).cast("int")
    zero = (F.col("variant") == 3) & (F.col("vec_id") % 5 == 0)
    reason = decide.registration_error(
        F.when(zero, F.repeat(F.lit("0"), 64)).otherwise(F.col("video_hash")),
        points("confidence", 12000),
        points("lipsync_score", 11000),
        points("fact_check_score", 10500),
    )
    return derived.detections(spark, d).select(
        "video_hash", "variant", F.coalesce(reason, F.lit("ok")).alias("status")
    )


@query("validate_sighting", """
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'invalid video hash' ELSE 'ok' END AS status
FROM sightings""")
def _(spark, d):
    given = F.when(F.col("event_id") % 50 == 0, F.lit("0x0")).otherwise(F.col("video_hash"))
    bad = decide.is_zero_hash(given)
    return derived.sightings(spark, d).select(
        "event_id", F.when(bad, "invalid video hash").otherwise("ok").alias("status")
    )


@query("thumbnail_gate", """
SELECT video_hash, NOT f OR q > 0.8 AS high_confidence,
       CASE WHEN NOT f OR q > 0.8 THEN false END AS is_deepfake,
       CASE WHEN NOT f OR q > 0.8 THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
       round(q, 3) AS thumbnail_quality
FROM (SELECT video_hash, variant < 3 AS f, lipsync_score AS q FROM detections)""")
def _(spark, d):
    gate = decide.thumbnail_gate(F.col("variant") < 3, F.col("lipsync_score"))
    return derived.detections(spark, d).select(
        "video_hash", *[c.alias(n) for n, c in gate.items()]
    )


@query("score_band", """
SELECT video_hash, CASE WHEN fact_check_score IS NULL THEN 'N/A' WHEN fact_check_score >= 0.7 THEN 'high'
  WHEN fact_check_score >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM detections""")
def _(spark, d):
    return derived.detections(spark, d).select(
        "video_hash", decide.score_band(F.col("fact_check_score")).alias("band")
    )


SITES = ["www.youtube.com", "m.facebook.com", "x.com", "netflix.com", "old.reddit.com", "tiktok.com"]


@query("platform_of", """
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'YouTube' WHEN 1 THEN 'Facebook' WHEN 2 THEN 'X'
  WHEN 4 THEN 'Reddit' WHEN 5 THEN 'TikTok' END AS platform FROM pages""")
def _(spark, d):
    # the page's own URL on every seventh row, its path below a known site on the others
    which = (F.col("page_id") % 7).cast("int")
    sites = F.array(*[F.lit(s) for s in SITES])
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    moved = F.concat(F.lit("https://"), F.get(sites, which), path)
    url = F.when(which == 6, F.col("url")).otherwise(moved)
    return derived.table(spark, d, "pages").select(
        "page_id", decide.platform_of(url).alias("platform")
    )


@query("country_flag", """
SELECT n_nationkey, CASE WHEN n_nationkey = 23 THEN chr(127987) || chr(65039)
  ELSE chr(127462 + n_nationkey) || chr(127462 + (n_nationkey * 7 + 3) % 26) END AS flag FROM nation""")
def _(spark, d):
    letter = lambda n: F.char(n + 97)
    key = F.col("n_nationkey")
    code = F.when(key == 23, "xx").otherwise(F.concat(letter(key), letter((key * 7 + 3) % 26)))
    return derived.table(spark, d, "nation").select(
        "n_nationkey", decide.country_flag(code).alias("flag")
    )


@query("parse_metadata", """
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN json_extract_string(props, '$.k') END AS k,
       CASE WHEN event_id % 10 <> 0 THEN 1 ELSE 0 END AS fields FROM events""")
def _(spark, d):
    text = F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    parsed = F.coalesce(
        F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>")
    )
    return (
        derived.table(spark, d, "events")
        .withColumn("meta", parsed)
        .select("event_id", F.col("meta")["k"].alias("k"), F.size("meta").alias("fields"))
    )


@query("decode_frame_batch", """
SELECT doc_id, k AS frame_no, sha256(substr(text, k * w + 1, w)) AS frame_hash
FROM (SELECT *, (length(text) + 17) // 18 AS w FROM documents), (SELECT unnest(range(18))::INT AS k)""")
def _(spark, d):
    # the whole text in eighteen frames of one width
    width = F.floor((F.length("text") + 17) / 18).cast("int")

    def encoded(k):
        body = F.base64(F.encode(F.substr("text", k * width + 1, width), "UTF-8"))
        return F.when(k % 2 == 0, F.concat(F.lit("data:image/jpeg;base64,"), body)).otherwise(body)

    requests = derived.table(spark, d, "documents").select(
        "doc_id", F.transform(F.sequence(F.lit(0), F.lit(17)), encoded).alias("frames")
    )
    return tables.decode_frame_batch(requests, max_frames=18).select(
        "doc_id", "frame_no", F.sha2("frame", 256).alias("frame_hash")
    )


# ---- frame features -----------------------------------------------------------------------------

register("frame_pairs", """
SELECT a.video_id, a.frame_idx, a.pixels, b.pixels AS next_pixels
FROM frames a JOIN frames b ON b.video_id = a.video_id AND b.frame_idx = a.frame_idx + 1
JOIN (SELECT video_id, unnest(CASE WHEN count(*) - 1 < 10 THEN range(count(*) - 1)
        ELSE list_transform(range(10), lambda i: i * (count(*) - 2) // 9) END) AS idx
      FROM frames GROUP BY video_id HAVING count(*) >= 2) s
  ON s.video_id = a.video_id AND s.idx = a.frame_idx""")

register("pair_moments", """
SELECT video_id, frame_idx, avg(x) AS ma, avg(y) AS mb, var_pop(x) AS va, var_pop(y) AS vb,
       covar_pop(x, y) AS cov, avg(abs(x - y)) AS diff
FROM (SELECT video_id, frame_idx, unnest(pixels) AS x, unnest(next_pixels) AS y FROM frame_pairs)
GROUP BY ALL""")

register("pair_scores", """
SELECT video_id, frame_idx,
  greatest(0, least(1, (cov / ((sqrt(va) + 1e-8) * (sqrt(vb) + 1e-8)) + 1) / 2)) AS correlation,
  greatest(0, least(1, ((2 * ma * mb + 6.5025::DOUBLE) * (2 * cov + 58.5225::DOUBLE)
    / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (va + vb + 58.5225::DOUBLE) + 1e-8) + 1) / 2)) AS ssim,
  greatest(0, least(1, (coalesce(cov / nullif(sqrt(va * vb), 0), 0) + 1) / 2)) AS lip_sync_score,
  diff AS pixel_difference,
  greatest(0, least(100, (1 - coalesce(cov / nullif(sqrt(va * vb), 0), 0)) * 50 + diff * 0.5)) AS mismatch_score
FROM pair_moments""")

register("pair_hist", """
SELECT video_id, frame_idx, greatest(0, least(1, (CASE WHEN s > 0 THEN c / s ELSE 1 END + 1) / 2)) AS h
FROM (SELECT video_id, frame_idx, sum(a * b) - sum(a) * sum(b) / 256 AS c,
             sqrt((sum(a * a) - sum(a) * sum(a) / 256) * (sum(b * b) - sum(b) * sum(b) / 256)) AS s
      FROM (SELECT video_id, frame_idx, floor(v) AS bin, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b
            FROM (SELECT video_id, frame_idx, unnest(pixels) AS v, 1 AS a, 0 AS b FROM frame_pairs
                  UNION ALL SELECT video_id, frame_idx, unnest(next_pixels), 0, 1 FROM frame_pairs)
            GROUP BY ALL) GROUP BY ALL)""")


def _pairs(spark, d):
    return scoring.frame_pair_join(derived.frames(spark, d))


def _features(spark, d):
    return scoring.pair_features(_pairs(spark, d)).drop("pixels", "next_pixels")


@query("frame_pair_join", """
SELECT video_id, frame_idx, round(list_sum(pixels), 4) AS first_sum, round(list_sum(next_pixels), 4) AS next_sum
FROM frame_pairs""")
def _(spark, d):
    return _pairs(spark, d).select(
        "video_id",
        "frame_idx",
        F.round(arrays.total(F.col("pixels")), 4).alias("first_sum"),
        F.round(arrays.total(F.col("next_pixels")), 4).alias("next_sum"),
    )


for _name, _column in {
    "pair_correlation": "correlation",
    "pair_ssim": "ssim",
    "pair_pixel_diff": "pixel_difference",
    "lip_sync_score": "lip_sync_score",
    "mismatch_score": "mismatch_score",
}.items():
    query(_name, f"""
SELECT video_id, frame_idx, round({_column}, 6) AS {_column} FROM pair_scores""")(
        lambda spark, d, c=_column: rounded(
            _features(spark, d).select("video_id", "frame_idx", c), c
        )
    )


@query("pair_histogram_similarity", """
SELECT video_id, frame_idx, round(h, 6) AS histogram_similarity FROM pair_hist""")
def _(spark, d):
    found = scoring.pair_histogram_similarity(_pairs(spark, d))
    return rounded(found.select("video_id", "frame_idx", "histogram_similarity"), "histogram_similarity")


@query("temporal_consistency", """
SELECT video_id, frame_idx, round(greatest(0, least(1, correlation * 0.3 + ssim * 0.3
         + (frame_idx % 10) / 10 * 0.2 + h * 0.2)), 6) AS temporal_consistency
FROM pair_scores JOIN pair_hist USING (video_id, frame_idx)""")
def _(spark, d):
    key = ["video_id", "frame_idx"]
    pairs = _pairs(spark, d)
    joined = scoring.pair_features(scoring.pair_histogram_similarity(pairs))
    edge = (F.col("frame_idx") % 10) / 10
    score = arrays.temporal_consistency(
        F.col("correlation"), F.col("ssim"), edge, F.col("histogram_similarity")
    )
    return rounded(joined.select(*key, score.alias("temporal_consistency")), "temporal_consistency")


register("spectrum", """
SELECT video_id, frame_idx, avg(m) FILTER (WHERE sqrt(pow((u + 4) % 8 - 4, 2) + pow((v + 4) % 8 - 4, 2)) > 2.4) AS hf
FROM (SELECT video_id, frame_idx, u, v,
             sqrt(pow(sum(x / 255 * cos(2 * pi() * (u * (i // 8) + v * (i % 8)) / 8)), 2)
                  + pow(sum(x / 255 * sin(2 * pi() * (u * (i // 8) + v * (i % 8)) / 8)), 2)) AS m
      FROM frame_pixels, (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS v) GROUP BY ALL)
GROUP BY ALL""")


@query("frequency_artifacts", """
SELECT p.video_id, round(avg(least(1, abs(a.hf - b.hf) / 0.5)), 6) AS frequency_artifacts
FROM frame_pairs p JOIN spectrum a ON a.video_id = p.video_id AND a.frame_idx = p.frame_idx
JOIN spectrum b ON b.video_id = p.video_id AND b.frame_idx = p.frame_idx + 1 GROUP BY p.video_id""")
def _(spark, d):
    scored = kernels.frequency_artifacts(_pairs(spark, d), 8)
    out = scored.groupBy("video_id").agg(F.avg("artifact_score").alias("frequency_artifacts"))
    return rounded(out, "frequency_artifacts")


register("qualities", """
SELECT video_id, frame_idx, greatest(0, least(1, 0.7 * least(var_pop(lap) / 500, 1)
         + 0.3 * stddev_pop(x) / 128)) AS quality
FROM (SELECT video_id, frame_idx, pixels[i + 1] AS x,
        pixels[CASE WHEN r = 0 THEN 1 ELSE r - 1 END * 8 + c + 1]
        + pixels[CASE WHEN r = 7 THEN 6 ELSE r + 1 END * 8 + c + 1]
        + pixels[r * 8 + CASE WHEN c = 0 THEN 1 ELSE c - 1 END + 1]
        + pixels[r * 8 + CASE WHEN c = 7 THEN 6 ELSE c + 1 END + 1] - 4 * pixels[i + 1] AS lap
      FROM (SELECT *, i // 8 AS r, i % 8 AS c FROM frames, (SELECT unnest(range(64)) AS i)))
GROUP BY ALL""")


def _qualities(spark, d):
    return kernels.frame_quality(derived.frames(spark, d), 8)


@query("frame_quality", "SELECT video_id, frame_idx, round(quality, 6) AS quality FROM qualities")
def _(spark, d):
    return rounded(_qualities(spark, d), "quality")


@query("frame_rollup", """
SELECT video_id, count(*) FILTER (WHERE frame_idx % 3 <> 0) AS frames_with_faces,
       round(count(*) FILTER (WHERE frame_idx % 3 <> 0) / count(*), 6) AS face_detection_rate,
       round(coalesce(avg(quality) FILTER (WHERE frame_idx % 3 <> 0), 0.5), 6) AS avg_quality
FROM qualities GROUP BY video_id""")
def _(spark, d):
    rows = _qualities(spark, d).withColumn("has_face", F.col("frame_idx") % 3 != 0)
    return rounded(scoring.frame_rollup(rows), "face_detection_rate", "avg_quality")


@query("mean_features", """
SELECT video_id, round(avg(correlation), 6) AS correlation, round(avg(ssim), 6) AS ssim,
       round(avg(lip_sync_score), 6) AS lip_sync_score,
       round(avg(pixel_difference), 6) AS pixel_difference FROM pair_scores GROUP BY video_id""")
def _(spark, d):
    names = ["correlation", "ssim", "lip_sync_score", "pixel_difference"]
    return rounded(scoring.mean_features(_features(spark, d), names), *names)


@query("prediction_vote", """
SELECT video_id, round(r, 6) AS lipsync_score, f > r AS is_deepfake, round(greatest(f, r), 6) AS confidence
FROM (SELECT video_id, avg(1 - ((video_id * 7 + frame_idx * 13) % 101) / 100) AS r,
             avg(((video_id * 7 + frame_idx * 13) % 101) / 100) AS f FROM frame_pairs GROUP BY video_id)""")
def _(spark, d):
    fake = ((F.col("video_id") * 7 + F.col("frame_idx") * 13) % 101) / 100
    rows = _pairs(spark, d).select(
        "video_id", fake.alias("p_fake"), (1 - fake).alias("p_real")
    )
    return rounded(scoring.prediction_vote(rows), "lipsync_score", "confidence")


@query("risk_frame_summary", """
SELECT label, round(avg(((vec_id * 37) % 101) / 100), 6) AS avg_risk,
       count(*) FILTER (WHERE ((vec_id * 37) % 101) / 100 > 0.6) AS high_risk_frames
FROM embeddings GROUP BY label""")
def _(spark, d):
    rows = derived.table(spark, d, "embeddings").select(
        F.col("label").alias("video_id"), ((F.col("vec_id") * 37 % 101) / 100).alias("risk")
    )
    out = scoring.risk_frame_summary(rows).withColumnRenamed("video_id", "label")
    return rounded(out, "avg_risk")


@query("capture_plan", """
SELECT doc_id, array_to_string(list_sort(list_distinct(t2 || CASE WHEN d > 300 AND len(t2) < most
         THEN [d / 2] ELSE [] END))[1:most], ',') AS times
FROM (SELECT doc_id, d, most, t1 || CASE WHEN d > 30 AND len(t1) < most THEN [d - 2] ELSE [] END AS t2
  FROM (SELECT doc_id, d, most, [0.5::DOUBLE] || list_transform(range(1, greatest(1, 1 +
          least(ceil((d - 1) / step) - 1, most - 2)::BIGINT)), lambda i: (i * step)::DOUBLE) AS t1
    FROM (SELECT doc_id, (n_chars % 700)::DOUBLE AS d,
                 CASE WHEN n_chars % 700 <= 30 THEN 3 WHEN n_chars % 700 <= 300 THEN 10 ELSE 30 END AS step,
                 CASE WHEN n_chars % 700 <= 30 THEN 10 WHEN n_chars % 700 <= 300 THEN 15 ELSE 12 END AS most
          FROM documents)))""")
def _(spark, d):
    duration = (F.col("n_chars") % 700).cast("double")
    return derived.table(spark, d, "documents").select(
        "doc_id", F.array_join(arrays.capture_plan(duration), ",").alias("times")
    )


@query("handcrafted_verdict", """
SELECT video_hash, f > 0.4 AS is_deepfake,
       round(CASE WHEN f > 0.4 THEN 0.5 + (f - 0.4) * 0.5 ELSE 0.4 END, 6) AS confidence,
       round(1 - greatest(0, least(1, f * 0.6 + abs(e) * 0.2 + 0.2)), 6) AS lipsync_score,
       CASE WHEN f > 0.4 THEN 0.5 + (f - 0.4) * 0.5 ELSE 0.4 END < 0.6 AS uncertain
FROM (SELECT video_hash, ((vec_id * 31) % 101) / 100 AS f,
             ((vec_id * 17 + variant) % 41 - 20) / 20 AS e FROM detections)""")
def _(spark, d):
    v = F.col("vec_id")
    out = scoring.handcrafted_verdict(
        (v * 31 % 101) / 100, ((v * 17 + F.col("variant")) % 41 - 20) / 20
    )
    rows = derived.detections(spark, d).select(
        "video_hash", *[c.alias(n) for n, c in out.items()]
    )
    return rounded(rows, "confidence", "lipsync_score")


@query("edge_node_verdict", """
SELECT video_hash, round(s, 6) AS confidence, round(s, 6) >= 65 AS is_deepfake,
       greatest(0.0::DOUBLE, 100 - a) AS lipsync_score
FROM (SELECT video_hash, a, a * 0.25 + b * 0.15 + c * 0.20 + e * 0.25 + f * 0.15 AS s
      FROM (SELECT video_hash, (vec_id * 37 % 121)::DOUBLE AS a, (vec_id * 11 % 101)::DOUBLE AS b,
                   (vec_id * 13 % 101)::DOUBLE AS c, (vec_id * 17 % 101)::DOUBLE AS e,
                   (variant * 30)::DOUBLE AS f FROM detections))""")
def _(spark, d):
    v = F.col("vec_id")
    values = {
        "optical_flow": v * 37 % 121,
        "color_histogram": v * 11 % 101,
        "edge_detection": v * 13 % 101,
        "frequency_analysis": v * 17 % 101,
        "noise_analysis": F.col("variant") * 30,
    }
    scores = F.create_map(*[x for n, c in values.items() for x in (F.lit(n), c.cast("double"))])
    out = scoring.edge_node_verdict(F.col("scores"))
    rows = derived.detections(spark, d).withColumn("scores", scores)
    return rows.select(
        "video_hash",
        F.round(out["confidence"], 6).alias("confidence"),
        (F.round(out["confidence"], 6) >= 65).alias("is_deepfake"),
        out["lipsync_score"].alias("lipsync_score"),
    )


# ---- reply parsing ------------------------------------------------------------------------------


def sql_block(reply: str, name: str, *stops: str) -> str:
    ends = "|".join([f"{s}:" for s in stops] + [r"\z"])
    return rf"nullif(regexp_extract({reply}, '(?is){name}:\s*(.+?)\s*(?:{ends})', 1), '')"


def sql_word(reply: str, name: str, choices: str, default: str | None) -> str:
    hit = rf"nullif(upper(regexp_extract({reply}, '(?i){name}:\s*({choices})', 1)), '')"
    return hit if default is None else f"coalesce({hit}, '{default}')"


def sql_number(reply: str, name: str, default: str, decimals: bool = True) -> str:
    digits = r"\d+(?:\.\d+)?" if decimals else r"\d+"
    hit = rf"nullif(regexp_extract({reply}, '(?i){name}:\s*({digits})', 1), '')"
    return f"coalesce({hit}::DOUBLE, {default}::DOUBLE)"


def sql_items(block: str, nothing: str) -> str:
    parts = (
        f"array_to_string(list_filter(list_transform(string_split({block}, ','), "
        "lambda p: trim(p)), lambda p: p <> ''), '|')"
    )
    return f"CASE WHEN {block} IS NULL OR lower({block}) IN ({nothing}) THEN '' ELSE {parts} END"


def _parsed(spark, d, reply, parser, lists=()):
    rows = derived.replies(spark, d)
    out = parser(F.col(reply))
    return rows.select(
        "doc_id",
        *[(F.array_join(c, "|") if n in lists else c).alias(n) for n, c in out.items()],
    )


A = "artifact_reply"


@query("parse_artifact_reply", f"""
SELECT doc_id, {sql_number(A, 'SCORE', '5')} AS score,
       coalesce({sql_block(A, 'REASONING', 'CONFIDENCE')}, '') AS reasoning,
       {sql_word(A, 'CONFIDENCE', 'LOW|MEDIUM|HIGH', 'MEDIUM')} AS confidence FROM replies""")
def _(spark, d):
    return _parsed(spark, d, A, parsing.parse_artifact_reply)


C = "celebrity_reply"


@query("parse_celebrity_reply", f"""
SELECT doc_id, {sql_word(C, 'CELEBRITY_DETECTED', 'YES|NO', 'NO')} = 'YES' AS detected,
       CASE WHEN lower(p) <> 'unknown' THEN p END AS person,
       coalesce({sql_block(C, 'NEWS_CONTEXT', 'RISK_LEVEL')}, '') AS context,
       {sql_word(C, 'RISK_LEVEL', 'LOW|MEDIUM|HIGH', 'LOW')} AS risk_level
FROM (SELECT *, {sql_block(C, 'LIKELY_PERSON', 'NEWS_CONTEXT')} AS p FROM replies)""")
def _(spark, d):
    return _parsed(spark, d, C, parsing.parse_celebrity_reply)


N = "news_reply"


@query("parse_news_reply", f"""
SELECT doc_id, {sql_number(N, 'NEWS_MATCHES', '0', False)}::INT AS matches,
       {sql_items('s', "'none'")} AS sources,
       {sql_word(N, 'VERDICT', 'CONFIRMED_REAL|CONFIRMED_FAKE|UNKNOWN', 'UNKNOWN')} AS verdict,
       coalesce({sql_block(N, 'REASONING', 'CONFIDENCE')}, '') AS reasoning,
       {sql_word(N, 'CONFIDENCE', 'LOW|MEDIUM|HIGH', 'LOW')} AS confidence
FROM (SELECT *, {sql_block(N, 'SOURCES', 'VERDICT')} AS s FROM replies)""")
def _(spark, d):
    return _parsed(spark, d, N, parsing.parse_news_reply, ["sources"])


P = "personality_reply"
CATEGORIES = "POLITICIAN|CELEBRITY|BUSINESS|SPORTS|MEDIA|RELIGIOUS|OTHER|UNKNOWN"

register("who", f"""
SELECT doc_id, {sql_word(P, 'PERSON_IDENTIFIED', 'YES|NO', 'NO')} = 'YES' AS detected,
       CASE WHEN lower(w) NOT IN ('unknown', 'unknown person', 'none') THEN w END AS identity,
       {sql_word(P, 'CONFIDENCE', 'LOW|MEDIUM|HIGH', 'LOW')} AS confidence,
       {sql_word(P, 'CATEGORY', CATEGORIES, 'UNKNOWN')} AS category,
       coalesce({sql_block(P, 'REASONING')}, '') AS reasoning
FROM (SELECT *, {sql_block(P, 'IDENTITY', 'CONFIDENCE', 'CATEGORY', 'REASONING')} AS w FROM replies)""")


@query("parse_personality_reply", "SELECT * FROM who")
def _(spark, d):
    return _parsed(spark, d, P, parsing.parse_personality_reply)


V = "verdict_reply"


def _judged_sql(reply: str) -> str:
    return f"""
SELECT doc_id, CASE said WHEN 'YES' THEN true WHEN 'NO' THEN false END AS is_deepfake,
       greatest(0, least(100, {sql_number(reply, 'CONFIDENCE', '50', False)}))::INT AS confidence,
       greatest(0, least(10, {sql_number(reply, 'AUTHENTICITY_SCORE', '5')})) AS authenticity_score,
       coalesce({sql_block(reply, 'REASONING', 'RED_FLAGS', 'TECHNICAL_ARTIFACTS', 'ARTIFACTS_FOUND', 'CONTEXTUAL_ISSUES')}, '') AS reasoning,
       {sql_items('rf', "'none', 'none detected'")} AS red_flags,
       {sql_items('ta', "'none', 'none found'")} AS technical_artifacts,
       {sql_items('ci', "'none', 'none found'")} AS contextual_issues,
       {sql_items('af', "'none', 'none detected'")} AS artifacts,
       {sql_word(reply, 'RECOMMENDATION', 'TRUST|VERIFY|REJECT', 'VERIFY')} AS recommendation
FROM (SELECT *, {sql_word(reply, 'IS_DEEPFAKE', 'YES|NO|UNCERTAIN', None)} AS said,
  {sql_block(reply, 'RED_FLAGS', 'TECHNICAL_ARTIFACTS', 'CONTEXTUAL_ISSUES', 'RECOMMENDATION')} AS rf,
  {sql_block(reply, 'TECHNICAL_ARTIFACTS', 'CONTEXTUAL_ISSUES', 'RECOMMENDATION')} AS ta,
  {sql_block(reply, 'CONTEXTUAL_ISSUES', 'RECOMMENDATION')} AS ci,
  {sql_block(reply, 'ARTIFACTS_FOUND', 'QUALITY_ASSESSMENT', 'RECOMMENDATION')} AS af FROM replies)"""


register("judged", _judged_sql(V))
register("judged_technical", _judged_sql("technical_reply"))

LISTS = ["red_flags", "technical_artifacts", "contextual_issues", "artifacts"]


@query("parse_verdict_reply", "SELECT * FROM judged")
def _(spark, d):
    return _parsed(spark, d, V, parsing.parse_verdict_reply, LISTS)


R = "verifier_reply"
FLAGS = [name.lower() for name in parsing.INDICATORS]
register("verified", f"""
SELECT doc_id, {sql_word(R, 'VERDICT', 'REAL|FAKE|UNCERTAIN', 'UNCERTAIN')} AS verdict,
       {sql_number(R, 'CONFIDENCE', '50', False)}::INT AS confidence,
       {sql_number(R, 'MANIPULATION_SCORE', '5')} AS manipulation_score,
       {", ".join(f"{sql_word(R, f.upper(), 'YES|NO', 'NO')} = 'YES' AS {f}" for f in FLAGS)},
       coalesce({sql_block(R, 'REASONING', 'DETAILED_ANALYSIS')}, '') AS reasoning,
       coalesce({sql_block(R, 'DETAILED_ANALYSIS')}, '') AS detailed_analysis FROM replies""")


@query("parse_verifier_reply", "SELECT * FROM verified")
def _(spark, d):
    return _parsed(spark, d, R, parsing.parse_verifier_reply)


@query("indicator_adjust", f"""
SELECT doc_id, verdict = 'FAKE' AS is_deepfake, round(CASE WHEN n >= 3 THEN least(0.95, c * 1.2)
  WHEN n = 0 AND verdict <> 'FAKE' THEN least(0.95, c * 1.1) ELSE c END, 6) AS confidence
FROM (SELECT doc_id, verdict, confidence / 100 AS c, {" + ".join(f"{f}::INT" for f in FLAGS)} AS n FROM verified)""")
def _(spark, d):
    rows = _parsed(spark, d, R, parsing.parse_verifier_reply)
    fake = F.col("verdict") == "FAKE"
    score = scoring.indicator_adjust(F.col("confidence") / 100, fake, [F.col(f) for f in FLAGS])
    return rows.select(
        "doc_id", fake.alias("is_deepfake"), F.round(score, 6).alias("confidence")
    )


# ---- fusion -------------------------------------------------------------------------------------

AUTHENTIC = """
SELECT video_hash, news_verdict, greatest(0, least(1, s * CASE WHEN NOT celebrity_detected THEN 1
  WHEN risk = 'HIGH' THEN 0.6 WHEN risk = 'MEDIUM' THEN 0.75 ELSE 0.85 END)) AS a
FROM (SELECT *, CASE news_verdict WHEN 'CONFIRMED_FAKE' THEN least(lipsync_score, 0.3)
  WHEN 'CONFIRMED_REAL' THEN greatest(lipsync_score, 0.7) ELSE lipsync_score END AS s FROM detections)"""
register("authentic", AUTHENTIC)


def _authenticity():
    return scoring.authenticity_score(
        F.col("lipsync_score"), F.col("news_verdict"), F.col("celebrity_detected"), F.col("risk")
    )


@query("authenticity_score", "SELECT video_hash, round(a, 6) AS authenticity_score FROM authentic")
def _(spark, d):
    rows = derived.detections(spark, d).select(
        "video_hash", _authenticity().alias("authenticity_score")
    )
    return rounded(rows, "authenticity_score")


@query("fact_verdict", """
SELECT video_hash, CASE WHEN news_verdict = 'CONFIRMED_FAKE' THEN 'CONFIRMED_FAKE - Known manipulated media'
  WHEN news_verdict = 'CONFIRMED_REAL' THEN 'CONFIRMED_REAL - Verified authentic'
  WHEN round(a, 6) >= 0.7 THEN 'LIKELY_AUTHENTIC - No manipulation detected'
  WHEN round(a, 6) >= 0.4 THEN 'UNCERTAIN - Manual review recommended'
  ELSE 'LIKELY_FAKE - Manipulation indicators detected' END AS final_verdict FROM authentic""")
def _(spark, d):
    label = scoring.fact_verdict(F.col("news_verdict"), F.round(_authenticity(), 6))
    return derived.detections(spark, d).select("video_hash", label.alias("final_verdict"))


@query("fuse_scores", """
WITH base AS (
  SELECT *, confidence > 0.5 AS local_fake, variant = 1 AS uncertain,
         CASE WHEN variant >= 2 THEN 'cnn' ELSE 'handcrafted' END AS method, len(red_flags) AS nf,
         fact_check_score AS f, lipsync_score AS l FROM detections),
mixed AS (
  SELECT *, CASE
      WHEN celebrity_detected AND nf > 0
        THEN least(1, (1 - l) * 0.1 + (1 - f) * 0.9 + least(0.25, 0.08 * nf))
      WHEN celebrity_detected THEN (1 - l) * 0.1 + (1 - f) * 0.9
      WHEN uncertain OR method = 'handcrafted' THEN (1 - l) * 0.2 + (1 - f) * 0.8
      ELSE (1 - l) * 0.7 + (1 - f) * 0.3 END AS p FROM base),
step AS (
  SELECT *, abs(p - 0.5) * 2 + 0.5 AS b, celebrity_detected AND risk = 'HIGH' AND f < 0.60 AS risky FROM mixed),
out AS (
  SELECT *, CASE WHEN NOT celebrity_detected THEN round(p, 9) > 0.5
        WHEN risky THEN true WHEN f < 0.5 THEN true WHEN f > 0.8 AND nf = 0 THEN false ELSE round(p, 9) > 0.5 END AS fake,
    CASE WHEN NOT celebrity_detected THEN b WHEN news_verdict <> 'UNKNOWN' THEN greatest(b, 0.95)
        WHEN risky THEN greatest(b, 0.75) WHEN f < 0.5 THEN b
        WHEN f > 0.8 AND nf = 0 THEN f ELSE b END AS c FROM step)
SELECT video_hash,
  CASE WHEN f IS NULL THEN local_fake WHEN news_verdict = 'CONFIRMED_FAKE' THEN true
       WHEN news_verdict = 'CONFIRMED_REAL' THEN false ELSE fake END AS fused_fake,
  round(CASE WHEN f IS NULL THEN confidence WHEN news_verdict <> 'UNKNOWN' THEN greatest(c, 0.9)
       ELSE c END, 6) AS fused_confidence,
  CASE WHEN f IS NULL THEN NULL WHEN local_fake = (f < 0.5) THEN 'agree' ELSE 'disagree' END AS agreement,
  CASE WHEN f IS NULL THEN uncertain WHEN local_fake <> (f < 0.5) THEN true
       WHEN celebrity_detected AND news_verdict <> 'UNKNOWN' THEN false
       WHEN risky THEN true ELSE uncertain END AS requires_review
FROM out""")
def _(spark, d):
    rows = derived.detections(spark, d).withColumns(
        {
            "local_fake": F.col("confidence") > 0.5,
            "local_confidence": F.col("confidence"),
            "uncertain": F.col("variant") == 1,
            "method": F.when(F.col("variant") >= 2, "cnn").otherwise("handcrafted"),
        }
    )
    out = scoring.fuse_scores(rows, "detector").select(
        "video_hash", "fused_fake", "fused_confidence", "agreement", "requires_review"
    )
    return rounded(out, "fused_confidence")


@query("fuse_scores_frames", """
WITH base AS (
  SELECT video_hash, ((vec_id * 41 + variant * 7) % 101) / 100 AS q, (vec_id % 11) / 10 AS fr,
         CASE WHEN vec_id % 6 <> 0 THEN is_deepfake END AS rf, vec_id % 12 <> 0 AS came, lipsync_score AS ra, confidence AS rc,
         celebrity_detected AS pd, ['POLITICIAN', 'SPORTS', 'BUSINESS'][variant % 3 + 1] AS pc FROM detections),
mix AS (
  SELECT *, CASE WHEN rf THEN 1 ELSE 1 - ra END AS g, (CASE WHEN q > 0.6 THEN 0.3 WHEN q < 0.4 THEN 0.6 ELSE 0.45 END)::DOUBLE AS lo,
         (CASE WHEN pd AND pc IN ('POLITICIAN', 'BUSINESS') THEN 0.9 WHEN pd THEN 0.85 ELSE 0.7 END)::DOUBLE AS w FROM base),
f AS (
  SELECT *, CASE WHEN rf IS NOT NULL THEN g * w + lo * (1 - w) > 0.5 ELSE q < 0.4 AND fr > 0.3 END AS fake,
         g * w + lo * (1 - w) AS p FROM mix),
c AS (
  SELECT *, CASE WHEN rf IS NOT NULL THEN greatest(rc, abs(p - 0.5) * 2 + 0.5)
                 WHEN fake THEN 0.6 + 0.3 * (1 - q) ELSE 0.7 + 0.25 * q END AS c FROM f)
SELECT video_hash, fake AS fused_fake, round(round(c, 3), 2) AS fused_confidence,
       CASE WHEN fake THEN 'high' WHEN c < 0.8 THEN 'medium' ELSE 'low' END AS risk_level,
       CASE WHEN came THEN 'personality_first' ELSE 'heuristic' END AS analysis_method FROM c""")
def _(spark, d):
    v = F.col("vec_id")
    groups = F.array(F.lit("POLITICIAN"), F.lit("SPORTS"), F.lit("BUSINESS"))
    rows = derived.detections(spark, d).select(
        "video_hash",
        ((v * 41 + F.col("variant") * 7) % 101 / 100).alias("avg_quality"),
        (v % 11 / 10).alias("face_detection_rate"),
        (v % 12 != 0).alias("reply_present"),
        F.when(v % 6 != 0, F.col("is_deepfake")).alias("reply_fake"),
        F.col("lipsync_score").alias("reply_authenticity"),
        F.col("confidence").alias("reply_confidence"),
        F.col("celebrity_detected").alias("personality_detected"),
        F.get(groups, F.col("variant") % 3).alias("personality_category"),
    )
    out = scoring.fuse_scores(rows, "frames")
    return out.select(
        "video_hash", "fused_fake", F.round("fused_confidence", 2).alias("fused_confidence"),
        "risk_level", "analysis_method",
    )


@query("personality_branch", """
SELECT w.doc_id, CASE WHEN k THEN 'personality_specific' ELSE 'technical_artifacts' END AS analysis_method,
       CASE WHEN k THEN j.is_deepfake ELSE t.is_deepfake END AS is_deepfake,
       CASE WHEN k THEN j.confidence ELSE t.confidence END / 100 AS deepfake_confidence,
       CASE WHEN k THEN j.authenticity_score ELSE t.authenticity_score END / 10 AS authenticity_score,
       CASE WHEN k THEN j.red_flags ELSE t.artifacts END AS red_flags,
       CASE WHEN k THEN j.recommendation ELSE 'VERIFY' END AS recommendation,
       CASE WHEN w.category IN ('POLITICIAN', 'BUSINESS') THEN 'HIGH' WHEN w.detected THEN 'MEDIUM'
            ELSE 'LOW' END AS risk_level,
       CASE CASE WHEN k THEN j.is_deepfake ELSE t.is_deepfake END
         WHEN true THEN 'FAKE' WHEN false THEN 'AUTHENTIC' ELSE 'UNCERTAIN' END AS final_verdict
FROM (SELECT *, detected AND identity IS NOT NULL AS k FROM who) w JOIN judged j ON j.doc_id = w.doc_id
JOIN judged_technical t ON t.doc_id = w.doc_id""")
def _(spark, d):
    def packed(parser, reply):
        return F.struct(*[c.alias(n) for n, c in parser(F.col(reply)).items()])

    rows = derived.replies(spark, d).select(
        "doc_id",
        packed(parsing.parse_personality_reply, P).alias("who"),
        packed(parsing.parse_verdict_reply, V).alias("known"),
        packed(parsing.parse_verdict_reply, "technical_reply").alias("technical"),
    )
    out = scoring.personality_branch(rows).drop("who", "known", "technical")
    return out.withColumn("red_flags", F.array_join("red_flags", "|"))
