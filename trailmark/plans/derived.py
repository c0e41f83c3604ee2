"""Views that give the given tables the shape of media-provenance data.

Each view is a lazy DataFrame over the whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import bits

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds_of(column: str = "ts"):
    """Whole epoch seconds of a zone-less timestamp, independent of the session time zone."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, {column})")


def sightings_from(events: DataFrame, nation: DataFrame) -> DataFrame:
    """Sighting rows from event rows; works on a batch or a stream of events."""
    user = F.col("user_id")
    item = F.get_json_object("props", "$.k").cast("int")
    shaped = events.select(
        "event_id",
        "ts",
        item.alias("item"),
        F.sha2(item.cast("string"), 256).alias("video_hash"),
        F.concat(
            F.when(user % 10 == 0, F.lit("10.0.0.")).otherwise(F.lit("203.0.113.")),
            user.cast("string"),
        ).alias("ip"),
        (user % 25).cast("int").alias("n_nationkey"),
        (user % 3).cast("string").alias("_city"),
        F.col("event_type").alias("platform"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"),
        (item % 3 == 0).alias("is_deepfake"),
    )
    places = nation.select(
        "n_nationkey",
        F.col("n_name").alias("country"),
        (F.col("n_nationkey") * 7 - 84).cast("double").alias("_lat"),
        (F.col("n_nationkey") * 14 - 168).cast("double").alias("_lon"),
    )
    located = F.col("event_id") % 17 != 0
    return shaped.join(places, "n_nationkey").select(
        "event_id",
        "ts",
        "item",
        "video_hash",
        "ip",
        F.sha2("ip", 256).alias("ip_hash"),
        "country",
        F.concat("country", F.lit("_C"), "_city").alias("city"),
        F.when(located, F.col("_lat")).alias("latitude"),
        F.when(located, F.col("_lon")).alias("longitude"),
        "platform",
        "confidence",
        "is_deepfake",
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sightings_from(table(spark, sf_dir, "events"), table(spark, sf_dir, "nation"))
    return rows.withColumn("seconds", seconds_of())


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings folded onto five items: denser event streams per item."""
    dense = (F.col("item") % 5).cast("int")
    return sightings(spark, sf_dir).withColumns(
        {"item": dense, "video_hash": F.sha2(dense.cast("string"), 256)}
    )


def item_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lineage row per sighted item: item k >= 10 descends from item k div 3."""
    k = F.col("item")
    first = F.min_by(
        F.struct("ts", "platform", "country", "city", "latitude", "longitude", "confidence"),
        F.struct("ts", "event_id"),
    )
    parent = F.when(k >= 10, F.floor(k / 3).cast("int"))
    generation = (
        F.when(k < 10, 0).when(k < 30, 1).when(k < 90, 2).when(k < 270, 3).otherwise(4).cast("int")
    )
    return (
        sightings(spark, sf_dir)
        .groupBy("item", "video_hash", "is_deepfake")
        .agg(first.alias("f"))
        .select(
            "video_hash",
            F.sha2(parent.cast("string"), 256).alias("parent_hash"),
            generation.alias("generation"),
            F.col("f.ts").alias("first_seen"),
            F.col("f.platform").alias("source_platform"),
            "is_deepfake",
            F.col("f.confidence").alias("confidence"),
            F.col("f.country").alias("origin_country"),
            F.col("f.city").alias("origin_city"),
            F.col("f.latitude").alias("origin_latitude"),
            F.col("f.longitude").alias("origin_longitude"),
            (k % 10).cast("int").alias("family"),
        )
    )


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IP dimension; every 13th IP is left out so that the default branch is used."""
    users = table(spark, sf_dir, "events").select("user_id").where("user_id % 13 <> 0").distinct()
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return users.join(nation, F.col("user_id") % 25 == F.col("n_nationkey")).select(
        F.concat(F.lit("203.0.113."), F.col("user_id").cast("string")).alias("ip"),
        F.col("n_name").alias("country"),
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("country_code"),
        F.col("r_name").alias("region"),
        F.concat("n_name", F.lit("_C"), (F.col("user_id") % 3).cast("string")).alias("city"),
        F.lit("UTC").alias("timezone"),
        F.when(F.col("user_id") % 2 == 0, "Even Net").alias("isp"),
        (F.col("n_nationkey") * 7 - 84).cast("double").alias("latitude"),
        (F.col("n_nationkey") * 14 - 168).cast("double").alias("longitude"),
    )


def base_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", bits.median_bits(F.col("embedding")).alias("bits")
    )


def media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four planted variants per embedding; variant v flips 3v bits of frame v."""
    variants = base_bits(spark, sf_dir).withColumn(
        "variant", F.explode(F.sequence(F.lit(0), F.lit(3)))
    )
    flips = F.col("variant") * 3
    frames = []
    for f in range(bits.FRAMES):
        turned = (
            F.concat(
                F.substr("bits", F.lit(7 * f + 1), F.lit(64)),
                F.substr("bits", F.lit(1), F.lit(7 * f)),
            )
            if f
            else F.col("bits")
        )
        flipped = F.concat(
            F.translate(F.substr(turned, F.lit(1), flips), "01", "10"),
            F.substr(turned, flips + 1, F.lit(64)),
        )
        frames.append(bits.bits_to_hex(F.when(F.col("variant") == f, flipped).otherwise(turned)))
    place = F.when(F.col("vec_id") % 3 == 1, 3 - F.col("variant")).otherwise(F.col("variant"))
    hours = ((F.col("vec_id") * 7 + place * 13) % 1009).cast("int")
    return variants.select(
        "vec_id",
        "label",
        "variant",
        F.sha2(
            F.concat(
                F.lit("v"),
                F.col("vec_id").cast("string"),
                F.lit("-"),
                F.col("variant").cast("string"),
            ),
            256,
        ).alias("video_hash"),
        F.concat_ws("-", *frames).alias("perceptual_hash"),
        F.expr("timestampadd(HOUR, 1, TIMESTAMP_NTZ'2023-12-31 23:00:00')").alias("_start"),
        hours.alias("_hours"),
    ).select(
        "vec_id",
        "label",
        "variant",
        "video_hash",
        "perceptual_hash",
        F.expr("timestampadd(HOUR, _hours, _start)").alias("first_seen"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec, var, label = F.col("vec_id"), F.col("variant"), F.col("label")
    flags = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: i <= label % 4),
        lambda i: F.concat(F.lit("flag"), i.cast("string")),
    )
    return media_fingerprints(spark, sf_dir).select(
        "*",
        (((vec * 37 + var * 5) % 101) / 100).alias("lipsync_score"),
        F.when(vec % 5 != 0, ((vec * 53 + 11) % 101) / 100).alias("fact_check_score"),
        (((vec * 29 + var) % 101) / 100).alias("confidence"),
        (label % 3 == 0).alias("is_deepfake"),
        (label % 4 == 0).alias("celebrity_detected"),
        F.element_at(
            F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), (label % 3 + 1).cast("int")
        ).alias("risk"),
        flags.alias("red_flags"),
        F.when(vec % 7 == 0, "CONFIRMED_FAKE")
        .when(vec % 7 == 1, "CONFIRMED_REAL")
        .otherwise("UNKNOWN")
        .alias("news_verdict"),
        ((vec % 50) / 10).alias("processing_time"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    return (
        detections(spark, sf_dir)
        .where((vec % 2 == 0) | (F.col("variant") == 0))
        .withColumn("detection_count", (vec % 5 + 1).cast("bigint"))
        .withColumn("_days", (vec % 120).cast("int"))
        .withColumn("last_seen", F.expr("timestampadd(DAY, _days, first_seen)"))
        .select(
            "video_hash",
            "perceptual_hash",
            "vec_id",
            "variant",
            "is_deepfake",
            "confidence",
            "lipsync_score",
            "fact_check_score",
            "first_seen",
            "last_seen",
            "detection_count",
        )
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review replies in the layout each parser reads; some empty, cut short or in lower case."""
    docs = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    d = F.col("doc_id")
    quality, toxic = F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))
    head = F.regexp_replace("text", "[^A-Za-z ]", "")

    def pick(by, *values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))

    level = pick(d, "LOW", "MEDIUM", "HIGH")
    yes = F.when(toxic == 1, "YES").otherwise("NO")
    n = lambda m: (d % m).cast("string")
    layouts = {
        "artifact": [("SCORE: ", n(11)), ("REASONING: ", head), ("CONFIDENCE: ", level)],
        "celebrity": [
            ("CELEBRITY_DETECTED: ", pick(d, "YES", "NO")),
            ("LIKELY_PERSON: ", pick(d, "Unknown", "Ada Example", "Bo Sample")),
            ("NEWS_CONTEXT: ", head),
            ("RISK_LEVEL: ", level),
        ],
        "news": [
            ("NEWS_MATCHES: ", n(7)),
            ("SOURCES: ", pick(d, "none", "alpha, beta", "gamma,, delta ,")),
            ("VERDICT: ", pick(d, "CONFIRMED_REAL", "CONFIRMED_FAKE", "UNKNOWN")),
            ("REASONING: ", head),
            ("CONFIDENCE: ", level),
        ],
        "personality": [
            ("PERSON_IDENTIFIED: ", pick(d, "YES", "NO")),
            ("IDENTITY: ", pick(d, "Unknown Person", "Ada Example", "none", "Bo Sample")),
            ("CONFIDENCE: ", level),
            ("CATEGORY: ", pick(d, "POLITICIAN", "BUSINESS", "SPORTS", "OTHER", "ALIEN")),
            ("REASONING: ", head),
        ],
        "verdict": [
            ("IS_DEEPFAKE: ", pick(d, "YES", "NO", "UNCERTAIN")),
            ("CONFIDENCE: ", n(131)),
            ("AUTHENTICITY_SCORE: ", F.concat(n(12), F.lit(".5"))),
            ("REASONING: ", head),
            ("RED_FLAGS: ", pick(d, "none", "blur, halo", "none detected", "jitter")),
            ("TECHNICAL_ARTIFACTS: ", pick(d, "none found", "seams,noise")),
            ("CONTEXTUAL_ISSUES: ", pick(d, "none", "wrong place, old clip")),
            ("ARTIFACTS_FOUND: ", pick(d, "ringing, banding", "none")),
            ("RECOMMENDATION: ", pick(d, "TRUST", "VERIFY", "REJECT")),
        ],
        "technical": [
            ("IS_DEEPFAKE: ", pick(d + 1, "YES", "NO", "UNCERTAIN")),
            ("CONFIDENCE: ", n(97)),
            ("AUTHENTICITY_SCORE: ", F.concat(n(9), F.lit(".5"))),
            ("REASONING: ", head),
            ("ARTIFACTS_FOUND: ", pick(d + 1, "seams, ghosting", "none", "halo")),
            ("RECOMMENDATION: ", pick(d + 1, "TRUST", "VERIFY", "REJECT")),
        ],
        "verifier": [
            ("VERDICT: ", pick(d, "REAL", "FAKE", "UNCERTAIN")),
            ("CONFIDENCE: ", n(101)),
            ("MANIPULATION_SCORE: ", n(11)),
            ("LIP_SYNC_ISSUES: ", yes),
            ("FACE_BLENDING_ARTIFACTS: ", pick(d, "NO", "YES")),
            ("LIGHTING_INCONSISTENCIES: ", pick(quality, "YES", "NO")),
            ("TEMPORAL_ANOMALIES: ", pick(d, "YES", "NO", "NO")),
            ("TEXTURE_ABNORMALITIES: ", pick(d, "NO", "NO", "NO", "YES")),
            ("REASONING: ", head),
            ("DETAILED_ANALYSIS: ", head),
        ],
    }

    def layout(fields):
        kept = [
            F.concat(F.lit(name), value, F.lit("\n"))
            if i != 1
            else F.when(d % 11 == 0, F.lit("")).otherwise(
                F.concat(F.lit(name), value, F.lit("\n"))
            )
            for i, (name, value) in enumerate(fields)
        ]
        whole = F.concat(*kept)
        return F.when(d % 9 == 0, F.lit("")).when(d % 13 == 0, F.lower(whole)).otherwise(whole)

    return docs.select("doc_id", *[layout(v).alias(f"{k}_reply") for k, v in layouts.items()])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded 8x8 grey frames: one clip per block of 50 vectors, in vector order."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 50).alias("video_id"),
        (F.col("vec_id") % 50).cast("int").alias("frame_idx"),
        F.transform("embedding", lambda x: (x.cast("double") + 1) * 127.5).alias("pixels"),
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {
        "1-URGENT": "register_video",
        "2-HIGH": "spread_event",
        "3-MEDIUM": "lineage",
        "4-NOT SPECIFIED": "record_spread",
    }
    kind = F.lit("check_thresholds")
    for priority, name in kinds.items():
        kind = F.when(F.col("o_orderpriority") == priority, name).otherwise(kind)
    key = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "O", F.when(key % 3 == 0, "retrying").otherwise("queued"))
        .when(F.col("o_orderstatus") == "F", F.when(key % 4 == 0, "failed").otherwise("confirmed"))
        .otherwise("pending")
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        kind.alias("tx_type"),
        status.alias("status"),
        (key % 6).cast("int").alias("retries"),
        F.lit(5).alias("max_retries"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_custkey").alias("node"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("node"),
        F.when(F.col("s_nationkey") % 2 == 0, "pi").otherwise("laptop").alias("node_type"),
        (F.col("s_acctbal") > 0).alias("is_active"),
    )


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("peer"),
        F.when(F.col("s_nationkey") % 2 == 0, "host").otherwise("client").alias("role"),
        F.greatest(F.lit(0.0), F.col("s_acctbal") / 100).alias("latency_ms"),
        (F.col("s_suppkey") % 120).alias("age_seconds"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .withColumn("_m", F.col("doc_id").cast("int"))
        .select(
            "doc_id",
            F.sha2("text", 256).alias("content_hash"),
            F.expr("timestampadd(MINUTE, _m, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("seen_at"),
            "source",
        )
    )
