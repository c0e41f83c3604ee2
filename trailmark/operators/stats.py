"""Statistics, dashboards and reports: combining aggregates over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.decide import verdict

# fixed values
MS_SAVED_PER_HIT = 3000
KNOWN_PLATFORMS = ["youtube", "tiktok", "twitter", "instagram", "upload", "url"]


def _n() -> Column:
    return F.count(F.lit(1))


def registry_stats(registry: DataFrame) -> DataFrame:
    out = registry.agg(
        _n().alias("total_entries"),
        F.count_if("is_deepfake").alias("deepfake_count"),
        F.coalesce(F.sum("detection_count"), F.lit(0)).alias("total_lookups"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"),
    )
    hits = F.col("total_lookups") - F.col("total_entries")
    return out.withColumns(
        {
            "authentic_count": F.col("total_entries") - F.col("deepfake_count"),
            "cache_hits": F.greatest(F.lit(0), hits),
            "cache_hit_rate": F.when(hits > 0, hits / F.col("total_lookups")).otherwise(0.0),
        }
    )


def registry_totals(registry: DataFrame) -> DataFrame:
    return registry.agg(
        _n().alias("total"),
        F.count_if("is_deepfake").alias("deepfakes"),
        F.count_if(~F.col("is_deepfake")).alias("authentic"),
    )


def lineage_by_verdict(lineage: DataFrame) -> DataFrame:
    return lineage.groupBy("is_deepfake").agg(_n().alias("count"))


def generation_histogram(lineage: DataFrame) -> DataFrame:
    return lineage.groupBy("generation").agg(_n().alias("count")).orderBy("generation")


def platform_distribution(sightings: DataFrame, known: list[str] = KNOWN_PLATFORMS) -> DataFrame:
    """Events per platform; platforms outside the list count as uploads."""
    name = F.lower("platform")
    shown = F.when(name.isin(known), name).otherwise("upload")
    return (
        sightings.groupBy(shown.alias("platform"))
        .agg(_n().alias("count"))
        .orderBy(F.desc("count"), "platform")
    )


def lineage_summary(lineage: DataFrame) -> DataFrame:
    out = lineage.agg(
        _n().alias("total_videos"),
        F.count_if("is_deepfake").alias("deepfakes"),
        F.count_if(~F.col("is_deepfake")).alias("authentic"),
        F.count_if(F.col("generation") == 0).alias("unique_families"),
    )
    families = F.greatest(F.col("unique_families"), F.lit(1))
    return out.withColumn(
        "avg_mutations_per_family", (F.col("total_videos") - F.col("unique_families")) / families
    )


def dashboard(detections: DataFrame) -> DataFrame:
    out = detections.agg(
        _n().alias("total_analyzed"),
        F.count_if("is_deepfake").alias("deepfakes_found"),
        F.avg("processing_time").alias("avg_processing_time"),
    )
    rate = F.when(
        F.col("total_analyzed") > 0, F.col("deepfakes_found") / F.col("total_analyzed") * 100
    ).otherwise(0.0)
    return out.withColumns({"detection_rate": rate, "threat_count": F.col("deepfakes_found")})


def daily_counters(sightings: DataFrame, firsts: DataFrame) -> DataFrame:
    """Per day: scans, fakes among new items, cache hits (items seen before) and time saved.

    ``firsts``: video_hash, first_event_id. A scan of an item after its first is a cache hit.
    """
    rows = sightings.join(firsts, "video_hash")
    fresh = F.col("event_id") == F.col("first_event_id")
    out = rows.groupBy(F.to_date("ts").alias("day")).agg(
        _n().alias("scans_total"),
        F.count_if(fresh & F.col("is_deepfake")).alias("deepfakes_found"),
        F.count_if(~fresh).alias("cache_hits"),
    )
    return out.withColumn("time_saved_ms", F.col("cache_hits") * MS_SAVED_PER_HIT)


def weekly_totals(daily: DataFrame, today: Column) -> DataFrame:
    """Sums over the days since a week before ``today``."""
    recent = daily.where(F.col("day") >= F.date_sub(today, 7))
    names = ["scans_total", "deepfakes_found", "cache_hits", "time_saved_ms"]
    return recent.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def peer_snapshot(peers: DataFrame, stale_after: int = 60) -> DataFrame:
    """Peers by role and their latency; zero latency means unknown and is left out."""
    known = F.when(F.col("latency_ms") > 0, F.col("latency_ms"))
    return peers.agg(
        _n().alias("total_peers"),
        F.count_if(F.col("role") == "host").alias("hosts"),
        F.count_if(F.col("role") == "client").alias("clients"),
        F.coalesce(F.avg(known), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.max(known), F.lit(0.0)).alias("max_latency_ms"),
        F.count_if(F.col("age_seconds") > stale_after).alias("stale_peers"),
    )


def active_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count_if("is_active").alias("active_nodes"))


def node_stats(results: DataFrame) -> DataFrame:
    return results.groupBy("node").agg(
        _n().alias("videos_analyzed"), F.count_if("is_deepfake").alias("deepfakes_found")
    )


def authorized_only(events: DataFrame, nodes: DataFrame, owner: int) -> DataFrame:
    """Events of active nodes and of the owner."""
    allowed = nodes.where("is_active").select("node")
    by_owner = events.where(F.col("node") == owner)
    others = events.where(F.col("node") != owner).join(allowed, "node", "left_semi")
    return others.unionByName(by_owner)


def exact_duplicate_groups(uploads: DataFrame) -> DataFrame:
    groups = uploads.groupBy("content_hash").agg(
        _n().alias("times_seen"),
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
    )
    return groups.where("times_seen > 1")


def geo_enrich(events: DataFrame, geo: DataFrame, private: Column, fallback: dict) -> DataFrame:
    """Location of each event's IP; the raw IP column is dropped.

    Private addresses and addresses without an entry get the ``fallback`` place; missing
    names of known addresses become Unknown and XX.
    """
    looked_up = events.join(
        geo.select(*[F.col(c).alias(f"_{c}" if c != "ip" else c) for c in geo.columns], F.lit(True).alias("_known")),
        "ip",
        "left",
    )
    known = F.coalesce("_known", F.lit(False)) & ~private
    empty = {
        "country": "Unknown", "country_code": "XX", "region": "", "city": "", "timezone": "",
        "isp": "", "latitude": 0.0, "longitude": 0.0,
    }
    out = {
        f"geo_{c}": F.when(known, F.coalesce(F.col(f"_{c}"), F.lit(empty[c]))).otherwise(fallback[c])
        for c in empty
    }
    return looked_up.withColumns(out).drop("ip", "_known", *[f"_{c}" for c in geo.columns if c != "ip"])


def forensic_report(
    lineage: DataFrame, origins: DataFrame, family_sizes: DataFrame, sightings: DataFrame, first: int = 5
) -> DataFrame:
    """Report text per item: dates, verdict, origin, mutations, and the first spread events of its family.

    ``lineage`` may have ``mutations``, labels of the item. The rank filter is applied on each
    side of the shuffle, so at most ``first`` events per family and task travel; the rest is
    only counted.
    """
    family = lineage.select("video_hash", "generation").join(origins, "video_hash", "left")
    family = family.select("video_hash", "generation", F.coalesce("origin_hash", "video_hash").alias("_family"))
    events = sightings.select("video_hash", "ts", "event_id", "platform").join(family, "video_hash")
    order = Window.partitionBy("_family").orderBy("ts", "event_id")
    early = events.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= first)
    line = F.concat(
        F.lit("  "),
        F.date_format("ts", "yyyy-MM-dd"),
        F.lit(" | "),
        F.rpad("platform", 12, " "),
        F.lit(" | Gen "),
        F.col("generation").cast("string"),
    )
    shown = early.groupBy("_family").agg(
        F.sort_array(F.collect_list(F.struct("_rn", line.alias("line")))).alias("_e")
    )
    counts = events.groupBy("_family").agg(_n().alias("_total"))
    source = lineage.select(
        F.col("video_hash").alias("origin_hash"),
        F.col("first_seen").alias("_origin_seen"),
        F.col("source_platform").alias("_origin_platform"),
    )
    rows = (
        lineage.join(origins, "video_hash", "left")
        .join(source, "origin_hash", "left")
        .join(family_sizes, "video_hash", "left")
        .withColumn("_family", F.coalesce("origin_hash", "video_hash"))
        .join(shown, "_family", "left")
        .join(counts, "_family", "left")
    )
    labels = F.col("mutations") if "mutations" in lineage.columns else F.array().cast("array<string>")
    mutation = F.transform(labels, lambda m: F.concat(F.lit("  * "), F.initcap(F.replace(m, F.lit("_"), F.lit(" ")))))
    has_origin = F.col("origin_hash").isNotNull()
    tenths = F.floor(F.col("confidence") * 1000 + 0.5)
    percent = F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%")
    )
    more = F.col("_total") - first
    report = F.concat_ws(
        "\n",
        F.concat(F.lit("Video Hash: "), F.substring("video_hash", 1, 32), F.lit("...")),
        F.concat(F.lit("First Seen: "), F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss")),
        F.concat(F.lit("Platform: "), F.coalesce("source_platform", F.lit("Unknown"))),
        F.concat(
            F.lit("Status: "),
            F.when(F.col("is_deepfake"), "DEEPFAKE DETECTED").otherwise("Appears Authentic"),
        ),
        F.concat(F.lit("Verdict: "), verdict(F.col("is_deepfake"), F.col("confidence"))),
        F.concat(F.lit("Confidence: "), percent),
        F.when(
            has_origin,
            F.concat(F.lit("Origin Hash: "), F.substring("origin_hash", 1, 32), F.lit("...")),
        ).otherwise("This appears to be an original/first-seen video"),
        F.when(has_origin, F.concat(F.lit("Origin Date: "), F.date_format("_origin_seen", "yyyy-MM-dd HH:mm:ss"))),
        F.when(has_origin, F.concat(F.lit("Origin Platform: "), F.coalesce("_origin_platform", F.lit("Unknown")))),
        F.concat(
            F.lit("Current Generation: "), F.col("generation").cast("string"), F.lit(" (0 = original)")
        ),
        F.concat(F.lit("Total Family Members: "), F.col("family_members").cast("string")),
        F.when(F.size(mutation) > 0, F.array_join(F.concat(F.array(F.lit("Detected Mutations:")), mutation), "\n")),
        F.array_join(F.transform("_e", lambda e: e["line"]), "\n"),
        F.when(more > 0, F.concat(F.lit("  ... and "), more.cast("string"), F.lit(" more events"))),
    )
    return rows.select("video_hash", report.alias("report"))
