"""Spread of items over sources, countries and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.runs import running
from trailmark.sources.rules import GEO_RULES

ORDER = ["ts", "event_id"]

# fixed values: counts at which a spread warning is raised
MILESTONES = [10, 50, 100]
MILESTONE_STEP = 500


def detection_sequence(sightings: DataFrame, run_rows: int | None = None) -> DataFrame:
    """Running detection number per item; number 1 registers it, later ones re-detect it."""
    out = running(
        sightings, ["video_hash"], ORDER,
        row_number="detection_no", run_rows=run_rows,
    )
    event = F.when(F.col("detection_no") == 1, "registered").otherwise("redetected")
    return out.withColumn("event_kind", event)


def same_ip_reuploads(
    sightings: DataFrame, run_rows: int | None = None, rules: DataFrame | None = None
) -> DataFrame:
    """Second and later uploads of an item by one source, with the seconds since its first.

    ``rules``, one row per item, are attached where given.
    """
    out = running(
        sightings, ["video_hash", "ip_hash"], ORDER,
        row_number="upload_count", running_min={"_first": "seconds"}, run_rows=run_rows,
        attach=rules, attach_on=["video_hash"],
    )
    return (
        out.where("upload_count >= 2")
        .withColumn("seconds_since_first", F.col("seconds") - F.col("_first"))
        .drop("_first")
    )


def first_country_events(
    sightings: DataFrame, run_rows: int | None = None, rules: DataFrame | None = None
) -> DataFrame:
    """Every sighting with its number, first-in-country flag, running countries, previous country.

    ``rules``, one row per item, are attached where given.
    """
    return running(
        sightings, ["video_hash"], ORDER,
        row_number="spread_count", lag={"previous_country": "country"},
        distinct=("country", "is_new_country", "unique_countries"), run_rows=run_rows,
        attach=rules,
    )


def new_country_spread(sightings: DataFrame, run_rows: int | None = None) -> DataFrame:
    """First sighting in a country that is not the item's first sighting."""
    rows = first_country_events(sightings, run_rows)
    return rows.where(F.col("is_new_country") & (F.col("spread_count") > 1))


def viral_milestones(sightings: DataFrame, run_rows: int | None = None) -> DataFrame:
    n = F.col("spread_count")
    rows = first_country_events(sightings, run_rows)
    return rows.where(n.isin(MILESTONES) | (n % MILESTONE_STEP == 0))


def threshold_crossings(
    sightings: DataFrame, rules: DataFrame, run_rows: int | None = None
) -> DataFrame:
    """Events whose running count is a multiple of the item's detection or spread threshold."""
    rows = first_country_events(sightings, run_rows, rules)
    n = F.col("spread_count")
    hits = rows.where("enabled").withColumns(
        {
            "crosses_detection": n % F.col("detection_threshold") == 0,
            "crosses_spread": n % F.col("spread_threshold") == 0,
        }
    )
    return hits.where("crosses_detection or crosses_spread")


def trailing_counts(
    sightings: DataFrame, keys: list[str], window_seconds: int, slot_seconds: int = 86_400
) -> DataFrame:
    """Events in the trailing window, one row per key and second that has an event.

    Rows are first counted per second, so that one slot of a key holds at most
    ``slot_seconds + window_seconds`` rows however hot the key is; the tail of each slot is
    repeated at the head of the next, so no window looks outside its slot.
    """
    slot = F.floor(F.col("seconds") / slot_seconds)
    into = F.col("seconds") % slot_seconds
    needed_next = into >= slot_seconds - window_seconds
    per_second = sightings.groupBy(*keys, "seconds").agg(F.count(F.lit(1)).alias("events"))
    spread = per_second.withColumn(
        "_slot", F.explode(F.when(needed_next, F.array(slot, slot + 1)).otherwise(F.array(slot)))
    )
    trailing = (
        Window.partitionBy(*keys, "_slot").orderBy("seconds").rangeBetween(-window_seconds, 0)
    )
    return (
        spread.withColumn("events_in_window", F.sum("events").over(trailing))
        .where(F.col("_slot") == slot)
        .drop("_slot")
    )


def rapid_spread(
    sightings: DataFrame,
    threshold: int = GEO_RULES["rapid_spread_threshold"],
    window_seconds: int = GEO_RULES["velocity_window_seconds"],
) -> DataFrame:
    """Seconds at which an item had more than ``threshold`` events in the trailing window."""
    counts = trailing_counts(sightings, ["video_hash"], window_seconds)
    return counts.where(F.col("events_in_window") > threshold)


def rapid_reupload(
    sightings: DataFrame,
    threshold: int = GEO_RULES["rapid_reupload_threshold"],
    window_seconds: int = GEO_RULES["rapid_window_seconds"],
) -> DataFrame:
    counts = trailing_counts(sightings, ["video_hash", "ip_hash"], window_seconds)
    return counts.where(F.col("events_in_window") >= threshold)


def city_escalation(
    sightings: DataFrame, threshold: int = GEO_RULES["city_threshold"], run_rows: int | None = None
) -> DataFrame:
    """Events that bring an item to a new city once the country has ``threshold`` cities or more."""
    rows = running(
        sightings, ["video_hash", "country"], ORDER,
        distinct=("city", "is_new_city", "unique_cities"), run_rows=run_rows,
    )
    return rows.where(F.col("is_new_city") & (F.col("unique_cities") >= threshold))


def ip_upload_counts(sightings: DataFrame) -> DataFrame:
    return sightings.groupBy("video_hash", "ip_hash").agg(
        F.count(F.lit(1)).alias("upload_count"), F.min("ts").alias("first_upload")
    )


def country_counts(sightings: DataFrame) -> DataFrame:
    return sightings.groupBy("video_hash", "country").agg(F.count(F.lit(1)).alias("spread_count"))


def unique_countries(sightings: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return sightings.groupBy("video_hash").agg(count("country").alias("unique_countries"))


def location_summary(sightings: DataFrame, with_totals: bool = False) -> DataFrame:
    """Per country and city: events, first, last; optionally the country and grand totals."""
    by = sightings.rollup if with_totals else sightings.groupBy
    return by("country", "city").agg(
        F.count(F.lit(1)).alias("spread_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def sightings_with_lineage(sightings: DataFrame, lineage: DataFrame) -> DataFrame:
    """Sightings of registered items with the item's generation and verdict."""
    facts = lineage.select("video_hash", "generation", "is_deepfake")
    return sightings.drop("is_deepfake").join(facts, "video_hash")


def family_semi(sightings: DataFrame, family: DataFrame) -> DataFrame:
    return sightings.join(family.select("video_hash"), "video_hash", "left_semi")


def spread_timeline(sightings: DataFrame, lineage: DataFrame, family: DataFrame) -> DataFrame:
    rows = sightings_with_lineage(family_semi(sightings, family), lineage)
    return rows.orderBy("ts", "event_id")


def spread_locations(sightings: DataFrame, lineage: DataFrame) -> DataFrame:
    """Origins and sightings that have coordinates, as map markers in time order."""
    origin = lineage.where("origin_latitude is not null and origin_longitude is not null").select(
        F.lit("origin").alias("kind"),
        "video_hash",
        F.col("first_seen").alias("ts"),
        F.coalesce("source_platform", F.lit("Direct Upload")).alias("platform"),
        F.col("origin_country").alias("country"),
        F.col("origin_city").alias("city"),
        F.col("origin_latitude").alias("latitude"),
        F.col("origin_longitude").alias("longitude"),
        "is_deepfake",
        "generation",
        F.when(F.col("is_deepfake"), "red").otherwise("green").alias("marker_color"),
    )
    placed = sightings.where("latitude is not null and longitude is not null")
    spread = sightings_with_lineage(placed, lineage).select(
        F.lit("spread").alias("kind"),
        "video_hash",
        "ts",
        "platform",
        "country",
        "city",
        "latitude",
        "longitude",
        "is_deepfake",
        "generation",
        F.when(F.col("is_deepfake"), "orange").otherwise("blue").alias("marker_color"),
    )
    both = origin.unionByName(spread)
    return both.withColumn("short_hash", F.concat(F.substring("video_hash", 1, 12), F.lit("...")))


def spread_summary(locations: DataFrame) -> DataFrame:
    """Marker counts and the sorted country list over a set of markers."""
    return locations.agg(
        F.count(F.lit(1)).alias("total_locations"),
        F.count_distinct("country").alias("unique_countries"),
        F.array_join(F.sort_array(F.collect_set("country")), ",").alias("countries"),
        F.count_if(F.col("kind") == "origin").alias("origin_count"),
        F.count_if(F.col("kind") == "spread").alias("spread_count"),
    )


def generation_links(locations: DataFrame, family: str = "family") -> DataFrame:
    """Lines from one generation to the next present one within a family.

    Every location of one generation is linked to every location of the next; equal locations
    are folded first, so the number of lines depends on places, not on events.
    """
    located = locations.where(
        "latitude is not null and longitude is not null and latitude <> 0 and longitude <> 0"
    )
    places = located.groupBy(family, "generation", "latitude", "longitude").agg(
        F.max("is_deepfake").alias("is_deepfake"), F.count(F.lit(1)).alias("events")
    )
    # next present generation: one row per family and generation, so this window is tiny
    present = locations.select(family, "generation").distinct()
    steps = present.withColumn(
        "next_generation",
        F.lead("generation").over(Window.partitionBy(family).orderBy("generation")),
    ).where("next_generation is not null")
    start = places.join(steps, [family, "generation"]).select(
        family,
        "generation",
        "next_generation",
        F.col("latitude").alias("from_latitude"),
        F.col("longitude").alias("from_longitude"),
        F.col("events").alias("from_events"),
    )
    end = places.select(
        family,
        F.col("generation").alias("next_generation"),
        F.col("latitude").alias("to_latitude"),
        F.col("longitude").alias("to_longitude"),
        F.col("events").alias("to_events"),
        F.when(F.col("is_deepfake"), "#ff4757").otherwise("#2ed573").alias("color"),
    )
    return start.join(end, [family, "next_generation"])


def geo_cluster(sightings: DataFrame, radius_km: float = GEO_RULES["cluster_radius_km"]) -> DataFrame:
    """Grid cell of about the radius, and the great-circle distance to the cell's centre."""
    step = radius_km / 111.195
    lat, lon = F.col("latitude"), F.col("longitude")
    row = F.floor(lat / step)
    centre_lat = (row + 0.5) * step
    # cells narrow with latitude so that they keep the same width in kilometres
    lon_step = step / F.greatest(F.cos(F.radians(centre_lat)), F.lit(0.01))
    col = F.floor(lon / lon_step)
    centre_lon = (col + 0.5) * lon_step
    half = (
        F.pow(F.sin(F.radians(lat - centre_lat) / 2), 2)
        + F.cos(F.radians(lat))
        * F.cos(F.radians(centre_lat))
        * F.pow(F.sin(F.radians(lon - centre_lon) / 2), 2)
    )
    return sightings.where("latitude is not null and longitude is not null").withColumns(
        {
            "cell": F.concat_ws(":", row, col),
            "km_to_centre": F.asin(F.sqrt(half)) * 2 * 6371.0088,
        }
    )
