"""Structured Streaming jobs. Each takes a stream and returns a stream or starts a query.

Rows later than the watermark are dropped by the built-in stateful operators; ``late_rows`` keeps them
in a table, and the batch operators over the stored sightings are the correction path. Operators with
custom state give their late rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trailmark import schemas
from trailmark.functions.bits import NUM_BANDS
from trailmark.operators.registry import fold_batch
from trailmark.session import scratch_path
from trailmark.sources import band_index, registry_store
from trailmark.streaming.in_order import CARRIED, DETECTION, ORDER, SIGHTING, AsItComes, Cooldown, Decider, InOrder, LastDetection, Spread

LATENESS = "10 minutes"
#: Seconds of event time after which the state of a quiet item is forgotten.
FORGET = 366 * 86_400
#: How many times the span of a lookup a slot of time is long; a detection in the last of these is carried to the next slot.
SLOT_SPANS = 6


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as they appear; the checkpoint of the query remembers what was read."""
    return (
        spark.readStream.schema(schemas.EVENTS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def stream_sightings(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(schemas.SIGHTINGS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def event_time(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Adds ``at``, the event time as an instant with a watermark."""
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)


# ---- sinks ----------------------------------------------------------------------------------


def _places(spark: SparkSession, label: str, output: str | None, checkpoint: str | None):
    """Where a job writes and where it remembers its place. A job that is to go on after a restart names both."""
    if (output is None) != (checkpoint is None):
        raise ValueError("name the output and the checkpoint of a job, or neither")
    out = scratch_path(spark, label) if output is None else output
    return out, checkpoint or f"{out}/progress"


def run_to_table(
    stream: DataFrame, label: str, output: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Runs an append stream over all available input into a Parquet table and reads it back.

    With ``output`` and ``checkpoint`` a later call goes on where this one ended and returns all
    rows so far; without them every call begins anew in a folder of its own.
    """
    spark = stream.sparkSession
    out, progress = _places(spark, label, output, checkpoint)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def run_updates(
    stream: DataFrame, keys: list[str], label: str, output: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Runs an update stream; the newest row per key is the result.

    Every micro-batch writes its own folder, overwritten on a retry, so a repeated batch
    changes nothing. ``output`` and ``checkpoint`` as in ``run_to_table``.
    """
    spark = stream.sparkSession
    out, progress = _places(spark, label, output, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch_id", LongType())])
    rows = spark.read.schema(schema).parquet(f"{out}/rows")
    values = F.struct(*[c for c in stream.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(values, "batch_id").alias("v")).select(*keys, "v.*")


def run_batches(
    stream: DataFrame, transform, label: str, output: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Applies a batch operator to every micro-batch of all available input; returns all its rows.

    A repeated batch overwrites its own folder. ``output`` and ``checkpoint`` as in ``run_to_table``.
    """
    spark = stream.sparkSession
    out, progress = _places(spark, label, output, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch_id")


# ---- late rows ------------------------------------------------------------------------------


def late_rows(
    stream: DataFrame, label: str = "late", lateness: str = LATENESS, output: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """The rows of a stream that came behind the watermark, with the ``batch_id`` they came in.

    Behind are those not later than the latest time of all earlier micro-batches less the lateness.
    Built-in stateful operators over the same stream drop no other rows; they may still take some of
    these, as they go by the watermark of the batch before and by the end of windows. Rows without
    a time are never behind. Every micro-batch writes its rows and the latest time so far to folders named by its
    number, so a repeated batch changes nothing. ``output`` and ``checkpoint`` as in ``run_to_table``.
    """
    spark = stream.sparkSession
    out, progress = _places(spark, label, output, checkpoint)
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{out}/rows/batch_id=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        known = spark.read.parquet(f"{out}/marks/batch_id={batch_id - 1}").first()["latest"] if batch_id else None
        edge = F.lit(known).cast("bigint") - F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {lateness}"))
        batch.where(at <= edge).write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
        latest = batch.agg(F.greatest(F.max(at), F.lit(known).cast("bigint")).alias("latest"))
        latest.write.mode("overwrite").parquet(f"{out}/marks/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch_id", LongType())])).parquet(f"{out}/rows")


def late_counts(late: DataFrame) -> DataFrame:
    """Late rows per micro-batch and item."""
    return late.groupBy("batch_id", "video_hash").agg(F.count(F.lit(1)).alias("late_rows"))


def corrected(streamed: DataFrame, late: DataFrame, stored: DataFrame, operator, keys: list[str]) -> DataFrame:
    """The result of a stream as it would be had no row come late.

    Result rows are told apart by ``keys``, which late rows have as columns or get from ``operator``. Those
    that a late row belongs to are made again by ``operator`` from the stored rows of its items, all others
    stay, so the work follows the late rows. It makes no difference whether the stream took a late row.
    """
    touched = late if set(keys) <= set(late.columns) else operator(late)
    touched = touched.select(*keys).distinct()
    items = [c for c in keys if c in stored.columns]
    again = operator(stored.join(touched.select(*items).distinct(), items, "left_semi"))
    again = again.join(touched, keys, "left_semi").select(*streamed.columns)
    return streamed.join(touched, keys, "left_anti").unionByName(again)


# ---- operators ------------------------------------------------------------------------------


def stream_spread_counts(sightings: DataFrame) -> DataFrame:
    """Running events, first and last time per item (update mode)."""
    return sightings.groupBy("video_hash").agg(
        F.count(F.lit(1)).alias("spread_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def stream_velocity(
    sightings: DataFrame, window: str = "1 hour", slide: str = "10 minutes"
) -> DataFrame:
    """Events per item and sliding window."""
    span = F.window("at", window, slide)
    counted = event_time(sightings).groupBy("video_hash", span.alias("w")).agg(
        F.count(F.lit(1)).alias("events")
    )
    return counted.select(
        "video_hash",
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "events",
    )


def stream_reupload_bursts(
    sightings: DataFrame, gap: str = "30 minutes", least: int = 3
) -> DataFrame:
    """Sessions of uploads of an item by one source, with enough uploads.

    An upload that follows the one before by ``gap`` or more begins a session. On a stream a session comes
    out when the watermark has passed its end. Those still open are ``open_sessions`` of the stored rows.
    """
    # windows that touch are one to Spark, so they are the least unit of time shorter than the session
    window = F.session_window("at", f"{gap} -1 microsecond")
    counted = (
        event_time(sightings)
        .groupBy("video_hash", "ip_hash", window.alias("s"))
        .agg(F.count(F.lit(1)).alias("uploads"))
    )
    return counted.where(F.col("uploads") >= least).select(
        "video_hash",
        "ip_hash",
        F.col("s.start").alias("session_start"),
        (F.col("s.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("session_end"),
        "uploads",
    )


def open_sessions(
    stored: DataFrame, gap: str = "30 minutes", least: int = 3, lateness: str = LATENESS
) -> DataFrame:
    """The sessions of stored sightings that a stream over them has not closed yet."""
    sessions = stream_reupload_bursts(stored, gap, least)
    last = F.max(F.col("ts").cast("timestamp")) - F.expr(f"INTERVAL {lateness}")
    # one number: the watermark that the stream ended with, which has whole milliseconds
    mark = stored.agg(F.unix_millis(last) * 1000).first()[0]
    return sessions.where(F.unix_micros("session_end") - 1 > F.lit(mark))


def _decided(rows: DataFrame, keys: list[str], decider: Decider, schema: str, lateness: str | None, ttl: str | int | None):
    """Rows of ``keys``, ``seconds``, ``event_id`` and the decider's fields through custom state."""
    if lateness is None:
        processor, mode = AsItComes(decider, ttl), "ProcessingTime" if ttl else "None"
    else:
        processor, mode = InOrder(decider, ttl), "EventTime"
    # a null would turn whole numbers into floats on their way to Python
    values = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ORDER] + [F.isnotnull("event_id").alias("is_row")]
    # the event time itself is left out, or Spark would drop late rows before they are counted
    return rows.select(*keys, *values, *decider.FIELDS).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode
    )


def stream_alerts(
    candidates: DataFrame, cooldown_seconds: int = 300, lateness: str | None = None, forget_seconds: int = FORGET
) -> DataFrame:
    """Alerts that outlive the cooldown. The state is one number per item and alert type.

    Needs the RocksDB state store and columns video_hash, alert_type, seconds, event_id. Without
    ``lateness`` micro-batches must come in order of time. With it candidates (and their ``ts``) may come
    in any order within it: they are decided in order once the watermark has passed them. A column
    ``late`` then marks candidates that came after later ones of their key had been decided; these are no
    alerts. Rows without event_id are heartbeats: they move the watermark on where a source is quiet.
    A missing second counts as 0, which is late for all keys that have later rows.
    A micro-batch may bring one key many candidates; ``maxFilesPerTrigger`` of the source bounds them.
    """
    keys, schema = ["video_hash", "alert_type"], "video_hash string, alert_type string, seconds bigint, event_id bigint"
    if lateness is None:
        return _decided(candidates, keys, Cooldown(cooldown_seconds), schema, None, None)
    forget = max(forget_seconds, cooldown_seconds)
    return _decided(event_time(candidates, lateness), keys, Cooldown(cooldown_seconds, True), f"{schema}, late boolean", lateness, forget)


def stream_spread_events(
    sightings: DataFrame, ttl_ms: int | None = None, lateness: str | None = None, forget_seconds: int = FORGET
) -> DataFrame:
    """What a sighting tells about its item, given all before it: one row per finding.

    ``reupload`` (number: uploads of the source so far, detail: seconds since its first),
    ``spread`` (a first sighting in a country that is not the item's first; previous_country,
    country, number: countries so far) and ``viral`` (number: sightings so far, at milestones;
    detail: countries so far). Needs the RocksDB state store.

    Without ``lateness`` micro-batches must come in order of time; state expires ``ttl_ms`` after its last
    change, if given. With ``lateness`` sightings may come in any order within it: they are decided in
    order once the watermark has passed them, and those that come after later ones of their item have
    been decided are findings ``late`` (country; detail: by how many seconds). An item without a sighting
    for ``forget_seconds`` of event time is forgotten. Rows without event_id are heartbeats: they move
    the watermark on where a source is quiet. State is one row per item, country and source, and the
    sightings that wait.
    """
    columns = [F.coalesce(c, F.lit("")).alias(c) if c in Spread.FIELDS else F.col(c) for c in ("video_hash", *ORDER, *Spread.FIELDS)]
    schema = (
        "video_hash string, event_id bigint, kind string, previous_country string, "
        "country string, number bigint, detail bigint"
    )
    if lateness is None:
        return _decided(sightings.select(*columns), ["video_hash"], Spread(), schema, None, ttl_ms)
    rows = event_time(sightings, lateness).select(*columns)
    return _decided(rows, ["video_hash"], Spread(), schema, lateness, forget_seconds)


def stream_first_countries(sightings: DataFrame) -> DataFrame:
    """First arrival of an item in a country; state is one row per item and country."""
    return sightings.dropDuplicates(["video_hash", "country"])


def stream_dedup(uploads: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """The first upload of each key, whatever files or micro-batches they come in.

    State is one entry per key for ever. With ``within`` an entry expires when the watermark has
    passed its time by that much, and a key that comes again later passes again.
    """
    if within is None:
        return uploads.dropDuplicates(keys)
    return event_time(uploads, within).dropDuplicatesWithinWatermark(keys)


def stream_lookup(stream: DataFrame, registry: DataFrame) -> DataFrame:
    """Each arrival with the stored result of its content hash, if any (stream-static join)."""
    known = registry.select("video_hash", F.col("first_seen").alias("known_since"))
    return stream.join(known, "video_hash", "left")


def stream_tiered_lookup(
    arrivals: DataFrame,
    registry: DataFrame | None,
    label: str = "tiered-lookup",
    output: str | None = None,
    checkpoint: str | None = None,
    index: str | None = None,
    **options,
) -> DataFrame:
    """Every arrival with its best stored match: content hash, hash code, nearest code.

    The tiers are those of the batch operator. Each micro-batch reads the folders of a stored band
    index that its items ask for. ``index`` names one that is kept up by ``band_index.append``, whose
    versions the next micro-batch sees; without it one is written of ``registry``, once.
    """
    if index is None:
        index = scratch_path(arrivals.sparkSession, "band-index")
        band_index.append(registry, index, 0, options.get("num_bands", NUM_BANDS))
    return run_batches(arrivals, lambda batch: band_index.lookup(batch, index, **options), label, output, checkpoint)


def stream_detection_sighting_join(
    detections: DataFrame, sightings: DataFrame, within: str = "1 hour"
) -> DataFrame:
    """Sightings of an item that follow a detection of it by at most ``within``.

    Both sides carry a watermark and the time range bounds the state of the join. Rows meet by item and
    slot of time, as long as ``within``: a sighting is looked up in its own slot and in the one before, where
    each detection lies once. So the work follows the pairs and not the rows that an item has in state.
    """
    width = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {within}"))

    def slot(at: str) -> Column:
        return F.unix_micros(at) - F.pmod(F.unix_micros(at), width)

    found = event_time(detections).select(
        F.col("video_hash").alias("detected_hash"),
        F.col("event_id").alias("detection_id"),
        F.col("at").alias("detected_at"),
        slot("at").alias("detected_slot"),
    )
    seen = event_time(sightings).select(
        "video_hash",
        "event_id",
        F.col("at").alias("seen_at"),
        F.explode(F.array(slot("at"), slot("at") - width)).alias("seen_slot"),
    )
    return found.join(
        seen,
        F.expr(
            "video_hash = detected_hash AND seen_slot = detected_slot AND seen_at > detected_at "
            f"AND seen_at <= detected_at + INTERVAL {within}"
        ),
    ).select("video_hash", "detection_id", "event_id")


def stream_last_detection(
    detections: DataFrame, sightings: DataFrame, within_seconds: int = 3600, lateness: str = LATENESS
) -> DataFrame:
    """Each sighting that follows a detection of its item by at most ``within_seconds``, with the last such
    detection (of an earlier second; ties: the greatest event_id) and how many there are.

    One row per sighting, where ``stream_detection_sighting_join`` has one per pair. Both sides come in any
    order within ``lateness``; ``kind`` tells the sides apart. State is kept by item and slot of time, so an item
    with any number of rows is many tasks' work; a detection whose span reaches into the next slot is carried to it.
    Rows behind the watermark are given out as ``late``, without a detection. The state of a slot is one entry per
    second of the span that has a detection, and the rows that wait. Rows without event_id are heartbeats.
    Needs the RocksDB state store and columns ts, video_hash, seconds, event_id.
    """
    width = SLOT_SPANS * max(1, within_seconds)

    def slot(second: Column) -> Column:
        return F.floor(second / width)

    def side(rows: DataFrame, kind: str, reach: int) -> DataFrame:
        """The rows, once for every slot from their own to that ``reach`` seconds later."""
        second = F.coalesce("seconds", F.lit(0).cast("long"))
        slots = F.explode(F.sequence(slot(second), slot(second + reach))).alias("slot")
        own = F.when(F.col("slot") == slot(second), F.lit(kind)).otherwise(F.lit(CARRIED))
        return rows.select("ts", "video_hash", *ORDER, slots).withColumn("kind", own)

    both = side(detections, DETECTION, within_seconds).unionByName(side(sightings, SIGHTING, 0))
    schema = "video_hash string, kind string, event_id bigint, detection_id bigint, detections bigint, late boolean"
    rows = event_time(both, lateness)
    return _decided(rows, ["video_hash", "slot"], LastDetection(within_seconds), schema, lateness, within_seconds)


def stream_upsert_registry(
    batches: DataFrame,
    existing: DataFrame,
    label: str = "registry",
    output: str | None = None,
    checkpoint: str | None = None,
    most_deltas: int = 16,
) -> DataFrame:
    """Upserts every micro-batch into a stored registry and returns the registry.

    A micro-batch is folded to one row per item and written as a delta with its number, so what is
    written follows the batch, and a batch that runs twice writes the same rows to the same place.
    Arrivals may come in any order: scores are those of the item's last sighting by (seen_at, event_id).
    When a run leaves more than ``most_deltas`` deltas, buckets that these have grown large for are written anew.
    ``existing`` is stored once, when ``output`` is new; a job that is called again with the same
    ``output`` and ``checkpoint`` goes on from what is stored.
    """
    spark = existing.sparkSession
    out, progress = _places(spark, label, output, checkpoint)
    schema = existing.select(*registry_store.COLUMNS).schema
    if not registry_store.exists(spark, out):
        registry_store.append(existing, out, -1)

    def add(batch: DataFrame, batch_id: int) -> None:
        # times and counts in the registry's own types, whatever the arrivals bring
        folded = fold_batch(batch, ordered=True)
        registry_store.append(folded.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], "order"), out, batch_id)

    query = (
        batches.writeStream.foreachBatch(add)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if registry_store.pending(spark, out) > most_deltas:
        registry_store.compact(spark, out, schema)
    return registry_store.read(spark, out, schema)


def stream_offline_replay(spark: SparkSession, path: str) -> DataFrame:
    """Queued JSON entries, each file once."""
    return spark.readStream.schema(schemas.OFFLINE_ENTRY).json(path).select(
        "*", F.col("_metadata.file_name").alias("file_name")
    )


