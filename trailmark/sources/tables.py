"""Readers and writers of the stored tables, JSON exports, offline queues and media files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark import schemas
from trailmark.functions.bits import digest

MAX_FRAMES = 15
# fixed values: upload limits
MEDIA_EXTENSIONS = [
    "mp4", "avi", "mov", "mkv", "webm", "flv", "wmv", "png", "jpg", "jpeg", "gif", "bmp",
]
MAX_MEDIA_BYTES = 500 * 1024 * 1024


def load_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FINGERPRINTS).parquet(path)


def load_lineage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LINEAGE).parquet(path)


def load_sightings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SIGHTINGS).parquet(path)


def export_json(df: DataFrame, path: str) -> DataFrame:
    """Writes all rows as JSON lines and returns them read back under the same schema."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def write_offline_queue(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read_offline_queue(spark: SparkSession, path: str) -> DataFrame:
    """Queued entries with the name of the file each came from, the order of replay."""
    rows = spark.read.schema(schemas.OFFLINE_ENTRY).json(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file_name"))


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of every file below a path. Content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content")


def content_inventory(
    files: DataFrame, extensions: list[str] = MEDIA_EXTENSIONS, max_bytes: int = MAX_MEDIA_BYTES
) -> DataFrame:
    """``files`` (path, length, content) with accepted and, for those that are, the digest of the content.

    A file is accepted by its extension, in any case, and its size; others are listed as refused.
    """
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    accepted = kind.isin(extensions) & (F.col("length") <= max_bytes)
    rest = [c for c in files.columns if c != "content"]
    wanted = files.where(accepted).select(
        *rest, F.lit(True).alias("accepted"), digest(F.col("content")).alias("sha256")
    )
    refused = files.where(~F.coalesce(accepted, F.lit(False))).select(
        *rest, F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("sha256")
    )
    return wanted.unionByName(refused)


def decode_frame_batch(
    requests: DataFrame, frames: str = "frames", max_frames: int = MAX_FRAMES
) -> DataFrame:
    """Binary frames of each request: data-URL prefix removed, the first ``max_frames`` only.

    A frame that is not valid base64 is skipped.
    """
    rest = [c for c in requests.columns if c != frames]
    each = requests.select(
        *rest, F.posexplode(F.slice(frames, 1, max_frames)).alias("frame_no", "_f")
    )
    parts = F.split("_f", ",")
    encoded = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.col("_f"))
    decoded = each.withColumn("frame", F.try_to_binary(encoded, F.lit("base64"))).drop("_f")
    return decoded.where("frame is not null")
