"""A registry that takes batches as deltas: a batch writes its own rows, and reading merges what was written.

``rows/version=N`` has the rows of batch N, one for each item that it brings. ``versions/of=N`` lists the
buckets (of content hashes) that these lie in, with the number of their rows, and makes the batch count.
``base/version=N`` has whole buckets with everything up to batch N, and ``bases/of=N`` lists them. An item is
the base row of its bucket, if any, and the deltas after it: scores of the newest, first time of the oldest,
sum of the counts. Where batches tell by ``order`` (time, event_id) which sighting their scores are of, the
newest are those of the last sighting and the first time is the least, so these batches may come in any order;
they are newer than all batches that don't. Whatever runs twice writes the same rows to the same folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from trailmark.operators.registry import SCORES
from trailmark.session import cut_lineage

COLUMNS = ["video_hash", *SCORES, "first_seen", "last_seen", "detection_count"]
#: Leading digits of a hash that name its bucket: 256 of them.
DIGITS = 2
#: A bucket is written anew when its deltas have so large a share of the rows of its base.
SHARE = 0.25


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.coalesce(F.substring("video_hash", 1, DIGITS), F.lit("")))


def _order(rows: StructType) -> StructType:
    """The type of ``order`` beside such rows."""
    return StructType([StructField("seen_at", rows["last_seen"].dataType), StructField("event_id", LongType())])


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, version, n); at most 256 rows of a version."""
    try:
        return spark.read.schema("bucket string, version bigint, n bigint").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "bucket string, version bigint, n bigint")


def exists(spark: SparkSession, out: str) -> bool:
    try:
        spark.read.schema("version bigint").parquet(f"{out}/versions")
    except AnalysisException:
        return False
    return True


def append(rows: DataFrame, out: str, version: int) -> None:
    """Writes the items of a batch, one row each, as version ``version``. Bytes follow the batch, not the registry."""
    order = F.col("order") if "order" in rows.columns else F.lit(None)
    rows = _bucketed(rows.select(*COLUMNS, order.cast(_order(rows.schema)).alias("order"))).repartitionByRange("bucket").sortWithinPartitions("bucket", "video_hash")
    rows.write.mode("overwrite").parquet(f"{out}/rows/version={version}")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{out}/rows/version={version}")
    counts = written.groupBy("bucket").agg(F.lit(version).cast("bigint").alias("version"), F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{out}/versions/of={version}")


def _bases(spark: SparkSession, out: str, before: int | None = None) -> dict[str, tuple[int, int]]:
    """The newest base of each bucket: its version and rows. At most 256 come to the driver."""
    listed = _listed(spark, f"{out}/bases")
    if before is not None:
        listed = listed.where(F.col("version") < before)
    newest = listed.groupBy("bucket").agg(F.max(F.struct("version", "n")).alias("v"))
    return {r.bucket: (r.v.version, r.v.n) for r in newest.collect()}


def _since(bases: dict[str, tuple[int, int]]) -> Column:
    """The version that a row's bucket has a base of; a lower one than any where it has none."""
    never = F.lit(-(1 << 62))
    if not bases:
        return never
    listed = F.create_map(*[F.lit(x) for b, (v, _) in bases.items() for x in (b, v)])
    return F.coalesce(F.try_element_at(listed, F.col("bucket")), never)


def _parts(spark: SparkSession, out: str, schema: StructType, bases: dict, buckets: list[str] | None = None, before: int | None = None) -> DataFrame:
    """Base rows and later deltas, with bucket and version, of all buckets or of some."""
    wide = StructType([*schema.fields, StructField("order", _order(schema)), StructField("bucket", StringType()), StructField("version", LongType())])
    # a batch counts when it is listed
    counted = [r.version for r in _listed(spark, f"{out}/versions").select("version").distinct().collect()]
    counted = [v for v in counted if before is None or v < before]
    deltas = spark.createDataFrame([], wide)
    if counted:
        deltas = spark.read.schema(wide).parquet(f"{out}/rows").where(F.col("version").isin(counted))
    deltas = deltas.where(F.col("version") > _since(bases))
    if buckets is not None:
        deltas = deltas.where(F.col("bucket").isin(buckets))
    whole = [f"{out}/base/version={v}/bucket={b}" for b, (v, _) in bases.items() if buckets is None or b in buckets]
    if not whole:
        return deltas
    base = spark.read.schema(wide).option("basePath", f"{out}/base").parquet(*whole)
    return deltas.unionByName(base)


def _merged(parts: DataFrame) -> DataFrame:
    """One row per item; aggregates combine before they are shuffled."""
    # a null is less than any order
    items = parts.groupBy("bucket", "video_hash").agg(
        F.max_by(F.struct(*SCORES, "order"), F.struct("order", "version")).alias("_s"),
        F.when(F.count("order") > 0, F.min("first_seen")).otherwise(F.min_by("first_seen", "version")).alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("detection_count").alias("detection_count"),
    )
    return items.select("bucket", "video_hash", "_s.*", "first_seen", "last_seen", "detection_count")


def read(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """The registry as it is after all versions that count; ``schema`` is that of its columns."""
    return _merged(_parts(spark, out, schema, _bases(spark, out))).select(*COLUMNS)


def pending(spark: SparkSession, out: str) -> int:
    """How many versions have rows that are in no base."""
    listed = _listed(spark, f"{out}/versions").where(F.col("version") > _since(_bases(spark, out)))
    return listed.select("version").distinct().count()


def compact(spark: SparkSession, out: str, schema: StructType, share: float = SHARE) -> list[str]:
    """Writes the buckets anew whose deltas have grown to ``share`` of their base, and returns which.

    Other buckets are not touched. The rows of the registry stay what they were. Readers that have begun
    go on with the older files, which stay.
    """
    bases = _bases(spark, out)
    listed = _listed(spark, f"{out}/versions")
    newest = listed.agg(F.max("version")).first()[0]
    if newest is None:
        return []
    pending = listed.where(F.col("version") > _since(bases)).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    due = sorted(r.bucket for r in pending if r.n >= share * bases.get(r.bucket, (0, 0))[1])
    if due:
        rows = cut_lineage(_merged(_parts(spark, out, schema, bases, due)))
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "video_hash")
        # only the folders of these buckets are replaced
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{out}/base/version={newest}")
        counts = rows.groupBy("bucket").agg(F.lit(newest).cast("bigint").alias("version"), F.count(F.lit(1)).alias("n"))
        # listed last, so that a compaction that broke off is not seen; listed twice is as good as once
        counts.coalesce(1).write.mode("append").parquet(f"{out}/bases/of={newest}")
    return due
