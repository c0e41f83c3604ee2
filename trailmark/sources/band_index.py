"""A stored index of hash codes by their bands, so that a lookup reads the bands it asks for and no others.

Below the folder lie two tables. ``bands`` has a row for each band of each code, in folders by band and
the first digits of the band's value; ``items`` has a row for each item, in folders by the first digits
of its hash, and one for each code. Rows are appended, never rewritten: an append is a version, written to
folders of its own number, and it counts from when the number is listed in ``versions``. So an append that
runs twice replaces itself, and one that broke off is not seen.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import bits
from trailmark.session import cut_lineage

#: Leading digits, of the digest of a band's value or an item's hash, that name a folder: 16 folders for a band.
#: Each folder costs a file in every append. Within a file rows lie in order of their values. For a registry
#: whose folders grow to many GB, set this to 2 or 3 before the first append; all uses of an index need the same.
DIGITS = 1

_BANDS = "band_index int, part string, band_value string, code string, first_hash string, version bigint"
_ITEMS = "part string, video_hash string, version bigint"


def _part(value: Column) -> Column:
    """The folder of a value: digits of its digest, since values themselves may share their beginnings."""
    return F.substring(F.md5(value), 1, DIGITS)


def _band_rows(codes: DataFrame, num_bands: int) -> DataFrame:
    """Each code by its bands from 0 on, and whole at -1, so that equal codes meet whatever their layout."""
    bands = F.coalesce(bits.lsh_bands(F.col("code"), num_bands, "bits"), F.array().cast("array<string>"))
    rows = codes.select("*", F.posexplode(F.concat(F.array("code"), bands)).alias("_at", "band_value"))
    rows = rows.withColumn("band_index", F.col("_at") - 1).drop("_at").where("band_value IS NOT NULL")
    return rows.withColumn("part", _part(F.col("band_value")))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the appends that count, one for each; empty where there is no index."""
    try:
        return sorted(r.version for r in spark.read.schema("version bigint").parquet(f"{path}/versions").distinct().collect())
    except AnalysisException:
        return []


def append(registry: DataFrame, path: str, version: int | None = None, num_bands: int = bits.NUM_BANDS) -> int:
    """Adds the items of ``registry`` (video_hash, perceptual_hash) as a version and returns its number.

    Without a number it is the next one. Items without a content hash are left out, items without a code
    are found by content hash only. An empty table is a version without rows.
    """
    spark = registry.sparkSession
    if version is None:
        version = max(versions(spark, path), default=-1) + 1
    items = registry.where("video_hash IS NOT NULL").select("video_hash", "perceptual_hash")
    codes = items.where("perceptual_hash IS NOT NULL").groupBy(F.col("perceptual_hash").alias("code"))
    codes = codes.agg(F.min("video_hash").alias("first_hash"))
    # rows of one folder meet in few tasks, so that a folder has few files however many tasks there are
    bands = _band_rows(codes, num_bands).repartition("band_index", "part").sortWithinPartitions("band_index", "part", "band_value")
    bands.write.mode("overwrite").partitionBy("band_index", "part").parquet(f"{path}/bands/version={version}")
    hashes = items.select("video_hash").distinct().withColumn("part", _part(F.col("video_hash")))
    hashes = hashes.repartition("part").sortWithinPartitions("part", "video_hash")
    hashes.write.mode("overwrite").partitionBy("part").parquet(f"{path}/items/version={version}")
    spark.range(1).select(F.lit(version).cast("bigint").alias("version")).write.mode("overwrite").parquet(f"{path}/versions/of={version}")
    return version


def _read(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """The rows of all versions that count; folders that a condition on their columns excludes are not read."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{table}").where(F.col("version").isin(known))


def _folders(rows: DataFrame, *columns: str) -> Column:
    """The condition that rows lie in the folders of ``rows``; there are 16 ** DIGITS folders for a band."""
    found = rows.select(*columns).distinct().collect()
    condition = F.lit(False)
    for first in sorted({r[0] for r in found}):
        one = F.col(columns[0]) == first
        if len(columns) > 1:
            one &= F.col(columns[1]).isin([r[1] for r in found if r[0] == first])
        condition |= one
    return condition


def _shuffled(rows: DataFrame) -> DataFrame:
    """Rows that are joined without a broadcast: in a stream each micro-batch would send them to the driver anew."""
    return rows.hint("merge")


def _meeting(rows: DataFrame) -> DataFrame:
    """Band rows without the whole code, the longest of them, where equal codes meet at a band anyhow."""
    return rows.where((F.col("band_index") >= 0) | ~F.col("code").rlike(bits.STANDARD_LAYOUT))


def stored_hashes(queries: DataFrame, path: str) -> DataFrame:
    """Those of the content hashes of ``queries`` that the index has."""
    asked = queries.select("video_hash").distinct().withColumn("part", _part(F.col("video_hash"))).where("video_hash IS NOT NULL")
    items = _read(queries.sparkSession, path, "items", _ITEMS).where(_folders(asked, "part"))
    return asked.join(_shuffled(items.select("video_hash")), "video_hash", "left_semi").select("video_hash")


def candidates(codes: DataFrame, path: str, num_bands: int = bits.NUM_BANDS) -> DataFrame:
    """(q_code, r_code, first_hash): the stored codes that share a band with one of ``codes`` (code).

    A pair comes once for every band that it shares; equal codes share all.
    """
    asked = _meeting(_band_rows(codes.select("code").where("code IS NOT NULL").distinct(), num_bands))
    stored = _meeting(_read(codes.sparkSession, path, "bands", _BANDS).where(_folders(asked, "band_index", "part")))
    stored = stored.select("band_index", "band_value", F.col("code").alias("r_code"), "first_hash")
    asked = asked.select("band_index", "band_value", F.col("code").alias("q_code"))
    return asked.join(_shuffled(stored), ["band_index", "band_value"]).select("q_code", "r_code", "first_hash")


def lookup(
    queries: DataFrame, path: str, threshold: int = bits.CACHE_THRESHOLD, num_bands: int = bits.NUM_BANDS
) -> DataFrame:
    """Best stored match of every query item, from the index alone.

    Exact content hash first, then exact hash code, then the nearest code within the threshold; of equally
    near ones the least (distance, content hash). Columns: video_hash, matched_hash, cache_hit_type,
    perceptual_distance. Items without hash or code miss where these are asked for; repeated items come out each.
    """
    items = queries.select("video_hash", "perceptual_hash")
    known = stored_hashes(items, path).withColumn("_exact", F.lit(True))
    # written once: it is read for the folders, for the codes and for the result
    staged = cut_lineage(items.join(_shuffled(known), "video_hash", "left"))
    codes = staged.where("_exact IS NULL").select(F.col("perceptual_hash").alias("code"))
    distance = F.when(F.col("q_code") == F.col("r_code"), 0).otherwise(bits.hamming(F.col("q_code"), F.col("r_code"), "cache"))
    near = candidates(codes, path, num_bands).select("q_code", distance.alias("distance"), "first_hash").where(F.col("distance") <= threshold)
    best = near.groupBy(F.col("q_code").alias("perceptual_hash")).agg(F.min(F.struct("distance", "first_hash")).alias("_near"))
    exact = F.col("_exact").isNotNull()
    return staged.join(_shuffled(best), "perceptual_hash", "left").select(
        "video_hash",
        F.when(exact, F.col("video_hash")).otherwise(F.col("_near.first_hash")).alias("matched_hash"),
        F.when(exact, "exact").when(F.col("_near").isNotNull(), "perceptual").otherwise("miss").alias("cache_hit_type"),
        F.when(~exact, F.col("_near.distance")).alias("perceptual_distance"),
    )
