"""A stored alert log that later candidates extend: what was decided stays, and cooldowns go on from it.

An append decides the candidates of a later span of time and writes, under its number, the ``alerts`` it keeps and
the second of the ``last`` one of each item and type; it counts from when ``versions`` lists it with the seconds
it covers. The cooldown of a key depends on its past only through the last kept alert, so an append reads the
``last`` rows of those versions that reach into the longest cooldown before it, not the log. Acknowledgements are
``acks`` of their own, merged on read. Whatever runs twice writes the same rows to the same folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from trailmark.operators.alerts import CANDIDATE_COLUMNS, KEYS, acknowledge, alert_cooldown
from trailmark.session import cut_lineage

ALERTS = (
    "alert_id string, video_hash string, alert_type string, severity string, message string, ts timestamp_ntz, "
    "seconds bigint, event_id bigint, ip_hash string, country string, version bigint"
)
LAST = "video_hash string, alert_type string, seconds bigint, version bigint"
ACKS = "alert_id string, acked_at timestamp_ntz, acked_by bigint, version bigint"
VERSIONS = "version bigint, first bigint, last bigint, n bigint"


@dataclass(frozen=True)
class AlertLog:
    """The log below ``path``, with the cooldowns of ``alerts.alert_cooldown``.

    Candidates of an append must come after all seconds of earlier versions (else ValueError), in any order among
    themselves. Candidates without a second are none. An empty append is a version without alerts.
    """

    path: str
    cooldowns: dict[str, int] = field(default_factory=dict)
    default_seconds: int = 300

    def _table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return spark.createDataFrame([], schema)

    def versions(self, spark: SparkSession) -> list[Row]:
        """One row per append: its number, first and last second (null: no candidate) and number of alerts."""
        return self._table(spark, "versions", VERSIONS).orderBy("version").collect()

    def carried(self, spark: SparkSession, first: int, version: int) -> DataFrame:
        """The last kept second of each key that a cooldown may still hold back at the second ``first``."""
        longest = max([self.default_seconds, *self.cooldowns.values()])
        near = [v.version for v in self.versions(spark) if v.version < version and v.last is not None and v.last > first - longest]
        rows = self._table(spark, "last", LAST).where(F.col("version").isin(near) & (F.col("seconds") > first - longest))
        return rows.groupBy(*KEYS).agg(F.max("seconds").alias("seconds"))

    def append(self, candidates: DataFrame, version: int) -> None:
        """Decides the candidates of a later span of time and adds the alerts that outlive the cooldown."""
        spark = candidates.sparkSession
        rows = cut_lineage(candidates.select(*CANDIDATE_COLUMNS).where("seconds is not null"))
        first, last = rows.agg(F.min("seconds"), F.max("seconds")).first()
        known = [v.last for v in self.versions(spark) if v.version < version and v.last is not None]
        if first is not None and known and first <= max(known):
            raise ValueError(f"candidates from second {first} on come behind the log, which is decided up to {max(known)}")
        rows = rows.withColumn("_carried", F.lit(False))
        if first is not None:
            # an alert kept before is the first of its key here, so it is kept again and holds back what follows
            past = self.carried(spark, first, version).withColumns({"_carried": F.lit(True), "event_id": F.lit(-1).cast("bigint")})
            rows = rows.unionByName(past, allowMissingColumns=True)
        kept = alert_cooldown(rows, self.cooldowns, self.default_seconds).where("not _carried").select(*CANDIDATE_COLUMNS)
        kept.write.mode("overwrite").parquet(f"{self.path}/alerts/version={version}")
        stored = self._table(spark, "alerts", ALERTS).where(F.col("version") == version)
        latest = stored.groupBy(*KEYS).agg(F.max("seconds").alias("seconds"))
        latest.write.mode("overwrite").parquet(f"{self.path}/last/version={version}")
        listed = spark.createDataFrame([(first, last, stored.count())], "first bigint, last bigint, n bigint")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")

    def acknowledge(self, acks: DataFrame, version: int) -> None:
        """Adds acknowledgements (alert_id, acked_at, acked_by), those of alerts still to come too."""
        first = acks.groupBy("alert_id").agg(F.min(F.struct("acked_at", "acked_by")).alias("a")).select("alert_id", "a.*")
        first.write.mode("overwrite").parquet(f"{self.path}/acks/version={version}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The log: all alerts, each with its earliest acknowledgement, as ``alerts.acknowledge`` gives it."""
        counted = [v.version for v in self.versions(spark)]
        rows = self._table(spark, "alerts", ALERTS).where(F.col("version").isin(counted)).drop("version")
        nobody = {"acknowledged_by": F.lit(None).cast("bigint"), "acknowledged_at": F.lit(None).cast("timestamp_ntz")}
        return acknowledge(rows.withColumns({"acknowledged": F.lit(False)} | nobody), self._table(spark, "acks", ACKS))
