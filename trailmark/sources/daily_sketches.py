"""Distinct counts that are kept up: mergeable HyperLogLog sketches per day and key, written once and united on read.

An append folds its rows to one sketch per (day, key, counted column) and writes them below
``rows/version=N/day=D``; it counts from when ``versions/of=N`` lists it, so an append that runs twice
replaces itself and one that broke off is not seen. Reading opens the folders of the days asked for and
unites their sketches. Raw rows are read once, by the append that brings them, and a value may come in any
number of days and appends without being counted twice.

A count has a relative standard error of about 1.04 / sqrt(2 ** lg_k), 1.6 % at the default of 12; below some
hundreds of values sketches hold the hashes themselves, and counts are exact but for equal hashes. A sketch has at
most a few KB, whatever it counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's own default: 4096 registers.
LG_K = 12


@dataclass(frozen=True)
class DailySketches:
    """A stored table of sketches: ``keys`` as DDL, ``values`` the columns whose distinct values are counted.

    Nulls are not counted; a null key is a key of its own; rows without ``ts`` have the null day, which only a
    read without bounds holds. Every result has ``events`` and ``unique_<value>`` per key. An empty store gives no rows.
    """

    path: str
    keys: str
    values: tuple[str, ...]
    lg_k: int = LG_K

    @property
    def _names(self) -> list[str]:
        return [part.split()[0] for part in self.keys.split(",")]

    def append(self, rows: DataFrame, version: int) -> None:
        """Writes the sketches of ``rows`` (ts, keys and values) as version ``version``.

        Sketches are built before the shuffle, so a key of a third of all rows costs one sketch per task.
        """
        spark = rows.sparkSession
        sketches = [F.hll_sketch_agg(v, self.lg_k).alias(v) for v in self.values]
        folded = rows.groupBy(F.to_date("ts").alias("day"), *self._names).agg(F.count(F.lit(1)).alias("events"), *sketches)
        # by key within a day, so that a day of many keys is many files and a small one is one
        dealt = folded.repartitionByRange("day", *self._names)
        dealt.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/rows/version={version}")
        spark.range(1).select(F.lit(version).cast("bigint").alias("version")).write.mode("overwrite").parquet(
            f"{self.path}/versions/of={version}"
        )

    def _versions(self, spark: SparkSession) -> list[int]:
        try:
            listed = spark.read.schema("version bigint").parquet(f"{self.path}/versions")
        except AnalysisException:
            return []
        return sorted(r.version for r in listed.collect())

    def stored(self, spark: SparkSession, first: date | None = None, last: date | None = None) -> DataFrame:
        """The stored sketches of the days from ``first`` to ``last``; other days' folders are not read."""
        binary = "".join(f", {v} binary" for v in self.values)
        schema = f"{self.keys}, events bigint{binary}, version bigint, day date"
        versions = self._versions(spark)
        if not versions:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(f"{self.path}/rows").where(F.col("version").isin(versions))
        if first is not None:
            rows = rows.where(F.col("day") >= F.lit(first))
        return rows if last is None else rows.where(F.col("day") <= F.lit(last))

    def _united(self) -> list[Column]:
        return [F.sum("events").alias("events"), *[F.hll_union_agg(v).alias(v) for v in self.values]]

    def _counted(self, rows: DataFrame, *names: str) -> DataFrame:
        counts = [F.hll_sketch_estimate(v).alias(f"unique_{v}") for v in self.values]
        return rows.select(*names, "events", *counts)

    def between(self, spark: SparkSession, first: date | None = None, last: date | None = None) -> DataFrame:
        """Per key: events and distinct values of all days of the range together."""
        return self._counted(self.stored(spark, first, last).groupBy(*self._names).agg(*self._united()), *self._names)

    def daily(self, spark: SparkSession, first: date | None = None, last: date | None = None) -> DataFrame:
        """Per key and day: events and distinct values of the day."""
        by = ["day", *self._names]
        return self._counted(self.stored(spark, first, last).groupBy(*by).agg(*self._united()), *by)

    def trailing(self, spark: SparkSession, days: int, first: date | None = None, last: date | None = None) -> DataFrame:
        """Per key and day that has events: events and distinct values of the ``days`` days that end with it.

        Appends of a day are united first, so a key has one row per day in its window, however hot it is.
        Days before ``first`` are out of the windows too.
        """
        by = ["day", *self._names]
        rows = self.stored(spark, first, last).where("day is not null").groupBy(*by).agg(*self._united())
        number = F.unix_date("day")
        span = Window.partitionBy(*self._names).orderBy(number).rangeBetween(1 - days, 0)
        wide = [F.sum("events").over(span).alias("events"), *[F.hll_union_agg(v).over(span).alias(v) for v in self.values]]
        return self._counted(rows.select(*by, *wide), *by)
