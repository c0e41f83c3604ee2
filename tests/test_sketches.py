"""Distinct counts from stored daily sketches: ranges, windows, retries, error and what is read."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailmark.session import scratch_path
from trailmark.sources.daily_sketches import DailySketches

SHAPE = "ts timestamp_ntz, item string, country string, ip string"
START = datetime(2024, 3, 1, 12)


def at(day):
    return START + timedelta(days=day)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def store(spark):
    return DailySketches(scratch_path(spark, "sketches"), "item string", ("country", "ip"))


def put(spark, store, version, *rows):
    store.append(spark.createDataFrame(list(rows), SHAPE), version)


def test_ranges_unite_days_and_appends(spark, store):
    put(spark, store, 0, (at(0), "a", "X", "1"), (at(0), "a", "X", "2"), (at(1), "a", "Y", "1"), (at(1), "b", None, "1"))
    put(spark, store, 1, (at(1), "a", "X", "3"), (at(4), "a", "Z", "1"), (at(4), None, "Z", None))
    assert rows_of(store.between(spark)) == sorted([("a", 5, 3, 3), ("b", 1, 0, 1), (None, 1, 1, 0)], key=str)
    day = date(2024, 3, 2)
    assert rows_of(store.between(spark, day, day)) == [("a", 2, 2, 2), ("b", 1, 0, 1)]
    assert rows_of(store.daily(spark, day, day)) == [(day, "a", 2, 2, 2), (day, "b", 1, 0, 1)]
    windows = [r[1:] for r in rows_of(store.trailing(spark, 4)) if r[1] == "a"]
    assert windows == [("a", 2, 1, 2), ("a", 4, 2, 3), ("a", 3, 3, 2)]


def test_an_append_that_runs_twice_counts_once_and_a_broken_one_not(spark, store):
    rows = [(at(0), "a", "X", "1"), (at(1), "a", "Y", "2")]
    put(spark, store, 0, *rows)
    put(spark, store, 0, *rows)
    assert rows_of(store.between(spark)) == [("a", 2, 2, 2)]
    # rows of a version that was never listed
    spark.createDataFrame([("a", 9)], "item string, events bigint").write.parquet(f"{store.path}/rows/version=7/day=2024-03-01")
    assert rows_of(store.between(spark)) == [("a", 2, 2, 2)]


def test_only_the_days_asked_for_are_read(spark, store):
    put(spark, store, 0, *[(at(d), "a", "X", str(d)) for d in range(6)])
    plan = store.between(spark, date(2024, 3, 2), date(2024, 3, 3))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "day" in text.split("PartitionFilters")[1].split("]")[0]
    read = store.stored(spark, date(2024, 3, 2), date(2024, 3, 3)).select(F.input_file_name().alias("f")).distinct()
    assert sorted(r.f.split("/day=")[1][:10] for r in read.collect()) == ["2024-03-02", "2024-03-03"]


def test_large_counts_keep_the_stated_error(spark, store):
    """60,000 values over eight days, each in several of them and in two appends."""
    values = spark.range(60_000).select(F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"), "id")
    day = F.pmod(F.col("id") + F.col("k") * 3, F.lit(8)).cast("int")
    ts = F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(days=day)
    rows = values.select(ts.alias("ts"), F.lit("hot").alias("item"), F.lit("X").alias("country"), F.col("id").cast("string").alias("ip"))
    store.append(rows, 0)
    store.append(rows.where("ip < '5'"), 1)
    ((_, _, countries, ips),) = rows_of(store.between(spark))
    assert countries == 1
    assert abs(ips / 60_000 - 1) < 4 * 1.04 / 2**6
    for _, _, _, _, unique in rows_of(store.daily(spark)):
        assert abs(unique / 22_500 - 1) < 4 * 1.04 / 2**6


def test_empty_store_and_empty_append(spark, store):
    assert rows_of(store.between(spark)) == rows_of(store.trailing(spark, 7)) == []
    store.append(spark.createDataFrame([], SHAPE), 0)
    assert rows_of(store.between(spark)) == []
