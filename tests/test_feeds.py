"""The event feeds of the registered stream queries over a table of many files in no order of time."""

import shutil
from pathlib import Path

import oracle
import pytest
from pyspark.sql import functions as F

from trailmark.plans import stream_book
from trailmark.plans.catalog import ORACLE, QUERIES
from trailmark.session import scratch_path
from trailmark.streaming import jobs


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The tables with events six times over, in files of which the first has the latest times."""
    d = tmp_path_factory.mktemp("tables")
    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        if f.name != "events.parquet":
            shutil.copy(f, d / f.name)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    copies = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(5))))
    copies = copies.withColumn("event_id", F.col("event_id") + 1_000 * F.col("copy")).repartitionByRange(24, F.col("ts").desc())
    copies.drop("copy").write.parquet(str(d / "events.parquet"))
    return str(d)


@pytest.fixture(scope="module")
def con(many_files):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("nation", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{many_files}/{name}.parquet{'/*.parquet' if name == 'events' else ''}'")
    return con


@pytest.fixture
def split(spark, monkeypatch):
    """Every file of the input is a task, and a part of the feed has many files."""
    monkeypatch.setattr(stream_book, "FILE_ROWS", 100, raising=False)
    monkeypatch.setattr(stream_book, "_PARTS", {})
    conf = {"spark.sql.files.openCostInBytes": "128m", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["stream_reupload_bursts", "stream_upsert_registry"])
def test_parts_of_many_files_come_in_order_of_time(spark, many_files, con, split, name):
    problem, n = oracle.compare(spark, con, QUERIES[name], ORACLE[name], many_files)
    assert problem is None and n > 0


def test_a_part_is_one_micro_batch_whatever_its_files(spark):
    """Parts with fewer rows than files, and one without rows, still are one micro-batch each."""
    path = scratch_path(spark, "parts")
    rows = spark.range(40).select(F.col("id").alias("event_id"), (F.col("id") >= 37).cast("int").alias("part"))
    stream_book._written(rows, F.col("part") * 2, 3, path, 7)
    assert len(spark.read.schema(rows.schema).parquet(path).inputFiles()) == 21
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 7).parquet(path)
    seen = jobs.run_batches(stream, lambda b: b.withColumn("n", F.lit(b.count())), "parts-seen")
    assert sorted((r.part, r.n) for r in seen.distinct().select("part", "n").distinct().collect()) == [(0, 37), (1, 3)]


def test_sessions_open_within_the_millisecond_of_the_watermark(spark):
    """The watermark has whole milliseconds: a session that ends in its last one is open, and not lost."""
    rows = spark.sql(
        "SELECT 'v' AS video_hash, 's' AS ip_hash, t AS ts FROM VALUES (TIMESTAMP'2024-01-01 00:00:00.000300'), "
        "(TIMESTAMP'2024-01-01 00:40:00.000700') AS x(t)"
    )
    assert jobs.open_sessions(rows, gap="30 minutes", least=1, lateness="10 minutes").count() == 2


def _tables(spark, path, rows):
    """A folder of the tables that sightings need, with these (event_id, ts, user_id) as events of one item."""
    shutil.copy("/root/testdata/sf0.001/nation.parquet", path / "nation.parquet")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    values = ", ".join(f"({i}L, TIMESTAMP_NTZ'{t}', {u}L)" for i, t, u in rows)
    made = spark.sql(f"SELECT *, 'view' AS event_type, 1.0D AS value, '{{\"k\": 5}}' AS props FROM VALUES {values} AS x(event_id, ts, user_id)")
    made.select(*events.columns).coalesce(1).write.parquet(str(path / "events.parquet"))
    return str(path)


def _connected(d):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW nation AS SELECT * FROM '{d}/nation.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
    return con


def test_bursts_end_where_the_gap_is_just_reached(spark, tmp_path):
    """Uploads exactly 30 minutes apart are two sessions; one that ends within the last millisecond before the mark is closed."""
    times = ["00:00:00", "00:29:59.999999", "00:59:59.999999", "01:00:00", "02:00:00.000300", "02:00:00.000300", "02:40:00.000700"]
    rows = [(i, f"2024-01-01 {t}", 7) for i, t in enumerate(times)]
    rows += [(20, "2024-01-01 02:00:00.000700", 8), (21, "2024-01-01 02:00:00.000700", 8), (22, "2024-01-01 02:00:00.000701", 9), (23, "2024-01-01 02:00:00.000701", 9)]
    d = _tables(spark, tmp_path, rows)
    found = QUERIES["stream_reupload_bursts"](spark, d)
    assert sorted((r.uploads, r.closed) for r in found.collect()) == [(2, False), (2, True), (2, True), (2, True), (2, True)]
    assert oracle.compare(spark, _connected(d), QUERIES["stream_reupload_bursts"], ORACLE["stream_reupload_bursts"], d) == (None, 5)


def test_bursts_do_not_depend_on_the_order_of_files(spark, many_files, con, monkeypatch):
    """A file system whose times say nothing of the order of writing brings the last part first."""
    path = scratch_path(spark, "events-backwards")
    events = spark.read.parquet(f"{many_files}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(at), F.max(at)).first()
    stream_book._written(events, 3 - F.floor((at - first) * 4 / (last - first + 1)), 4, path, 2)
    monkeypatch.setattr(stream_book, "_PARTS", {(spark.sparkContext.applicationId, many_files): (path, 2)})
    problem, n = oracle.compare(spark, con, QUERIES["stream_reupload_bursts"], ORACLE["stream_reupload_bursts"], many_files)
    assert problem is None and n > 0
