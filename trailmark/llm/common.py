"""What the operators share: the table reader, the word pattern and the size of Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import scratch_path

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes of one Arrow batch; a longer single row makes a batch of its own.
BATCH_BYTES = 4 << 20

_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes, not only by rows, so that long texts can't fill a worker.

    A smaller bound that the session already has stays.
    """
    if int(spark.conf.get(_BATCH_KEY).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder as a Parquet table and read back.

    Cuts the lineage like a checkpoint, but takes far less disk for rows with repeating columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """The rows, which a join sorts on both sides and never sends through the driver.

    Spark sizes a table by its file, lists in it as one element, and what a function or an explode makes
    as what these are given. So it may broadcast what is many times as large as its bound.
    """
    return df.hint("merge")


def once(udf):
    """The function, evaluated once for a row however many later expressions and filters use its result.

    Spark copies deterministic functions into each of them, which doubles the work and the workers.
    """
    return udf.asNondeterministic()


def unused(name: str, *frames: DataFrame) -> str:
    """The name, with as many underscores before it as it takes to clash with no column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name in taken:
        name = f"_{name}"
    return name


def whole_text(column: str = "text") -> Column:
    """A missing text counts as the empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")
