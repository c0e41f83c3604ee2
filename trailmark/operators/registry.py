"""Registry upserts, retention, paging and recent-row lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.runs import FEW, narrowed, ranked, running

SCORES = ["perceptual_hash", "is_deepfake", "confidence", "lipsync_score", "fact_check_score"]


def fold_batch(batch: DataFrame, ordered: bool = False) -> DataFrame:
    """One row per item of a batch: newest scores, first and last time, number of arrivals.

    Aggregates combine before the shuffle, so an item with a third of the batch is no problem.
    With ``ordered`` a column ``order`` tells the time and event_id of the sighting that the scores are of.
    """
    place = F.struct("seen_at", "event_id")
    newest = F.max_by(F.struct(*SCORES), place)
    folded = (
        batch.groupBy("video_hash")
        .agg(
            newest.alias("_s"),
            F.min("seen_at").alias("first_seen"),
            F.max("seen_at").alias("last_seen"),
            F.count(F.lit(1)).alias("detection_count"),
            F.max(place).alias("order"),
        )
        .select("video_hash", "_s.*", "first_seen", "last_seen", "detection_count", "order")
    )
    return folded if ordered else folded.drop("order")


def upsert_registry(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Registry after a batch: new scores replace old, first_seen is kept, counts add up."""
    old = existing.select("video_hash", *SCORES, "first_seen", "last_seen", "detection_count")
    new = fold_batch(batch).withColumn("_new", F.lit(True))
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, "video_hash", "full_outer")
    arrived = F.coalesce("n._new", F.lit(False))
    replaced = [
        F.when(arrived, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in SCORES
    ]
    return joined.select(
        "video_hash",
        *replaced,
        F.coalesce("o.first_seen", "n.first_seen").alias("first_seen"),
        F.greatest("o.last_seen", "n.last_seen").alias("last_seen"),
        (
            F.coalesce("o.detection_count", F.lit(0)) + F.coalesce("n.detection_count", F.lit(0))
        ).alias("detection_count"),
    )


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest row per key as a combining aggregate, not a window."""
    payload = F.struct(*[c for c in df.columns if c != key])
    return (
        df.groupBy(key).agg(F.max_by(payload, F.struct(*order)).alias("r")).select(key, "r.*")
    )


def retention(df: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """Rows whose timestamp is within the last ``days`` days before ``now``."""
    return df.where(F.col(column) >= now - F.make_dt_interval(F.lit(days)))


def retention_report(df: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    kept = F.col(column) >= now - F.make_dt_interval(F.lit(days))
    return df.agg(
        F.count_if(kept).alias("kept"), F.count_if(~kept).alias("removed")
    )


def newest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n newest rows; the last order column makes the order total."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def page(
    df: DataFrame, order: list[str], offset: int, limit: int, run_rows: int | None = None
) -> DataFrame:
    """A page of an ordered table, however deep; empty when the offset is past its end.

    Only the ranges of the first order column that hold the page are put in order; the others are counted.
    """
    part = narrowed(df, order[0], offset, offset + limit, run_rows or FEW)
    rows, _ = ranked(df.where(part.inside), order, run_rows)
    place = F.col("_rank") + part.before
    return rows.where((place > offset) & (place <= offset + limit)).drop("_rank")


def events_between(df: DataFrame, low: int, high: int, column: str = "event_id") -> DataFrame:
    """Rows of a sequence range; the bounds reach the Parquet scan."""
    return df.where(F.col(column).between(low, high))


def evict_oldest(
    df: DataFrame, order: list[str], keep: int, run_rows: int | None = None
) -> DataFrame:
    """The newest ``keep`` rows, however many these are. Only the range in which the oldest of them lies is put in order."""
    gone = df.count() - keep
    if gone <= 0:
        return df
    part = narrowed(df, order[0], gone - 1, gone, run_rows or FEW)
    rows, _ = ranked(df.where(part.inside), order, run_rows)
    edge = rows.where(F.col("_rank") + part.before > gone).drop("_rank")
    return edge.unionByName(df.where(part.after))


def family_rank(lineage: DataFrame, run_rows: int | None = None) -> DataFrame:
    """Position in the family by (generation, first_seen) and rank of the generation."""
    rows = running(
        lineage, ["family"], ["generation", "first_seen", "video_hash"],
        row_number="position", run_rows=run_rows,
    )
    present = lineage.select("family", "generation").distinct()
    ranks = present.withColumn(
        "generation_rank",
        F.dense_rank().over(Window.partitionBy("family").orderBy("generation")),
    )
    return rows.join(ranks, ["family", "generation"])


#: The kinds of transactions that can be sent together, and how many at most.
BATCHABLE = ("register_video",)
MAX_BATCH = 50


def batch_chunks(outbox: DataFrame, n: int = 20, run_rows: int | None = None) -> DataFrame:
    """Consecutive chunks of at most ``n`` rows per node, oldest first, of the rows that wait and are batchable.

    Rows that are confirmed, failed or of another kind are sent one by one and have no chunk.
    """
    if not 1 <= n <= MAX_BATCH:
        raise ValueError(f"a batch holds 1 to {MAX_BATCH} transactions")
    waiting = F.col("status").isin("queued", "retrying") & F.col("tx_type").isin(*BATCHABLE)
    rows = running(
        outbox.where(waiting), ["node"], ["created_at", "id"],
        row_number="_rn", run_rows=run_rows,
    )
    return rows.withColumn("chunk", F.floor((F.col("_rn") - 1) / n)).drop("_rn")
