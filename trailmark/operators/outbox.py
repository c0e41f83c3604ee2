"""The queue of outgoing transactions as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.decide import outbox_route


def route_outbox(outbox: DataFrame) -> DataFrame:
    return outbox.withColumn("route", outbox_route(F.col("tx_type")))


def pending_outbox(outbox: DataFrame, limit: int = 100) -> DataFrame:
    waiting = outbox.where(F.col("status").isin("queued", "retrying"))
    return waiting.orderBy("created_at", "id").limit(limit)


def outbox_stats(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def outbox_transition(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """Status after a round of sending. ``results``: id, ok, error, block_number."""
    joined = outbox.join(results, "id", "left")
    sent, failed = F.col("ok"), ~F.col("ok")
    tries = F.col("retries") + F.when(failed, 1).otherwise(0)
    status = (
        F.when(sent, "confirmed")
        .when(failed & (tries >= F.col("max_retries")), "failed")
        .when(failed, "retrying")
        .otherwise(F.col("status"))
    )
    return joined.withColumns({"status": status, "retries": tries}).drop("ok")


def purge_completed(outbox: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    done = F.col("status").isin("confirmed", "failed")
    old = F.col("updated_at") < now - F.make_dt_interval(hours=F.lit(hours))
    return outbox.where(~(done & old))


def retry_failed(outbox: DataFrame) -> DataFrame:
    """Failed rows back to the queue with a clean count."""
    failed = F.col("status") == "failed"
    return outbox.withColumns(
        {
            "status": F.when(failed, "queued").otherwise(F.col("status")),
            "retries": F.when(failed, 0).otherwise(F.col("retries")),
        }
    )
