"""Connected components of a link table by contraction, in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import stored

#: Links up to which a round takes no more tasks than there are cores, however many partitions a shuffle has.
FEW = 1 << 20


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link to another; nodes of a component share the root.

    Each round every node goes to its neighbour (or itself) of least rank and on to where that one goes, under an
    order that is drawn anew every other round by hashing, and links are carried over to the joined nodes. A second
    round under one order ends a star, whose leaves of lesser rank than the middle stay in the first. Minima
    combine before they are shuffled, so a node may have any number of links. Rounds of few links are few tasks:
    the driver keeps a record of every task, and a table of some thousand links needs no more of them than cores.
    """
    cores = links.sparkSession.sparkContext.defaultParallelism

    def dealt(rows: DataFrame, few: bool) -> DataFrame:
        return rows.coalesce(cores) if few else rows

    edges = stored(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b"), "edges")
    rounds: list[tuple[DataFrame, bool]] = []
    while count := edges.count():
        few, salt = count <= FEW, F.lit(len(rounds) // 2)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(
            F.min(F.struct(F.xxhash64(salt, "b").alias("rank"), F.col("b").alias("to"))).alias("near")
        )
        own = F.struct(F.xxhash64(salt, "node").alias("rank"), F.col("node").alias("to"))
        near = stored(dealt(least.select("node", F.least("near", own)["to"].alias("to")), few), "near")
        on = near.select(F.col("node").alias("to"), F.col("to").alias("root"))
        parent = stored(dealt(near.join(on, "to"), few).select("node", "root"), "parents")
        rounds.append((parent, few))
        for end in ("a", "b"):
            moved = parent.select(F.col("node").alias(end), F.col("root").alias("_root"))
            edges = dealt(edges.join(moved, end).drop(end).withColumnRenamed("_root", end), few)
        edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = stored(dealt(edges, few), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # from the last round, which has the fewest nodes, to the first
    labels = rounds.pop()[0]
    for parent, few in reversed(rounds):
        step = labels.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        labels = dealt(parent.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), few)
    return stored(labels, "labels")
