"""Descent of items: parents, generations, trees, origins and families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions import bits
from trailmark.functions.decide import classify_mutation
from trailmark.operators.lookup import near_duplicate_pairs
from trailmark.session import cut_lineage


def find_family(items: DataFrame, threshold: int = bits.FAMILY_THRESHOLD, **options) -> DataFrame:
    """Family of every hash code: codes within the threshold, itself included.

    Columns: q_code, r_code, distance, members (items behind r_code), first_seen (its earliest).
    """
    pairs = near_duplicate_pairs(items, items, threshold, mode="family", **options)
    facts = items.groupBy(F.col("perceptual_hash").alias("r_code")).agg(
        F.count(F.lit(1)).alias("members"), F.min("first_seen").alias("first_seen")
    )
    return pairs.join(facts, "r_code")


def find_origin(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Earliest member of each code's family by (generation, first_seen, hash)."""
    rank = F.struct("generation", "first_seen", "video_hash")
    best = nodes.groupBy(F.col("perceptual_hash").alias("r_code")).agg(F.min(rank).alias("_best"))
    return (
        pairs.join(best, "r_code")
        .groupBy(F.col("q_code").alias("perceptual_hash"))
        .agg(F.min("_best").alias("_o"))
        .select(
            "perceptual_hash",
            F.col("_o.video_hash").alias("origin_hash"),
            F.col("_o.generation").alias("origin_generation"),
            F.col("_o.first_seen").alias("origin_first_seen"),
        )
    )


def assign_parents(
    items: DataFrame, threshold: int = bits.FAMILY_THRESHOLD, pairs: DataFrame | None = None, **options
) -> DataFrame:
    """Nearest earlier family member of every item, by (distance, first_seen, hash).

    ``pairs`` are the items' near-duplicate pairs in family mode, where the caller has them already.

    Copies of one code need no pairing: all but the earliest have it as parent, at distance 0.
    Only the earliest item of each code looks for a parent among the earliest of other codes.
    """
    stamp = F.struct("first_seen", "video_hash")
    heads = items.groupBy("perceptual_hash").agg(F.min(stamp).alias("_head"))
    if pairs is None:
        pairs = near_duplicate_pairs(items, items, threshold, mode="family", **options)
    child = heads.select(F.col("perceptual_hash").alias("q_code"), F.col("_head").alias("_child"))
    other = heads.select(F.col("perceptual_hash").alias("r_code"), F.col("_head").alias("_parent"))
    nearest = (
        pairs.where("q_code <> r_code")
        .join(child, "q_code")
        .join(other, "r_code")
        .where("_parent < _child")
        .groupBy(F.col("q_code").alias("perceptual_hash"))
        .agg(F.min(F.struct("distance", "_parent")).alias("_near"))
    )
    found = items.join(heads, "perceptual_hash").join(nearest, "perceptual_hash", "left")
    copy = F.col("video_hash") != F.col("_head.video_hash")
    return found.select(
        *items.columns,
        F.when(copy, F.col("_head.video_hash"))
        .otherwise(F.col("_near._parent.video_hash"))
        .alias("parent_hash"),
        F.when(copy, F.lit(0)).otherwise(F.col("_near.distance")).alias("distance"),
    )


def with_mutation(parents: DataFrame) -> DataFrame:
    label = classify_mutation(F.col("distance"))
    return parents.withColumn("mutation", F.when(F.col("parent_hash").isNotNull(), label))


def _linked(lineage: DataFrame) -> DataFrame:
    """Nodes with their parent, NULL where the parent is not registered.

    Roots take no part in the join: their NULL would be one key for all of them.
    """
    nodes = lineage.select("video_hash", "parent_hash")
    present = lineage.select(F.col("video_hash").alias("parent_hash"), F.lit(1).alias("_p"))
    with_parent = nodes.where("parent_hash is not null").join(present, "parent_hash", "left")
    with_parent = with_parent.select(
        "video_hash", F.when(F.col("_p") == 1, F.col("parent_hash")).alias("parent_hash")
    )
    return with_parent.unionByName(nodes.where("parent_hash is null"))


def _descent(lineage: DataFrame, max_rounds: int, with_path: bool = True) -> DataFrame:
    """(video_hash, parent_hash, ancestor, steps, path, done) with the root as ancestor, by pointer doubling.

    Every round doubles the distance looked back: ``path`` leads from below the ancestor, at the
    end from the root, down to the node. Nodes that reached a root leave the loop, so a root
    with millions of children is joined only once.
    """
    root = F.col("parent_hash").isNull()
    state = cut_lineage(
        _linked(lineage).select(
            "video_hash",
            "parent_hash",
            F.coalesce("parent_hash", "video_hash").alias("ancestor"),
            F.when(root, 0).otherwise(1).cast("bigint").alias("steps"),
            (F.substring("video_hash", 1, 8) if with_path else F.lit("")).alias("path"),
            root.alias("done"),
        )
    )
    for _ in range(max_rounds):
        if state.where(~F.col("done")).isEmpty():
            return state
        jump = state.select(
            F.col("video_hash").alias("ancestor"),
            F.struct("ancestor", "steps", "path", "done").alias("_on"),
        )
        moved = (
            state.where(~F.col("done"))
            .join(jump, "ancestor")
            .select(
                "video_hash",
                "parent_hash",
                F.col("_on.ancestor").alias("ancestor"),
                (F.col("steps") + F.col("_on.steps")).alias("steps"),
                (F.concat("_on.path", F.lit("/"), "path") if with_path else F.lit("")).alias("path"),
                F.col("_on.done").alias("done"),
            )
        )
        state = cut_lineage(state.where("done").unionByName(moved))
    raise ValueError("lineage has a cycle or is deeper than the round limit allows")


def generations(lineage: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Root and distance to it for every node; depth d takes log2(d) rounds.

    A cycle never reaches a root and raises after ``max_rounds``.
    """
    return _descent(lineage, max_rounds, with_path=False).select(
        "video_hash",
        F.col("ancestor").alias("root_hash"),
        F.col("steps").alias("generation"),
    )


def trace_to_origin(lineage: DataFrame, start: DataFrame, max_depth: int = 10) -> DataFrame:
    """Ancestors of each starting item, nearest first, at most ``max_depth`` of them."""
    links = (
        _linked(lineage)
        .where("parent_hash is not null")
        .select(F.col("video_hash").alias("at"), F.col("parent_hash").alias("ancestor"))
    )
    links = cut_lineage(links)
    frontier = start.select("video_hash", F.col("video_hash").alias("at"))
    found: DataFrame | None = None
    for step in range(1, max_depth + 1):
        frontier = cut_lineage(
            frontier.join(links, "at").select(
                "video_hash", F.lit(step).alias("step"), F.col("ancestor").alias("at")
            )
        )
        found = frontier if found is None else found.unionByName(frontier)
        if frontier.isEmpty():
            break
        frontier = frontier.select("video_hash", "at")
    return found.select("video_hash", "step", F.col("at").alias("ancestor_hash"))


def parent_child_edges(lineage: DataFrame) -> DataFrame:
    """Edges whose parent is registered."""
    return _linked(lineage).where("parent_hash is not null").select(
        "parent_hash", F.col("video_hash").alias("child_hash")
    )


def children_of(lineage: DataFrame) -> DataFrame:
    """Child rows of every parent with the parent's number of children, one row per child."""
    edges = parent_child_edges(lineage)
    counts = edges.groupBy("parent_hash").agg(F.count(F.lit(1)).alias("n_children"))
    return edges.join(counts, "parent_hash")


def family_roots(lineage: DataFrame) -> DataFrame:
    """Nodes without a registered parent."""
    parents = lineage.select(F.col("video_hash").alias("parent_hash"))
    return lineage.join(parents, "parent_hash", "left_anti")


def family_tree(lineage: DataFrame, families: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Tree rows: (family, root, node, parent, generation, path), of any depth below 2 ** ``max_rounds``.

    A family with several roots gets a virtual root row at generation -1. ``path`` joins the
    first eight digits of the hashes from the root down. A cycle raises.
    """
    tree = _descent(lineage, max_rounds).select(
        "video_hash",
        "parent_hash",
        F.col("ancestor").alias("root_hash"),
        F.col("steps").cast("int").alias("generation"),
        "path",
    )
    rows = tree.join(families, "video_hash")
    several = (
        rows.where("generation = 0")
        .groupBy("family_id")
        .agg(F.count(F.lit(1)).alias("n_roots"))
        .where("n_roots > 1")
    )
    virtual = several.select(
        F.lit("Multiple Origins").alias("video_hash"),
        F.lit(None).cast("string").alias("parent_hash"),
        F.lit("Multiple Origins").alias("root_hash"),
        F.lit(-1).alias("generation"),
        F.lit("").alias("path"),
        "family_id",
    )
    return rows.unionByName(virtual)


def family_components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: every node with its smallest reachable node.

    Each round hands the smallest label among a node's neighbours to the node and to the node
    its label names, then takes the label of the label. Trees of labels merge whole, so the
    rounds grow with the logarithm of the longest path. All reductions combine before the shuffle.
    """
    links = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut_lineage(nodes.select(F.col("node").alias("a"), F.col("node").alias("label")))
    for _ in range(max_rounds):
        around = (
            links.join(labels, "a")
            .groupBy(F.col("b").alias("a"))
            .agg(F.min("label").alias("_near"))
        )
        around = cut_lineage(around.join(labels, "a"))
        named = around.groupBy(F.col("label").alias("a")).agg(F.min("_near").alias("_far"))
        lower = (
            labels.join(around.select("a", "_near"), "a", "left")
            .join(named, "a", "left")
            .select("a", F.col("label").alias("_old"), F.least("label", "_near", "_far").alias("label"))
        )
        lower = cut_lineage(lower)
        hop = lower.select(F.col("a").alias("label"), F.col("label").alias("_up"))
        labels = cut_lineage(
            lower.join(hop, "label", "left").select(
                "a", "_old", F.coalesce("_up", "label").alias("label")
            )
        )
        if labels.where("_old <> label").isEmpty():
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
        labels = labels.drop("_old")
    raise ValueError("components did not settle within the round limit")


def register_lineage(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Links accepted from a batch: the first per child, and only for children not yet known."""
    payload = F.struct(*[c for c in batch.columns if c != "child_hash"])
    firsts = batch.groupBy("child_hash").agg(
        F.min_by(payload, F.struct("registered_at", "request_id")).alias("r")
    )
    return firsts.select("child_hash", "r.*").join(
        existing.select(F.col("video_hash").alias("child_hash")), "child_hash", "left_anti"
    )
