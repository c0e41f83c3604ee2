"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target / size times. The expected copies are summed up
along the source, one offset is added, and a document is emitted once for every integer its
stretch crosses. Within a source the documents lie in order of size, so each stretch of the
sum holds documents of nearly one size and the words taken come very near the target.

The running sum is a position within the source times one rate, so only positions are needed.
They come from a range-sorted narrow table, not from a window over a source, which may hold a
third of all rows: position = place within the task's run of this source + rows of this source
in earlier tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.book import query
from trailmark.llm.common import table, unused, word_count
from trailmark.session import cut_lineage

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all words.
SHARE = 1.5
#: Most a target may be, as a multiple of its source's size.
MOST = 2


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with pos, from 0 within each group in the given order; nulls are a group, and last.

    No task holds a group: the rows are dealt by range of (group, order), and the table that is
    broadcast or joined has one row for each group and task that has rows of it.
    """
    by = [F.col(group).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in order)]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = cut_lineage(dealt.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    runs = placed.groupBy(F.col(group).alias("_group"), task.alias("_task")).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    before = Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    runs = runs.select("_group", "_task", (F.col("_before") - F.col("_first")).alias("_shift"))
    joined = placed.join(runs, (task == F.col("_task")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_group", "_task", "_shift")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with target: shares by weight, the excess over most x size reshared.

    Each round fixes the sources whose share is above their bound and shares the rest anew; only
    two sums per round come to the driver. A source of size 0 has target 0.
    """
    indexed = positions(sizes.withColumn("_all", F.lit(0)), "_all", ["source"]).drop("_all")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int"))
    sources = cut_lineage(
        indexed.select("source", "source_size", weight.alias("_weight"), (most * F.col("source_size")).alias("_bound"))
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = level * F.col("_weight") > F.col("_bound")
        fixed, open_weight = sources.agg(
            F.sum(F.when(full, F.col("_bound")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("_weight")))
        ).first()
        raised = (share * total - fixed) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    target = F.least(F.lit(level) * F.col("_weight"), F.col("_bound").cast("double"))
    return sources.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """In [0, 1), the same at every run: 32 bits of a digest of seed and source."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def mix(docs: DataFrame, *, key: str = "doc_id", seed: int = 42, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """(key, _tie, size, source, source_size, target, copies) for every row of ``docs``.

    copies is how often the mix takes the row. A null text has size 0 and takes part in the
    sampling; a null source is a source of its own, after all others. Ties of size are broken by
    key and then by a digest of the text, so reruns agree; rows equal in all of these are
    exchangeable. An empty table gives an empty result.
    """
    narrow = docs.select(
        F.col(key),
        F.col("source"),
        word_count().alias("size"),
        F.md5(F.coalesce("text", F.lit(""))).alias("_tie"),
    )
    placed = positions(narrow, "source", ["size", key, "_tie"])
    # the checkpoint below positions() holds sizes already, so texts are read once
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share)
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = F.col("pos") * rate + offset(F.col("source"), seed)
    end = (F.col("pos") + 1) * rate + offset(F.col("source"), seed)
    crossed = F.least(F.floor(end) - F.floor(start), F.ceil(rate))
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    return joined.select(key, "_tie", "size", "source", "source_size", "target", crossed.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, *, seed: int = 42, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it, with its columns.

    Texts are shuffled once, by row, to meet their numbers. Rows repeated with one doc_id, source
    and text are exchangeable: the copies of all are dealt out among them in turn.
    """

    def row_key(tie: Column) -> Column:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("doc_id", "source")]
        return F.md5(F.concat_ws("\x01", *parts, tie))

    key, listed, n, copy = (unused(x, docs) for x in ("_key", "_copies", "_n", "_copy"))
    taken = mix(docs, seed=seed, weights=weights, share=share).select(row_key(F.col("_tie")).alias(key), "copies")
    taken = taken.filter("copies > 0").groupBy(key).agg(F.sort_array(F.collect_list("copies"), False).alias(listed))
    joined = docs.withColumn(key, row_key(F.md5(F.coalesce("text", F.lit(""))))).join(taken, key)
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*others, F.lit(0))) - 1
    copies = joined.withColumn(n, F.get(listed, nth)).filter(F.col(n).isNotNull())
    return copies.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*docs.columns)


MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tie,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 2 * source_size AS bound, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(2 * source_size) OVER o, 0) AS fixed, coalesce(sum(w) OVER o, 0) AS fixed_w
  FROM s WINDOW o AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (
  SELECT max((1.5::DOUBLE * total::DOUBLE - fixed::DOUBLE) / (all_w - fixed_w)::DOUBLE) AS level FROM r),
t AS (
  SELECT source, source_size, least(level * w::DOUBLE, bound::DOUBLE) AS target,
    ('0x' || substr(md5('42:' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM r, lev),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
    (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST, d.tie) - 1)::DOUBLE AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(floor((pos + 1) * rate + u) - floor(pos * rate + u), ceil(rate)) * size)::BIGINT AS taken
FROM p
"""


@query("op9_mixing", MIX_SQL)
def op9_mixing(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
