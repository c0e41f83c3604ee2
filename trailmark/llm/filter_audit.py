"""How filters interact: what each removes in every order in which they can be applied.

A row that fails some of the filters (its mask) is removed at the first of them in the order. The
orders are numbered lexicographically by their Lehmer ranks, so all orders that begin with the same
filters are an interval of ranks: after a beginning that spares the row, the filter that removes it
at the next step does so throughout one interval. Rows are first counted by mask; each mask's counts
are then added at the starts of its intervals and taken off past their ends, and prefix sums over the
ranks give every order's totals. No row of the table meets any order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.book import query
from trailmark.llm.common import bound_batches, once, table

#: The text filters by letter, and what fails them.
FILTERS = {
    "A": "fewer than 200 words",
    "B": "100 x distinct words below 50 x words",
    "C": "100 x capital letters A-Z above 3 x code points",
    "D": "holds one of # $ % & * |",
    "E": "identical to the text of a smaller doc_id",
}
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Most filters: the result has as many orders as their permutations.
MOST_FILTERS = 7

_INSPECTED = T.StructType().add("mask", T.IntegerType()).add("digest", T.BinaryType())


def text_mask(text: bytes, n_chars: int) -> int:
    """The bits of the filters A to D (A lowest) that the text fails. Words lie between ASCII white space."""
    words = text.split()
    failed = [
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * (len(text) - len(text.translate(None, CAPITALS))) > CAPITAL_PERCENT * n_chars,
        SYMBOLS.search(text) is not None,
    ]
    return sum(bit << k for k, bit in enumerate(failed))


@once
@F.arrow_udf(_INSPECTED)
def inspected(texts: pa.Array) -> pa.Array:
    masks, digests = [], []
    for text in texts:
        raw = text.as_py() or ""
        data = raw.encode()
        masks.append(text_mask(data, len(raw)))
        digests.append(hashlib.sha256(data).digest())
    return pa.StructArray.from_arrays([pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["mask", "digest"])


def removal_intervals(mask: int, k: int) -> list[tuple[int, int, int]]:
    """(step, first rank, rank past the last): where rows of this mask go, for k filters; neighbours of one step joined."""

    def walk(free: list[int], step: int, at: int) -> Iterator[tuple[int, int, int]]:
        wide = factorial(len(free) - 1)
        for i, f in enumerate(free):
            if mask >> f & 1:
                yield step, at + i * wide, at + (i + 1) * wide
            elif len(free) > 1:
                yield from walk(free[:i] + free[i + 1 :], step + 1, at + i * wide)

    joined: list[tuple[int, int, int]] = []
    last: dict[int, int] = {}  # by step, the place of its latest interval
    for step, first, past in walk(list(range(k)), 1, 0):
        if step in last and joined[last[step]][2] == first:
            joined[last[step]] = (step, joined[last[step]][1], past)
        else:
            last[step] = len(joined)
            joined.append((step, first, past))
    return joined


def _ends(spark, k: int) -> DataFrame:
    """(mask, step, rank, sign) of all masks' interval ends; its size depends on k alone."""
    rows = []
    for mask in range(1, 1 << k):
        for step, first, past in removal_intervals(mask, k):
            rows += [(mask, step, first, 1), (mask, step, past, -1)]
    columns = np.array(rows, np.int32).T
    return spark.createDataFrame(pa.table(dict(zip(("mask", "step", "rank", "sign"), map(pa.array, columns), strict=True))))


def interactions(counts: DataFrame, letters: str, marks: tuple[str, ...] = ()) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, marks..., shapley) for every part, order and step.

    ``counts`` has part, mask (bit i: the row fails letters[i]), n and, for each of ``marks``, how many
    of the n rows carry it; rows may repeat a part and mask. A mark's column in the result counts the
    rows removed at the step that carry it. Letters must ascend. All orders are returned for every
    part that occurs, zeros included; an empty table gives an empty result. Further columns are ignored.
    """
    k, spark = len(letters), counts.sparkSession
    if not 0 < k <= MOST_FILTERS or list(letters) != sorted(set(letters)):
        raise ValueError(f"1 to {MOST_FILTERS} letters in ascending order are needed")
    summed = ("n", *marks)
    held = counts.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in summed])
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << f)) != 0, F.col("n")).otherwise(0)) for f in range(k)]
    alone = [F.sum(F.when(F.col("mask") == 1 << f, F.col("n")).otherwise(0)) for f in range(k)]
    parts = held.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))

    # the difference arrays: counts at interval ends, and a zero at every rank
    at_ends = held.join(F.broadcast(_ends(spark, k)), "mask")
    deltas = at_ends.select("part", "step", "rank", *[(F.col("sign") * F.col(c)).alias(c) for c in summed])
    spots = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    spots = spots.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(k) - 1))))
    deltas = deltas.unionByName(spots.select("*", *[F.lit(0).cast("long").alias(c) for c in summed]))
    deltas = deltas.groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in summed])
    # at most k! + 1 rows of a part and step
    prefix = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    totals = deltas.select("part", "step", "rank", *[F.sum(c).over(prefix).alias(c) for c in summed]).filter(F.col("rank") < factorial(k))

    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    order = F.element_at(orders, F.col("rank") + 1)
    rows = totals.withColumn("filter_order", order).withColumn("_letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_gone", F.sum("n").over(so_far))
    rows = rows.withColumn("shapley", F.sum("n").over(Window.partitionBy("part", "_letter")))
    of = F.instr(F.lit(letters), F.col("_letter"))
    return rows.join(parts, "part").select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.col("_gone")).alias("kept"),
        F.col("n").alias("removed"),
        (F.element_at("fails", of) - F.col("n")).alias("redundant"),
        F.element_at("alone", of).alias("unique_fails"),
        *marks,
        "shapley",
    )


def failure_counts(docs: DataFrame, marked: DataFrame, marks: dict[str, Column], part: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, n, marks...): the rows of ``docs`` by the filters A to E that they fail.

    ``marks`` are conditions on the rows of ``marked``, which has the key too; a row carries a mark if
    any row of its key meets it. A null text is the empty one; a null key is no smaller than any other
    and none is smaller than it, so such rows don't fail E, and carry no mark. Repeated rows count
    each; rows of one text with its smallest key don't fail E. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    seen = docs.select(F.col(key).alias("key"), F.coalesce(part, F.lit("")).alias("part"), inspected(F.col(text)).alias("seen"))
    seen = seen.select("key", "part", "seen.*")
    hits = [F.max(F.when(c, 1).otherwise(0)).alias(name) for name, c in marks.items()]
    hits = marked.groupBy(F.col(key).alias("key")).agg(*hits).filter(F.col("key").isNotNull())
    # rows without a key never meet a mark and don't travel to one task for that
    keyed = seen.filter(F.col("key").isNotNull()).join(hits, "key", "left")
    loose = seen.filter(F.col("key").isNull()).select("*", *[F.lit(None).cast("int").alias(m) for m in marks])
    rows = keyed.unionByName(loose).fillna(0, list(marks))

    # copies combine before they are shuffled, and what is left of a text is one row for each part and set of marks
    alike = ["digest", "part", "mask", *marks]
    by_key = rows.groupBy(*alike, "key").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct(F.col("key").isNull().alias("loose"), "key", "n"))
    groups = by_key.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("loose"), least.alias("least")
    )
    owner = F.min("least.key").over(Window.partitionBy("digest"))
    first = F.when(F.col("least.key") == F.col("owner"), F.col("least.n")).otherwise(0) + F.col("loose")
    groups = groups.withColumn("owner", owner).withColumn("first", first)
    repeats = F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("first")).alias("n"))
    both = F.array(F.struct("mask", F.col("first").alias("n")), repeats)
    dealt = groups.select("part", *marks, F.explode(both).alias("_")).select("part", "_.*", *marks).filter("n > 0")
    return dealt.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(m)).alias(m) for m in marks])


AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.doc_id, part,
    concat(
      CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END,
      CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
g AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM l a, l b, l c, l d, l e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
-- the step at which rows of a mask go: the first letter of the order that they fail
c AS (
  SELECT g.part, s.filter_order, s.step, s.letter, n, good, toxic, fails,
    strpos(fails, letter) > 0 AS hit,
    strpos(fails, letter) > 0 AND length(translate(fails, substr(s.filter_order, 1, s.step - 1), '')) = length(fails) AS goes
  FROM g, s),
t AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN goes THEN n ELSE 0 END) AS removed, sum(n) AS total,
    sum(CASE WHEN hit AND NOT goes THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN goes THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN goes THEN toxic ELSE 0 END) AS toxic_lost
  FROM c GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step,
  (total - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step))::BIGINT AS kept,
  removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM t
"""


@query("op11_filter_audit", AUDIT_SQL)
def op11_filter_audit(spark, sf_dir):
    marks = {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1}
    counts = failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), marks, F.col("lang"))
    return interactions(counts, "".join(FILTERS), tuple(marks))
