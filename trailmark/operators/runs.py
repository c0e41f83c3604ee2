"""Running values per key that survive hot keys.

A plain window puts all rows of a key in one task. Here rows are dealt by ranges of (key,
order), so that a range holds about equally many rows whatever the keys, and the part of a key
that lies in one range is a slot: a window partition of its own. A small table of per-slot totals
supplies what came before the slot. The result is the same as that of the plain window, and
there is one way for all keys, hot or not.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.session import cut_lineage


def with_slots(df: DataFrame, keys: list[str], order: list[str], run_rows: int | None = None) -> DataFrame:
    """The rows, written once, with ``_slot``: rising numbers along (keys, order), bounded by rows.

    How many ranges there are is left to Spark, unless ``run_rows`` names the rows of one.
    """
    by = [*keys, *order]
    if run_rows is None:
        dealt = df.repartitionByRange(*by)
    else:
        dealt = df.repartitionByRange(max(1, -(-df.count() // run_rows)), *by)
    return cut_lineage(dealt.withColumn("_slot", F.spark_partition_id().cast("bigint")))


def ranked(df: DataFrame, order: list[str], run_rows: int | None = None) -> tuple[DataFrame, int]:
    """The rows with ``_rank``, from 1 in the total order, and how many rows there are.

    No task holds more than a range of the rows; only the rows of each range are counted on the driver.
    """
    rows = with_slots(df, [], order, run_rows)
    before, offsets = 0, []
    for r in sorted(rows.groupBy("_slot").count().collect()):
        offsets.append((r["_slot"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(offsets, "_slot bigint, _before bigint")
    inside = Window.partitionBy("_slot").orderBy(*order)
    placed = rows.withColumn("_in", F.row_number().over(inside)).join(starts, "_slot")
    return placed.select(*df.columns, (F.col("_in") + F.col("_before")).alias("_rank")), before


#: Ranges that a table is counted in at once, and rows that are few enough to be put in order.
RANGES, FEW = 64, 1_000_000
_CUT = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Narrowed:
    """The rows of some neighbouring ranges of a table's order: which they are, how many come before, which come after."""

    inside: Column
    before: int
    after: Column


def narrowed(df: DataFrame, column: str, low: int, high: int, few: int = FEW) -> Narrowed:
    """Ranges of the first order column that hold the rows of ranks ``low`` + 1 to ``high``; nulls come first.

    Each step counts the rows of all ranges at once, from that column alone, and goes on with those that
    hold a wanted row, until they are few or one value. A column that has no quantiles, as a string, gives one range.
    """
    inside, before, after = F.lit(True), 0, F.lit(False)
    kind = df.schema[column].dataType
    if not isinstance(kind, _CUT):
        return Narrowed(inside, before, after)
    col, held = F.col(column), None
    while True:
        part = df.where(inside).select(col)
        at = [k / RANGES for k in range(1, RANGES)]
        texts = F.transform(F.percentile_approx(col, at, 100 * RANGES), lambda x: x.cast("string"))
        cuts = [F.lit(x).cast(kind) for x in dict.fromkeys(part.agg(texts.alias("c")).first()["c"] or [])]
        number = F.when(col.isNull(), F.lit(-1)).otherwise(reduce(lambda n, c: n + (col >= c).cast("int"), cuts, F.lit(0)))
        counts = sorted(tuple(r) for r in part.groupBy(number.alias("n")).count().collect())
        past, wanted, skipped = before, [], 0
        for n, count in counts:
            if past + count <= low:
                skipped += count
            elif past < high:
                wanted.append((n, count))
            past += count
        if not wanted:
            return Narrowed(F.lit(False), before + skipped, F.lit(False))
        rows = sum(count for _, count in wanted)
        before += skipped
        first, last = wanted[0][0], wanted[-1][0]
        if first > 0:
            inside = inside & (col >= cuts[first - 1])
        elif first == 0:
            inside = inside & col.isNotNull()
        if last < 0:
            inside, after = inside & col.isNull(), col.isNotNull()
        elif last < len(cuts):
            below = col < cuts[last]
            inside, after = inside & (below if first >= 0 else (below | col.isNull())), col >= cuts[last]
        if rows <= few or last < 0 or (held is not None and rows * 2 > held):
            return Narrowed(inside, before, after)
        held = rows


def _with_firsts(rows: DataFrame, keys: list[str], order: list[str], column: str, flag: str) -> DataFrame:
    """The rows with ``flag``: whether one is the first of its value of ``column``, over all slots of the key.

    Slots are aggregated first, so a hot value is one row per slot before it is compared over slots.
    """
    at = F.struct(*order, "_slot")
    firsts = rows.groupBy(*keys, "_slot", column).agg(F.min(at).alias("_f")).groupBy(*keys, column).agg(F.min("_f").alias("_f"))
    on = [*keys, "_slot", order[-1]]
    firsts = firsts.select(*[F.col(c).alias(f"_of_{c}") for c in keys], *[F.col(f"_f.{c}").alias(f"_of_{c}") for c in ("_slot", order[-1])])
    found = rows.join(firsts, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on], "left")
    return found.withColumn(flag, F.col("_of__slot").isNotNull()).drop(*[f"_of_{c}" for c in on])


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    row_number: str | None = None,
    running_min: dict[str, str] | None = None,
    lag: dict[str, str] | None = None,
    distinct: tuple[str, str, str] | None = None,
    attach: DataFrame | None = None,
    attach_on: list[str] | None = None,
    run_rows: int | None = None,
) -> DataFrame:
    """Adds running columns per key in the given total order; the last order column is unique.

    ``row_number`` names a 1-based position. ``running_min`` maps new column -> column.
    ``lag`` maps new column -> column of the previous row. ``distinct`` = (column, first flag,
    running count) marks the first row of each distinct value and counts the values so far, however
    many there are: first rows are joined one to one, and only their number travels with a slot.
    ``attach`` has facts of keys (of the columns ``attach_on``, all keys if not given), one row each:
    they are joined to the small table of slots, and reach the rows with it, so a hot key is not joined
    on its plain value; rows of keys without facts are left out.
    """
    rows = with_slots(df, keys, order, run_rows)
    part = [*keys, "_slot"]
    order_struct = F.struct(*order)
    mins, lags = running_min or {}, lag or {}

    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.min(src).alias(f"_min_{new}") for new, src in mins.items()]
    if lags:
        last = F.struct(*[F.col(src).alias(new) for new, src in lags.items()])
        aggs.append(F.max_by(last, order_struct).alias("_last"))
    if distinct:
        column, first_flag, seen_count = distinct
        rows = _with_firsts(rows, keys, order, column, first_flag)
        aggs.append(F.count_if(first_flag).alias("_firsts"))
    slots = rows.groupBy(*part).agg(*aggs)

    before = Window.partitionBy(*keys).orderBy("_slot")
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before")]
    carried += [F.min(f"_min_{new}").over(past).alias(f"_min_{new}") for new in mins]
    if lags:
        carried.append(F.lag("_last").over(before).alias("_last"))
    if distinct:
        carried.append(F.coalesce(F.sum("_firsts").over(past), F.lit(0)).alias("_seen"))
    facts: list[str] = []
    if attach is not None:
        on = attach_on or keys
        facts = [c for c in attach.columns if c not in on]
        slots = slots.join(attach, on)
    slots = slots.select(*[F.col(c).alias(f"_of_{c}") for c in part], *carried, *facts)
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in part]
    joined = rows.join(slots, same).drop(*[f"_of_{c}" for c in part])

    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out: dict[str, Column] = {}
    if row_number:
        out[row_number] = (
            F.row_number().over(inside) + F.coalesce("_before", F.lit(0))
        ).cast("bigint")
    for new, src in mins.items():
        out[new] = F.least(F.min(src).over(upto), F.col(f"_min_{new}"))
    for new, src in lags.items():
        at_start = F.row_number().over(inside) == 1
        out[new] = F.when(at_start, F.col(f"_last.{new}")).otherwise(F.lag(src).over(inside))
    if distinct:
        out[seen_count] = (F.sum(F.col(first_flag).cast("int")).over(upto) + F.col("_seen")).cast(
            "bigint"
        )
    result = joined.withColumns(out)
    extra = [first_flag] if distinct else []
    return result.select(*df.columns, *extra, *out, *facts)
