"""Near duplicates by SimHash fingerprints that are compared at the words of a covering code.

Two 64-bit fingerprints that differ in at most two bits differ in at most one bit in their upper
or in their lower half. The anchors of a half are the words of a perfect code: a Hamming code on
31 of its bits, the last bit free, so every half lies within covering radius 1 of exactly one
anchor, its home. A fingerprint is replicated to every anchor within radius + threshold
(1 + 1 bits, 17 anchors at most); one that differs from it by one bit in the half has its home among them.
So comparing, per anchor, those at home with those replicated there finds every link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.book import query
from trailmark.llm.common import bound_batches, stored, table
from trailmark.llm.components import components
from trailmark.llm.shingles import rows_at, similar_groups
from trailmark.session import cut_lineage

#: Shingles whose hashes are held at one time.
RUN = 1 << 16
#: Differing bits up to which two fingerprints are linked; the code is made for this bound.
MOST_BITS = 2


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """SimHash of the text's word shingles as an unsigned 64-bit number; 0 if it has no word."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, RUN):
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + RUN], ends[at : at + RUN], strict=True)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


@F.arrow_udf(T.LongType())
def simhash(texts: pa.Array) -> pa.Array:
    found = np.array([fingerprint(t or "") for t in texts.to_pylist()], np.uint64)
    return pa.array(found.view(np.int64))


def _half(fp: Column, part: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if part == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _syndrome(half: Column) -> Column:
    """Exclusive or of the positions of the set bits, of positions 1 to 31."""
    parities = [
        F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(sum(1 << i for i in range(32) if i >> k & 1)))) % 2, k)
        for k in range(5)
    ]
    out = parities[0]
    for p in parities[1:]:
        out = out + p
    return out


def _flips(syndrome: int) -> list[int]:
    """Bit patterns of weight at most 2 that lead from a word of this syndrome to an anchor; the nearest first."""
    one = [1 << syndrome] if syndrome else [0]
    free = [one[0] | 1]
    two = [1 << i | 1 << (i ^ syndrome) for i in range(1, 32) if syndrome and i < (i ^ syndrome)]
    return one + free + two


def links(nodes: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b), a < b, once for each pair of ``nodes``' distinct fingerprints at most two bits apart."""
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in _flips(s)]) for s in range(32)])
    homes, guests = [], []
    for part in (0, 1):
        half = _half(F.col(fp), part)
        flips = F.get(table, _syndrome(half))
        # the anchor's number and the half it belongs to in one key
        key = half.bitwiseXOR(F.col("_flip")).bitwiseOR(F.lit(part << 32)).alias("anchor")
        homes.append(nodes.select(fp, F.get(flips, F.lit(0)).alias("_flip")).select(key, F.col(fp).alias("a")))
        guests.append(nodes.select(fp, F.explode(flips).alias("_flip")).select(key, F.col(fp).alias("b")))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    upper = F.bit_count(_half(differ, 0))
    first = (F.col("anchor") < (1 << 32)) | (upper > 1)  # a pair found in both halves counts in the upper
    near = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= MOST_BITS)
    at_home, away = homes[0].unionByName(homes[1]), guests[0].unionByName(guests[1])
    one_apart = F.when(F.col("anchor") < (1 << 32), upper).otherwise(F.bit_count(_half(differ, 1))) <= 1
    return at_home.join(away, "anchor").filter(near & one_apart & first).select("a", "b")


def near_duplicates(docs: DataFrame, *extra: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, extra..., fp, component_id) for every row: the smallest key that its links lead to.

    A null text is the empty one. Texts without words all have fingerprint 0, which is linked
    like any other. Equal texts have equal fingerprints, and only distinct fingerprints are
    compared. A component of rows without a key has none. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    printed = cut_lineage(docs.select(F.col(key), *extra, simhash(F.col(text)).alias("fp")))
    nodes = cut_lineage(printed.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(nodes), "a", "b").withColumnRenamed("node", "fp")
    rooted = cut_lineage(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return printed.join(classes, "fp")


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row of smallest (doc_id, text digest).

    Near duplicates are texts whose sets of five-word shingles have a Jaccard likeness of 0.8 or
    more, all of them. A fingerprint's bits can't say so: texts that like differ in two bits or in
    a dozen. Groups are told apart by their texts alone; doc_id only chooses the row that stays. Rows repeated in
    full are one row of a group. Groups are never gathered in a task: the least row is a minimum,
    and the rows are then picked by key.
    """
    digest = F.md5(F.coalesce("text", F.lit("")))
    pick = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), digest)))
    found = similar_groups(docs, pick, F.col("doc_id"))
    counted = found.groupBy("root", "_row").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_rows"))
    winners = counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row", "_rows")).alias("w"))
    winners = stored(winners.select("w._row", "w._rows"), "winners")
    return rows_at(docs, pick, winners).select(*docs.columns)


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")
