"""Groups of texts whose sets of word shingles have at least a given Jaccard likeness, exactly.

Of two sets in one order of shingles whose likeness is at least t, the first n - ceil(t n) + 1 of
each (n its size) have one in common, so texts that meet at no such shingle need no comparing. The
order is by hash, with shingles that a sample shows to be common last, so that few texts meet at
them; the order has no influence on the groups. No fingerprint of fixed bits can do the same: the
bits in which texts of likeness 0.8 differ have no bound.

A pair is dropped unread only on what rules it out: sizes, what can follow the first shared shingle,
or parities. Each set has 1024 bits, every shingle turning one over; sets differ in at least as many
shingles as bits. What remains is counted on the whole sets.

Texts are first compared with the least one at each of their shingles. The remaining pairs are then
those of texts that are not in one group already, so that many copies of one text don't make all pairs.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import bound_batches, once, stored, unused
from trailmark.llm.components import components

#: Bits that a set's shingles turn over.
PARITIES = 1024
#: One in so many texts is read for common shingles.
SAMPLE = 32
#: Texts of the sample that make a shingle common.
COMMON = 8
#: Most common shingles that are told to the tasks.
TOLD = 100_000


def shingle_hashes(text: str, width: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct hashes of the text's word shingles in ascending order; a shorter text with words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True))
    return np.unique(np.fromiter(hashes, np.uint64, n).view(np.int64))


def _sets(width: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(t or "", width) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return once(sets)


def _sketches(width: int, similarity: Fraction, common: np.ndarray):
    """node (a hash of the set), n (its size), head (the shingles at which texts meet) and parity."""
    rank = np.argsort(common)  # of each of ``told``, from 0 for the most common
    told = common[rank]

    longs = T.ArrayType(T.LongType())

    @F.arrow_udf(T.StructType().add("node", T.LongType()).add("n", T.LongType()).add("head", longs).add("parity", longs))
    def sketches(texts: pa.Array) -> pa.Array:
        nodes, sizes, heads, parities = [], [], [], []
        for t in texts.to_pylist():
            own = shingle_hashes(t or "", width)
            nodes.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
            sizes.append(len(own))
            turned = np.bincount(own.view(np.uint64) % np.uint64(PARITIES), minlength=PARITIES) & 1
            parities.append(np.packbits(turned.astype(bool)).view(np.int64))
            late = np.full(len(own), -1)
            if len(told):
                at = np.minimum(np.searchsorted(told, own), len(told) - 1)
                hit = told[at] == own
                late[hit] = len(told) - rank[at[hit]]
            least = -(-len(own) * similarity.numerator // similarity.denominator)
            heads.append(own[np.argsort(late, kind="stable")][: len(own) - least + 1 if len(own) else 0])
        columns = [*(pa.array(x, pa.int64()) for x in (nodes, sizes)), *(pa.array(x, pa.list_(pa.int64())) for x in (heads, parities))]
        return pa.StructArray.from_arrays(columns, ["node", "n", "head", "parity"])

    return once(sketches)


def _alike(na: Column, nb: Column, both: Column, similarity: Fraction) -> Column:
    """Whether sets of these sizes that share ``both`` shingles reach the likeness; in whole numbers."""
    p, q = similarity.numerator, similarity.denominator
    return both * (p + q) >= (na + nb) * p


def rows_at(docs: DataFrame, row: Column, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row`` is in ``wanted`` (_row, _rows), once each.

    ``_rows`` tells how many rows have it; only repeated rows are grouped.
    """
    name = unused("_row", docs)
    found = [docs.withColumn(name, row).join(wanted.filter(some).select(F.col("_row").alias(name)), name) for some in ("_rows = 1", "_rows > 1")]
    return found[0].unionByName(found[1].dropDuplicates([name])).withColumnRenamed(name, "_row")


def similar_groups(docs: DataFrame, row: Column, *extra: Column, text: str = "text", width: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """(_row, extra..., root) for every row: rows have one root where a chain of similar texts leads from one to the other.

    ``row`` gives equal values to rows of equal texts only. White space and the case of ASCII
    letters don't count. A null text is the empty one; texts without words are one group.
    """
    bound_batches(docs.sparkSession)
    sampled = docs.filter(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).select(F.explode(_sets(width)(F.col(text))).alias("shingle"))
    counted = sampled.groupBy("shingle").count().filter(F.col("count") >= COMMON)
    common = np.array([r.shingle for r in counted.orderBy(F.desc("count"), "shingle").limit(TOLD).collect()], np.int64)
    sketch = _sketches(width, similarity, common)(F.col(text)).alias("_sketch")
    drawn = stored(docs.select(row.alias("_row"), *extra, sketch).select("*", "_sketch.*").drop("_sketch"), "sketches")

    counted = drawn.groupBy("node", "_row").agg(F.count(F.lit(1)).alias("_rows"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    nodes = counted.groupBy("node").agg(F.min(F.struct("_row", "_rows")).alias("at"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    nodes = stored(nodes.select("node", "at.*", "n", "parity"), "nodes")

    heads = drawn.select("node", "n", F.posexplode("head").alias("place", "shingle")).repartition("shingle")
    heads = heads.groupBy("shingle", "node").agg(F.min("n").alias("n"), F.min("place").alias("place"))
    at = Window.partitionBy("shingle")
    member = F.struct("node", "n", "place")
    met = heads.withColumn("_met", F.count(F.lit(1)).over(at)).withColumn("least", F.min(member).over(at))
    met = stored(met.filter("_met > 1").select("shingle", member.alias("one"), "least"), "meetings")

    def possible(a: str, b: str) -> Column:
        """At the first shingle that two sets share, at most what follows in the shorter rest is shared."""
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        rest = F.least(na - F.col(f"{a}.place"), nb - F.col(f"{b}.place"))
        return _alike(na, nb, rest, similarity)

    def unruled(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) without those whose parities differ in more bits than similar sets have unlike shingles."""
        left, right = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "ab")
        bits = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        both = (F.col("na") + F.col("nb") - bits) / 2  # at most so many; exact, as a half
        return pairs.join(left, "a").join(right, "b").filter(_alike(F.col("na"), F.col("nb"), both, similarity)).select("a", "b")

    def checked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        shown = stored(nodes.select("node", "_row", "_rows").join(ends, "node"), "ends")
        read = rows_at(docs.select(F.col(text).alias("_text"), row.alias("_at")), F.col("_at"), shown.select("_row", "_rows"))
        sets = read.select("_row", _sets(width)("_text").alias("shingles")).join(shown, "_row")
        sets = stored(sets.select("node", "shingles"), "shingles")
        left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"_{x}")) for x in "ab")
        joined = pairs.join(left, "a").join(right, "b")
        both = F.size(F.array_intersect("_a", "_b"))
        return joined.filter(_alike(F.size("_a"), F.size("_b"), both, similarity)).select("a", "b")

    first = met.filter((F.col("one.node") != F.col("least.node")) & possible("one", "least"))
    first = stored(unruled(first.select(F.col("least.node").alias("a"), F.col("one.node").alias("b")).distinct()), "pairs")
    links = stored(checked(first), "links")
    roots = components(links, "a", "b")
    placed = met.select("shingle", "one", F.col("one.node").alias("node")).join(roots, "node", "left")
    placed = placed.select("shingle", "one", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "placed")
    other = placed.select("shingle", F.col("one").alias("two"), F.col("root").alias("_root"))
    rest = placed.join(other, "shingle").filter((F.col("one.node") < F.col("two.node")) & (F.col("root") != F.col("_root")) & possible("one", "two"))
    rest = rest.select(F.col("one.node").alias("a"), F.col("two.node").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    links = links.unionByName(checked(stored(unruled(rest), "pairs")))
    roots = components(links, "a", "b")
    return drawn.drop("n", "head", "parity").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")
