"""Groups of texts of a given Jaccard likeness: wide SimHash fingerprints compared at anchors, then an exact way for the rest.

A text's fingerprint is taken over its distinct five-word shingles. It is cut into parts, and the anchors
of a part are the words of a covering code: a perfect Hamming code on 7 of its bits, the other bits free.
Every part lies within covering radius 1 of one anchor, its home, and is replicated to all anchors within
radius + threshold (1 + 1 bits, 4 at most): of two parts that differ by one bit at most within the code, one
meets the other at its home. Two texts of the given likeness differ in a known share of bits, so the parts
are as many as it takes for nearly all such pairs to meet, and a part has the more free bits the more texts
there are, so that a text meets few others by chance. What meets is told apart by 128 bits that are in no
part: of those that meet by chance hardly any are left.

Those at home at an anchor are first compared with one of them; where many are, with the one nearest
to the majority of their bits, which copies of one text mostly are copies of. Of the groups that this finds,
one member at each anchor is then compared with those of other groups. So a group of many copies gives
links in proportion to its members. What the fingerprints let pass is decided by the shingles, exactly.

Fingerprints miss a pair now and then, and one member of a group does not speak for the others. So texts of
different groups are at last compared wherever they can be alike: of two sets in one order of shingles whose
likeness is at least t and that share w or more, the first l that they share are among the first n - w + l of
either (n its size), and n - ceil(t n) + l of each set are enough for all others, whose sizes are not known. The order is by hash, with shingles that a sample shows to be common last; it has no influence on the groups.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import bound_batches, once, stored, unsent, unused
from trailmark.llm.components import components
from trailmark.llm.shingles import rows_at, shingle_hashes

WIDTH, SIMILARITY = 5, Fraction(4, 5)
#: Share of the pairs at the very likeness that should meet at an anchor; more alike ones do more often.
MEETING = 0.96
#: Least free bits of a part, and by how many bits these are fewer than the texts' number has; so a text is
#: compared with some 2^12 others by chance, which takes less than its fingerprint does.
LEAST_FREE, FEWER = 8, 10
#: An anchor is crowded if it is home to so many times the expected texts.
CROWDED = 4
#: Pairs of one text that are counted in one task.
CHUNK = 256
#: Words of 64 bits, in no part, by which those that meet are told apart; and the deviations up to which they may differ.
CHECKS, DEVIATIONS = 2, 3
#: One in so many texts is read for common shingles, texts of the sample that make one common, and most that are told to the tasks.
SAMPLE, COMMON, TOLD = 8, 8, 100_000
#: Of one in so many of a set's shingles, and one more, it is asked whether the heads of alike sets share them.
ASKED = 40
#: Most bits, as a power of two, of the set of marks that rows are looked up in before they are shuffled.
MOST_MARKS = 25

_CODE = 7  # bits of the Hamming code; the position of a wrong bit is the exclusive or of the set positions
_SYNDROME = np.array([np.bitwise_xor.reduce([0, *(k + 1 for k in range(_CODE) if x >> k & 1)]) for x in range(1 << _CODE)])
_HOME = np.array([x ^ (1 << s - 1 if s else 0) for x, s in enumerate(_SYNDROME.tolist())])
_WORDS = np.unique(_HOME)
_GUESTS = [[w for w in _WORDS.tolist() if bin(w ^ x).count("1") <= 2] for x in range(1 << _CODE)]
_MOST = max(map(len, _GUESTS))
_AT = np.array([g + [-1] * (_MOST - len(g)) for g in _GUESTS])


@dataclass(frozen=True)
class Cover:
    """Parts of so many free bits beside the code, and bits in which pairs of the likeness may differ."""

    free: int
    parts: int
    differ: float  # expected share of differing bits

    @property
    def words(self) -> int:
        """With the words that are in no part."""
        return -(-self.parts * (_CODE + self.free) // 64) + CHECKS

    def most(self, bits: int, deviations: float) -> int:
        return math.ceil(bits * self.differ + deviations * math.sqrt(bits * self.differ * (1 - self.differ)))


def cover(texts: int, similarity: Fraction = SIMILARITY) -> Cover:
    """The parts for so many texts. Sets of likeness J are at an angle whose cosine is 2 J / (1 + J) if they are of one size."""
    differ = math.acos(float(2 * similarity / (1 + similarity))) / math.pi
    free = max(LEAST_FREE, max(1, texts).bit_length() - FEWER)
    same = 1 - differ
    meet = (same**_CODE + _CODE * differ * same ** (_CODE - 1)) * same**free
    return Cover(free, math.ceil(math.log(1 - MEETING) / math.log1p(-meet)), differ)


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` x 64 bits; a bit is 1 if it is in over half of the hashes, of which each word has its own."""
    ones = np.zeros((words, 64), np.int64)
    for a in range(0, len(hashes), 1 << 14):
        base = hashes[a : a + (1 << 14)].view(np.uint64)
        for k in range(words):
            x = base + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            ones[k] += np.unpackbits((x ^ x >> np.uint64(31)).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), axis=1).view(np.int64).reshape(-1)


def _sketches(width: int, words: int):
    @F.arrow_udf(T.StructType().add("node", T.LongType()).add("n", T.LongType()).add("fp", T.ArrayType(T.LongType())))
    def sketches(texts: pa.Array) -> pa.Array:
        nodes, sizes, prints = [], [], []
        for t in texts:
            own = shingle_hashes(t.as_py() or "", width)
            nodes.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
            sizes.append(len(own))
            prints.append(fingerprint(own, words))
        columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(columns, ["node", "n", "fp"])

    return once(sketches)


_CHECKS = [f"check{k}" for k in range(CHECKS)]
_ROW = f"anchor long, node long, root long, {', '.join(f'{c} long' for c in _CHECKS)}, home boolean"


def _anchors(plan: Cover, homes_only: bool = False):
    """A row for every anchor that a fingerprint is replicated to, or for the homes alone."""
    wide = _CODE + plan.free
    if wide + plan.parts.bit_length() > 62:
        raise ValueError("an anchor's number needs more than 62 bits")

    def rows(batches):
        for batch in batches:
            nodes, roots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            prints = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            if not len(nodes):
                continue
            bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(nodes), -1), axis=1)
            for part in range(plan.parts):
                own = bits[:, part * wide : (part + 1) * wide].astype(np.int64)
                code = own[:, :_CODE] @ (1 << np.arange(_CODE))
                free = own[:, _CODE:] @ (1 << np.arange(plan.free)) << _CODE | part << wide
                at = _HOME[code][:, None] if homes_only else _AT[code]
                there = at >= 0
                from_ = np.nonzero(there)[0]
                anchor, home = at[there], (at == _HOME[code][:, None])[there]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (anchor | free[from_], nodes[from_], roots[from_], *prints[from_, -CHECKS:].T, home)],
                    ["anchor", "node", "root", *_CHECKS, "home"],
                )

    return rows


def _alike(na, nb, both, similarity: Fraction):
    p, q = similarity.numerator, similarity.denominator
    return both * (p + q) >= (na + nb) * p


def _apart(a: str, b: str) -> Column:
    """Differing bits of the check words of both, whose columns have these names before their numbers."""
    return reduce(Column.__add__, [F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(CHECKS)])


def _shared_by(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose shingle has unlike values of the column."""
    at = Window.partitionBy("shingle")
    found = rows.withColumn("_least", F.min(column).over(at)).withColumn("_most", F.max(column).over(at))
    return found.filter("_least < _most").drop("_least", "_most")


def _heads(width: int, similarity: Fraction, common: np.ndarray):
    """(shingle, node, place) of the head of each set, where any alike one has ``ASKED`` of its shingles or more.

    ``common`` are shingles that come last in the order, the most common at the end. Equal sets give rows once a task.
    """
    told = np.sort(common)
    rank = len(common) - np.argsort(common)  # of each of ``told``, the greatest for the most common

    def rows(batches):
        seen = set()
        for batch in batches:
            found = []
            for t in batch.column(0):
                own = shingle_hashes(t.as_py() or "", width)
                node = xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)
                if not len(own) or node in seen:
                    continue
                seen.add(node)
                late = np.zeros(len(own), np.int64)
                if len(told):
                    at = np.minimum(np.searchsorted(told, own), len(told) - 1)
                    hit = told[at] == own
                    late[hit] = rank[at[hit]]
                whole = -(-len(own) * similarity.numerator // similarity.denominator)
                head = len(own) - whole + min(whole, len(own) // ASKED + 1)
                found.append((own[np.argsort(late, kind="stable")][:head], node))
            if found:
                sizes = [len(x[0]) for x in found]
                shingles, nodes = np.concatenate([x[0] for x in found]), np.repeat(np.array([x[1] for x in found], np.int64), sizes)
                places = np.concatenate([np.arange(1, k + 1) for k in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shingles, nodes, places)], ["shingle", "node", "place"])

    return rows


def _sets(width: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(t.as_py() or "", width) for t in texts], pa.list_(pa.int64()))

    return once(sets)


def _marked(docs: DataFrame, key: str, wanted: DataFrame, others: bool = False) -> DataFrame:
    """The rows of ``docs`` whose ``key`` may be among ``wanted`` (_row), without a shuffle; or those that surely are not.

    The marks are bits, so many that few other rows hit one, but never more than ``MOST_MARKS`` allows.
    """
    size = 1 << min(MOST_MARKS, max(10, (16 * wanted.count()).bit_length()))
    word, bits = unused("_word", docs), unused("_bits", docs)

    def spot(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(size))

    def bit(column: str) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot(column), F.lit(64)).cast("int"))

    marks = wanted.groupBy(F.shiftright(spot("_row"), 6).alias(word)).agg(F.bit_or(bit("_row")).alias(bits))
    placed = docs.withColumn(word, F.shiftright(spot(key), 6)).join(F.broadcast(marks), word, "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(bit(key)) != 0, F.lit(False))
    return placed.filter(~hit if others else hit).drop(word, bits)


def _count(width: int, similarity: Fraction):
    def count(key, one: pa.Table, others: pa.Table) -> pa.Table:
        """(a, b) of the texts that are alike with the one text."""
        found = []
        if one.num_rows:
            own = shingle_hashes(one["text"][0].as_py(), width)
            for b, text in zip(others["b"].to_pylist(), others["text"], strict=True):
                other = shingle_hashes(text.as_py(), width)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if _alike(len(own), len(other), both, similarity):
                    found.append(b)
        return pa.table({"a": pa.array([key[0].as_py()] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return count


def similar_groups(docs: DataFrame, row: Column, *extra: Column, text: str = "text", width: int = WIDTH, similarity: Fraction = SIMILARITY) -> DataFrame:
    """(_row, extra..., root) for every row: rows have one root where links lead from one to the other.

    Linked are all texts whose sets of word shingles have at least the likeness; none below it. ``row`` gives equal values to rows of equal texts only. White space and the case
    of ASCII letters don't count. A null text is the empty one; texts without words are one group.
    """
    bound_batches(docs.sparkSession)
    plan = cover(docs.count(), similarity)
    sketch = _sketches(width, plan.words)(F.col(text)).alias("_sketch")
    drawn = stored(docs.select(row.alias("_row"), *extra, sketch).select("*", "_sketch.*").drop("_sketch"), "sketches")
    nodes = drawn.groupBy("node").agg(F.min("_row").alias("_row"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    nodes = stored(nodes, "nodes")
    worded = nodes.filter("n > 0").select("node", F.col("node").alias("root"), "fp")
    near = _apart("check", "_check") <= plan.most(64 * CHECKS, DEVIATIONS)

    def likely(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) without those whose sizes or whole fingerprints tell them apart."""
        for x in "ab":
            own = nodes.select(F.col("node").alias(x), F.col("n").alias(f"_n{x}"), F.col("fp").alias(f"_{x}"))
            pairs = pairs.join(unsent(own), x)
        bits = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        few = bits <= plan.most(64 * plan.words, DEVIATIONS)
        return pairs.filter(_alike(F.col("_na"), F.col("_nb"), F.least("_na", "_nb"), similarity) & few).select("a", "b")

    def links(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are alike; each b's text goes to its a, and a's once for many of them."""
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            return pairs
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ends = stored(nodes.select("node", "_row").join(unsent(ends), "node"), "ends")
        texts = _marked(docs.select(F.col(text).alias("text"), row.alias("_row")), "_row", ends)
        texts = texts.join(unsent(ends.select("node", "_row")), "_row").dropDuplicates(["_row"]).select("node", "text")
        texts = stored(texts, "texts")
        chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_n"))
        chunk = F.pmod(F.xxhash64("b"), F.col("_n")).alias("chunk")
        others = pairs.join(unsent(chunks), "a").select("a", "b", chunk).join(unsent(texts.withColumnRenamed("node", "b")), "b")
        own = chunks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("chunk"))
        own = own.join(unsent(texts.withColumnRenamed("node", "a")), "a")
        own = own.select(*[F.col(c).alias(c) for c in own.columns])  # columns of its own, told apart from those of ``others``
        both = own.groupBy("a", "chunk").cogroup(others.groupBy("a", "chunk"))
        return stored(both.applyInArrow(_count(width, similarity), "a long, b long"), "links")

    def grouped(found: DataFrame) -> DataFrame:
        """(node, root, n) of all texts with words, by the links found."""
        roots = components(found, "a", "b")
        rooted = nodes.filter("n > 0").select("node", "n", "fp").join(unsent(roots), "node", "left")
        return stored(rooted.select("node", F.coalesce("root", "node").alias("root"), "n", "fp"), "grouped")

    # one of those at home at an anchor, and of these the nearest for each text
    homes = worded.mapInArrow(_anchors(plan, homes_only=True), _ROW).select("anchor", "node", *_CHECKS)
    expected = worded.count() / (1 << 4 + plan.free)
    crowded = homes.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CROWDED * expected)
    crowded = stored(crowded.select("anchor"), "crowded")

    def majority(check: str) -> Column:
        ones = [F.sum(F.shiftrightunsigned(check, k).bitwiseAND(F.lit(1))) for k in range(64)]
        bits = [F.when(2 * x > F.count(F.lit(1)), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)) for k, x in enumerate(ones)]
        return reduce(Column.bitwiseOR, bits)

    votes = homes.join(crowded, "anchor", "left_semi").groupBy("anchor").agg(*[majority(c).alias(f"_vote{k}") for k, c in enumerate(_CHECKS)])
    votes = stored(votes, "votes")
    far = F.coalesce(_apart("check", "_vote"), F.lit(0)).alias("far")
    leaders = homes.join(votes, "anchor", "left").groupBy("anchor").agg(F.min(F.struct(far, "node", *_CHECKS)).alias("leader"))
    leaders = leaders.select("anchor", F.col("leader.node").alias("a"), *[F.col(f"leader.{c}").alias(f"_{c}") for c in _CHECKS])
    led = homes.join(unsent(leaders), "anchor").filter((F.col("a") != F.col("node")) & near)
    led = led.groupBy("node").agg(F.min(F.struct(_apart("check", "_check").alias("bits"), "a")).alias("nearest"))
    first = links(likely(led.select("nearest.a", F.col("node").alias("b"))))

    # one member of each group at an anchor, and those of other groups
    placed = grouped(first).select("node", "root", "fp")
    one = F.min(F.struct("node", *_CHECKS)).alias("one")
    at_home = placed.mapInArrow(_anchors(plan, homes_only=True), _ROW).groupBy("anchor", "root").agg(one)
    checks = [F.col(f"one.{c}").alias(f"_{c}") for c in _CHECKS]
    at_home = at_home.select("anchor", F.col("root").alias("_root"), F.col("one.node").alias("a"), *checks)
    guests = placed.mapInArrow(_anchors(plan), _ROW).groupBy("anchor", "root").agg(one).select("anchor", "root", "one.*")
    pairs = at_home.join(unsent(guests), (at_home["anchor"] == guests["anchor"]) & (F.col("root") != F.col("_root")) & near)
    pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    first = first.unionByName(links(likely(pairs)))

    # the rest, exactly: texts of different groups that share enough within their heads
    sampled = docs.filter(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).select(F.explode(_sets(width)(F.col(text))).alias("shingle"))
    sampled = sampled.groupBy("shingle").count().filter(F.col("count") >= COMMON)
    common = np.array([r.shingle for r in sampled.orderBy(F.desc("count"), "shingle").limit(TOLD).collect()], np.int64)
    heads = docs.select(F.col(text)).mapInArrow(_heads(width, similarity, common), "shingle long, node long, place long")
    met = stored(_shared_by(heads, "node").groupBy("shingle", "node").agg(F.min("place").alias("place")), "met")

    rows = met.join(unsent(grouped(first).select("node", "root", "n")), "node")
    rows = stored(_shared_by(rows, "root"), "meeting")
    left, right = (rows.select(*[F.col(c).alias(f"{c}_{x}") for c in rows.columns]) for x in "ab")
    # both shall have ``whole`` in common, and the first few of these are so far from the end in either
    whole = F.ceil((F.col("n_a") + F.col("n_b")) * similarity.numerator / (similarity.numerator + similarity.denominator))
    few = F.least(whole, F.floor(F.least("n_a", "n_b") / ASKED) + 1)
    early = [F.col(f"place_{x}") <= F.col(f"n_{x}") - whole + few for x in "ab"]
    sizes = whole <= F.least("n_a", "n_b")
    pairs = left.join(unsent(right), (F.col("shingle_a") == F.col("shingle_b")) & (F.col("root_a") < F.col("root_b")) & sizes & early[0] & early[1])
    pairs = pairs.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), few.alias("few")).agg(F.count(F.lit(1)).alias("both"))
    joined = components(first.unionByName(links(pairs.filter("both >= few").select("a", "b"))), "a", "b")
    return drawn.drop("n", "fp").join(unsent(joined), "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")


def keep_one_per_group(docs: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row of smallest (doc_id, text digest).

    Groups are told apart by their texts alone; doc_id only chooses the row that stays, so unlike texts
    with one doc_id all stay. A row without doc_id stays only where no row of its group has one. Rows
    repeated in full are one row of a group; a null text is the empty one, and texts without words are
    one group. Columns stay as they are, whatever their names. An empty table gives an empty result.
    Groups are never gathered in a task: the least row is a minimum, and rows are picked by key.
    """
    digest = F.md5(F.coalesce("text", F.lit("")))
    pick = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), digest)))
    found = similar_groups(docs, pick, F.col("doc_id"), similarity=similarity)
    counted = found.groupBy("root", "_row").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_rows"))
    winners = counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row", "_rows")).alias("w"))
    winners = unsent(stored(winners.select("w._row", "w._rows"), "winners"))
    # most rows stay; only those that may be others', or repeated, are told apart by a shuffle
    others = stored(counted.select("_row").join(winners.filter("_rows = 1"), "_row", "left_anti"), "others")
    name = unused("_row", docs)
    keyed = docs.withColumn(name, pick)
    found = rows_at(_marked(keyed, name, others).drop(name), pick, winners)
    return _marked(keyed, name, others, others=True).select(*docs.columns).unionByName(found.select(*docs.columns))
