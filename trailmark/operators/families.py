"""Families as classes: near-equal codes are folded around centers, and links are kept between classes.

A class is a center and the codes around it that are at most half the threshold away and agree with it in
the same bands. Its codes are all linked to one another, so N near-equal codes are N rows of membership
instead of N * N pairs. Two classes that surely are linked whole make one row. Only between classes at the
border of the threshold are codes compared, and what is found there is kept as pairs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import bits
from trailmark.operators.lineage import family_components
from trailmark.operators.lookup import _codes, _first_agreement, _pair_distance, _remainder_slices
from trailmark.session import cut_lineage

#: Units of a bucket above which they meet by slices: some 25 rows each are then fewer than the pairs.
SLICED_FROM = 64
#: Where codes of a large bucket meet that have another layout than the standard one.
ODD = -2


class Families(NamedTuple):
    """``members``: code, class_id, center (no item need have it), distance (to it). ``links``: class_a, class_b, all of whose codes
    are linked, each two classes once. ``pairs``: q_code, r_code, distance, of codes of other classes, each two once."""

    members: DataFrame
    links: DataFrame
    pairs: DataFrame


def _distance(mode: str, left: str, right: str) -> Column:
    """Distance of two codes with their words, given by prefix."""
    fast = reduce(lambda a, b: a + b, [
        F.bit_count(F.get(f"{left}_words", F.lit(i)).bitwiseXOR(F.get(f"{right}_words", F.lit(i)))) for i in range(bits.FRAMES)
    ])
    standard = F.col(f"{left}_words").isNotNull() & F.col(f"{right}_words").isNotNull()
    return F.when(standard, fast).otherwise(bits.hamming(F.col(f"{left}_code"), F.col(f"{right}_code"), mode))


def _leaders(codes: DataFrame, radius: int, mode: str, num_bands: int) -> DataFrame:
    """Every code with a leader at most ``radius`` away, itself if no other.

    Codes vote in buckets of one band and of two bands for the least of their hashes, and take the least
    of the leaders that are near enough. A vote is an aggregate that combines before it is shuffled.
    """
    vote = F.struct(F.xxhash64("code").alias("h"), F.col("code").alias("code"))
    parts = [(b,) for b in range(num_bands)] + list(combinations(range(num_bands), 2))
    keys = [
        F.struct(F.lit(i).alias("k"), F.concat_ws("|", *[F.get("bands", F.lit(b)) for b in part]).alias("v"))
        for i, part in enumerate(parts)
    ]
    standard = codes.where("words is not null").select("code", F.inline(F.array(*keys)))
    elected = standard.groupBy("k", "v").agg(F.min(vote).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    offered = standard.join(elected, ["k", "v"]).where("code <> lead.code").select("code", "lead").distinct()

    def words(code: Column) -> Column:
        return F.transform(F.split(code, "-"), bits.hex_word)

    near = offered.select("code", "lead", F.col("code").alias("a_code"), F.col("lead.code").alias("b_code"))
    near = near.withColumns({"a_words": words(F.col("a_code")), "b_words": words(F.col("b_code"))})
    near = near.where(_distance(mode, "a", "b") <= radius).groupBy("code").agg(F.min("lead").alias("lead"))
    return codes.join(near, "code", "left").withColumn("leader", F.least("lead", vote)["code"]).drop("lead")


def _centers(led: DataFrame) -> DataFrame:
    """Per leader the band values that most of its codes have, as a code (ties: the greatest value)."""
    counts = led.select("leader", F.posexplode("bands").alias("b", "v")).groupBy("leader", "b", "v").agg(F.count(F.lit(1)).alias("n"))
    usual = counts.groupBy("leader", "b").agg(F.max(F.struct("n", "v"))["v"].alias("v"))
    bands = usual.groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("b", "v")))["v"].alias("center_bands"))
    center = F.array_join(F.transform("center_bands", lambda v: F.lpad(v, bits.FRAME_BITS // 4, F.lit("0"))), "-")
    return bands.withColumn("center", center)


def fold_families(
    items: DataFrame, threshold: int = bits.FAMILY_THRESHOLD, mode: str = "family"
) -> Families:
    """The links of ``lookup.near_duplicate_pairs(items, items, threshold, mode)``, folded; none lost, none added.

    Where centers lie decides only how many rows there are. A bucket (one band value) of more than
    ``SLICED_FROM`` classes is matched by slices of the remaining digits too, which finds the same pairs; codes
    in another layout meet all of their bucket. Null hashes are left out.
    """
    num_bands, scheme = bits.FRAMES, "chars" if mode == "family" else "bits"
    codes = cut_lineage(_codes(items.where("perceptual_hash is not null"), num_bands, scheme))
    led = cut_lineage(_leaders(codes, threshold // 2, mode, num_bands))
    centers = _centers(led.where("words is not null"))
    of = led.join(centers, "leader", "left").withColumns({
        "a_code": F.col("code"), "a_words": F.col("words"), "b_code": F.col("center"),
        "b_words": F.transform(F.split("center", "-"), bits.hex_word),
    })
    agree = [F.get("bands", F.lit(b)) == F.get("center_bands", F.lit(b)) for b in range(num_bands)]
    mask = reduce(lambda a, b: a + b, [F.when(same, 1 << b).otherwise(0) for b, same in enumerate(agree)])
    of = of.withColumns({"mask": mask, "distance": F.when(F.col("center").isNotNull(), _distance(mode, "a", "b"))})
    # a code that is too far from the center of its like, or has no band of it, is a class of its own
    inside = F.coalesce((F.col("distance") <= threshold // 2) & (F.col("mask") > 0), F.lit(False))
    members = of.select(
        "code", "bands", "words",
        F.when(inside, F.col("center")).otherwise(F.col("code")).alias("center"),
        F.when(inside, F.col("center_bands")).otherwise(F.col("bands")).alias("center_bands"),
        F.when(inside, F.col("b_words")).otherwise(F.col("words")).alias("center_words"),
        F.when(inside, F.col("mask")).otherwise(2**num_bands - 1).alias("mask"),
        F.when(inside, F.col("distance")).otherwise(0).alias("distance"),
    )
    members = cut_lineage(members.withColumn("class_id", F.concat_ws("/", "center", "mask")))

    # units: a class in the buckets that all of its codes are in, a code alone in its others
    facts = ["class_id", "center", "mask", "center_bands", "center_words"]
    classes = members.groupBy(*facts).agg(F.max("distance").alias("reach"))
    shared = list(range(num_bands))
    in_mask = F.filter(F.array(*[F.lit(b) for b in shared]), lambda b: F.getbit("mask", b) == 1)
    bucket = ["band_index", "band_value"]
    core = classes.select(
        *facts, "reach", F.lit(None).cast("string").alias("alone"), F.col("center").alias("code"),
        F.col("center_words").alias("words"), F.col("reach").alias("radius"), F.explode(in_mask).alias("band_index"),
    ).withColumn("band_value", F.get("center_bands", F.col("band_index")))
    edge = (
        members.join(classes.select("class_id", "reach"), "class_id")
        .select(*facts, "reach", F.col("code").alias("alone"), "code", "words", F.lit(0).alias("radius"), F.posexplode("bands").alias(*bucket))
        .where(F.getbit("mask", F.col("band_index")) == 0)
    )
    units = cut_lineage(core.select(*edge.columns).unionByName(edge))
    sizes = units.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    units = units.join(sizes, bucket)

    slices = threshold + 2 * (threshold // 2) + 1
    large, odd = F.col("n") > SLICED_FROM, F.col("words").isNull()
    cut = F.when(large & ~odd, _remainder_slices(F.col("code"), F.col("band_index"), num_bands, slices))
    units = units.withColumn("slices", cut)
    places = F.transform("slices", lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    whole = F.struct(F.lit(-1).alias("i"), F.lit("").alias("v"))
    strange = F.array(F.struct(F.lit(ODD).alias("i"), F.lit("").alias("v")))

    def side(name: str, key: Column) -> DataFrame:
        rows = units.withColumn("_at", F.explode(key)).select("*", F.col("_at.i").alias("at"), F.col("_at.v").alias("cut"))
        names = [c for c in units.columns if c not in bucket]
        return rows.select(*bucket, "at", "cut", *[F.col(c).alias(f"{name}_{c}") for c in names])

    left = side("q", F.when(~large, F.array(whole)).when(odd, strange).otherwise(places))
    right = side("r", F.when(~large, F.array(whole)).when(odd, strange).otherwise(F.concat(places, strange)))
    # two units once: in one order, but for a code in another layout that meets all others
    once = (F.col("q_class_id") < F.col("r_class_id")) | (
        (F.col("at") == ODD) & F.col("r_words").isNotNull() & (F.col("q_class_id") != F.col("r_class_id"))
    )
    # large buckets are few: there is nothing to compare where the slices are null
    first_slice = F.col("q_slices").isNull() | F.col("r_slices").isNull() | _first_agreement("q_slices", "r_slices", slices, F.col("at"))
    met = (
        left.join(right, [*bucket, "at", "cut"])
        .where(once & first_slice)
        .withColumn("apart", _distance(mode, "q", "r"))
        .where(F.col("apart") <= threshold + F.col("q_radius") + F.col("r_radius"))
    )
    common = [
        (F.getbit("q_mask", F.lit(b)) == 1) & (F.getbit("r_mask", F.lit(b)) == 1)
        & (F.get("q_center_bands", F.lit(b)) == F.get("r_center_bands", F.lit(b)))
        for b in shared
    ]
    centers = met.withColumns({
        f"{to}_{c}": F.col(f"{of}_center{rest}")
        for to, of in (("a", "q"), ("b", "r")) for c, rest in (("code", ""), ("words", "_words"))
    })
    # a class of more than one code is of the standard layout; for others the radius is zero and codes decide
    standard = F.col("q_words").isNotNull() & F.col("r_words").isNotNull()
    near = _distance(mode, "a", "b") + F.col("q_reach") + F.col("r_reach") <= threshold
    full = F.coalesce(standard & near & reduce(lambda a, b: a | b, common), F.lit(False))
    first_common = reduce(
        lambda rest, b: F.when(common[b], b).otherwise(rest), reversed(shared), F.lit(num_bands)
    )
    met = cut_lineage(
        centers.withColumns({"full": full, "first_common": first_common}).select(
            "band_index", "full", "first_common", "q_class_id", "r_class_id", "q_alone", "r_alone"
        )
    )
    links = met.where("full and band_index = first_common and q_alone is null and r_alone is null").select(
        F.col("q_class_id").alias("class_a"), F.col("r_class_id").alias("class_b")
    )

    # borders: codes of either unit, each in the bucket that the units met in
    def opened(rows: DataFrame, name: str) -> DataFrame:
        inside = members.select(*[F.col(c).alias(f"{name}_{c}") for c in ("class_id", "code", "bands", "words")])
        rows = rows.join(inside, f"{name}_class_id")
        return rows.where(F.col(f"{name}_alone").isNull() | (F.col(f"{name}_alone") == F.col(f"{name}_code")))

    border = opened(opened(met.where("not full"), "q"), "r")
    pairs = (
        border.where(_first_agreement("q_bands", "r_bands", num_bands, F.col("band_index")))
        .withColumn("distance", _pair_distance(mode))
        .where(F.col("distance") <= threshold)
        .select("q_code", "r_code", "distance")
    )
    return Families(members.select("code", "class_id", "center", "distance"), links, cut_lineage(pairs))


def _both_ways(rows: DataFrame, a: str, b: str, names: tuple[str, str]) -> DataFrame:
    one, other = names
    there = rows.select(F.col(a).alias(one), F.col(b).alias(other))
    return there.unionByName(rows.select(F.col(b).alias(one), F.col(a).alias(other)))


def family_facts(items: DataFrame, families: Families, rank: list[str]) -> DataFrame:
    """Per code: n_links (other codes linked), members (items of its family, its own too) and the
    family's ``first`` item by the columns ``rank``; from sums over classes, without a row for each link."""
    own = items.groupBy(F.col("perceptual_hash").alias("code")).agg(
        F.count(F.lit(1)).alias("members"), F.min(F.struct(*rank)).alias("first")
    )
    own = families.members.select("code", "class_id").join(own, "code")
    total = [F.sum("n").alias("n"), F.sum("members").alias("members"), F.min("first").alias("first")]
    own = cut_lineage(own.withColumn("n", F.lit(1).cast("bigint")))
    classes = own.groupBy("class_id").agg(*total)
    linked = _both_ways(families.links, "class_a", "class_b", ("to", "class_id")).join(classes, "class_id")
    around = classes.unionByName(linked.select(F.col("to").alias("class_id"), "n", "members", "first"))
    around = around.groupBy("class_id").agg(*total)
    beside = _both_ways(families.pairs, "q_code", "r_code", ("to", "code")).join(own, "code")
    beside = beside.select(F.col("to").alias("code"), "n", "members", "first")
    whole = own.select("code", "class_id").join(around, "class_id").drop("class_id").unionByName(beside)
    out = whole.groupBy("code").agg(*total)
    return out.select(F.col("code").alias("perceptual_hash"), (F.col("n") - 1).alias("n_links"), "members", "first")


def folded_components(families: Families) -> DataFrame:
    """Every code with the least code that links lead to. Only classes take part in the rounds."""
    of = families.members.select("code", "class_id")
    ends = families.pairs.join(of.select(F.col("code").alias("q_code"), F.col("class_id").alias("a")), "q_code")
    ends = ends.join(of.select(F.col("code").alias("r_code"), F.col("class_id").alias("b")), "r_code").select("a", "b")
    edges = ends.unionByName(families.links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    groups = family_components(edges, of.select(F.col("class_id").alias("node")).distinct())
    placed = of.join(groups.withColumnRenamed("node", "class_id"), "class_id")
    least = placed.groupBy("component").agg(F.min("code").alias("least"))
    return placed.join(least, "component").select(F.col("code").alias("node"), F.col("least").alias("component"))
