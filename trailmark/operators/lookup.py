"""Exact and near-duplicate lookup over perceptual hashes, and set operations over hash lists.

Near-duplicate work runs on distinct hash codes, never on their copies: a million identical
uploads are one code. Results per item come from a join back at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import bits
from trailmark.session import cut_lineage

#: Bands up to which candidates are counted by inclusion and exclusion where a band value is full.
MAX_COUNTED_BANDS = 8
#: Registered codes of a band value that are compared with each query.
LARGE_BUCKET = 256
HOT_PAIRS = 20_000_000


def exact_lookup(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """Query items whose content hash is registered, with the stored result."""
    facts = registry.select(
        "video_hash", "is_deepfake", "confidence", "first_seen", "last_seen", "detection_count"
    )
    return queries.select("video_hash").join(facts, "video_hash")


def exact_phash_lookup(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered items per queried hash code: how many, and the smallest content hash."""
    codes = queries.select("perceptual_hash").distinct()
    stored = registry.groupBy("perceptual_hash").agg(
        F.count(F.lit(1)).alias("matches"), F.min("video_hash").alias("first_match")
    )
    return codes.join(stored, "perceptual_hash")


def _codes(df: DataFrame, num_bands: int, scheme: str) -> DataFrame:
    """Distinct hash codes with their bands, 64-bit words and a fixed-width hex form."""
    parts = F.split("perceptual_hash", "-")
    return (
        _distinct_codes(df)
        .select(
            F.col("perceptual_hash").alias("code"),
            bits.lsh_bands(F.col("perceptual_hash"), num_bands, scheme).alias("bands"),
            F.when(
                F.col("perceptual_hash").rlike(bits.STANDARD_LAYOUT),
                F.transform(parts, bits.hex_word),
            ).alias("words"),
        )
    )


def _distinct_codes(df: DataFrame) -> DataFrame:
    return df.select("perceptual_hash").distinct()


def lsh_candidates(
    queries: DataFrame,
    registry: DataFrame,
    num_bands: int = bits.NUM_BANDS,
    scheme: str = "bits",
    large: int = LARGE_BUCKET,
) -> DataFrame:
    """Per queried hash code: how many registered codes share at least one band.

    A registered code is counted at the first band that it shares. A code makes one row a band, and in a band value
    of at most ``large`` registered codes these are compared with each query. Fuller ones form no pair: there they
    are counted by inclusion and exclusion over the earlier bands. So the work is linear in the codes, however full
    a band is. Rows carry 64-bit hashes of the earlier bands, and 128 bits of the code and the band value.
    """
    key = ["band", "k1", "k2"]

    def pair(name: str, *values: Column) -> list[Column]:
        return [F.xxhash64(F.lit(f"{name}{i}"), *values).alias(f"{name}{i}") for i in (1, 2)]

    code = F.col("perceptual_hash")

    def rows(codes: DataFrame, *names: Column) -> DataFrame:
        """A row for each band of each code: its key and the bands before it."""
        split = codes.select(*names, bits.lsh_bands(code, num_bands, scheme).alias("bands"))
        split = split.select("*", F.posexplode("bands").alias("band", "value"))
        earlier = F.transform(F.slice("bands", F.lit(1), F.col("band")), lambda v: F.xxhash64(v))
        return split.select("*", *pair("k", F.col("value")), earlier.alias("earlier")).drop("bands", "value")

    # written once: both are read twice
    asked, known = (cut_lineage(_distinct_codes(df.where(code.isNotNull()))) for df in (queries, registry))
    q, r = rows(asked, *pair("id", code)), rows(known)
    full = cut_lineage(r.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).select(*key))
    found = [
        F.sum("n").alias("candidates"),
        F.bit_or(F.expr("shiftleft(1L, band)")).alias("hit"),
    ]
    shared = F.exists(F.zip_with("earlier", "_earlier", lambda x, y: x == y), lambda same: same)
    # a row of a full bucket meets none, so the keys of these are joined to one side only
    few = r.join(full, key, "left_anti").withColumnRenamed("earlier", "_earlier")
    hits = q.join(few, key).select("id1", "id2", "band", (~shared).cast("bigint").alias("n"))
    hits = hits.groupBy("id1", "id2").agg(*found)
    if not full.isEmpty():
        deepest = full.agg(F.max("band")).first()[0]
        if deepest >= MAX_COUNTED_BANDS:
            raise ValueError(f"full values in more than {MAX_COUNTED_BANDS} bands: their codes make 2 ** band rows")

        def signed(df: DataFrame) -> DataFrame:
            """A row for each set of earlier bands; a set with a band that is not earlier is left out."""
            sets = F.array(*[
                F.struct(
                    F.lit(m).alias("mask"),
                    F.lit(-1 if m.bit_count() % 2 else 1).alias("sign"),
                    *pair("s", F.lit(m), *[F.get("earlier", F.lit(b)) for b in range(deepest) if m >> b & 1]),
                )
                for m in range(2**deepest)
            ])
            kept = F.slice(sets, F.lit(1), F.expr("shiftleft(1, band)"))
            return df.join(full, key, "left_semi").select("*", F.inline(kept)).drop("earlier")

        at = [*key, "mask", "s1", "s2"]
        counted = signed(r).groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
        many = signed(q).join(counted, at).select("id1", "id2", "band", (F.col("sign") * F.col("_n")).alias("n"))
        hits = hits.unionByName(many.groupBy("id1", "id2").agg(*found))
        hits = hits.groupBy("id1", "id2").agg(F.sum("candidates").alias("candidates"), F.bit_or("hit").alias("hit"))
    return hits.join(asked.select(*pair("id", code), code), ["id1", "id2"]).select(
        "perceptual_hash", "candidates", F.bit_count("hit").cast("bigint").alias("bands_hit")
    )


def candidate_union(
    queries: DataFrame, registry: DataFrame, num_bands: int = bits.NUM_BANDS
) -> DataFrame:
    """Queried hash codes with a candidate in any band: all per-band hits, de-duplicated."""

    def bands(df: DataFrame) -> DataFrame:
        rows = _codes(df, num_bands, "bits")
        return rows.select("code", F.posexplode("bands").alias("band_index", "band_value"))

    stored = bands(registry).select("band_index", "band_value").distinct()
    hits = bands(queries).join(stored, ["band_index", "band_value"], "left_semi")
    return hits.select(F.col("code").alias("perceptual_hash")).distinct()


def _pair_distance(mode: str) -> Column:
    """Unrolled word distance for the standard layout; the general form for any other."""
    words = [
        F.bit_count(
            F.get("q_words", F.lit(i)).bitwiseXOR(F.get("r_words", F.lit(i)))
        )
        for i in range(bits.FRAMES)
    ]
    fast = reduce(lambda a, b: a + b, words)
    standard = F.col("q_words").isNotNull() & F.col("r_words").isNotNull()
    return F.when(standard, fast).otherwise(bits.hamming(F.col("q_code"), F.col("r_code"), mode))


def _first_agreement(left: str, right: str, n: int, index: Column) -> Column:
    """No entry before ``index`` agrees: lets exactly one of several shared keys emit a pair."""
    clashes = [
        (F.lit(i) >= index)
        | ~F.coalesce(F.get(left, F.lit(i)) == F.get(right, F.lit(i)), F.lit(False))
        for i in range(n - 1)
    ]
    return reduce(lambda a, b: a & b, clashes, F.lit(True))


def _remainder_slices(code: Column, index: Column, num_bands: int, slices: int) -> Column:
    """Hex digits outside band ``index``, dealt out to equal slices in turn.

    Two standard codes that agree in the band and differ in at most slices - 1 bits elsewhere
    agree in at least one slice, so matching on (band, slice) loses no pair. Slices take every
    ``slices``-th digit: where codes share further whole frames (black ones, say), every slice
    still holds digits of the frames in which they differ, so no slice becomes one key for all.
    """
    clean = F.replace(code, F.lit("-"), F.lit(""))
    digits = bits.FRAMES * 16
    start, end = F.floor(index * digits / num_bands), F.floor((index + 1) * digits / num_bands)
    # a band that does not end on a whole digit keeps its partial digits in the remainder
    start = F.ceil(index * digits / num_bands).cast("int")
    end = F.greatest(start, end.cast("int"))
    rest = F.concat(
        F.substr(clean, F.lit(1), start), F.substr(clean, end + 1, F.lit(digits))
    )
    n = F.length(rest)
    return F.transform(
        F.sequence(F.lit(0), F.lit(slices - 1)),
        lambda i: F.array_join(
            F.transform(
                F.sequence(i, n - 1, F.lit(slices)), lambda at: F.substr(rest, at + 1, F.lit(1))
            ),
            "",
        ),
    )


def near_duplicate_pairs(
    queries: DataFrame,
    registry: DataFrame,
    threshold: int = bits.CACHE_THRESHOLD,
    mode: str = "cache",
    num_bands: int = bits.NUM_BANDS,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """Pairs of distinct hash codes that share a band and are at most ``threshold`` bits apart.

    Columns: q_code, r_code, distance. A band value so common that it would form more than
    ``hot_pairs`` candidate pairs (black opening frames, say) is matched on (band, slice of the
    remaining digits) instead, which by the pigeonhole principle finds the same pairs.
    """
    scheme = "chars" if mode == "family" else "bits"
    # written once to the shared folder: the codes are read by the counts and by every join
    left = cut_lineage(_codes(queries, num_bands, scheme))
    right = left if registry is queries else cut_lineage(_codes(registry, num_bands, scheme))
    band_key = ["band_index", "band_value"]

    def exploded(df: DataFrame, side: str) -> DataFrame:
        return df.select(
            F.col("code").alias(f"{side}_code"),
            F.col("bands").alias(f"{side}_bands"),
            F.col("words").alias(f"{side}_words"),
            F.posexplode("bands").alias(*band_key),
        )

    q, r = exploded(left, "q"), exploded(right, "r")

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*band_key).agg(F.count(F.lit(1)).alias(name))

    hot = cut_lineage(
        sizes(q, "nq")
        .join(sizes(r, "nr"), band_key)
        .where(F.col("nq") * F.col("nr") > hot_pairs)
        .select(*band_key, F.lit(True).alias("_hot"))
    )
    first_band = _first_agreement("q_bands", "r_bands", num_bands, F.col("band_index"))
    close = F.col("distance") <= threshold
    if hot.isEmpty():
        return (
            q.join(r, band_key)
            .where(first_band)
            .withColumn("distance", _pair_distance(mode))
            .where(close)
            .select("q_code", "r_code", "distance")
        )

    # the flag is joined on the very key of the pair join, so it needs no shuffle of its own
    q = q.join(hot, band_key, "left")
    # codes in another layout stay in the plain match: slices are defined for the standard one
    refine = F.col("_hot").isNotNull()
    usable = F.col("q_words").isNotNull() & F.col("r_words").isNotNull()

    cold_pairs = (
        q.where(~refine)
        .drop("_hot")
        .join(r, band_key)
        .where(first_band)
        .withColumn("distance", _pair_distance(mode))
        .where(close)
        .select("q_code", "r_code", "distance")
    )

    slices = threshold + 1
    r_hot = r.join(hot, band_key, "left_semi")

    def sliced(df: DataFrame, side: str) -> DataFrame:
        cut = _remainder_slices(F.col(f"{side}_code"), F.col("band_index"), num_bands, slices)
        return df.where(F.col(f"{side}_words").isNotNull()).withColumn(
            f"{side}_slices", cut
        ).select("*", F.posexplode(f"{side}_slices").alias("slice_index", "slice_value"))

    hot_pairs_df = (
        sliced(q.where(refine).drop("_hot"), "q")
        .join(sliced(r_hot, "r"), [*band_key, "slice_index", "slice_value"])
        .where(
            first_band & _first_agreement("q_slices", "r_slices", slices, F.col("slice_index"))
        )
        .withColumn("distance", _pair_distance(mode))
        .where(close)
        .select("q_code", "r_code", "distance")
    )
    odd_q = q.where(refine & F.col("q_words").isNull()).drop("_hot").join(r_hot, band_key)
    odd_r = (
        q.where(refine & F.col("q_words").isNotNull())
        .drop("_hot")
        .join(r_hot.where("r_words is null"), band_key)
    )
    odd_pairs = (
        odd_q.unionByName(odd_r)
        .where(first_band & ~usable)
        .withColumn("distance", _pair_distance(mode))
        .where(close)
        .select("q_code", "r_code", "distance")
    )
    return cold_pairs.unionByName(hot_pairs_df).unionByName(odd_pairs)


def near_duplicate_join(
    queries: DataFrame, registry: DataFrame, threshold: int = bits.CACHE_THRESHOLD, **options
) -> DataFrame:
    """Near-duplicate code pairs with the number of items behind each side."""
    pairs = near_duplicate_pairs(queries, registry, threshold, **options)

    def copies(df: DataFrame, code: str, name: str) -> DataFrame:
        return df.groupBy(F.col("perceptual_hash").alias(code)).agg(
            F.count(F.lit(1)).alias(name)
        )

    return pairs.join(copies(queries, "q_code", "q_items"), "q_code").join(
        copies(registry, "r_code", "r_items"), "r_code"
    )


def tiered_lookup(
    queries: DataFrame, registry: DataFrame, threshold: int = bits.CACHE_THRESHOLD, **options
) -> DataFrame:
    """Best stored match of every query item.

    Exact content hash first, then exact perceptual hash, then the nearest code within the
    threshold. Only hash codes missed by the first two tiers take part in the banded join.
    Columns: video_hash, matched_hash, cache_hit_type, perceptual_distance.
    """
    items = queries.select("video_hash", "perceptual_hash")
    known = registry.select("video_hash", F.lit(True).alias("_exact"))
    by_code = registry.groupBy("perceptual_hash").agg(F.min("video_hash").alias("_same_code"))
    staged = items.join(known, "video_hash", "left").join(by_code, "perceptual_hash", "left")
    missed = staged.where("_exact is null and _same_code is null")
    best = (
        near_duplicate_pairs(missed, registry, threshold, **options)
        .join(by_code.withColumnRenamed("perceptual_hash", "r_code"), "r_code")
        .groupBy(F.col("q_code").alias("perceptual_hash"))
        .agg(F.min(F.struct("distance", "_same_code")).alias("_near"))
    )
    out = staged.join(best, "perceptual_hash", "left")
    exact, same = F.col("_exact").isNotNull(), F.col("_same_code").isNotNull()
    return out.select(
        "video_hash",
        F.when(exact, F.col("video_hash"))
        .otherwise(F.coalesce("_same_code", "_near._same_code"))
        .alias("matched_hash"),
        F.when(exact, "exact")
        .when(same | F.col("_near").isNotNull(), "perceptual")
        .otherwise("miss")
        .alias("cache_hit_type"),
        F.when(exact, F.lit(None).cast("int"))
        .when(same, F.lit(0))
        .otherwise(F.col("_near.distance"))
        .alias("perceptual_distance"),
    )


def sync_missing(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Rows one side has and the other lacks, with the direction they must travel."""
    send = local.join(remote.select("video_hash"), "video_hash", "left_anti")
    receive = remote.join(local.select("video_hash"), "video_hash", "left_anti")
    return send.withColumn("direction", F.lit("send")).unionByName(
        receive.withColumn("direction", F.lit("receive"))
    )


def tiered_source_lookup(queries: DataFrame, local: DataFrame, backend: DataFrame) -> DataFrame:
    """Confidence from the local store, else from the backend; ``source`` tells which."""
    near = local.select("video_hash", F.col("confidence").alias("_l"), F.lit(1).alias("_in_l"))
    far = backend.select("video_hash", F.col("confidence").alias("_b"), F.lit(1).alias("_in_b"))
    joined = queries.select("video_hash").join(near, "video_hash", "left").join(
        far, "video_hash", "left"
    )
    return joined.select(
        "video_hash",
        F.when(F.col("_in_l") == 1, F.col("_l")).otherwise(F.col("_b")).alias("confidence"),
        F.when(F.col("_in_l") == 1, "local")
        .when(F.col("_in_b") == 1, "backend")
        .otherwise("none")
        .alias("source"),
    )


def hash_diff(local: DataFrame, peer: DataFrame) -> DataFrame:
    """Hashes only one of two peers knows, from both sides."""
    mine, theirs = local.select("video_hash"), peer.select("video_hash")
    return (
        mine.subtract(theirs)
        .withColumn("side", F.lit("local"))
        .unionByName(theirs.subtract(mine).withColumn("side", F.lit("peer")))
    )


def family_plus_self(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """Family members of each code together with the code itself."""
    own = codes.select(F.col("perceptual_hash").alias("q_code"), F.col("perceptual_hash").alias("r_code"))
    return pairs.select("q_code", "r_code").union(own).distinct()


def merge_results(*parts: DataFrame) -> DataFrame:
    """Union of node results; the newest row per item wins (ties: the greater node)."""
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    payload = F.struct(*[c for c in rows.columns if c != "video_hash"])
    return (
        rows.groupBy("video_hash")
        .agg(F.max_by(payload, F.struct("updated_at", "node")).alias("r"))
        .select("video_hash", "r.*")
    )
