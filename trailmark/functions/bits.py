"""Bit, hash and distance expressions over perceptual hashes.

A perceptual hash is the upper-case hex of one 64-bit word per sampled frame, joined by '-'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the hash format
FRAME_BITS = 64
FRAMES = 5
NUM_BANDS = 5
CACHE_THRESHOLD = 10
FAMILY_THRESHOLD = 12

_FRAME_HEX = "^[0-9A-Fa-f]{1,16}$"
_ANY_HEX = "^[0-9A-Fa-f]+$"


def _hex32(text: Column) -> Column:
    """Up to 8 hex digits as a non-negative long (longer input would overflow)."""
    return F.conv(text, 16, 10).cast("bigint")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hex_word(frame_hash: Column) -> Column:
    """Up to 16 hex digits as one long; the sign bit carries bit 63."""
    padded = F.lpad(frame_hash, 16, "0")
    high = _hex32(F.substring(padded, 1, 8))
    low = _hex32(F.substring(padded, 9, 8))
    return F.shiftleft(high, 32).bitwiseOR(low)


def bits_to_hex(bits: Column) -> Column:
    """A string of 64 '0'/'1' as 16 upper-case hex digits, 32 bits at a time."""
    halves = [F.lpad(F.conv(F.substring(bits, s, 32), 2, 16), 8, "0") for s in (1, 33)]
    return F.concat(*halves)


def hex_to_bits(hex_text: Column) -> Column:
    """Hex digits (a multiple of 8) as a string of '0'/'1'."""
    words = F.sequence(F.lit(0), (F.length(hex_text) / 8).cast("int") - 1)
    return F.array_join(
        F.transform(
            words, lambda i: F.lpad(F.conv(F.substr(hex_text, i * 8 + 1, F.lit(8)), 16, 2), 32, "0")
        ),
        "",
    )


def median_bits(values: Column, mean_median: bool = False) -> Column:
    """One bit per value: 1 where the value exceeds the median of the array.

    The default median is the element after the middle of the ascending sort;
    ``mean_median`` takes the mean of the two middle elements instead.
    """
    half = F.floor(F.size(values) / 2).cast("int")

    def middle(ordered: Column) -> Column:
        upper = F.element_at(ordered, half + 1)
        return (F.element_at(ordered, half) + upper) / 2 if mean_median else upper

    def compare(median: Column) -> Column:
        return F.transform(values, lambda v: F.when(v > median, "1").otherwise("0"))

    return F.array_join(let(middle(F.array_sort(values)), compare), "")


def dhash_bits(pixels: Column, width: int) -> Column:
    """One bit per horizontal neighbour pair of a row-major grid: right brighter than left."""
    starts = F.filter(F.sequence(F.lit(0), F.size(pixels) - 2), lambda i: (i + 1) % width != 0)
    return F.array_join(
        F.transform(
            starts, lambda i: F.when(F.get(pixels, i + 1) > F.get(pixels, i), "1").otherwise("0")
        ),
        "",
    )


def _strip_zeros(hex_text: Column) -> Column:
    return F.coalesce(F.nullif(F.ltrim(hex_text, F.lit("0")), F.lit("")), F.lit("0"))


def _bits_to_short_hex(bits: Column) -> Column:
    """Hex of any number of bits without leading zeros ('0' for zero)."""

    def words(padded: Column) -> Column:
        full = F.transform(
            F.sequence(F.lit(0), (F.length(padded) / 32).cast("int") - 1),
            lambda i: F.lpad(F.conv(F.substr(padded, i * 32 + 1, F.lit(32)), 2, 16), 8, "0"),
        )
        return _strip_zeros(F.array_join(full, ""))

    whole = F.ceil(F.length(bits) / 32).cast("int") * 32
    return let(F.lpad(bits, whole, F.lit("0")), words)


STANDARD_LAYOUT = f"^[0-9A-Fa-f]{{16}}(?:-[0-9A-Fa-f]{{16}}){{{FRAMES - 1}}}$"


def lsh_bands(phash: Column, num_bands: int = NUM_BANDS, scheme: str = "bits") -> Column:
    """Array of band signatures.

    ``bits`` cuts the bit string at integer boundaries and prints each band as short hex;
    ``chars`` cuts the hex digits in equal parts, the last band taking the remainder.
    """
    clean = F.replace(phash, F.lit("-"), F.lit(""))
    index = F.sequence(F.lit(0), F.lit(num_bands - 1))
    if scheme == "chars":
        size = F.floor(F.length(clean) / num_bands).cast("int")
        return F.transform(
            index,
            lambda i: F.substr(
                clean,
                i * size + 1,
                F.when(i < num_bands - 1, size).otherwise(F.length(clean)),
            ),
        )
    if scheme != "bits":
        raise ValueError(f"unknown band scheme: {scheme}")

    def cut(bits: Column) -> Column:
        total = F.length(bits)

        def band(i: Column) -> Column:
            start = F.floor(i * total / num_bands).cast("int")
            end = F.floor((i + 1) * total / num_bands).cast("int")
            return let(F.substr(bits, start + 1, end - start), _bits_to_short_hex)

        return F.transform(index, band)

    general = let(hex_to_bits(clean), cut)
    if num_bands != FRAMES:
        return general
    # one band per frame: the frame's own digits
    frames = F.transform(F.split(F.upper(phash), "-"), _strip_zeros)
    return F.when(phash.rlike(STANDARD_LAYOUT), frames).otherwise(general)


def char_distance(a: Column, b: Column) -> Column:
    """Differing characters over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    left = F.split(F.substr(a, F.lit(1), n), "")
    right = F.split(F.substr(b, F.lit(1), n), "")
    differ = F.zip_with(left, right, lambda x, y: (x != y).cast("int"))
    return F.when(n == 0, F.lit(0)).otherwise(_sum_ints(differ))


def _sum_ints(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + v)


def _frame_distance(a: Column, b: Column) -> Column:
    """Bits apart for one frame; NULL where either side is not hex."""
    ok = a.rlike(_FRAME_HEX) & b.rlike(_FRAME_HEX)
    return F.when(ok, F.bit_count(hex_word(a).bitwiseXOR(hex_word(b))))


def hamming(a: Column, b: Column, mode: str = "cache") -> Column:
    """Distance between two perceptual hashes.

    ``cache``: sum over frames, 64 for a missing or malformed frame.
    ``family``: the joined hex digits as one number; character distance when not hex.
    ``average``: mean per frame; NULL when frame counts differ or a frame is malformed.
    """
    if mode == "family":
        left = F.replace(a, F.lit("-"), F.lit(""))
        right = F.replace(b, F.lit("-"), F.lit(""))
        words = F.ceil(F.greatest(F.length(left), F.length(right)) / 8).cast("int")
        pad_left = F.lpad(left, words * 8, F.lit("0"))
        pad_right = F.lpad(right, words * 8, F.lit("0"))

        def apart(i: Column) -> Column:
            x = _hex32(F.substr(pad_left, i * 8 + 1, F.lit(8)))
            y = _hex32(F.substr(pad_right, i * 8 + 1, F.lit(8)))
            return F.bit_count(x.bitwiseXOR(y))

        total = _sum_ints(F.transform(F.sequence(F.lit(0), words - 1), apart))
        both_hex = left.rlike(_ANY_HEX) & right.rlike(_ANY_HEX)
        return F.when(both_hex, total).otherwise(char_distance(left, right))

    left, right = F.split(a, "-"), F.split(b, "-")
    if mode == "cache":
        shared = F.least(F.size(left), F.size(right))
        per_frame = F.zip_with(
            F.slice(left, F.lit(1), shared),
            F.slice(right, F.lit(1), shared),
            lambda x, y: F.coalesce(_frame_distance(x, y), F.lit(FRAME_BITS)),
        )
        return _sum_ints(per_frame) + F.abs(F.size(left) - F.size(right)) * FRAME_BITS
    if mode == "average":
        per_frame = F.zip_with(left, right, _frame_distance)
        usable = (F.size(left) == F.size(right)) & ~F.exists(per_frame, lambda v: v.isNull())
        return F.when(usable, _sum_ints(per_frame) / F.size(left))
    raise ValueError(f"unknown distance mode: {mode}")


def is_similar(a: Column, b: Column, mode: str = "cache", threshold: float = 10) -> Column:
    return F.coalesce(hamming(a, b, mode) <= threshold, F.lit(False))


def similarity_score(a: Column, b: Column) -> Column:
    """1 - mean distance / 64, within [0, 1]; 0 when the hashes cannot be compared."""
    mean = hamming(a, b, "average")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean / FRAME_BITS))
    return F.when(mean.isNull(), F.lit(0.0)).otherwise(score)


def digest(value: Column, algorithm: str = "sha256") -> Column:
    """Content digest; an unknown algorithm is an error."""
    if algorithm == "sha256":
        return F.sha2(value, 256)
    if algorithm == "md5":
        return F.md5(value)
    if algorithm == "sha1":
        return F.sha1(value)
    raise ValueError(f"unsupported hash algorithm: {algorithm}")


def multi_part_hash(parts: DataFrame, keys: list[str], order: str, part: str) -> DataFrame:
    """One digest per key over its parts in order. For the few sampled parts of an item only."""
    ordered = F.sort_array(F.collect_list(F.struct(order, part)))
    gathered = parts.groupBy(*keys).agg(ordered.alias("_p"))
    joined = F.array_join(F.transform("_p", lambda x: x[part]), "")
    return gathered.select(
        *keys, F.size("_p").cast("bigint").alias("parts"), F.sha2(joined, 256).alias("content_hash")
    )


def ip_hash(ip: Column, salt: str, length: int | None = None) -> Column:
    """Pseudonym of an IP. The salt has no default so that leaving it out is a decision."""
    full = F.sha2(F.concat(F.lit(salt), ip), 256)
    return full if length is None else F.substring(full, 1, length)


def pad_hex32(value: Column) -> Column:
    """Hex digest stripped of 0x, padded on the right and cut to 64 digits."""
    return F.substring(F.rpad(F.replace(value, F.lit("0x"), F.lit("")), 64, "0"), 1, 64)


def cache_key(url: Column, frames: Column, duration: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", url, frames, duration), 256), 1, 32)


def short_hash(value: Column, n: int) -> Column:
    return F.concat(F.substring(value, 1, n), F.lit("..."))
