"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols, code points at first. Deterministic coin tossing labels every
symbol by the lowest bit in which it differs from its predecessor; after three tosses labels
are below 8 and depend on four neighbouring symbols only. Phrases start where labels have a local
maximum, and are named by a hash of their symbols; the names are the symbols of the next level.
Where a passage stands in a text has no influence on the phrases in its interior, so equal
passages have equal names at every level, but for a few phrases at their ends.

The fingerprint is the set of all phrases from the second level (about 9 characters each) up to the one
that is the whole text, as their hashes; it grows with the text. The likeness of two is 2 |A and B| / (|A| + |B|).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.book import query
from trailmark.llm.common import bound_batches, table

#: The level from which on phrases count.
LOWEST = 2
#: Code points that are parsed together; texts are never cut, a longer one is parsed alone.
RUN = 1 << 18

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _FACTOR
    return (x ^ (x >> _SHIFT)) * _FACTOR


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _collapsed(symbols: np.ndarray, lengths: np.ndarray):
    """Runs of one symbol become one symbol, named by symbol and length."""
    new = np.ones(len(symbols), bool)
    new[1:] = symbols[1:] != symbols[:-1]
    starts = _starts(lengths)
    new[starts] = True
    if new.all():
        return symbols, lengths
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(symbols)))
    out = symbols[at]
    long = size > 1
    out[long] = _mix(out[long] + size[long].astype(np.uint64))
    return out, np.add.reduceat(new, starts, dtype=np.int64)


def _tossed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """2 x place of the lowest bit that differs from the predecessor + that bit, as bytes."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = ~x[first]
    differ = x ^ before
    low = differ & (~differ + x.dtype.type(1))
    return (np.bitwise_count(low - x.dtype.type(1)) << 1) + ((x & low) != 0)


def next_level(symbols: np.ndarray, lengths: np.ndarray):
    """Names of the phrases of sequences that lie one after another, and how many each has.

    Every sequence holds at least one symbol.
    """
    symbols, lengths = _collapsed(symbols, lengths)
    first = _starts(lengths)
    labels = symbols
    for _ in range(3):
        labels = _tossed(labels, first)
    cut = np.zeros(len(symbols), bool)
    if len(symbols) > 2:
        cut[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] >= labels[2:])
    cut[first[1:] - 1] &= lengths[:-1] == 1  # a sequence's last symbol never stands alone
    cut[first] = True
    at = np.flatnonzero(cut)
    size = np.diff(np.append(at, len(symbols)))
    place = np.arange(len(symbols), dtype=np.uint64) - np.repeat(at, size).astype(np.uint64)
    names = np.add.reduceat(_mix(symbols + (place + np.uint64(1)) * _FACTOR), at)
    return _mix(names + size.astype(np.uint64)), np.add.reduceat(cut, first, dtype=np.int64)


def _parsed(texts: list[str]) -> list[bytes]:
    """Fingerprints of non-empty texts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols, lengths = _mix(points.astype(np.uint64) + np.uint64(1)), np.array(list(map(len, texts)))
    found: list[list[np.ndarray]] = [[] for _ in texts]
    level, growing = 0, np.ones(len(texts), bool)
    while growing.any():
        symbols, lengths = next_level(symbols, lengths)
        level += 1
        if level < LOWEST:
            continue
        names, ends = (symbols >> _SHIFT).astype(np.uint32), np.cumsum(lengths)
        for k in np.flatnonzero(growing).tolist():
            found[k].append(names[ends[k] - lengths[k] : ends[k]])
        growing &= lengths > 1
    return [np.unique(np.concatenate(own)).astype(">u4").tobytes() for own in found]


def fingerprints(texts: list[str]) -> list[bytes]:
    """Of each text, its phrase hashes in order, four bytes each; empty for the empty text."""
    out = [b""] * len(texts)
    group: list[int] = []
    size = 0
    for i, t in enumerate([*texts, None]):
        if group and (t is None or size + len(t) > RUN):
            for k, f in zip(group, _parsed([texts[k] for k in group]), strict=True):
                out[k] = f
            group, size = [], 0
        if t:
            group.append(i)
            size += len(t)
    return out


def likeness(a: bytes, b: bytes) -> float:
    """From 0 (nothing in common) to 1 (equal fingerprints)."""
    if a == b:
        return 1.0
    x, y = np.frombuffer(a, ">u4"), np.frombuffer(b, ">u4")
    if not len(x) or not len(y):
        return 0.0
    both = np.intersect1d(x, y, assume_unique=True)
    return 2 * len(both) / (len(x) + len(y))


@F.arrow_udf(T.StringType())
def phrase_fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([f.hex() for f in fingerprints([t or "" for t in texts.to_pylist()])])


@F.arrow_udf(T.DoubleType())
def fingerprint_likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([likeness(bytes.fromhex(x or ""), bytes.fromhex(y or "")) for x, y in pairs], pa.float64())


def add_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with fingerprint, the hexadecimal digits of the text's phrase hashes.

    A null text is the empty one, whose fingerprint is empty. Repeated rows get equal ones. A
    column of that name is replaced.
    """
    bound_batches(docs.sparkSession)
    return docs.withColumn("fingerprint", phrase_fingerprint(text))


def with_next(docs: DataFrame, make, schema: str) -> DataFrame:
    """``make(rows)`` over the documents in ascending doc_id, every one beside its successor.

    ``make`` gets lists of (doc_id, text) in which all but the last are to be answered, the last being the successor of the one
    before; the successor of the last document is the first. Texts are shuffled once, by ranges
    of doc_id; the first document of each range goes to the range before as well. Only the bounds
    of the ranges come to the driver. Rows of one doc_id are in order of a digest of their texts;
    rows without one stand before all others.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    lowest = -(1 << 63)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest))
    keyed = docs.select(order.alias("_order"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = np.unique(np.array(keyed.approxQuantile("_order", shares, 1 / (8 * ranges)) or [], np.float64)).astype(np.int64)

    @F.arrow_udf(T.IntegerType())
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32))

    placed = keyed.withColumn("_range", range_of("_order"))
    firsts = sorted(placed.groupBy("_range").agg(F.min("_order")).collect())
    if not firsts:
        return spark.createDataFrame([], schema)
    last = firsts[-1][0]
    first_of = np.array([first for _, first in firsts], np.int64)
    range_before = np.array([last, *[r for r, _ in firsts[:-1]]], np.int32)

    @F.arrow_udf(T.IntegerType())
    def guest_of(ids: pa.Array) -> pa.Array:
        """The range before, for the first document of a range."""
        ids = ids.to_numpy()
        at = np.minimum(np.searchsorted(first_of, ids), len(first_of) - 1)
        return pa.array(range_before[at], mask=first_of[at] != ids)

    earlier = F.col("_earlier")
    own = F.struct(F.col("_range").alias("to"), F.lit(0).alias("role"))
    role = F.when(F.col("_order") == F.lit(firsts[0][1]), 2).otherwise(1)
    guest = F.struct(earlier.alias("to"), role.alias("role"))
    homes = F.when(earlier.isNull(), F.array(own)).otherwise(F.array(own, guest))
    dealt = placed.withColumn("_earlier", guest_of("_order")).withColumn("_home", F.explode(homes)).select("doc_id", "text", "_order", "_home.*")
    sent = dealt.repartitionById(last + 1, F.col("to"))
    # role 1: first of the range after, role 2: first of all, which follows the last
    by = [(F.col("role") == 2), F.col("_order"), F.md5("text")]
    ordered = sent.sortWithinPartitions(*by).select("doc_id", "text", "role")

    def run(batches):
        held, size, over = [], 0, False
        for batch in batches:
            for doc, text, role in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if over:  # more rows of the successor's doc_id
                    continue
                held.append((doc, text))
                size += len(text)
                over = role > 0
                if size > RUN or over:
                    yield make(held)
                    held, size = held[-1:], len(text)

    return ordered.mapInArrow(run, schema)


_NEIGHBOURS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    ids, texts = zip(*rows, strict=True)
    own = fingerprints(list(texts))
    edited = []
    for text, follower in zip(texts, texts[1:], strict=False):
        n = len(text) // 4
        edited.append(text[: len(text) - n] + follower[:n])
    changed = fingerprints(edited)
    columns = (
        pa.array(ids[:-1], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array([f.hex() for f in own[:-1]], pa.string()),
        pa.array([f.hex() for f in changed], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, changed, strict=False)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
    )
    return pa.RecordBatch.from_arrays(list(columns), [c.split()[0] for c in _NEIGHBOURS.split(", ")])


@query("op1_document_fingerprints")
def op1_document_fingerprints(spark, sf_dir):
    return with_next(table(spark, sf_dir, "documents"), _compared, _NEIGHBOURS)
