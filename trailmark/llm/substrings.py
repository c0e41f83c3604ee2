"""Removal of long passages that an earlier document already has, over prefix-partitioned suffixes.

Suffixes are word suffixes, and only nodes at least ``window`` words deep matter. Of all suffixes
those at anchors are kept: a window's anchor is the least of its short word runs (prefixes of
``prefix`` words) under a hash, so equal windows have their anchors at equal places. Prefixes
grow as far as they must:

1. suffixes are split by the prefix at their anchor; a prefix that one document alone has is a
   leaf's edge and is dropped;
2. of the prefixes left, the suffixes are lengthened to the region: all words of the windows that
   chose this anchor. Equal regions are one node, with its least document;
3. only where regions with one prefix differ, their windows become suffixes of their own, split by
   all their ``window`` words; each such group is one internal node of sufficient depth, again with
   its least document.

Words under a node whose least document is a smaller one are removed. Nodes are identified by
128-bit hashes of their words. All groups are minima, which combine before they are shuffled:
no subtree is ever gathered in one task, however many documents share a passage.
"""

from __future__ import annotations


from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.book import query
from trailmark.llm.common import bound_batches, stored, table
from trailmark.session import cut_lineage

WINDOW = 50
PREFIX = 8
#: Words whose hashes a worker remembers.
REMEMBERED = 400_000
#: Odd bases of the two rolling hashes, and the odd factors of the final mixing.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_FACTOR = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FACTOR
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of runs of words; equal runs have equal hashes in all documents and workers."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.words = np.zeros((2, 1024), np.uint64)
        self.powers = [np.ones(1, np.uint64)] * 2
        self.inverse = [np.ones(1, np.uint64)] * 2

    def sums(self, words: list[bytes], hashes: int = 2) -> np.ndarray:
        """As many rows of running sums over the words, from which ``run`` takes differences."""
        if len(self.place) > REMEMBERED:
            self.place.clear()
        place, n = self.place, len(words)
        at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, n)
        for i in np.flatnonzero(at < 0).tolist():
            k = place.setdefault(words[i], len(place))
            if k >= self.words.shape[1]:
                self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
            h = xxhash.xxh3_128_intdigest(words[i])
            self.words[0, k], self.words[1, k] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
            at[i] = k
        if n >= len(self.powers[0]):
            for i, b in enumerate(_BASES):
                for to, f in ((self.powers, b), (self.inverse, pow(b, -1, 1 << 64))):
                    to[i] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * n, f, np.uint64))))
        out = np.zeros((hashes, n + 1), np.uint64)
        for i in range(hashes):
            np.cumsum(self.words[i, at] * self.powers[i][:n], out=out[i, 1:])
        return out

    def run(self, sums: np.ndarray, i: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[i, end] - sums[i, start]) * self.inverse[i][start])


def anchors(rolling: Rolling, words: list[bytes], window: int, prefix: int, hashes: int = 2):
    """(running sums, prefix hashes, anchor of each window start); words must fill a window."""
    sums = rolling.sums(words, hashes)
    starts = np.arange(len(words) - prefix + 1)
    hashes = rolling.run(sums, 0, starts, starts + prefix)
    width = window - prefix + 1
    view = np.lib.stride_tricks.sliding_window_view(hashes, width)
    # in runs, so that a very long text needs no large intermediate result
    least = np.concatenate([view[k : k + 65536].argmin(axis=1) for k in range(0, len(view), 65536)])
    return sums, hashes, least + np.arange(len(view))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _digest(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """(words, words removed, digest of those kept)."""
    keep = np.ones(len(words), bool)
    for a, b in spans:
        keep[a:b] = False
    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k] if spans else words
    return len(words), len(words) - len(kept), b" ".join(kept).decode()


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): whole texts without words in windows of smaller doc_ids.

    A null text has no words; texts shorter than a window keep all. Rows of one doc_id count as
    one document: none is smaller than the other. A row without doc_id is smaller than none,
    and none is smaller than it, so it loses nothing and takes nothing from others.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))

    def find_anchors(batches):
        rolling = Rolling()
        for batch in batches:
            for doc, tie, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = text.encode().split()
                if doc is not None and len(words) >= window:
                    _, hashes, chosen = anchors(rolling, words, window, prefix, hashes=1)
                    at = np.unique(chosen)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), doc)),
                            pa.array(np.full(len(at), tie)),
                            _signed(hashes[at]),
                            pa.array(at.astype(np.int32)),
                        ],
                        ["doc_id", "tie", "prefix", "at"],
                    )

    sparse = stored(rows.mapInArrow(find_anchors, "doc_id long, tie long, prefix long, at int"), "anchors")
    hits = _shared(sparse, ["prefix"]).select("doc_id", "tie", "at")
    hits = hits.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("at")).alias("at"))

    def find_regions(batches):
        rolling = Rolling()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _SPLIT}
            for doc, tie, text, at in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                _add(out, doc_id=doc, tie=tie, text=text, hit=at is not None)
                if at is None:
                    continue
                words = _unpacked(text)
                sums, hashes, chosen = anchors(rolling, words, window, prefix)
                lo = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
                hi = np.concatenate((lo[1:] - 1, [len(chosen) - 1]))
                wanted = np.isin(chosen[lo], at)
                lo, hi = lo[wanted], hi[wanted]
                anchor = chosen[lo]
                shape = ((anchor - lo) * window + (hi - lo)).astype(np.uint64)
                r = [_mixed(rolling.run(sums, i, lo, hi + window) + shape) for i in (0, 1)]
                columns = (hashes[anchor].view(np.int64), *(x.view(np.int64) for x in r), lo, hi)
                for p, r1, r2, a, b in zip(*(x.tolist() for x in columns), strict=True):
                    _add(out, doc_id=doc, tie=tie, prefix=p, r1=r1, r2=r2, lo=a, hi=b)
            yield pa.RecordBatch.from_pydict(out, schema=_split_schema())

    packed = rows.mapInArrow(_pack, "doc_id long, tie long, text binary")
    split = packed.join(hits, ["doc_id", "tie"], "left").mapInArrow(find_regions, _SPLIT_DDL)
    split = stored(split, "regions")
    alone = split.filter("NOT hit").select("doc_id", "tie", "text")
    texts = split.filter("hit").select("doc_id", "tie", "text")
    regions = split.filter("prefix IS NOT NULL").select("doc_id", "tie", "prefix", "r1", "r2", "lo", "hi")

    least = regions.groupBy("r1", "r2").agg(F.min("doc_id").alias("least"))
    nodes = stored(regions.join(cut_lineage(least), ["r1", "r2"]), "nodes")
    covered = nodes.filter("doc_id > least").select("doc_id", "tie", "lo", (F.col("hi") + window).alias("hi"))
    # regions of one prefix that differ: their windows are compared one by one
    region = F.struct("r1", "r2")
    parted = nodes.groupBy("prefix").agg(F.min(region).alias("a"), F.max(region).alias("b")).filter("a <> b")
    first = nodes.filter("doc_id = least").join(cut_lineage(parted.select("prefix")), "prefix")
    first = first.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("lo", "hi")).alias("regions"))

    def find_windows(batches):
        rolling = Rolling()
        for batch in batches:
            for doc, tie, text, found in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                sums = rolling.sums(_unpacked(text))
                p = np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in found])
                w = [_signed(rolling.run(sums, i, p, p + window)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*w, pa.array(np.full(len(p), doc)), pa.array(np.full(len(p), tie)), pa.array(p.astype(np.int32))],
                    ["w1", "w2", "doc_id", "tie", "lo"],
                )

    suffixes = texts.join(first, ["doc_id", "tie"]).mapInArrow(
        find_windows, "w1 long, w2 long, doc_id long, tie long, lo int"
    )
    deep = _shared(stored(suffixes, "suffixes"), ["w1", "w2"]).filter("doc_id > least")
    deep = deep.select("doc_id", "tie", "lo", (F.col("lo") + window).alias("hi"))
    spans = covered.unionByName(deep).groupBy("doc_id", "tie")
    spans = spans.agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _RESULT}
            ids, packed = (batch.column(k).to_pylist() for k in (0, 2))
            listed = batch.column(3).to_pylist() if batch.num_columns > 3 else repeat(())
            for doc, text, found in zip(ids, packed, listed, strict=False):
                n, gone, kept = _digest(_unpacked(text), [(s["lo"], s["hi"]) for s in found or ()])
                for k, v in zip(_RESULT, (doc, n, gone, kept), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_result_schema())

    touched = texts.join(spans, ["doc_id", "tie"], "left").mapInArrow(cut, _RESULT_DDL)
    return alone.mapInArrow(cut, _RESULT_DDL).unionByName(touched)


def _shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` of the groups that more than one document has, with the group's least doc_id.

    The groups are materialised, so that the join shuffles both its sides and Spark can split a
    group that a large part of the rows belong to.
    """
    found = rows.groupBy(*by).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return rows.join(cut_lineage(found.filter("least < most").select(*by, "least")), by)


def _pack(batches):
    """Texts travel compressed: they are shuffled up to three times."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [pack.compress(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "tie", "text"])


def _unpacked(text: bytes) -> list[bytes]:
    return zstandard.decompress(text).split()


_RESULT = ("doc_id", "n_words", "n_removed", "kept")
_RESULT_DDL = "doc_id long, n_words long, n_removed long, kept string"
_SPLIT = ("doc_id", "tie", "text", "hit", "prefix", "r1", "r2", "lo", "hi")
_SPLIT_DDL = "doc_id long, tie long, text binary, hit boolean, prefix long, r1 long, r2 long, lo int, hi int"


def _result_schema() -> pa.Schema:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.schema(list(zip(_RESULT, kinds, strict=True)))


def _split_schema() -> pa.Schema:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.schema(list(zip(_SPLIT, kinds, strict=True)))


def _add(out: dict[str, list], **row) -> None:
    for k, column in out.items():
        column.append(row.get(k))


WINDOW_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
  SELECT rid, doc_id, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
s AS (
  SELECT p.rid, p.doc_id, p.i, md5(array_to_string(d.w[p.i : p.i + 49], ' ')) AS h FROM p JOIN d ON p.rid = d.rid),
m AS (
  SELECT rid, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM s) WHERE doc_id > least),
g AS (
  SELECT DISTINCT rid, unnest(range(i, i + 50)) AS k FROM m),
r AS (
  SELECT rid, list(k) AS ks FROM g GROUP BY rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ks IS NULL THEN w
    ELSE [w[x] for x in range(1, len(w) + 1) if NOT list_contains(ks, x)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN r ON d.rid = r.rid
"""


@query("op5_substring_dedup", WINDOW_SQL)
def op5_substring_dedup(spark, sf_dir):
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
