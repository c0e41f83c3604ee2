"""Collocations: frequent phrases that stand out against their parts, counted in quotient filters.

Words that are frequent enough are numbered, and a phrase is packed: its words' numbers side by side in
as many bits as the vocabulary needs. An invertible permutation spreads the packed phrases evenly. The
leading bits of a permuted phrase are its quotient, the rest its remainder, which is kept in full; so a
sorted filter of (quotient, remainder, counter) is lossless, and it needs no more than the remainder's
bytes and mostly two more for an entry, since quotients are told by the loads of their slots.

Texts are turned into blocks of word numbers. Every block makes one filter for each range of quotients,
and the filters of a range meet in one task, which merges them. Ranges are as many as the words ask for,
and permuted phrases are uniform, so no common word makes a large range. Phrases grow word by word: a
block learns by one bit per entry which of its phrases are frequent, keeps the stretches whose phrases
all are, and packs the next longer ones out of these alone, because a frequent phrase has frequent parts.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.book import query
from trailmark.llm.common import bound_batches, stored, table

#: What ends a piece of text (a phrase doesn't reach across it).
BREAK = re.compile(rb"[.,;:!?\n-\r]+")
#: Occurrences from which on a phrase is a candidate, most words of a phrase, reported phrases of a language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: A block is closed at the end of the text in which it has got so many words.
BLOCK_WORDS = 1 << 20
#: Words of the table for each range of quotients: a bound for the entries that a merging task holds, but for
#: the one more that each block may add of a phrase that all have.
RANGE_WORDS = 1 << 21

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Packing:
    """How phrases of so many words, each a number of so many bits, lie in limbs of ``width`` bits."""

    words: int
    bits: int

    @property
    def limbs(self) -> int:
        return max(2, -(-self.words * self.bits // 62))

    @property
    def width(self) -> int:
        return -(-self.words * self.bits // self.limbs)

    def pack(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """Limbs of the phrases whose j-th words are words[j]."""
        w = self.width
        out = [np.zeros(len(words[0]), np.uint64) for _ in range(self.limbs)]
        for j, x in enumerate(words):
            limb, shift = divmod(j * self.bits, w)
            out[limb] |= (x << np.uint64(shift)) & np.uint64((1 << w) - 1)
            if shift + self.bits > w:
                out[limb + 1] |= x >> np.uint64(w - shift)
        return out

    def unpack(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        w, out = self.width, []
        for j in range(self.words):
            limb, shift = divmod(j * self.bits, w)
            x = limbs[limb] >> np.uint64(shift)
            if shift + self.bits > w:
                x = x | limbs[limb + 1] << np.uint64(w - shift)
            out.append(x & np.uint64((1 << self.bits) - 1))
        return out

    def _turned(self, x: np.ndarray, turn: int) -> np.ndarray:
        """Some function of the limb; a round changes one limb by that of another, so it can be taken back."""
        x = (x + np.uint64(turn + 1)) * np.uint64(_ODD[turn % 4])
        x = (x ^ x >> np.uint64(29)) * np.uint64(_ODD[(turn + 1) % 4])
        return x >> np.uint64(64 - self.width)

    def permute(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        limbs = list(limbs)
        for turn in range(3 * self.limbs):
            at = turn % self.limbs
            limbs[at] = limbs[at] ^ self._turned(limbs[at - 1], turn)
        return limbs

    def restore(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        limbs = list(limbs)
        for turn in reversed(range(3 * self.limbs)):
            at = turn % self.limbs
            limbs[at] = limbs[at] ^ self._turned(limbs[at - 1], turn)
        return limbs

    def counted(self, limbs: list[np.ndarray], times: np.ndarray | None = None):
        """(distinct limbs in ascending order, their counts, the place of each given phrase among them)."""
        n = len(limbs[0])
        if self.limbs * self.width <= 64:
            order = np.argsort(limbs[0] << np.uint64(self.width) | limbs[1], kind="stable")
        else:
            order = np.lexsort(limbs[::-1])
        limbs = [x[order] for x in limbs]
        new = np.ones(n, bool)
        if n:
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in limbs])
        starts = np.flatnonzero(new)
        times = np.diff(np.append(starts, n)) if times is None else np.add.reduceat(times[order], starts) if n else times
        place = np.empty(n, np.int64)
        place[order] = np.cumsum(new) - 1
        return [x[starts] for x in limbs], times, place

    def ranges(self, wanted: int) -> int:
        """Bits of the quotient that number the ranges."""
        return min(self.width, max(0, (wanted - 1).bit_length()))


def _narrow(x: np.ndarray, bits: int) -> bytes:
    """The numbers' low bytes, as many as the bits need."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].tobytes()


def _widen(data: memoryview, n: int, bits: int) -> tuple[np.ndarray, memoryview]:
    size = -(-bits // 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data[: n * size], np.uint8).reshape(n, size)
    return out.view("<u8").reshape(n).astype(np.uint64), data[n * size :]


def written(limbs: list[np.ndarray], times: np.ndarray, width: int, skipped: int) -> bytes:
    """A sorted filter as bytes; ``skipped`` leading bits are the same in all entries (the range) and are written once.

    There are about as many slots as entries. A slot is a quotient; of each its load is written, then
    all remainders in order, then the counters, the large ones at the end.
    """
    n, left = len(times), width - skipped
    head = int(limbs[0][0]) >> left if n else 0
    first = limbs[0] & np.uint64((1 << left) - 1)
    q = min(left, n.bit_length())
    while True:
        load = np.bincount((first >> np.uint64(left - q)).astype(np.int64), minlength=1 << q)
        if load.max(initial=0) < 256:
            break
        # permuted phrases are even, so this is for tiny vocabularies: there, remainders of the other limbs share a slot
        if q == left:
            q = -1
            load = np.zeros(0, np.int64)
            break
        q += 1
    rest = left - max(q, 0)
    first, others = first & np.uint64((1 << rest) - 1), limbs[1:]
    if rest + width <= 64:  # one number takes fewer bytes than two
        first, others, rest = first << np.uint64(width) | limbs[1], limbs[2:], rest + width
    parts = [struct.pack("<qqb", n, head, q), load.astype(np.uint8).tobytes(), _narrow(first, rest)]
    parts += [_narrow(x, width) for x in others]
    large = times >= 255
    parts += [np.where(large, 255, times).astype(np.uint8).tobytes(), times[large].astype("<i8").tobytes()]
    return b"".join(parts)


def read(data: bytes, limbs: int, width: int, skipped: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(limbs, counts) of a filter."""
    n, head, q = struct.unpack_from("<qqb", data)
    view, left = memoryview(data)[17:], width - skipped
    slots = 1 << q if q >= 0 else 0
    load, view = np.frombuffer(view[:slots], np.uint8), view[slots:]
    rest = left - max(q, 0)
    joined = rest + width <= 64
    first, view = _widen(view, n, rest + width * joined)
    out = [first]
    if joined:
        out = [first >> np.uint64(width), first & np.uint64((1 << width) - 1)]
    if slots:
        out[0] |= np.repeat(np.arange(slots, dtype=np.uint64), load) << np.uint64(rest)
    out[0] |= np.uint64(head << left & _MASK)
    while len(out) < limbs:
        more, view = _widen(view, n, width)
        out.append(more)
    times = np.frombuffer(view[:n], np.uint8).astype(np.int64)
    times[times == 255] = np.frombuffer(view[n:], "<i8")
    return out, times


# texts to blocks


def _blocks(batches):
    """(block, lang, n, seq, words, counts): seq has the words' places in ``words``, from 1 on, and 0 between pieces."""
    from pyspark import TaskContext

    task, serial = TaskContext.get().partitionId(), count()
    names: dict[str, defaultdict] = {}
    parts: dict[str, list[np.ndarray]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)

    def close(lang):
        seq, listed = np.concatenate(parts.pop(lang)), names.pop(lang)
        del sizes[lang]
        del listed[b"."]
        times = np.bincount(seq, minlength=len(listed) + 1)[1:]
        row = {
            "block": task << 32 | next(serial),
            "lang": lang,
            "n": int(times.sum()),
            "seq": seq.tobytes(),
            "words": b"\n".join(listed),
            "counts": times.astype("<i4").tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], _BLOCK_TYPES)

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, data = lang.as_py(), (text.as_py() or "").encode()
            if lang not in names:
                numbers = count()
                names[lang] = defaultdict(numbers.__next__)
                names[lang][b"."]  # what stands between pieces is 0
            own = names[lang].__getitem__
            # the cuts between slices fall on a space, and change nothing
            at = 0
            while at < len(data):
                past = len(data) if len(data) - at <= 1 << 20 else data.find(b" ", at + (1 << 20)) + 1 or len(data)
                tokens = BREAK.sub(b" . ", data[at:past].lower()).split()
                parts[lang].append(np.fromiter(map(own, tokens), np.int32, len(tokens)))
                sizes[lang] += len(tokens)
                at = past
            parts[lang].append(np.zeros(1, np.int32))
            sizes[lang] += 1
            if sizes[lang] >= BLOCK_WORDS:
                yield close(lang)
            elif sum(sizes.values()) >= 2 * BLOCK_WORDS:
                yield close(max(sizes, key=sizes.get))
    for lang in list(names):
        yield close(lang)


_BLOCK = "block long, lang string, n long, seq binary, words binary, counts binary"
_BLOCK_TYPES = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), *((x, pa.binary()) for x in ("seq", "words", "counts"))])
#: What blocks and merging tasks tell each other. A block: its words (at -1, seq), its filter of a range (filter).
#: A merging task: which of a block's phrases are frequent (bits); without a block, the frequent phrases (filter).
_TOLD = "block long, at int, seq binary, filter binary, bits binary"
_TOLD_TYPES = pa.schema([("block", pa.int64()), ("at", pa.int32()), *((x, pa.binary()) for x in ("seq", "filter", "bits"))])
#: The same for single words, which are spelled: places and counts, or places and numbers.
_SPELLED = "block long, at int, lang string, words binary, places binary, counts binary"
_SPELLED_TYPES = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("lang", pa.string()), *((x, pa.binary()) for x in ("words", "places", "counts"))])


def _spelled(ranges: int):
    """The words of each block by ranges of their hashes."""

    def spell(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if not r["n"]:
                    continue
                words, times = np.array(r["words"].split(b"\n"), object), np.frombuffer(r["counts"], "<i4")
                seed = xxhash.xxh64_intdigest(r["lang"])
                of = np.fromiter((xxhash.xxh64_intdigest(w, seed) % ranges for w in words), np.int64, len(words))
                order = np.argsort(of, kind="stable")
                bounds = np.append(np.flatnonzero(np.diff(of[order], prepend=-1)), len(of))
                rows = []
                for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                    own = order[a:z]
                    told = {"words": b"\n".join(words[own]), "places": (own + 1).astype("<i4").tobytes(), "counts": times[own].tobytes()}
                    rows.append({"block": r["block"], "at": int(of[own[0]]), "lang": r["lang"], **told})
                yield pa.RecordBatch.from_pylist(rows, _SPELLED_TYPES)

    return spell


def _number(ranges: int, least: int):
    """The words of one range are added up; the frequent ones get numbers, by which blocks know them from then on.

    Numbers are dealt to the ranges in turn, so they need no count of what other ranges have.
    """

    def number(group: pa.Table) -> pa.Table:
        at, rows = group["at"][0].as_py(), group.to_pylist()
        total: dict[str, dict[bytes, int]] = defaultdict(dict)
        for r in rows:
            own = total[r["lang"]]
            for w, n in zip(r["words"].split(b"\n"), np.frombuffer(r["counts"], "<i4").tolist(), strict=True):
                own[w] = own.get(w, 0) + n
        next_ = count(at + 1, ranges)
        ids = {lang: {w: next(next_) for w in sorted(own) if own[w] >= least} for lang, own in sorted(total.items())}
        out = []
        for r in rows:
            own = np.array([ids[r["lang"]].get(w, 0) for w in r["words"].split(b"\n")], "<i8")
            places = np.frombuffer(r["places"], "<i4")[own > 0]
            out.append({"block": r["block"], "at": at, "places": places.tobytes(), "counts": own[own > 0].tobytes()})
        for lang, own in ids.items():
            if own:
                told = {"words": b"\n".join(own), "places": np.array([*own.values()], "<i8").tobytes()}
                out.append({"at": at, "lang": lang, **told, "counts": np.array([total[lang][w] for w in own], "<i8").tobytes()})
        return pa.Table.from_pylist(out, _SPELLED_TYPES)

    return number


def _vocabulary(batches):
    """(id, lang, word, f) of the numbered words."""
    for batch in batches:
        for lang, words, ids, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = pa.array(words.split(b"\n"), pa.binary()).cast(pa.string())
            ids, times = (pa.array(np.frombuffer(x, "<i8")) for x in (ids, times))
            yield pa.RecordBatch.from_arrays([ids, pa.array([lang] * len(words), pa.string()), words, times], ["id", "lang", "word", "f"])


def _stretches(seq: np.ndarray, good: np.ndarray, words: int) -> np.ndarray:
    """The words under neighbouring good windows of so many words, with 0 after each such run; equal words may repeat."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts + words  # the words of the run and the 0
    if not len(sizes):
        return seq[:0]
    past = np.cumsum(sizes)
    from_ = np.arange(past[-1]) + np.repeat(starts - (past - sizes), sizes)
    from_[past - 1] = 0
    out = seq[from_]
    out[past - 1] = 0
    return out


def _windows(seq: np.ndarray, words: int) -> np.ndarray:
    """Whether so many words in a row begin here; one entry for each place where they could."""
    n = len(seq) - words + 1
    if n <= 0:
        return np.zeros(0, bool)
    full = seq != 0
    return np.logical_and.reduce([full[j : j + n] for j in range(words)])


def _phrases(seq: np.ndarray, packing: Packing, windows: np.ndarray) -> list[np.ndarray]:
    at = np.flatnonzero(windows)
    return packing.permute(packing.pack([seq[at + j].astype(np.uint64) for j in range(packing.words)]))


def _filters(block: int, seq: np.ndarray, packing: Packing, wanted: int):
    """What a block tells: its words, and a filter for every range of quotients that it has entries of."""
    limbs, times, _ = packing.counted(_phrases(seq, packing, _windows(seq, packing.words)))
    rows = [{"block": block, "at": -1, "seq": seq.astype(np.uint32).tobytes()}] if len(times) else []
    skipped = packing.ranges(wanted)
    of = (limbs[0] >> np.uint64(packing.width - skipped)).astype(np.int64)
    bounds = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        data = written([x[a:z] for x in limbs], times[a:z], packing.width, skipped)
        rows.append({"block": block, "at": int(of[a]), "filter": data})
    return pa.Table.from_pylist(rows, _TOLD_TYPES)


def _first(packing: Packing, wanted: int):
    """Blocks learn the numbers of their words, and count phrases."""

    def step(group: pa.Table) -> pa.Table:
        held = group.filter(pc.is_valid(group["seq"]))
        named = group.filter(pc.is_valid(group["places"]))
        seq = np.frombuffer(held["seq"][0].as_py(), np.int32)
        numbers = np.zeros(int(seq.max(initial=0)) + 1, np.int64)
        for places, ids in zip(named["places"].to_pylist(), named["ids"].to_pylist(), strict=True):
            numbers[np.frombuffer(places, "<i4")] = np.frombuffer(ids, "<i8")
        seq = numbers[seq]
        good = _windows(seq, packing.words)
        return _filters(held["block"][0].as_py(), _stretches(seq, good, packing.words), packing, wanted)

    return step


def _next(before: Packing, packing: Packing, wanted: int):
    """Blocks learn which of their phrases are frequent, and count those that are one word longer."""

    def step(group: pa.Table) -> pa.Table:
        held = group.filter(pc.is_valid(group["seq"]))
        seq = np.frombuffer(held["seq"][0].as_py(), np.uint32).astype(np.int64)
        windows = _windows(seq, before.words)
        limbs, _, place = before.counted(_phrases(seq, before, windows))
        of = (limbs[0] >> np.uint64(before.width - before.ranges(wanted))).astype(np.int64)
        frequent = np.zeros(len(of), bool)
        said = group.filter(pc.is_valid(group["bits"]))
        for at, bits in zip(said["at"].to_pylist(), said["bits"].to_pylist(), strict=True):
            a, z = np.searchsorted(of, [at, at + 1])
            frequent[a:z] = np.unpackbits(np.frombuffer(bits, np.uint8), count=z - a)
        alive = np.zeros(len(windows), bool)
        alive[np.flatnonzero(windows)] = frequent[place]
        seq = _stretches(seq, alive[:-1] & alive[1:], packing.words)
        return _filters(held["block"][0].as_py(), seq, packing, wanted)

    return step


def _merge(packing: Packing, wanted: int, least: int):
    """Filters of one range become one of the frequent phrases, and bits for each of the blocks."""

    def merge(group: pa.Table) -> pa.Table:
        skipped = packing.ranges(wanted)
        blocks, at = group["block"].to_pylist(), group["at"][0].as_py()
        found = [read(x.as_py(), packing.limbs, packing.width, skipped) for x in group["filter"]]
        ends = np.cumsum([len(t) for _, t in found])
        given = [np.concatenate([f[0][k] for f in found]) for k in range(packing.limbs)]
        limbs, times, place = packing.counted(given, np.concatenate([t for _, t in found]))
        often = times >= least
        rows = [{"block": b, "at": at, "bits": np.packbits(x).tobytes()} for b, x in zip(blocks, np.split(often[place], ends[:-1]), strict=True)]
        if often.any():
            data = written([x[often] for x in limbs], times[often], packing.width, skipped)
            rows.append({"at": at, "filter": data})
        return pa.Table.from_pylist(rows, _TOLD_TYPES)

    return merge


def _listed(packing: Packing, wanted: int):
    """Filters to rows (ids, f)."""

    def rows(batches):
        for batch in batches:
            for x in batch.column(0):
                limbs, times = read(x.as_py(), packing.limbs, packing.width, packing.ranges(wanted))
                ids = np.stack(packing.unpack(packing.restore(limbs)), axis=1).astype(np.int64)
                for a in range(0, len(times), 1 << 16):
                    part = ids[a : a + (1 << 16)]
                    lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * packing.words, part.reshape(-1))
                    yield pa.RecordBatch.from_arrays([lists, pa.array(times[a : a + (1 << 16)])], ["ids", "f"])

    return rows


@dataclass(frozen=True)
class Counted:
    """words: (id, lang, word, f) of the frequent ones; grams: (ids, f) of all frequent phrases, single words
    included; totals: (lang, n) with all occurrences of words."""

    words: DataFrame
    grams: DataFrame
    totals: DataFrame


def count_phrases(docs: DataFrame, lang: Column, text: str = "text", least: int = LEAST, longest: int = LONGEST) -> Counted:
    """All phrases of up to ``longest`` words that occur at least ``least`` times in the texts of a language.

    A-Z count as lower case. A null language is ``und``, a null text has no words. Overlapping
    occurrences count, those across the end of a piece don't. An empty table gives empty tables.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
    blocks = stored(texts.mapInArrow(_blocks, _BLOCK), "blocks")
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    size = blocks.agg(F.sum("n")).first()[0] or 0
    wanted = max(1, -(-size // RANGE_WORDS))
    spelled = blocks.select("block", "lang", "n", "words", "counts").mapInArrow(_spelled(wanted), _SPELLED)
    numbered = stored(spelled.groupBy("at").applyInArrow(_number(wanted, least), _SPELLED), "numbers")
    words = numbered.filter("block is null").select("lang", "words", "places", "counts")
    words = stored(words.mapInArrow(_vocabulary, "id long, lang string, word string, f long"), "words")
    bits = max(1, (words.agg(F.max("id")).first()[0] or 0).bit_length())
    grams = words.select(F.array("id").alias("ids"), "f")

    told = None
    for n in range(2, longest + 1):
        packing = Packing(n, bits)
        if told is None:
            named = numbered.filter("block is not null").select("block", "places", F.col("counts").alias("ids"))
            both, step = blocks.select("block", "seq").unionByName(named, True), _first(packing, wanted)
        else:
            both = told.filter("at < 0").select("block", "seq").unionByName(merged.filter("block is not null").select("block", "at", "bits"), True)
            step = _next(Packing(n - 1, bits), packing, wanted)
        told = stored(both.groupBy("block").applyInArrow(step, _TOLD), f"phrases-{n}")
        filters = told.filter("at >= 0").select("block", "at", "filter")
        merged = stored(filters.groupBy("at").applyInArrow(_merge(packing, wanted, least), _TOLD), f"merged-{n}")
        found = merged.filter("block is null").select("filter").mapInArrow(_listed(packing, wanted), "ids array<long>, f long")
        grams = grams.unionByName(found)
    return Counted(words, stored(grams, "grams"), totals)


def cut_score(a: str = "a", n: str = "n", left: str = "l", r: str = "r") -> Column:
    """floor(1000 a n / (l r)) of whole numbers, exact while 1000 a n is below 10^38."""
    one, all_, x, y = (F.col(c).cast("decimal(19,0)") for c in (a, n, left, r))
    product, parts = one * all_ * F.lit(1000).cast("decimal(4,0)"), x * y
    return ((product - F.pmod(product, parts)) / parts).cast("decimal(38,0)").cast("long")


def collocations(counted: Counted) -> DataFrame:
    """(lang, phrase, a, l, r, n, k, score) of every frequent phrase of two or more words that isn't part of a longer one as frequent.

    Of a phrase's cuts in two the one of lowest score counts, of equal ones the earliest: k words, which
    occur l times, before the cut, and the rest, which occurs r times. The phrase occurs a times, all words n times.
    """
    grams, words = counted.grams, counted.words
    phrases = grams.filter(F.size("ids") > 1).withColumnRenamed("f", "a")
    m = F.size("ids")

    # phrases that lie in a longer one of the same count
    inner = phrases.filter(m > 2).select("ids", "a", F.explode(F.sequence(F.lit(2), m - 1)).alias("_m"))
    inner = inner.select("ids", "a", "_m", F.explode(F.sequence(F.lit(1), m - F.col("_m") + 1)).alias("_at"))
    inner = inner.groupBy(F.slice("ids", F.col("_at"), F.col("_m")).alias("ids")).agg(F.max("a").alias("_longer"))
    kept = phrases.join(inner, "ids", "left").filter(F.col("_longer").isNull() | (F.col("_longer") < F.col("a"))).drop("_longer")

    # words and totals: the language is that of any of the words
    named = kept.select("ids", "a", F.posexplode("ids").alias("_at", "id")).join(words.select("id", "lang", "word"), "id")
    named = named.groupBy("ids").agg(F.max("a").alias("a"), F.max("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("_at", "word"))).alias("_w"))
    named = named.select("ids", "a", "lang", F.array_join(F.col("_w.word"), " ").alias("phrase")).join(counted.totals, "lang")

    cuts = named.withColumn("k", F.explode(F.sequence(F.lit(1), m - 1)))
    cuts = cuts.withColumn("_l", F.slice("ids", F.lit(1), F.col("k"))).withColumn("_r", F.slice("ids", F.col("k") + 1, m - F.col("k")))
    for end in ("l", "r"):
        cuts = cuts.join(grams.select(F.col("ids").alias(f"_{end}"), F.col("f").alias(end)), f"_{end}")
    lowest = F.min(F.struct(cut_score().alias("score"), "k", "l", "r")).alias("cut")
    found = cuts.groupBy("ids", "lang", "phrase", "a", "n").agg(lowest)
    return found.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.k", "cut.score")


COLLOCATION_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
m AS (SELECT unnest([1, 2, 3, 4, 5]) AS m),
s AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, m WHERE len(ws) >= m),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a FROM f WHERE m > 1 AND f >= 100),
k AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c b
    WHERE b.lang = c.lang AND b.m > c.m AND 100 * b.a >= 100 * c.a
      AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
cut AS (
  SELECT k.*, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM k),
sc AS (
  SELECT cut.lang, cut.phrase, cut.a, cut.k, l.f AS l, r.f AS r, n.n,
    ((1000::HUGEINT * cut.a::HUGEINT * n.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT)) AS score
  FROM cut
  JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(cut.ws[1:cut.k], ' ')
  JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(cut.ws[cut.k + 1:cut.m], ' ')
  JOIN n ON n.lang = cut.lang),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM sc),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
    a, l, r, n, score FROM low WHERE nth = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
  score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


@query("op12_collocations", COLLOCATION_SQL)
def op12_collocations(spark, sf_dir):
    found = collocations(count_phrases(table(spark, sf_dir, "documents"), F.col("lang")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= TOP)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
