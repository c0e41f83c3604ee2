"""SentencePiece encoding and decoding by a max-plus parallel scan.

A merge-ordered vocabulary has exactly one segmentation of a text in which every two neighbouring
pieces, encoded together, stay as they are; it is the one that merging yields. So encoding
is a best path through a lattice whose states are (position, last piece) and whose steps weigh 0
where neighbours agree and minus infinity where not, and it can be cut anywhere:

1. a giant text is split into chunks; at a cut the state is the piece that covers it (how far it
   starts before and ends after the cut);
2. every chunk yields the transfer matrix from the states at its start to those at its end, on its own;
3. products of these matrices, which are associative, say which states at each cut are reached from the start and
   reach the end: one per cut is left;
4. every chunk is then traced back between its two states, on its own.

A piece never holds a space after another character, so before a space the lattice narrows to
one state; between such places words are merged directly, once for each distinct word of a batch.
"""

from __future__ import annotations

import heapq
import re
from array import array
from itertools import chain, compress, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.book import query
from trailmark.llm.common import bound_batches, once, stored, table, unused

#: Code points of a chunk; at least twice the longest piece.
CHUNK = 1 << 15
#: Words whose pieces a worker remembers, and pairs of pieces whose agreement it does.
REMEMBERED = 300_000
#: Characters whose words are looked up at one time.
RUN = 1 << 20
#: Longer words are merged one by one, with a queue.
TOGETHER = 48

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NONE = np.iinfo(np.int64).max


class Spelling:
    """The bytes of the pieces of a model with byte fallback, one after another."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                spelled.append(b"")
            else:
                spelled.append(piece.replace(SPACE, " ").encode())
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.sizes = np.array(list(map(len, spelled)))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids, first: bool = True) -> str:
        """The text of the ids; bytes that form no character become replacement characters.

        The first piece of a text begins with a space that was put before it.
        """
        ids = np.asarray(ids, np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.letters[at].tobytes().decode("utf-8", "replace")[1 if first else 0 :]


class Vocabulary:
    """Pieces and their merge order, of a model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        scores = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not model.is_control(i) and not model.is_unknown(i):
                self.ids[piece], scores[piece] = i, model.get_score(i)
        if not any(self.byte_ids) or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the model must have byte fallback and pieces with spaces at their start only")
        self.longest = max(map(len, self.ids))
        #: equal scores have equal ranks; the leftmost of equals is merged first
        rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: rank[s] for p, s in scores.items()}
        pairs = sorted(
            (self.ids[p[:k]] << 20 | self.ids[p[k:]], self.rank[p], i)
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if p[:k] in self.ids and p[k:] in self.ids
        )
        self.pair_keys, self.pair_ranks, self.pair_ids = np.array(pairs, np.int64).T.copy()
        #: symbol of each character; one without a piece has a negative symbol, which no pair holds
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self._forget()
        self.agree: dict[tuple[str, str], bool] = {}

    # words

    def _forget(self) -> None:
        """The pieces of known words lie one after another in one pool."""
        self.place: dict[str, int] = {}
        self.pool, self.filled = np.zeros(1 << 16, np.int32), 0
        self.word_start, self.word_size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _store(self, places: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Adds the ids of words, which follow one another, under their places."""
        if (need := int(places.max(initial=-1)) + 1) > len(self.word_start):
            grown = np.zeros(2 * need - len(self.word_start), np.int64)
            self.word_start, self.word_size = (np.concatenate([x, grown]) for x in (self.word_start, self.word_size))
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), np.int32)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.word_start[places] = self.filled + np.cumsum(sizes) - sizes
        self.word_size[places] = sizes
        self.filled += len(ids)

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def merged(self, word: str) -> list[str]:
        """The word's pieces, by merging the pair of best rank, leftmost first."""
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive, queue = [True] * n, []

        def offer(i: int) -> None:
            j = end[i] if i >= 0 else n
            if j < n and (r := self.rank.get(word[i : end[j]])) is not None:
                heapq.heappush(queue, (r, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, j, stop = heapq.heappop(queue)
            if alive[i] and alive[j] and end[i] == j and end[j] == stop:
                alive[j], end[i] = False, stop
                if stop < n:
                    before[stop] = i
                offer(before[i])
                offer(i)
        return [word[i : end[i]] for i in range(n) if alive[i]]

    def ids_of(self, pieces: list[str]) -> array:
        out = array("i")
        for p in pieces:
            i = self.ids.get(p)
            out.extend([i] if i is not None else self._bytes(p))
        return out

    def _rank_pairs(self, left: np.ndarray, right: np.ndarray):
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_ranks[at], _NONE), self.pair_ids[at]

    def _merge_together(self, words: list[str], places: np.ndarray) -> None:
        """Stores the pieces of many short words; each round merges one pair of every word."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol[points].astype(np.int64)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        rank, into = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], into[inside] = self._rank_pairs(symbols[inside], symbols[inside + 1])
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(first, len(word)))
            best = np.minimum.reduceat(rank, first)
            done = best == _NONE
            if done.any() and (done.mean() > 0.25 or len(done) < 2000):
                out = np.repeat(done, size)
                self._store_symbols(places[word[first[done]]], size[done], symbols[out])
                symbols, word, rank, into = symbols[~out], word[~out], rank[~out], into[~out]
                continue
            at = np.flatnonzero((rank == np.repeat(best, size)) & (rank != _NONE))
            owner = word[at]
            at = at[np.concatenate(([True], owner[1:] != owner[:-1]))]
            symbols[at] = into[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word, rank, into = symbols[keep], word[keep], rank[keep], into[keep]
            at -= np.arange(len(at))
            rank[at] = _NONE
            for left in (at, at - 1):
                left = left[(left >= 0) & (left < len(word) - 1)]
                left = left[word[left] == word[left + 1]]
                rank[left], into[left] = self._rank_pairs(symbols[left], symbols[left + 1])

    def _store_symbols(self, places: np.ndarray, sizes: np.ndarray, symbols: np.ndarray) -> None:
        """Characters without a piece become the pieces of their bytes."""
        unknown = np.flatnonzero(symbols < 0)
        if len(unknown):
            spelled = [self._bytes(chr(-1 - x)) for x in symbols[unknown].tolist()]
            count = np.ones(len(symbols), np.int64)
            count[unknown] = list(map(len, spelled))
            owner = np.repeat(np.repeat(np.arange(len(sizes)), sizes), count)
            wide = np.repeat(symbols, count)
            wide[wide < 0] = [i for own in spelled for i in own]
            symbols, sizes = wide, np.bincount(owner, minlength=len(sizes))
        self._store(places, sizes, symbols)

    def encode_flat(self, escaped: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has; texts begin and end where no
        piece can reach across."""
        cut = list(map(_WORD.findall, escaped))
        if len(self.place) > REMEMBERED:
            self._forget()
        n = sum(map(len, cut))
        place = self.place
        at = np.fromiter(map(place.get, chain.from_iterable(cut), repeat(-1)), np.int64, n)
        missing = at < 0
        if missing.any():
            known = len(place)
            new = compress(chain.from_iterable(cut), missing.tolist())
            at[missing] = [place.setdefault(w, len(place)) for w in new]
            fresh = list(islice(place, known, None))
            places = np.arange(known, known + len(fresh))
            short = np.fromiter(map(len, fresh), np.int64, len(fresh)) <= TOGETHER
            for k in np.flatnonzero(~short).tolist():
                ids = self.ids_of(self.merged(fresh[k]))
                self._store(places[k : k + 1], np.array([len(ids)]), np.frombuffer(ids, np.int32))
            if short.any():
                self._merge_together([fresh[k] for k in np.flatnonzero(short).tolist()], places[short])
        sizes = self.word_size[at]
        ends = np.cumsum(sizes)
        flat = self.pool[np.repeat(self.word_start[at] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        bounds = np.concatenate(([0], ends))[np.cumsum([0, *map(len, cut)])]
        return flat, np.diff(bounds)

    def encode_words(self, escaped: str) -> array:
        return array("i", self.encode_flat([escaped])[0].tobytes())

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Like ``encode_flat``, of texts as they are, in runs that bound the memory."""
        found, run, size = [], [], 0
        for k, t in enumerate(texts, 1):
            run.append(escape(t))
            size += len(t)
            if size > RUN or k == len(texts):
                found.append(self.encode_flat(run))
                run, size = [], 0
        flat, sizes = zip(*found, strict=True) if found else ((), ())
        return np.concatenate([np.zeros(0, np.int32), *flat]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def encode(self, texts: list[str]) -> list[list[int]]:
        flat, sizes = self.encode_texts(texts)
        return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]

    # the lattice

    def _agrees(self, a: str | None, b: str) -> bool:
        if a is None:
            return True
        found = self.agree.get((a, b))
        if found is None:
            if len(self.agree) > REMEMBERED:
                self.agree.clear()
            found = self.agree[a, b] = self.merged(a + b) == [a, b]
        return found

    def _covering(self, text: str, cut: int) -> list[tuple[int, int]]:
        """The pieces (start, end) that start before the cut and end at or after it."""
        found = []
        for s in range(max(0, cut - self.longest), cut):
            for e in range(cut, min(len(text), s + self.longest) + 1):
                piece = text[s:e]
                if (piece in self.ids or e - s == 1) and self.merged(piece) == [piece]:
                    found.append((s, e))
        return found

    def _walk(self, text: str, begin: dict, stop: int):
        """From (start, end) pieces with masks of origins: {end: {piece: [mask, predecessor]}} up to pieces that end at or after ``stop``."""
        reach: dict[int, dict] = {}
        for (s, e), mask in begin.items():
            reach.setdefault(e, {})[s, e] = [mask, None]
        at = min(reach, default=stop)
        while at < stop:
            for (s, e), (mask, _) in list(reach.get(at, {}).items()):
                last = text[s:e] or None
                for end in range(at + 1, min(len(text), at + self.longest) + 1):
                    piece = text[at:end]
                    if (piece in self.ids or end == at + 1) and self._agrees(last, piece):
                        step = reach.setdefault(end, {}).setdefault((at, end), [0, (s, e)])
                        step[0] |= mask
            at += 1
        return reach

    def _frame(self, left: str, body: str, right: str):
        """(whole text, start and end of the body, first and last place in it before a space, or None)."""
        text, c0 = left + body + right, len(left)
        c1 = c0 + len(body)
        edges = [m.start() + 1 for m in re.finditer(f"[^{SPACE}](?={SPACE})", text[max(0, c0 - 1) : c1 + 1])]
        edges = [e for x in edges if c0 <= (e := x + max(0, c0 - 1)) <= c1]
        return text, c0, c1, (edges[0], edges[-1]) if edges else None

    def transfer(self, left: str, body: str, right: str, first: bool) -> list[tuple[int, int]]:
        """The steps of weight 0 from states at the chunk's start to those at its end."""
        text, c0, c1, edges = self._frame(left, body, right)
        entries = [(c0, c0)] if first else self._covering(text, c0)
        begin = {piece: 1 << k for k, piece in enumerate(entries)}
        if edges is None:
            reach = self._walk(text, begin, c1)
            out = [(x, p[0]) for e in reach if e >= c1 for x, p in reach[e].items() if x[0] < c1]
        else:
            arrived = self._walk(text, begin, edges[0]).get(edges[0], {})
            mask = 0
            for m, _ in arrived.values():
                mask |= m
            last = edges[1]
            reach = self._walk(text, {(last, last): mask}, c1)
            out = [(x, p[0]) for e in reach if e >= c1 for x, p in reach[e].items() if x[0] < c1]
            if last == c1:  # the chunk ends before a space: any piece that ends there may
                out = [((s, e), mask) for s, e in self._covering(text, c1) if e == c1 and self._ends_word(text, s, e, edges, begin)]
        return [
            (_state(c0, *entries[k]), _state(c1, *x)) for x, mask in out for k in range(len(entries)) if mask >> k & 1
        ]

    def _ends_word(self, text: str, s: int, e: int, edges, begin) -> bool:
        """Whether (s, e), which ends before a space, is the last piece of its word."""
        return (s, e) in self._last_word(text, e, edges, begin)

    def _last_word(self, text: str, e: int, edges, begin):
        start = max((m.start() + 1 for m in re.finditer(f"[^{SPACE}](?={SPACE})", text[:e])), default=None)
        # the word starts in the chunk, or else it is the one that the entry states reach into
        source = {(start, start): 1} if start is not None and start >= edges[0] and start < e else begin
        return self._walk(text, source, e).get(e, {})

    def trace(self, left: str, body: str, right: str, first: bool, entry: int, leave: int) -> array:
        """Ids of the pieces that start in the chunk, on the path between its two states."""
        text, c0, c1, edges = self._frame(left, body, right)
        begin = (c0, c0) if first else _piece(c0, entry)
        goal = _piece(c1, leave)
        if edges is None or edges[0] == edges[1] == c1:
            return self.ids_of(self._back(text, begin, goal, c1))
        head = self._walk(text, {begin: 1}, edges[0])
        out = self.ids_of(_path(text, head, next(iter(head[edges[0]])), begin))
        if edges[1] < c1:
            middle = self.encode_words(text[edges[0] : edges[1]])
            tail = self._back(text, (edges[1], edges[1]), goal, c1)
            return out + middle + self.ids_of(tail)
        return out + self.encode_words(text[edges[0] : c1])

    def _back(self, text: str, begin: tuple[int, int], goal: tuple[int, int], stop: int) -> list[str]:
        return _path(text, self._walk(text, {begin: 1}, stop), goal, begin)


def _path(text: str, reach: dict, goal: tuple[int, int], begin: tuple[int, int]) -> list[str]:
    out = []
    while goal is not None and goal != begin:
        out.append(text[goal[0] : goal[1]])
        goal = reach[goal[1]][goal][1]
    return out[::-1]


def _state(cut: int, start: int, end: int) -> int:
    return (cut - start) << 8 | (end - cut)


def _piece(cut: int, state: int) -> tuple[int, int]:
    return cut - (state >> 8), cut + (state & 255)


def escape(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def compose(a: set[tuple[int, int]], b: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """Max-plus product of two transfer matrices of weights 0, kept as their finite entries."""
    onward: dict[int, list[int]] = {}
    for i, o in b:
        onward.setdefault(i, []).append(o)
    return {(i, o) for i, k in a for o in onward.get(k, ())}


def states(matrices: list[list[tuple[int, int]]]) -> list[int]:
    """The state at every cut, the two ends included, on the one path from start to end."""
    reached = [{0}]
    for m in matrices:
        reached.append({o for i, o in m if i in reached[-1]})
    path = [min(s for s in reached[-1] if s & 255 == 0)]
    for m, before in zip(matrices[::-1], reached[-2::-1], strict=True):
        (state,) = {i for i, o in m if o == path[-1] and i in before}
        path.append(state)
    return path[::-1]


_VOCABULARIES: dict[str, Vocabulary] = {}
_SPELLINGS: dict[str, Spelling] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker and model."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def spelling(path: str) -> Spelling:
    if path not in _SPELLINGS:
        _SPELLINGS[path] = Spelling(path)
    return _SPELLINGS[path]


def _lists(rows: list[array]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate([np.frombuffer(r, np.int32) for r in rows if len(r)] or [np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


_ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def _encoded(text: Column, model: str) -> Column:
    """Ids, and the text that they decode to, from one worker."""

    @F.arrow_udf(_ENCODED)
    def both(texts: pa.Array) -> pa.Array:
        flat, sizes = vocabulary(model).encode_texts([t or "" for t in texts.to_pylist()])
        ends = np.cumsum([0, *sizes])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        spelled = spelling(model)
        back = [spelled.decode(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pa.StructArray.from_arrays([ids, pa.array(back, pa.string())], ["ids", "decoded"])

    return once(both)(text)


def _chunked(texts: DataFrame, chunk: int, margin: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            for digest, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                text = escape(text)
                at = range(0, len(text), chunk)
                columns = (
                    [digest] * len(at),
                    list(range(len(at))),
                    [text[max(0, k - margin) : k] for k in at],
                    [text[k : k + chunk] for k in at],
                    [text[k + chunk : k + chunk + margin] for k in at],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) if i != 1 else pa.array(c, pa.int32()) for i, c in enumerate(columns)],
                    ["digest", "chunk", "left", "body", "right"],
                )

    return texts.mapInArrow(cut, "digest string, chunk int, left string, body string, right string")


def encode_giant(texts: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """(digest, ids, decoded) of ``texts`` (digest, text): the parallel scan over chunks.

    A character's bytes belong to the chunk it starts in, so chunks are also decoded on their own.
    """
    margin = 16
    if chunk < 2 * margin:
        raise ValueError("a chunk must be twice as long as the longest piece")
    # equal texts are encoded once, and chunks are dealt out whatever text they are of
    chunks = stored(_chunked(texts, chunk, margin).dropDuplicates(["digest", "chunk"]), "chunks")

    def solve(batches):
        for batch in batches:
            v = vocabulary(model)
            rows = [v.transfer(r["left"], r["body"], r["right"], r["chunk"] == 0) for r in batch.to_pylist()]
            flat = [array("i", [x for step in row for x in step]) for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(flat)], ["digest", "chunk", "steps"])

    def scan(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        steps = [list(zip(s[::2], s[1::2], strict=True)) for s in group.column("steps").to_pylist()]
        path = states(steps)
        columns = [group.column("digest"), group.column("chunk"), *(pa.array(p, pa.int32()) for p in (path[:-1], path[1:]))]
        return pa.table(columns, ["digest", "chunk", "entry", "leave"])

    def trace(batches):
        for batch in batches:
            v, rows = vocabulary(model), batch.to_pylist()
            ids = [v.trace(r["left"], r["body"], r["right"], r["chunk"] == 0, r["entry"], r["leave"]) for r in rows]
            back = [spelling(model).decode(i, r["chunk"] == 0) for i, r in zip(ids, rows, strict=True)]
            columns = [batch.column(0), batch.column(1), _lists(ids), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "chunk", "ids", "decoded"])

    matrices = chunks.mapInArrow(solve, "digest string, chunk int, steps array<int>")
    ends = matrices.groupBy("digest").applyInArrow(scan, "digest string, chunk int, entry int, leave int")
    traced = chunks.join(ends, ["digest", "chunk"]).mapInArrow(
        trace, "digest string, chunk int, ids array<int>, decoded string"
    )
    joined = traced.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids", "decoded"))).alias("parts"))
    return joined.select("digest", F.flatten("parts.ids").alias("ids"), F.array_join("parts.decoded", "").alias("decoded"))


def encode(docs: DataFrame, model: str, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ids, the pieces' numbers, and decoded, the text that they give back; columns of
    these names are replaced.

    A null text is the empty one, which has no ids. A text that fills less than a chunk has no inner
    cut and is encoded where it lies; longer ones are scanned in chunks that are dealt out.
    Equal long texts are encoded once. Both give what merging the whole text gives.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("ids", "decoded")
    whole = F.coalesce(F.col(text), F.lit(""))
    giant = F.length(whole) >= chunk
    both, digest = unused("_both", docs), unused("_digest", docs)
    short = docs.filter(~giant).withColumn(both, _encoded(F.col(text), model))
    short = short.withColumns({"ids": F.col(both)["ids"], "decoded": F.col(both)["decoded"]}).drop(both)
    long = docs.filter(giant).withColumn(digest, F.sha2(whole, 256))
    found = encode_giant(long.select(F.col(digest).alias("digest"), F.col(text).alias("text")), model, chunk)
    joined = long.join(found.withColumnRenamed("digest", digest), digest).drop(digest)
    return short.unionByName(joined)


def decode(ids: Column, model: str) -> Column:
    """The text of each list of ids; null for null. A text's own U+2581 comes back as a space."""

    @F.arrow_udf(T.StringType())
    def text(rows: pa.Array) -> pa.Array:
        v, flat, ends = spelling(model), rows.flatten().to_numpy(), [0]
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_pylist()
        for n in sizes:
            ends.append(ends[-1] + n)
        valid = rows.is_valid().to_pylist()
        found = [v.decode(flat[a:b]) if ok else None for a, b, ok in zip(ends, ends[1:], valid, strict=False)]
        return pa.array(found, pa.string())

    return text(ids)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_sentencepiece")
def op2_sentencepiece(spark, sf_dir):
    """Per document: number and digest of its ids, and digest of the text that they decode to."""
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
