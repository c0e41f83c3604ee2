"""Near duplicates among embeddings by a robust-pruned flat graph over overlapping cluster shards.

Only vectors of one label and length are compared, and equal ones are one node. Nodes are parted by
centers until a cell is a shard of bounded size; where a cell is parted a node also joins the cells next
to its own, so shards overlap. In every shard each node is given neighbours by robust pruning: of its
nearest ones those that are no nearer to a neighbour already taken. Of these, close ones are told to all
shards: those so near that both may lie within the range of one query, as no step of a search by range is
longer. What centers part once is parted again by others, for close lists alone, as two like vectors may share
no shard of one parting. The close lists of a node from all its shards are united, and each shard is handed what
its nodes' united lists lead to beyond it. The other neighbours stay in their shard, as places in it.

A node is looked up in its own shard: greedily from the medoid, and from there by range: whatever lies
within the range (and a little beyond) leads on to its neighbours until nothing new is found. Links are
verified in double precision. Some nodes, the same number for any table, are compared with all others;
if too few of their links were found, the search is done again with a wider beam.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.book import query
from trailmark.llm.common import bound_batches, stored, table
from trailmark.llm.components import components

#: Least cosine of a link, and of what a search by range goes on from.
SIMILAR, NEARBY = 0.98, 0.95
#: Most nodes of a shard.
SHARD = 1024
#: Nodes of a cell on which its centers are fitted (expected), and the most centers.
FIT, CENTERS = 4096, 32
#: Cells that a node joins where its own cell is parted.
OVERLAP = 2
#: Rows that one task gives cells at a time; rounds after which cells that centers can't part are dealt out by hash.
CHUNK, ROUNDS = 16384, 12
#: Nearest and random nodes that are pruned, neighbours that stay, factor by which a detour may be longer.
NEAREST, FAR, DEGREE, ALPHA = 48, 16, 24, 1.2
#: Width of the beam, and queries that are looked up at a time.
BEAM, TOGETHER = 24, 256
#: Nodes compared with all others, and the share of their links that must have been found.
AUDITED, RECALL = 256, 0.9


def _units(binaries, dtype: str) -> np.ndarray:
    """The vectors, in double precision, at length 1."""
    raw = np.frombuffer(b"".join(binaries), dtype).reshape(len(binaries), -1).astype(np.float64)
    raw /= np.abs(raw).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return raw / np.sqrt(np.einsum("nd,nd->n", raw, raw))[:, None]


def _table(schema: str, **columns) -> pa.Table:
    kinds = {"string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64(), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(columns[n], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


# cells


def centers(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k directions by k-means on unit vectors; the same for the same rows in the same order."""
    rng = np.random.default_rng(len(x))
    out = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ out.T, axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        size = np.sqrt(np.einsum("nd,nd->n", sums, sums))
        out = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], out)
    return out


_MEMBER = "cell string, node binary, v binary, copies long, home boolean"


def _assign(dtype: str):
    def assign(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table(_MEMBER, cell=[], node=[], v=[], copies=[], home=[])
        x = _units(rows["v"].to_pylist(), dtype)
        middle = np.frombuffer(fitted["centers"][0].as_py()).reshape(-1, x.shape[1])
        at = np.argsort(-(x @ middle.T), axis=1, kind="stable")[:, :OVERLAP]
        home = rows["home"].to_numpy(zero_copy_only=False)
        from_, cells, homes = [], [], []
        for j in range(at.shape[1]):  # a guest goes on to one cell only
            picked = np.arange(len(x)) if j == 0 else np.flatnonzero(home)
            from_.append(picked)
            cells.append(at[picked, j])
            homes.append(home[picked] if j == 0 else np.zeros(len(picked), bool))
        taken = rows.take(pa.array(np.concatenate(from_)))
        names = [f"{c}/{j}" for c, j in zip(taken["cell"].to_pylist(), np.concatenate(cells).tolist(), strict=True)]
        return _table(_MEMBER, cell=names, node=taken["node"].to_pylist(), v=taken["v"].to_pylist(), copies=taken["copies"].to_pylist(), home=np.concatenate(homes))

    return assign


def shards(nodes: DataFrame, dtype: str, turn: int = 0) -> DataFrame:
    """(cell, node, v, copies, home) with at most SHARD rows a cell; every node is at home in one cell.

    Another ``turn`` draws other centers.
    """
    members = nodes.select("cell", "node", "v", "copies", F.lit(True).alias("home"))
    ready: list[DataFrame] = []
    for depth in range(100):
        sizes = stored(members.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SHARD), "cells")
        ready.append(members.join(sizes, "cell", "left_anti"))
        if sizes.isEmpty():
            break
        large = members.join(sizes, "cell")
        if depth >= ROUNDS:
            part = F.pmod(F.xxhash64("node", F.lit(depth + 100 * turn)), F.ceil(2 * F.col("_n") / SHARD))
            members = large.withColumn("cell", F.concat_ws("/", "cell", part.cast("string"))).drop("_n")
        else:
            drawn = F.pmod(F.xxhash64("node", F.lit(depth + 100 * turn)), F.lit(1 << 20)) < F.ceil((1 << 20) * FIT / F.col("_n"))

            def fit(group: pa.Table) -> pa.Table:
                group = group.sort_by("node")
                k = min(CENTERS, max(2 * OVERLAP, int(np.ceil(2.5 * group["_n"][0].as_py() / SHARD))))
                found = centers(_units(group["v"].to_pylist(), dtype), k)
                return _table("cell string, centers binary", cell=[group["cell"][0].as_py()], centers=[found.tobytes()])

            fitted = large.filter(drawn).groupBy("cell").applyInArrow(fit, "cell string, centers binary").join(sizes, "cell")
            chunks = F.ceil(F.col("_n") / CHUNK)
            fitted = fitted.select("cell", "centers", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("_chunk"))
            large = large.withColumn("_chunk", F.pmod(F.xxhash64("node"), chunks)).drop("_n")
            dealt = large.groupBy("cell", "_chunk").cogroup(fitted.groupBy("cell", "_chunk"))
            members = dealt.applyInArrow(_assign(dtype), _MEMBER)
        members = stored(members, "members")
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out


# the graph


def pruned(x: np.ndarray) -> list[np.ndarray]:
    """The neighbours of each row of unit vectors: nearest and a few random ones, robustly pruned, and back again."""
    n = len(x)
    if n <= DEGREE + 1:
        return [np.delete(np.arange(n), i) for i in range(n)]
    rng = np.random.default_rng(n)
    near = min(NEAREST, n - 1)
    like = x @ x.T
    np.fill_diagonal(like, -2)
    best = np.argpartition(-like, near - 1, axis=1)[:, :near]
    among = np.concatenate([best, rng.integers(0, n, (n, FAR))], axis=1)
    out = _prune(x, like, among)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(out):
        for j in own.tolist():
            back[j].append(i)
    # a node that many name keeps the nearest of these
    for i, more in enumerate(back):
        both = np.union1d(out[i], np.array(more, np.int64))
        out[i] = both if len(both) <= 2 * DEGREE else both[np.argsort(-like[i, both], kind="stable")[: 2 * DEGREE]]
    return out


def _prune(x: np.ndarray, like: np.ndarray, among: np.ndarray) -> list[np.ndarray]:
    """Of the candidates of each row, in order of distance, those that no taken one is nearer to by the factor."""
    out: list[np.ndarray] = []
    for a in range(0, len(x), TOGETHER):
        ids = among[a : a + TOGETHER]
        rows = np.arange(len(ids))
        own = like[a + rows[:, None], ids]
        order = np.argsort(-own, axis=1, kind="stable")
        ids, own = np.take_along_axis(ids, order, axis=1), np.take_along_axis(own, order, axis=1)
        between = like[ids[:, :, None], ids[:, None, :]]
        between[ids[:, :, None] == ids[:, None, :]] = 1  # repeated candidates go with the first
        far, apart = np.sqrt(np.maximum(0, 2 - 2 * own)), np.sqrt(np.maximum(0, 2 - 2 * between))
        open_, taken = own > -2, np.zeros(ids.shape, bool)
        for _ in range(DEGREE):
            first = np.argmax(open_, axis=1)
            some = open_[rows, first]
            if not some.any():
                break
            taken[rows[some], first[some]] = True
            gone = (ALPHA * apart[rows, first] <= far) & some[:, None]
            gone[rows, first] = True
            open_ &= ~gone
        out += [np.unique(i[t]) for i, t in zip(ids, taken, strict=True)]
    return out


#: near: places among the nodes of the cell in order; close: nodes.
_LISTED = "cell string, node binary, v binary, copies long, home boolean, near binary, close array<binary>"


def close_by(similar: float) -> float:
    """The least cosine of two vectors that both are in what a search by range of a third goes on from."""
    reach = max(0.0, min(NEARBY, similar))
    return 2 * reach * reach - 1 - 1e-9


def _build(dtype: str, similar: float):
    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        names, x = np.array(group["node"].to_pylist(), object), _units(group["v"].to_pylist(), dtype)
        lists = pruned(x)
        near = pa.array([i.astype(np.int32).tobytes() for i in lists], pa.binary())
        close = pa.array([names[i[x[i] @ own >= close_by(similar)]].tolist() for own, i in zip(x, lists, strict=True)], pa.list_(pa.binary()))
        return group.select(["cell", "node", "v", "copies", "home"]).append_column("near", near).append_column("close", close)

    return build


# the search


def greedy(x: np.ndarray, near: np.ndarray, start: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, cosines) of the best rows that each query meets, going from the nearest unread one to its neighbours.

    near: the neighbours' places, -1 where there is none.
    """
    n = len(q)
    places = np.full((n, beam), -1)
    like = np.full((n, beam), -np.inf)
    unread, met = np.zeros((n, beam), bool), np.zeros((n, len(x)), bool)
    first = start[:beam]
    places[:, : len(first)], like[:, : len(first)], unread[:, : len(first)] = first, q @ x[first].T, True
    met[:, first] = True
    going = np.arange(n)
    while len(going):
        at = np.argmax(np.where(unread[going], like[going], -np.inf), axis=1)
        here = unread[going, at]
        going, at = going[here], at[here]
        if not len(going):
            break
        unread[going, at] = False
        found = near[places[going, at]]
        new = (found >= 0) & ~met[going[:, None], found]
        met[np.broadcast_to(going[:, None], found.shape)[new], found[new]] = True
        score = np.where(new, np.einsum("grd,gd->gr", x[found], q[going]), -np.inf)
        all_, places_ = np.concatenate([like[going], score], axis=1), np.concatenate([places[going], found], axis=1)
        unread_ = np.concatenate([unread[going], new], axis=1)
        best = np.argpartition(-all_, beam - 1, axis=1)[:, :beam]
        like[going], places[going], unread[going] = (np.take_along_axis(y, best, axis=1) for y in (all_, places_, unread_))
        unread[going] &= like[going] > -np.inf
    return places, like


def in_range(x: np.ndarray, near: np.ndarray, start: np.ndarray, asked: np.ndarray, beam: int, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the places of all rows b found within the range of the rows a that are asked for."""
    n, pairs = len(x), []
    for low in range(0, len(asked), TOGETHER):
        ids = asked[low : low + TOGETHER]
        places, like = greedy(x, near, start, x[ids], beam)
        own = np.repeat(np.arange(len(ids)), beam)
        good = like.reshape(-1) >= min(NEARBY, similar)
        front = np.unique(np.concatenate([own[good] * n + places.reshape(-1)[good], np.arange(len(ids)) * n + ids]))
        seen, hits = front, []
        while len(front):
            hits.append(front)
            found = near[front % n]
            there = found >= 0
            reached = np.unique(((front // n * n)[:, None] + found)[there])
            reached = np.setdiff1d(reached, seen, assume_unique=True)
            seen = np.union1d(seen, reached)
            score = np.einsum("nd,nd->n", x[reached % n], x[ids[reached // n]])
            front = reached[score >= min(NEARBY, similar)]
        found = np.concatenate(hits)
        a, b = ids[found // n], found % n
        true = (np.einsum("nd,nd->n", x[a], x[b]) >= similar) & (a != b)
        pairs.append((a[true], b[true]))
    return tuple(np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2


def _together(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each place is connected with."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if (least == before).all():
            return least


_FOUND = "node binary, root binary, hits long, weight long"


def _search(dtype: str, beam: int, similar: float):
    def search(group: pa.Table) -> pa.Table:
        """Of nodes at home: hits and weight, with and without copies. (node, root) of every node that is linked."""
        group = group.sort_by("node")
        names, copies = group["node"].to_pylist(), group["copies"].to_numpy()
        home, member = (group[c].to_numpy(zero_copy_only=False) for c in ("home", "member"))
        place, inner = {x: i for i, x in enumerate(names)}, np.flatnonzero(member)
        within = [inner[np.frombuffer(own or b"", np.int32)] for own in group["near"].to_pylist()]
        across = [[place[y] for y in own if y in place] for own in group["close"].to_pylist()]
        lists = [np.union1d(i, np.array(j, np.int64)) for i, j in zip(within, across, strict=True)]
        near = np.full((len(names), max(1, *map(len, lists))), -1)
        for i, own in enumerate(lists):
            near[i, : len(own)] = own
        x = _units(group["v"].to_pylist(), dtype)
        medoid = inner[np.argmax(x[inner] @ x[inner].mean(axis=0))]
        asked = np.flatnonzero(home)
        a, b = in_range(x, near, np.array([medoid]), asked, beam, similar)
        back = home[b]
        both = np.unique(np.concatenate([a * len(names) + b, b[back] * len(names) + a[back]]))
        a, b = both // len(names), both % len(names)
        hits = np.bincount(a, minlength=len(names))
        weight = np.zeros(len(names), np.int64)
        np.add.at(weight, a, copies[b])
        root = _together(len(names), a, b)
        told = np.flatnonzero(home | (root != np.arange(len(names))))
        # a node that is only a guest here says nothing of its own hits
        own = [[int(y[i]) if home[i] else None for i in told] for y in (hits, weight)]
        return _table(_FOUND, node=[names[i] for i in told], root=[names[i] for i in root[told]], hits=own[0], weight=own[1])

    return search


def _true_hits(asked: list, dtype: str, similar: float):
    """For every batch of nodes, how many of them are in the range of each audited node."""
    own = [(r["group"], r["node"], _units([r["v"]], dtype)[0]) for r in asked]

    def compare(batches):
        for batch in batches:
            groups, names = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(1).to_pylist(), object)
            out = {}
            for name in set(groups.tolist()):
                at = np.flatnonzero(groups == name)
                x = _units([batch.column(2)[i].as_py() for i in at], dtype)
                for _, node, q in (y for y in own if y[0] == name):
                    hits = int(((x @ q >= similar) & (names[at] != node)).sum())
                    if hits:
                        out[node] = out.get(node, 0) + hits
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.int64())], ["node", "true_hits"])

    return compare


def audit(nodes: DataFrame, found: DataFrame, dtype: str, similar: float = SIMILAR, queries: int = AUDITED) -> float:
    """The share of the links of ``queries`` nodes (those of least digest) that were found; 1 if they have none."""
    asked = nodes.orderBy("node").limit(queries).select(F.col("cell").alias("group"), "node", "v").collect()
    if not asked:
        return 1.0
    true = nodes.select("cell", "node", "v").mapInArrow(_true_hits(asked, dtype, similar), "node binary, true_hits long")
    true = true.groupBy("node").agg(F.sum("true_hits").alias("true_hits"))
    both = true.join(found.filter("hits is not null").select("node", "hits"), "node")
    seen, all_ = both.agg(F.sum(F.least("hits", "true_hits")), F.sum("true_hits")).first()
    return seen / all_ if all_ else 1.0


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", similar: float = SIMILAR) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``vectors``.

    Rows link if their labels are equal, their vectors have one length and a cosine of ``similar`` or
    more; n_links counts the other rows linked, copies each, and component_id is the smallest key
    that links lead to. A vector without a label, null, zero, empty or with null or non-finite
    components links with nothing and is its own component. Rows without a key link like any other but
    are never kept, and a component of such rows alone has no id; rows repeated in full count each.
    An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    dtype = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    double = F.col(vector).cast("array<double>")
    usable = F.forall(double, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))) & F.exists(double, lambda y: y != 0)
    usable = F.coalesce(usable & F.col(label).isNotNull(), F.lit(False))

    @F.arrow_udf("binary")
    def packed(rows: pa.Array) -> pa.Array:
        # adding 0 makes the two zeros one
        return pa.array([None if r is None else (np.array(r, dtype) + np.zeros((), dtype)).tobytes() for r in rows.to_pylist()], pa.binary())

    rows = vectors.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.when(usable, F.col(vector)).alias("v"))
    rows = rows.select("key", "label", packed("v").alias("v"))
    cell = F.concat_ws("/", F.md5(F.col("label")), F.octet_length("v").cast("string"))
    node = F.unhex(F.md5(F.concat(F.unhex(F.md5(F.col("label"))), F.col("v"))))
    keyed = stored(rows.select("key", F.when(F.col("v").isNotNull(), cell).alias("cell"), F.when(F.col("v").isNotNull(), node).alias("node"), "v"), "vectors")
    nodes = keyed.filter("node is not null").groupBy("cell", "node").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("key").alias("least"))
    nodes = stored(nodes, "nodes")

    listed = shards(nodes, dtype).groupBy("cell").applyInArrow(_build(dtype, similar), _LISTED)
    listed = stored(listed, "shards")
    parted = nodes.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SHARD).select("cell")
    again = shards(nodes.join(parted, "cell", "left_semi"), dtype, 1).groupBy("cell").applyInArrow(_build(dtype, similar), _LISTED)
    close = listed.select("node", "close").unionByName(again.select("node", "close"))
    united = close.select("node", F.explode("close").alias("close")).groupBy("node").agg(F.collect_set("close").alias("close"))
    united = stored(united, "lists")
    told = listed.select("cell", "node").join(united, "node").select("cell", F.explode("close").alias("node")).distinct()
    beyond = told.join(listed.select("cell", "node"), ["cell", "node"], "left_anti")
    beyond = beyond.join(nodes.select("node", "v", "copies"), "node").join(united, "node", "left")
    beyond = beyond.select("cell", "node", "v", "copies", F.lit(False).alias("home"), F.lit(False).alias("member"), F.lit(None).cast("binary").alias("near"), "close")
    members = listed.drop("close").withColumn("member", F.lit(True)).join(united, "node", "left")
    none = F.array().cast("array<binary>")
    regions = members.unionByName(beyond).withColumn("close", F.coalesce("close", none))

    beam = BEAM
    while True:
        found = stored(regions.groupBy("cell").applyInArrow(_search(dtype, beam, similar), _FOUND), "found")
        if beam >= SHARD or audit(nodes, found, dtype, similar) >= RECALL:
            break
        beam *= 4

    counts = found.filter("hits is not null").select("node", "weight")
    roots = components(found.filter("node <> root").select("node", "root"), "node", "root")
    placed = nodes.select("node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(placed.join(counts, "node", "left"), "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(least, "root").select("node", "component_id", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"))

    linked = keyed.filter("node is not null").select("key", "node").join(classes, "node").select("key", "n_links", "component_id")
    alone = keyed.filter("node is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    kept = F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept")
    return linked.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id", kept)


LINK_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, label, [x::DOUBLE for x in embedding] AS e,
    embedding IS NOT NULL AND label IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
      AND len([1 for x in embedding if x <> 0]) > 0 AS ok
  FROM embeddings),
u AS (SELECT r, vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE ok),
p AS (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS MATERIALIZED (
  WITH RECURSIVE w(a, b) AS (SELECT a, b FROM p UNION SELECT w.a, p.b FROM w JOIN p ON w.b = p.a)
  SELECT * FROM w),
c AS (
  SELECT v.r, v.vec_id, least(v.vec_id, min(o.vec_id)) AS component_id
  FROM v LEFT JOIN reach ON reach.a = v.r LEFT JOIN v o ON o.r = reach.b GROUP BY v.r, v.vec_id)
SELECT c.vec_id, (SELECT count(*) FROM p WHERE p.a = c.r)::BIGINT AS n_links, component_id,
  coalesce(c.vec_id = component_id, false) AS kept
FROM c
"""


@query("op13_vector_near_dedup", LINK_SQL)
def op13_vector_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
