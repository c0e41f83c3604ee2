"""Exact top-k by inner product with no-random-access aggregation of sorted lists.

Every component is a list of the candidates sorted by value; a query reads each list from the
end that its own component favours. What has been read of a candidate gives a lower bound of its
score (unread components at their list's far end) and an upper one (at the list's read depth).
Reading goes on, in steps, until no candidate outside the k best lower bounds can reach them;
the scores of those that are left are then resolved in full.

Candidates lie in blocks of bounded size, queries too; every pair of blocks is a row of its own,
read for all queries of the block at once as matrix products, and the k best of each block pair
meet in one ranking per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.book import query
from trailmark.llm.common import bound_batches, table
from trailmark.session import cut_lineage

CANDIDATE_BLOCK = 2048
QUERY_BLOCK = 1024
#: Shares of the lists after which bounds are compared.
DEPTHS = (1 / 16, 1 / 4, 1 / 2, 1.0)
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)


def best_of_block(q_ids, q, c_ids, c, k: int):
    """(query ids, candidate ids, scores): the k best candidates of the block for every query.

    q, c: rows of whole numbers as doubles. Ties go to the smaller candidate id. A candidate
    with the query's own id takes no part.
    """
    n, d = c.shape
    out: list[tuple] = []
    limit = max(1.0, np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(d, 1))
    exact = limit < EXACT
    own = q_ids[:, None] == c_ids[None, :]
    if not exact:  # beyond doubles: whole numbers of any size, cut off at the ends of a long
        whole = np.array([[int(x) for x in r] for r in c.tolist()], object).reshape(n, d)
        for i, row in enumerate(q.tolist()):
            s = np.clip(whole @ np.array([int(x) for x in row], object) if d else np.zeros(n, object), -(1 << 63), (1 << 63) - 1)
            out += _ranked(q_ids[i], c_ids, s.astype(object), np.flatnonzero(~own[i]), k)
        return out
    order = np.argsort(c, axis=0, kind="stable")
    from_low = np.empty((n, d), np.int64)
    np.put_along_axis(from_low, order, np.broadcast_to(np.arange(n)[:, None], (n, d)), axis=0)
    ascending = np.take_along_axis(c, order, axis=0)
    least, most = (ascending[0], ascending[-1]) if n else (np.zeros(d), np.zeros(d))
    up, down = np.maximum(q, 0), np.minimum(q, 0)  # lists read from the high and from the low end
    todo = np.arange(len(q))
    for share in DEPTHS:
        t = max(1, int(np.ceil(n * share)))
        seen_high, seen_low = from_low >= n - t, from_low < t
        frontier_high, frontier_low = ascending[n - t], ascending[t - 1]
        a, b = up[todo], down[todo]
        read = a @ (c * seen_high).T + b @ (c * seen_low).T
        left_high, left_low = (~seen_high).T.astype(float), (~seen_low).T.astype(float)
        upper = read + (a * frontier_high) @ left_high + (b * frontier_low) @ left_low
        lower = read + (a * least) @ left_high + (b * most) @ left_low
        skip = own[todo]
        lower[skip] = -np.inf
        upper[skip] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(todo), -np.inf)
        open_ = (upper >= kth[:, None]) & ~skip
        done = (open_.sum(axis=1) <= 4 * k) if t < n else np.ones(len(todo), bool)
        for i in np.flatnonzero(done):
            near = np.flatnonzero(open_[i])
            # what is left is resolved: the rest of the lists for these few candidates
            scores = np.full(n, -np.inf)
            scores[near] = c[near] @ q[todo[i]]
            out += _ranked(q_ids[todo[i]], c_ids, scores, near, k)
        todo = todo[~done]
        if not len(todo):
            break
    return out


def _ranked(query_id, ids, scores, among, k):
    order = sorted(among.tolist(), key=lambda j: (-scores[j], ids[j]))[:k]
    return [(int(query_id), int(ids[j]), int(scores[j])) for j in order]


def _whole(vector: str) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 256).cast("double"))


def _packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """One row per block: its number, its ids and its vectors, padded with zeros to one length."""

    def pack(batches):
        from pyspark import TaskContext

        tables = [b for b in batches if b.num_rows]
        if tables:
            whole = pa.Table.from_batches(tables)
            ids = whole.column(0).to_numpy().astype(np.int64)
            lists = whole.column(1).to_pylist()
            width = max(map(len, lists))
            flat = np.array([x + [0.0] * (width - len(x)) for x in lists], float)
            yield pa.RecordBatch.from_pydict(
                {
                    name: pa.array([TaskContext.get().partitionId()], pa.int32()),
                    f"{name}_ids": pa.array([ids.tobytes()], pa.binary()),
                    f"{name}_rows": pa.array([flat.tobytes()], pa.binary()),
                }
            )

    packed = rows.repartition(blocks).mapInArrow(pack, f"{name} int, {name}_ids binary, {name}_rows binary")
    return cut_lineage(packed)


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(256 x) for every query.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows
    without an id. Shorter vectors count as padded with zeros. Rows with the query's id are its
    own and no candidates for it; other repeated rows are candidates each. If an id repeats among
    the queries, its smallest vector asks. With fewer than k candidates all are returned.
    """
    bound_batches(vectors.sparkSession)
    finite = F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    )
    usable = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    rows = usable.select(F.col(key).cast("long").alias("id"), _whole(vector).alias("v"), is_query.alias("asks"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    queries = rows.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    q_blocks, c_blocks = max(1, -(-asked // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    q = _packed(queries, q_blocks, "q").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    c = _packed(rows.select("id", "v"), c_blocks, "c").withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = [np.frombuffer(r[f"{x}_ids"], np.int64) for x in "qc"]
                a, b = (np.frombuffer(r[f"{x}_rows"]).reshape(len(i), -1) for x, i in zip("qc", ids, strict=True))
                width = max(a.shape[1], b.shape[1])
                a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
                found = best_of_block(ids[0], a, ids[1], b, k)
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"]
                )

    found = q.join(c, ["q", "c"]).mapInArrow(read, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT vec_id AS query_id, min(e) AS a FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT query_id, vec_id, list_inner_product(a, e)::BIGINT AS score FROM q JOIN v ON vec_id <> query_id),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
  FROM s)
SELECT * FROM r WHERE rank <= 5
"""


@query("op6_exact_top_k", TOP_SQL)
def op6_exact_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
