"""Exact top-k search with the threshold algorithm over sorted lists.

Candidates are dealt into blocks; each has its rows sorted once by every dimension. A
query walks down the lists of all dimensions at once, from the end that suits the sign of
its component, and scores whatever it meets for the first time in full. What it has not
met cannot score more than the places reached in the lists add up to; once that bound is
below the k-th score, the block is done. Queries come in blocks too, every query block
meets every candidate block in a task of bounded size, and the blocks' best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorfill.llm.common import stored

K = 10
SCALE = 1024
#: Rows of a block of candidates and of queries, about.
CANDIDATES, QUERIES = 8192, 512
#: Places that a query walks down first; then twice as many, and so on.
FIRST_STEP = 16


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as longs; null for a null vector or one with
    null or non-finite components. Beyond the range of longs it is the nearest long."""
    each = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(each, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    lowest, highest = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)

    def whole(x: Column) -> Column:
        y = x * scale
        return F.when(y >= 2.0**63, highest).when(y < -(2.0**63), lowest).otherwise(F.floor(y))

    return F.when(~odd, F.transform(each, whole))


class Lists:
    """The sorted lists of a block of candidates."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.size = int(np.abs(x.astype(float)).max(initial=0))

    def _values(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates and query in numbers whose inner products are exact."""
        most = float(np.abs(query.astype(float)).max(initial=0)) * self.size * max(1, len(query))
        kind = float if most < 2.0**53 else np.int64 if most < 2.0**62 else object
        return self.x.astype(kind), query.astype(kind)

    def top(self, query: np.ndarray, own: int, k: int, values=None) -> list[tuple[int, int]]:
        """(score, id) of the k best by score, then smaller id, other than id ``own``."""
        x, q = self._values(query) if values is None else values
        n, dims = len(x), np.flatnonzero(query)
        order, q_used = self.order[:, dims], q[dims]
        # From the end that has the largest products.
        order = np.where(query[dims] > 0, order[::-1], order)
        met = self.ids == own
        best_score, best_id = x[:0] @ q, self.ids[:0]
        depth, step = 0, FIRST_STEP
        while True:
            reached = min(n, depth + step)
            if len(dims):
                new = np.unique(order[depth:reached])
                new = new[~met[new]]
            else:
                new, reached = np.flatnonzero(~met), n
            met[new] = True
            score = np.concatenate((best_score, x[new] @ q))
            ids = np.concatenate((best_id, self.ids[new]))
            keep = np.lexsort((ids, -score))[:k]
            best_score, best_id = score[keep], ids[keep]
            if reached == n:
                break
            depth, step = reached, 2 * step
            bound = (x[order[depth - 1], dims] * q_used).sum()
            # A candidate with just the k-th score could still have a smaller id.
            if len(best_score) == k and bound < best_score[-1]:
                break
        low, high = -(1 << 63), (1 << 63) - 1
        return [(min(max(int(s), low), high), int(i)) for s, i in zip(best_score, best_id)]


def _search(k: int):
    """applyInArrow function: the best of one candidate block for one query block."""

    def run(rows: pa.Table) -> pa.Table:
        out = []
        ids, asks = rows.column("id").to_numpy(), rows.column("ask").to_numpy()
        flat = rows.column("v").combine_chunks()
        sizes = np.diff(flat.offsets.to_numpy()) if len(flat) else np.zeros(0, int)
        # Only vectors of one length have inner products.
        for dim in np.unique(sizes[asks]):
            alike = sizes == dim
            x = np.array(rows.column("v").filter(pa.array(alike)).to_pylist(), dtype=np.int64)
            x, i, ask = x.reshape(alike.sum(), dim), ids[alike], asks[alike]
            lists = Lists(i[~ask], x[~ask])
            shared = lists.x.astype(float)
            limit = 2.0**53
            for number, query in zip(i[ask], x[ask]):
                small = float(np.abs(query.astype(float)).max(initial=0)) * lists.size * max(1, dim) < limit
                values = (shared, query.astype(float)) if small else None
                out += [(int(number), query, s, j) for s, j in lists.top(query, number, k, values)]
        return pa.table(
            {
                "query_id": pa.array([r[0] for r in out], pa.int64()),
                "query": pa.array([r[1].tobytes() for r in out], pa.binary()),
                "vec_id": pa.array([r[3] for r in out], pa.int64()),
                "score": pa.array([r[2] for r in out], pa.int64()),
            }
        )

    return run


def top_k(vectors: DataFrame, asked: Column, k: int = K, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best by inner product for each row of
    (id long, v array<long>) where ``asked`` holds, among all rows of other ids.

    Ties go to smaller ids; all candidates are ranked if there are fewer than k. Rows with
    a null id or vector take no part; a row that is there twice counts once; rows with one
    id and different vectors are each a candidate and a query. Only vectors of one length
    are compared. Scores beyond longs are the nearest long. Empty tables give no rows.
    """
    rows = stored(vectors.select("id", "v", asked.alias("ask")).where("id is not null and v is not null").distinct(), "vectors")
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if("ask").alias("asked")).head()
    blocks, asks = max(1, -(-n["all"] // candidates)), max(1, -(-n["asked"] // queries))
    mine = F.xxhash64("id", "v")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block, ask = F.pmod(mine, F.lit(blocks)).cast("int"), F.pmod(mine, F.lit(asks)).cast("int")
    left = rows.select("id", "v", F.lit(False).alias("ask"), block.alias("b"), every(asks).alias("a"))
    right = rows.where("ask").select("id", "v", "ask", ask.alias("a"), every(blocks).alias("b"))
    dealt = left.unionByName(right).repartition(blocks * asks, "b", "a")
    best = dealt.groupBy("b", "a").applyInArrow(_search(k), "query_id long, query binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best vectors for every hundredth."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), whole_numbers(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("id") % 100 == 0)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
