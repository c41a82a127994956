"""Exact top-k search by inner product with Fagin's threshold algorithm.

The vectors are dealt into shards by the hash of their id. A shard keeps one list per
dimension, sorted by component. A query walks down the lists, from the end that its own
component favours, scores every vector it meets for the first time, and stops when the sum of its
products at the current depth, which bounds every vector not met yet, is below its k-th best
score. Queries go to the shards in blocks; the best of the shards meet in a window that ranks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import list_matrix

#: Queries of a block, and the most vectors of a shard: both bound the memory of a task.
BLOCK, SHARD = 4_096, 131_072
#: Depth of the first step down the lists; every step doubles it.
STEP = 4


def finite(vector: Column) -> Column:
    """True for a vector that is neither null nor holds a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


class Shard:
    """The sorted lists of a shard. Ids must ascend, so that the first of equals has the smallest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.down = np.argsort(-vectors, axis=0, kind="stable")

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of the k best other than the query's own, and how many were scored."""
        n = len(self.ids)
        up, low = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = self.ids == query_id
        best, scores = np.zeros(0, np.int64), np.zeros(0, query.dtype)
        scored, depth, after = 0, 0, STEP
        while depth < n:
            after = min(n, after)
            head, tail = self.down[depth:after, up], self.down[n - after:n - depth, low]
            fresh = np.zeros(n, bool)
            fresh[head] = fresh[tail] = True
            if not len(up) and not len(low):
                fresh[:] = True  # a query of zeros scores all alike
            fresh &= ~met
            met |= fresh
            rows = np.flatnonzero(fresh)
            scored += len(rows)
            best, scores = np.concatenate([best, rows]), np.concatenate([scores, self.vectors[rows] @ query])
            order = np.lexsort((best, -scores))[:k]
            best, scores = best[order], scores[order]
            bound = (query[up] * self.vectors[self.down[after - 1, up], up]).sum() + (query[low] * self.vectors[self.down[n - after, low], low]).sum()
            if len(best) == k and scores[-1] > bound or met.all():
                break
            depth, after = after, 2 * after
        return best, scores, scored


def _sorted_rows(rows: pa.Table, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, each once, and floor(scale * component) of their vectors."""
    ids = rows.column(0).to_numpy()
    vectors = np.floor(scale * list_matrix(rows.column(1), width))
    if vectors.size and float(np.abs(vectors).max()) ** 2 * width >= 2.0 ** 53:
        vectors = vectors.astype(np.int64)  # sums beyond the exact range of a double
    order = np.lexsort((*vectors.T[::-1], ids)) if len(ids) > 1 else np.arange(len(ids))
    order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]] if len(ids) else order
    return ids[order], vectors[order]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int | None = None, block_rows: int = BLOCK) -> DataFrame:
    """The ``k`` highest integer inner products of each query with every other row.

    Components count as floor(scale * component). Returns query_id, rank from 1, vec_id and
    score; ties go to the smaller id, fewer rows than ``k`` if there are fewer candidates. A
    row with a null id, or whose vector is null or holds a null or non-finite component, takes no
    part; a shorter vector ends in zeros. Rows of one id count once (the smallest vector). Further
    columns are not read; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    n, asks, width = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1)), F.max(F.size("embedding"))).first()
    width = max(1, width or 0)
    shards = max(1, math.ceil(n / (shard_rows or min(SHARD, max(256, int(4 * math.sqrt(n)))))))
    blocks = max(1, math.ceil(asks / block_rows))
    shard = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(blocks)).cast("int")
    items = rows.select("vec_id", "embedding", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = rows.where("asks").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"))

    def search(items: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if items.num_rows and queries.num_rows:
            index = Shard(*_sorted_rows(items, width, scale))
            for query_id, query in zip(*_sorted_rows(queries, width, scale)):
                best, scores, _ = index.top(query_id, query, k)
                out.append((np.full(len(best), query_id), index.ids[best], scores))
        columns = [np.concatenate([x[c] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64) for c in range(3)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    found = items.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(
        lambda left, right: search(left.select(["vec_id", "embedding"]), right.select(["vec_id", "embedding"])), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""
