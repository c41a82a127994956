"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

The vectors are dealt into shards by the hash of their id, and every shard gets a graph of its
own. The graph starts at random; each round joins the sampled neighbours of every vector, both
ways, with their neighbours, scores the neighbours of neighbours and keeps the nearest, until few
lists change. A query walks the graph of every shard from a few entry points: it opens the best
vectors of its pool that are not open yet, adds their neighbours, and stops when the pool is open.

Inner products become distances by one further component that gives all vectors the length of the
longest, so the graph joins true neighbours also where lengths differ.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import list_matrix, materialize
from tidewatch.llm.topk import finite

#: Vectors of a shard, neighbours of a vector, neighbours sampled per round and direction.
SHARD, DEGREE, SAMPLE = 4_096, 20, 8
#: Rounds at most, and the share of changed list entries below which they end.
ROUNDS, QUIET = 10, 0.01
#: Pool, entry points and vectors opened at once of a search; queries searched at once.
POOL, ENTRIES, OPEN, BATCH = 96, 64, 4, 128
#: Queries of a block: bounds the memory of a search task.
BLOCK = 8_192


def level(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that gives them all the length ``longest``."""
    rest = np.sqrt(np.maximum(0.0, longest * longest - (vectors * vectors).sum(1)))
    return np.hstack([vectors, rest[:, None]]).astype(np.float32)


def nearest_of(vectors: np.ndarray, node: int, candidates: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest of ``candidates`` (each once, not the node), nearest first."""
    candidates = np.unique(candidates)
    candidates = candidates[candidates != node]
    return candidates[np.lexsort((candidates, -(vectors[candidates] @ vectors[node])))[:k]]


def search(vectors: np.ndarray, near: np.ndarray, queries: np.ndarray, own: np.ndarray, pool: int = POOL, entries: int = ENTRIES) -> np.ndarray:
    """Rows of the pool that a greedy walk ends with, for each query; -1 fills short pools.

    ``near`` holds the neighbours of each row (-1: none); ``own`` is the query's own row, -1 if it has none.
    """
    n, q = len(vectors), len(queries)
    size = min(pool, n)
    start = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(int))
    seen = np.zeros((q, n + 1), bool)  # the last column stands for no row
    seen[:, n] = True
    ids = np.broadcast_to(start, (q, len(start))).copy()
    ids = np.hstack([ids, np.where((own >= 0)[:, None], own[:, None], n)])
    everyone = np.arange(q)[:, None]
    dup = np.zeros(ids.shape, bool)
    dup[:, -1] = (ids[:, :-1] == ids[:, -1:]).any(1)
    ids[dup] = n
    padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])
    links = np.vstack([near, np.full((1, near.shape[1]), -1)])
    links = np.where(links < 0, n, links)

    def scored(ids: np.ndarray) -> np.ndarray:
        return np.where(ids == n, -np.inf, np.einsum("qkd,qd->qk", padded[ids], queries))

    seen[everyone, ids] = True
    score, opened = scored(ids), ids == n
    while True:
        best = np.argsort(-score, axis=1, kind="stable")[:, :size]
        ids, score, opened = (np.take_along_axis(x, best, 1) for x in (ids, score, opened))
        if opened.all():
            return np.where(ids == n, -1, ids)
        turn = np.argsort(opened, axis=1, kind="stable")[:, :OPEN]
        chosen = np.where(np.take_along_axis(opened, turn, 1), n, np.take_along_axis(ids, turn, 1))
        np.put_along_axis(opened, turn, True, 1)
        fresh = links[chosen].reshape(q, -1)
        fresh = np.sort(fresh, axis=1)
        again = np.zeros(fresh.shape, bool)
        again[:, 1:] = fresh[:, 1:] == fresh[:, :-1]
        fresh = np.where(again | seen[everyone, fresh], n, fresh)
        seen[everyone, fresh] = True
        width = max(1, int((fresh < n).sum(1).max()))
        fresh = np.sort(fresh, axis=1)[:, :width]
        ids, score, opened = np.hstack([ids, fresh]), np.hstack([score, scored(fresh)]), np.hstack([opened, fresh == n])


def _by_id(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, each once, and their vectors."""
    ids, vectors = rows.column("vec_id").to_numpy(), list_matrix(rows.column("embedding"), width)
    order = np.lexsort((*vectors.T[::-1], ids)) if len(ids) > 1 else np.arange(len(ids))
    order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]] if len(ids) else order
    return ids[order], vectors[order]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int32()))


def neighbour_graph(items: DataFrame, width: int, longest: float, degree: int = DEGREE, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """NN-descent within each shard of ``items`` (shard, vec_id, embedding): columns shard, node, near.

    ``node`` counts the ids of the shard in ascending order; ``near`` holds nodes, nearest first.
    """
    def begin(key: tuple, rows: pa.Table) -> pa.Table:
        _, vectors = _by_id(rows, width)
        vectors = level(vectors, longest)
        n = len(vectors)
        rng = np.random.default_rng(key[0].as_py())
        near = [nearest_of(vectors, i, rng.integers(0, n, degree), degree) for i in range(n)]
        return pa.table({"shard": pa.array([key[0].as_py()] * n, pa.int32()), "node": pa.array(np.arange(n), pa.int32()), "near": _lists(near)})

    def improve(key: tuple, candidates: pa.Table, rows: pa.Table) -> pa.Table:
        _, vectors = _by_id(rows, width)
        vectors = level(vectors, longest)
        nodes = candidates.column("node").to_numpy()
        near, changed = [], []
        for node, old, new in zip(nodes, candidates.column("near").combine_chunks(), candidates.column("found").combine_chunks()):
            old = old.values.to_numpy() if old.is_valid else np.zeros(0, np.int32)
            new = new.values.to_numpy() if new.is_valid else np.zeros(0, np.int32)
            near.append(nearest_of(vectors, node, np.concatenate([old, new]), degree))
            changed.append(len(np.setdiff1d(near[-1], old)))
        return pa.table({"shard": pa.array([key[0].as_py()] * len(nodes), pa.int32()), "node": pa.array(nodes, pa.int32()), "near": _lists(near), "changed": pa.array(changed, pa.int32())})

    shape = "shard int, node int, near array<int>"
    graph = materialize(items.groupBy("shard").applyInArrow(begin, shape), "graph")
    for k in range(rounds):
        # a deterministic sample of a list: its first members by a hash that changes with the round
        drawn = lambda c: F.transform(F.slice(F.array_sort(F.transform(c, lambda x: F.struct(F.xxhash64(F.lit(k), x).alias("h"), x.alias("x")))), 1, sample), lambda s: s["x"])  # noqa: E731,B023
        ahead = graph.select("shard", "node", F.explode(drawn(F.col("near"))).alias("other"))
        back = graph.select("shard", "node", F.explode("near").alias("other")).groupBy("shard", F.col("other").alias("node")).agg(drawn(F.collect_list("node")).alias("from_"))
        both = ahead.union(back.select("shard", "node", F.explode("from_")))
        lists = both.groupBy("shard", "node").agg(F.collect_set("other").alias("around"))
        two = both.join(lists.select("shard", F.col("node").alias("other"), "around"), ["shard", "other"])
        found = two.groupBy("shard", "node").agg(F.array_distinct(F.concat(F.collect_set("other"), F.flatten(F.collect_list("around")))).alias("found"))
        candidates = graph.select("shard", "node", "near").join(found, ["shard", "node"], "left")
        graph = materialize(candidates.groupBy("shard").cogroup(items.groupBy("shard")).applyInArrow(improve, shape + ", changed int"), "graph")
        entries, changes = graph.agg(F.sum(F.size("near")), F.sum("changed")).first()
        if not entries or changes < QUIET * entries:
            break
    return graph.select("shard", "node", "near")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD,
            block_rows: int = BLOCK, degree: int = DEGREE, pool: int = POOL) -> DataFrame:
    """The ``k`` rows found nearest to each query by inner product, the query's own row aside.

    Every row is indexed. Returns query_id, rank from 1, vec_id and score, the inner product in
    double precision; ties go to the smaller id, fewer rows than ``k`` if fewer are found. A row
    with a null id, or whose vector is null, zero or holds a null or non-finite component, takes
    no part; a shorter vector ends in zeros. Rows of one id count once (the smallest vector).
    Further columns are not read; an empty table gives an empty result.
    """
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).where(square > 0)
    n, asks, width, most = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1)), F.max(F.size("embedding")), F.max(square)).first()
    width, longest = max(1, width or 0), math.sqrt(most or 0.0)
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asks / block_rows))
    shard = F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64(F.lit(8), "vec_id"), F.lit(blocks)).cast("int")
    items = rows.select(shard.alias("shard"), "vec_id", "embedding")
    graph = neighbour_graph(items, width, longest, degree)
    # one side carries the graph and the vectors of a shard, told apart by what is null
    index = items.select("shard", "vec_id", "embedding", F.lit(None).cast("int").alias("node"), F.lit(None).cast("array<int>").alias("near")).union(
        graph.select("shard", F.lit(None).cast("long"), F.lit(None).cast(items.schema["embedding"].dataType), "node", "near"))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = rows.where("asks").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"))

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        is_node = np.asarray(left.column("node").is_valid())
        if len(is_node) and not is_node.all() and right.num_rows:
            ids, exact = _by_id(left.filter(pa.array(~is_node)).select(["vec_id", "embedding"]), width)
            nodes = left.filter(pa.array(is_node))
            near = np.full((len(ids), 2 * degree), -1)
            lists = {int(a): b.values.to_numpy() for a, b in zip(nodes.column("node").to_numpy(), nodes.column("near").combine_chunks())}
            back: list[list[int]] = [[] for _ in ids]
            for a, own in lists.items():
                near[a, :len(own)] = own
                for rank, b in enumerate(own):
                    back[b].append((rank, a))
            for b, own in enumerate(back):  # the nearest of those that point here, too
                pick = [a for _, a in sorted(own) if a not in lists.get(b, ())][:degree]
                near[b, degree:degree + len(pick)] = pick
            flat = level(exact, longest)
            query_ids, wanted = _by_id(right.select(["vec_id", "embedding"]), width)
            at = np.searchsorted(ids, query_ids)
            own = np.where(ids[np.minimum(at, len(ids) - 1)] == query_ids, at, -1)
            asked = np.hstack([wanted, np.zeros((len(wanted), 1))]).astype(np.float32)
            for a in range(0, len(query_ids), BATCH):
                found = search(flat, near, asked[a:a + BATCH], own[a:a + BATCH], pool)
                for i, rows_of in enumerate(found, a):
                    rows_of = rows_of[(rows_of >= 0) & (rows_of != own[i])]
                    scores = (exact[rows_of] * wanted[i]).sum(1)
                    best = np.lexsort((ids[rows_of], -scores))[:k]
                    out.append((np.full(len(best), query_ids[i]), ids[rows_of[best]], scores[best]))
        col = lambda c, t: np.concatenate([x[c] for x in out]).astype(t) if out else np.zeros(0, t)
        return pa.table({"query_id": col(0, np.int64), "vec_id": col(1, np.int64), "score": col(2, np.float64)})

    met = index.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(walk, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
