"""Hard negatives of anchors: rows of another label whose score lies in a window below a positive's.

The vectors are cut into shards by label, then by the coordinate of largest spread: the first two
slabs of a sort-tile-recursive packing. A shard is packed on by further coordinates into
leaves and these into the nodes of an R-tree. The box of a node gives, coordinate by coordinate,
the interval of what a product with an anchor can be; their sum bounds every inner product in the
node. A queue opens the nodes by their upper bound. Nodes whose interval lies outside all score windows
of the anchor, or strictly below the k-th score found, are left out; so are shards, by their own box.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import list_matrix, materialize, small_batches
from tidewatch.llm.topk import finite

#: Rows of a shard: ``ROOT`` times the root of the table's rows, between the first two bounds (every anchor may go to
#: every shard, so more shards mean more copies). Most shards, whose boxes are broadcast; beyond them shards grow.
LEAST_SHARD, MOST_SHARD, ROOT, SHARDS = 2_048, 131_072, 32, 8_192
#: Anchors of a block: bounds the memory of a task.
BLOCK = 4_096
#: Rows of a leaf and children of a node.
LEAF, FAN = 256, 16


def bounds(low: np.ndarray, high: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of ``query`` with any vector of each box."""
    up, down = np.maximum(query, 0), np.minimum(query, 0)
    return low @ up + high @ down, high @ up + low @ down


def tiled(vectors: np.ndarray, rows: np.ndarray, axes: list[int], leaf: int) -> list[np.ndarray]:
    """Sort-tile-recursive order of ``rows``: slabs by the first axis, each tiled by the next ones."""
    if len(rows) <= leaf:
        return [rows]
    rows = rows[np.argsort(vectors[rows, axes[0]], kind="stable")]
    if len(axes) == 1:
        return np.array_split(rows, math.ceil(len(rows) / leaf))
    slabs = math.ceil(math.ceil(len(rows) / leaf) ** (1 / len(axes)))
    return [t for slab in np.array_split(rows, slabs) for t in tiled(vectors, slab, axes[1:], leaf)]


class RTree:
    """Packed tree over the rows of a shard; labels are packed first, so that most leaves hold one label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fan: int = FAN, axes: int = 4):
        spread = np.argsort(-vectors.var(axis=0), kind="stable")[:axes].tolist() if len(ids) else [0]
        leaves = [t for label in np.unique(labels) for t in tiled(vectors, np.flatnonzero(labels == label), spread, leaf)]
        order = np.concatenate(leaves)  # rows of a leaf lie side by side
        self.ids, self.labels, self.vectors, self.fan = ids[order], labels[order], vectors[order], fan
        stop = np.cumsum([len(t) for t in leaves])
        self.leaves = [slice(a, b) for a, b in zip([0, *stop[:-1].tolist()], stop.tolist())]
        self.levels = [tuple(f.reduceat(x, [t.start for t in self.leaves]) for f, x in ((np.minimum, self.vectors), (np.maximum, self.vectors),
                                                                                       (np.minimum, self.labels), (np.maximum, self.labels)))]
        while len(self.levels[-1][0]) > 1:
            cut = np.arange(0, len(self.levels[-1][0]), fan)
            low, high, least, most = self.levels[-1]
            self.levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)))

    def search(self, query: np.ndarray, useful: Callable, take: Callable) -> int:
        """Open nodes by their upper bound; returns the number of rows scored.

        ``useful(low, high, least label, most label)`` says which intervals still matter, and is asked when
        nodes enter the queue and again when one leaves it. ``take(rows, scores)`` gets the rows of a leaf.
        """
        queue: list[tuple] = []

        def enter(level: int, first: int, last: int) -> None:
            low, high, least, most = (x[first:last] for x in self.levels[level])
            under, over = bounds(low, high, query)
            for k in np.flatnonzero(useful(under, over, least, most)):
                heapq.heappush(queue, (-over[k], level, first + int(k), under[k], least[k], most[k]))

        scored, top = 0, len(self.levels) - 1
        enter(top, 0, len(self.levels[top][0]))
        while queue:
            over, level, node, under, least, most = heapq.heappop(queue)
            if not useful(under, -over, least, most):
                continue
            if level:
                enter(level - 1, node * self.fan, (node + 1) * self.fan)
            else:
                rows = self.leaves[node]
                scored += rows.stop - rows.start
                take(rows, self.vectors[rows] @ query)
        return scored


class Best:
    """The ``k`` largest scores met so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]

    @property
    def least(self) -> float:
        """What a score must reach to matter."""
        return self.scores[-1] if len(self.scores) == self.k else -np.inf


def positives_of(tree: RTree, anchor: int, label: int, query: np.ndarray, k: int) -> Best:
    best = Best(k)

    def take(rows: slice, scores: np.ndarray) -> None:
        fits = (tree.labels[rows] == label) & (tree.ids[rows] != anchor) & (scores >= best.least)
        if fits.any():
            best.add(scores[fits], tree.ids[rows][fits])

    tree.search(query, lambda under, over, least, most: (least <= label) & (most >= label) & (over >= best.least), take)
    return best


def negatives_of(tree: RTree, label: int, query: np.ndarray, scores: np.ndarray, k: int, window: tuple[int, int]) -> list[Best]:
    """For every positive score the best rows of another label in its window."""
    found = [Best(k) for _ in scores]
    # in hundredths of a score: what a row must reach now, and what it must not exceed, for each positive
    low, high = window[0] * scores, window[1] * scores
    alive = high >= low
    least = np.where(alive, low, np.inf)
    ends = high

    def useful(under, over, least_label, most_label):
        other = (least_label != label) | (most_label != label)
        if np.ndim(over) == 0:
            return bool(other) and any(100 * over >= a and 100 * under <= b for a, b in zip(least.tolist(), ends.tolist()))
        return other & ((100 * over >= least[:, None]) & (100 * under <= ends[:, None])).any(axis=0)

    def take(rows: slice, products: np.ndarray) -> None:
        fits = (100 * products >= least.min()) & (100 * products <= ends.max()) & (tree.labels[rows] != label)
        if not fits.any():
            return
        products, ids = products[fits], tree.ids[rows][fits]
        for p, best in enumerate(found):
            own = (100 * products >= least[p]) & (100 * products <= ends[p])
            if own.any():
                best.add(products[own], ids[own])
                least[p] = max(least[p], 100 * best.least)

    if not len(scores):
        return found
    tree.search(query, useful, take)
    return found


def _matrix(rows: pa.Table | pa.RecordBatch, column: str, width: int, scale: float) -> np.ndarray:
    out = np.floor(scale * list_matrix(rows.column(column), width))
    if out.size and float(np.abs(out).max()) ** 2 * width * 100 >= 2.0 ** 53:
        return np.array([[int(x) for x in row] for row in out], object)  # beyond the exact range: integers of any size
    return out


def _widest(rows: DataFrame) -> tuple[int, int]:
    """Length of the longest vector and the coordinate of largest variance."""
    at = rows.select(F.posexplode("embedding").alias("at", "x")).groupBy("at").agg(F.var_pop(F.col("x").cast("double")).alias("v")).orderBy(F.col("v").desc(), "at").first()
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    return max(1, width), at["at"] if at else 0


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
                   scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None, block_rows: int = BLOCK) -> DataFrame:
    """For each anchor and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of another
    label whose score is between ``window`` percent of the positive's.

    Components count as floor(scale * component), scores are integer inner products with the anchor; ties go to
    the smaller id. Returns anchor_id, positive_id, rank from 1, negative_id, positive_score and negative_score;
    a positive without such rows gives none. Rows whose id, label or vector is null, or whose vector
    holds a null or non-finite component, take no part; a shorter vector ends in zeros. Rows of one id count once (the
    smallest label and vector). A score beyond 64 bits raises an error. Further columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
                          F.col(vector_col).alias("embedding"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding", "asks")).alias("r")).select("vec_id", "r.*")
    n, asks = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    width, axis = _widest(rows)
    shards, blocks = min(SHARDS, max(1, math.ceil(n / (shard_rows or min(MOST_SHARD, max(LEAST_SHARD, int(ROOT * math.sqrt(n)))))))), max(1, math.ceil(asks / block_rows))
    slab = F.coalesce(F.get("embedding", F.lit(axis)), F.lit(0.0))
    placed = materialize(rows.repartitionByRange(shards, "label", slab, "vec_id").withColumn("shard", F.spark_partition_id()), "slabs")
    items = placed.select("vec_id", "label", "embedding", "shard")

    def box(rows: pa.Table) -> pa.Table:
        x, labels = _matrix(rows, "embedding", width, scale).astype(np.float64), rows.column("label").to_numpy()
        numbers = np.concatenate([x.min(axis=0), x.max(axis=0)])
        return pa.table({"shard": rows.column("shard")[:1], "least": [labels.min()], "most": [labels.max()], "box": [numbers.tolist()]})

    boxes = items.groupBy("shard").applyInArrow(box, "shard int, least long, most long, box array<double>").orderBy("shard").collect()  # at most SHARDS
    table = spark.sparkContext.broadcast((np.array([b["shard"] for b in boxes], np.int32), np.array([b["least"] for b in boxes]), np.array([b["most"] for b in boxes]),
                                          np.array([b["box"] for b in boxes]).reshape(len(boxes), 2 * width)))

    def visits(scored: bool):
        """Shards that an anchor must visit: those with its label, or those whose box meets one of its windows."""
        def run(batches):
            shard, least, most, box = table.value
            for batch in batches:
                out, queries = [], _matrix(batch, "embedding", width, scale).astype(np.float64)
                labels = batch.column("label").to_numpy()
                for k, (query, own) in enumerate(zip(queries, labels)):
                    if not scored:
                        fits = (least <= own) & (most >= own)
                    else:
                        scores = np.array(batch.column("scores")[k].as_py(), float)[:, None]
                        under, over = bounds(box[:, :width], box[:, width:], query)
                        fits = ((100 * over >= window[0] * scores) & (100 * under <= window[1] * scores)).any(axis=0) & ((least != own) | (most != own))
                    out.append(shard[fits])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "shards"])
        return run

    def met(anchors: DataFrame, scored: bool, search, schema: str) -> DataFrame:
        """Search the shards for their anchors, a block of anchors at a time; each shard goes to every block."""
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema) + ", shards array<int>"
        asked = small_batches(anchors).mapInArrow(visits(scored), types).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        asked = asked.withColumn("shard", F.explode("shards")).drop("shards")
        copied = items.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        names = [f.split()[0] for f in schema.split(", ")]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if left.num_rows and right.num_rows:
                tree = RTree(left.column("vec_id").to_numpy(), left.column("label").to_numpy(), _matrix(left, "embedding", width, scale))
                queries, rows = _matrix(right, "embedding", width, scale), right.drop_columns(["embedding"]).to_pylist()
                for query, row in zip(queries, rows):
                    out += search(tree, query, row)
            columns = list(zip(*out)) if out else [()] * len(names)
            return pa.table({name: pa.array([int(x) for x in c], pa.int64()) for name, c in zip(names, columns)})

        return copied.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(run, schema)

    def first(tree: RTree, query: np.ndarray, row: dict) -> list[tuple]:
        best = positives_of(tree, row["vec_id"], row["label"], query, positives)
        return [(row["vec_id"], i, s) for i, s in zip(best.ids, best.scores)]

    def second(tree: RTree, query: np.ndarray, row: dict) -> list[tuple]:
        scores = np.array(row["scores"], query.dtype)
        found = negatives_of(tree, row["label"], query, scores, negatives, window)
        return [(row["vec_id"], p, i, ps, s) for p, ps, best in zip(row["ids"], row["scores"], found) for i, s in zip(best.ids, best.scores)]

    anchors = placed.where("asks").select("vec_id", "label", "embedding")
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    near = met(anchors, False, first, "anchor_id long, positive_id long, positive_score long")
    near = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= positives)
    chosen = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("p"))  # at most ``positives`` each
    chosen = chosen.select(F.col("anchor_id").alias("vec_id"), F.col("p.positive_id").alias("ids"), F.col("p.positive_score").alias("scores"))
    asking = materialize(anchors.join(chosen, "vec_id"), "positives")
    hard = met(asking, True, second, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return hard.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


HARD_NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""
