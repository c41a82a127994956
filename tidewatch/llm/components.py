"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize

#: Edges that a task holds while it looks for those that close a circle.
HELD = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (a, b) but the smallest of each component, with that smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(ends[:len(a)].tolist(), ends[len(a):].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        parent[max(x, y)] = min(x, y)
    for x in range(len(parent)):  # a parent is never larger
        parent[x] = parent[parent[x]]
    roots = nodes[np.array(parent, np.int64)]
    return nodes[roots < nodes], roots[roots < nodes]


def thinned(pairs: DataFrame, held: int = HELD) -> DataFrame:
    """Fewer edges (a, b) with the components of ``pairs``.

    A dense group has far more edges than nodes, and what a round of stars joins grows with its edges. Tasks of up to
    ``held`` edges leave the stars of theirs; passes go on, in fewer tasks, as long as they halve the edges.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            kept.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= held:
                kept = [stars(*(np.concatenate(x) for x in zip(*kept)))]
                size = len(kept[0][0])
                if 2 * size > held:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept[0]], names=["a", "b"])
                    kept, size = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(x) for x in zip(*kept)))], names=["a", "b"])

    n = pairs.count()
    while n:
        pairs = materialize(pairs.coalesce(math.ceil(n / held)).mapInArrow(join, "a long, b long"), "edges")
        before, n = n, pairs.count()
        if 2 * n > before or before <= held:
            break
    return pairs


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (columns a, b); columns node, component.

    Every round hangs the larger neighbours of a node below the smallest one, then its smaller
    ones; the rounds, about the logarithm of the longest path, end when no edge changes. Dense
    groups are thinned first.
    Nodes without an edge are not listed. Nothing but the number of changes reaches the driver.
    """
    pairs = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    pairs = thinned(pairs)
    while True:
        both = pairs.union(pairs.select("b", "a")).toDF("node", "other")
        least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("root"))
        large = both.join(least, "node").where("other > node").select(F.col("other").alias("a"), F.col("root").alias("b"))
        down = large.where("a <> b").distinct()
        small = down.groupBy("a").agg(F.min("b").alias("root"))
        joined = down.join(small, "a")
        turned = materialize(joined.select("a", F.col("root").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("root").alias("b")))
                             .where("a <> b").distinct(), "edges")
        # a forest of stars stays as it is: compare the edges by number and by the sum of their hashes
        mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark(turned) == mark(pairs):
            return turned.select(F.col("a").alias("node"), F.col("b").alias("component")).union(turned.select("b", "b").distinct())
        pairs = turned
