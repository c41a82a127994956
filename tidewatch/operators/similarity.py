"""Exact nearest neighbours and what is built on them.

Items are put into the cell of their nearest pivot (sampled vectors, their number growing with
the root of the table up to a bound). With the radius of every cell known, the triangle
inequality tells which cells can hold one of the k nearest items of a query; the others are
never compared. Neighbouring cells are packed into chunks of items, and the queries of
neighbouring cells into blocks, both of bounded size; a cell larger than that is several. A
query is copied to the chunks it visits and an item to the blocks that visit its chunk, so a
row has as many copies as there are chunks or blocks, not cells. A (chunk, block) pair meets
inside one task tile by tile, each a matrix product of bounded size with the cells its queries
visit, and only the k best per query leave it. The result is exact; pruning only saves work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.runtime import materialize, spread

#: Fewest and most pivots; between them the square root of the number of items.
PIVOTS = (16, 1_024)
CHUNK_ROWS = 32_000
BLOCK_QUERIES = 32_000
#: Chunks and blocks that a table is cut into where they stay above the fewest rows of one.
SIDES, SIDE_ROWS = 8, 256
#: Numbers in the product of one tile.
TILE = 2_000_000
SLACK = 1e-3
DIGITS = 9


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64) if len(vectors) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _smallest(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k smallest entries per row; ties go to the smaller column."""
    n = values.shape[1]
    if n > k:
        cut = np.partition(values, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero(values <= cut)
    else:
        rows, cols = np.nonzero(np.isfinite(values))
    order = np.lexsort((cols, values[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = (place < k) & np.isfinite(values[rows, cols])
    return rows[keep], cols[keep]


def _smallest_rounded(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded value of the k smallest entries per row, ties of the rounded values to the smaller column."""
    near = np.isfinite(values)
    if values.shape[1] > k:
        # rounding moves two values by half a last digit each
        near &= values <= np.partition(values, k - 1, axis=1)[:, k - 1 : k] + 2 * 10.0 ** -DIGITS
    rows, cols = np.nonzero(near)
    value = np.round(values[rows, cols], DIGITS)
    order = np.lexsort((cols, value, rows))
    rows, cols, value = rows[order], cols[order], value[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep], value[keep]


def _chain(centers: np.ndarray) -> list[int]:
    """The pivots, each followed by the nearest one that is left."""
    left, chain = np.ones(len(centers), dtype=bool), [0]
    while len(chain) < len(centers):
        left[chain[-1]] = False
        far = ((centers - centers[chain[-1]]) ** 2).sum(1)
        chain.append(int(np.where(left, far, np.inf).argmin()) if np.isfinite(far[left]).any() else int(left.argmax()))
    return chain


def _packs(sizes: np.ndarray, chain: list[int], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First pack and number of packs of every cell: cells that follow each other share a pack of up to ``rows`` rows, a larger one has its own."""
    first, count = np.zeros(len(sizes), dtype=int), np.maximum(1, -(-sizes // rows))
    pack = held = 0
    for c in chain:
        if held and held + sizes[c] > rows:
            pack, held = pack + 1, 0
        first[c] = pack
        pack, held = (pack + count[c], 0) if count[c] > 1 else (pack, held + sizes[c])
    return first, count


def _pivots(items: DataFrame, count: int) -> np.ndarray:
    """A repeatable sample of ``count`` vectors."""
    rows = items.orderBy(F.xxhash64("id"), "id").limit(count).select("vec").collect()
    return np.array([r["vec"] for r in rows], dtype=np.float64)


def _into_cells(items: DataFrame, pivots: np.ndarray) -> DataFrame:
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _distances(_matrix(pdf["vec"]), pivots)
                cell = d.argmin(1)
                yield pdf.assign(cell=cell.astype("int32"), far=d[np.arange(len(d)), cell])

    schema = T.StructType([*items.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    return items.mapInPandas(place, schema)


def nearest(queries: DataFrame, items: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec",
            metric: str = "euclidean", skip_self: bool = False, pivots: int | None = None,
            chunk_rows: int = CHUNK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k nearest items of every query: query_id, item_id, rank, and the distance
    (``euclidean``) or the inner product of unit vectors (``inner``)."""
    q = queries.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    i = items.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    id_type = i.schema["id"].dataType
    centers = _pivots(i, pivots or min(PIVOTS[1], max(PIVOTS[0], math.isqrt(i.count()))))
    out_schema = T.StructType([T.StructField("query_id", q.schema["id"].dataType), T.StructField("item_id", id_type),
                               T.StructField("measure", T.DoubleType())])
    if not len(centers):
        return q.sparkSession.createDataFrame([], out_schema).withColumn("rank", F.lit(0))
    need = k + 1 if skip_self else k
    celled = _into_cells(i, centers)
    # one row per cell reaches the driver: size, radius, and a bound on the k-th smallest
    # pivot distance (the k-th of the minima of disjoint shares is never below it)
    shares = celled.groupBy("cell", F.pmod(F.xxhash64("id"), F.lit(8 * need)).alias("share")).agg(
        F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.min("far").alias("close"))
    cells = shares.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"),
                                       F.get(F.sort_array(F.collect_list("close")), F.lit(need - 1)).alias("close")).collect()
    radius, close, held = np.full(len(centers), -np.inf), np.full(len(centers), np.inf), np.zeros(len(centers), dtype=int)
    for c in cells:
        radius[c["cell"]] = c["radius"]
        close[c["cell"]] = c["close"] if c["close"] is not None else np.inf
        held[c["cell"]] = c["n"]
    filled = np.flatnonzero(np.isfinite(radius))
    asking = _into_cells(q, centers).withColumnRenamed("cell", "home")
    asks = np.zeros(len(centers), dtype=int)  # one number per pivot
    for r in asking.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect():
        asks[r["home"]] = r["n"]
    chain = _chain(centers)

    def side(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        return _packs(sizes, chain, min(most, max(SIDE_ROWS, -(-int(sizes.sum()) // SIDES))))

    (chunk_of, chunks), (block_of, blocks) = side(held, chunk_rows), side(asks, block_queries)
    all_chunks = int((chunk_of + chunks).max())

    def pack(first: np.ndarray, count: np.ndarray, cell: str) -> Column:
        def of(numbers: np.ndarray) -> Column:
            return F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), F.col(cell) + 1)

        return (of(first) + F.pmod(F.xxhash64("id"), of(count))).cast("int")

    chunked = celled.select("id", "vec", "cell", pack(chunk_of, chunks, "cell").alias("chunk"))

    def visited_cells(x: np.ndarray) -> np.ndarray:
        """Which of the filled cells can hold one of the nearest items of each vector."""
        d = _distances(x, centers)
        bound = (d + close[None, :]).min(1)
        return d[:, filled] - radius[filled][None, :] <= bound[:, None] + SLACK

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1_000):
                part = pdf.iloc[at:at + 1_000]
                seen = visited_cells(_matrix(part["vec"]))
                goes = np.zeros((len(part), all_chunks), dtype=bool)
                for place, c in enumerate(filled):
                    goes[:, chunk_of[c]:chunk_of[c] + chunks[c]] |= seen[:, place, None]
                rows, chunk = np.nonzero(goes)
                for cut in range(0, len(rows), 10_000):
                    yield part.iloc[rows[cut:cut + 10_000]].assign(chunk=chunk[cut:cut + 10_000].astype("int32"))

    visit_schema = T.StructType([*q.schema.fields, T.StructField("block", T.IntegerType()), T.StructField("chunk", T.IntegerType())])
    visits = asking.select(*q.columns, pack(block_of, blocks, "home").alias("block")).mapInPandas(visit, visit_schema)
    visited = visits.select(F.col("chunk").alias("_chunk"), F.col("block").alias("_block")).distinct()
    copied = chunked.join(visited, F.col("chunk") == F.col("_chunk")).select("id", "vec", "cell", "chunk", F.col("_block").alias("block"))
    place_of = np.zeros(len(centers), dtype=int)
    place_of[filled] = np.arange(len(filled))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "item_id": [], "measure": []})
        if not len(left) or not len(right):
            return empty
        right = right.sort_values("id")
        a, b = _matrix(left["vec"]), _matrix(right["vec"])
        # queries that visit the same cells share a tile
        home = np.concatenate([_distances(a[at:at + 1_000], centers).argmin(1) for at in range(0, len(a), 1_000)])
        order = np.argsort(home, kind="stable")
        a, qid, iid = a[order], left["id"].to_numpy()[order], right["id"].to_numpy()
        place = place_of[right["cell"].to_numpy()]
        names = pd.factorize(np.concatenate([qid, iid]))[0] if skip_self else None
        step, parts = max(1, TILE // len(b)), []
        for at in range(0, len(a), step):
            x = a[at:at + step]
            cols = np.flatnonzero(visited_cells(x).any(0)[place])
            if not len(cols):
                continue
            y = b if len(cols) == len(b) else b[cols]
            score = -(x @ y.T) if metric == "inner" else _distances(x, y)
            if skip_self:
                score[names[at:at + len(x), None] == names[len(qid):][cols][None, :]] = np.inf
            r, c, value = _smallest_rounded(score, k)
            parts.append(pd.DataFrame({"query_id": qid[at + r], "item_id": iid[cols[c]], "measure": -value if metric == "inner" else value}))
        return pd.concat(parts) if parts else empty

    group = ["chunk", "block"]
    found = visits.groupBy(*group).cogroup(copied.groupBy(*group)).applyInPandas(meet, out_schema)
    best = F.desc("measure") if metric == "inner" else F.asc("measure")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(best, "item_id")))
    return ranked.where(F.col("rank") <= k)


def lookalikes(matched: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Verdict from the best match: similar to a known site without being on its domain.

    ``matched`` holds ``similarity``, ``site`` and ``is_official`` of the best match.
    """
    official_flags = F.col("is_official")
    similar = F.col("similarity") >= threshold
    reason = (
        F.when(similar & official_flags, "similar, official domain").when(similar, "similar, foreign domain")
        .otherwise("no similar site"))
    return matched.withColumns({
        "is_phishing": similar & ~official_flags, "domain_mismatch": similar & ~official_flags,
        "confidence": F.when(similar & ~official_flags, F.col("similarity")).otherwise(0.0), "reason": reason})


def knn_classify(queries: DataFrame, items: DataFrame, label: str, k: int = 5, id_col: str = "id", vec_col: str = "vec",
                 skip_self: bool = False) -> DataFrame:
    """Most frequent label of the k nearest items (the smallest label on ties)."""
    near = nearest(queries, items, k, id_col, vec_col, skip_self=skip_self)
    labels = items.select(F.col(id_col).alias("item_id"), F.col(label).alias("label"))
    votes = near.join(labels, "item_id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("predicted"))


def local_outlier_factor(points: DataFrame, k: int = 20, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Local outlier factor: mean density of the neighbours over the own density."""
    near = nearest(points, points, k, id_col, vec_col, skip_self=True)
    reach_of = near.groupBy("query_id").agg(F.max("measure").alias("k_distance"))
    reached = near.join(reach_of.withColumnRenamed("query_id", "item_id"), "item_id").withColumn(
        "reach", F.greatest("measure", "k_distance"))
    density = reached.groupBy("query_id").agg((1.0 / (F.avg("reach") + 1e-10)).alias("density"))
    around = near.join(density.select(F.col("query_id").alias("item_id"), F.col("density").alias("_other")), "item_id")
    return around.groupBy("query_id").agg(F.avg("_other").alias("_around")).join(density, "query_id").select(
        F.col("query_id").alias("id"), (F.col("_around") / F.col("density")).alias("lof"))


# --- imputation from the nearest rows ---------------------------------------------------------


def _cells(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


#: Patterns of a list, most lists (their bounds are broadcast), and askers of a list that one task handles.
LIST_ROWS, LISTS, ASKERS = 2_000, 16_384, 4_000


class ListBounds:
    """What is known of every list of patterns: which columns some and all of its rows have, between which values, and how many rows have them."""

    def __init__(self, rows: list, width: int):
        self.lists = np.array([r["list"] for r in rows], np.int64)
        self.low, self.high = (np.array([[np.nan if x is None else x for x in r[n]] for r in rows], float).reshape(len(rows), width) for n in ("low", "high"))
        self.have = np.array([r["have"] for r in rows], float).reshape(len(rows), width)
        size = np.array([r["n"] for r in rows], float)[:, None]
        self.some, self.all, self.width = self.have > 0, self.have == size, width
        self.low, self.high = (np.where(self.all, x, y) for x, y in ((self.low, -np.inf), (self.high, np.inf)))

    def least(self, asking: np.ndarray) -> np.ndarray:
        """For each pattern and list a lower bound of the distance to any row of the list; infinite where they share no column.

        Columns that all rows of the list have add at least the gap to its values; the sum is scaled by the most columns
        that can be shared, which makes it least.
        """
        present = ~np.isnan(asking)
        x = np.nan_to_num(asking)
        square = np.zeros((len(asking), len(self.lists)))
        for c in range(self.width):
            gap = np.maximum(np.maximum(self.low[None, :, c] - x[:, c, None], x[:, c, None] - self.high[None, :, c]), 0.0)
            square += np.where(present[:, c, None], gap * gap, 0.0)
        shared = present.astype(float) @ self.some.T
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(shared > 0, np.sqrt(square * self.width / shared), np.inf)

    def sure(self, asking: np.ndarray) -> np.ndarray:
        """Whether every row of the list shares a column with the pattern, so that each has a distance."""
        return (~np.isnan(asking)).astype(float) @ self.all.T > 0


def listed_patterns(df: DataFrame, columns: list[str], list_rows: int = LIST_ROWS) -> tuple[DataFrame, ListBounds]:
    """Distinct row patterns with their counts, in lists of neighbours by mask and by values, and the bounds of the lists."""
    width = len(columns)
    patterns = materialize(
        df.select(_cells(columns).alias("cells")).groupBy("cells").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("pattern", F.concat_ws(",", F.transform("cells", lambda x: F.coalesce(x.cast("string"), F.lit("_")))))
        .withColumn("mask", F.concat_ws("", F.transform("cells", lambda x: F.when(x.isNull(), "1").otherwise("0")))), "patterns")
    cell = lambda i: F.get("cells", F.lit(i))
    spread_of = patterns.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(cell(i)).alias(f"v{i}") for i in range(width)]).first()
    wide = sorted(range(width), key=lambda i: -(spread_of[f"v{i}"] or 0.0))
    lists = min(LISTS, max(1, -(-spread_of["n"] // list_rows)))
    listed = materialize(patterns.repartitionByRange(lists, "mask", *[cell(i) for i in wide], "pattern").withColumn("list", F.spark_partition_id()), "lists")
    bounds = listed.groupBy("list").agg(
        F.sum("n").alias("n"), F.array(*[F.min(cell(i)) for i in range(width)]).alias("low"), F.array(*[F.max(cell(i)) for i in range(width)]).alias("high"),
        F.array(*[F.coalesce(F.sum(F.when(cell(i).isNotNull(), F.col("n"))), F.lit(0)) for i in range(width)]).alias("have")).orderBy("list").collect()  # at most LISTS
    return listed, ListBounds(bounds, width)


def _visits(asking: DataFrame, bounds: ListBounds, k: int) -> DataFrame:
    """The lists that a pattern must visit, before (``limit`` is null: the nearest ones that surely hold ``k`` givers of each
    missing column) or after the distances of its ``k``-th givers are known (``limit`` by column: all lists that may hold a nearer one)."""
    sent = asking.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = sent.value
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                x = _matrix(part["cells"])
                least, sure = b.least(x), b.sure(x)
                out = []
                for i, (limit, done) in enumerate(zip(part["limit"], part["visited"])):
                    if limit is None:
                        order, chosen = np.argsort(least[i], kind="stable"), set()
                        for c in np.flatnonzero(np.isnan(x[i])):
                            found = 0
                            for j in order:
                                if found >= k or not np.isfinite(least[i, j]):
                                    break
                                if b.some[j, c]:
                                    chosen.add(j)
                                    found += b.have[j, c] if sure[i, j] else 0
                        out.append(b.lists[sorted(chosen)])
                    else:
                        far = np.array([np.inf if v is None or np.isnan(v) else v for v in limit])
                        wanted = (b.some & np.isnan(x[i])) & (least[i][:, None] <= far * (1 + 1e-9) + 2 * 10.0 ** -DIGITS) & np.isfinite(least[i])[:, None]
                        out.append(np.setdiff1d(b.lists[wanted.any(axis=1)], done))
                yield pd.DataFrame({"cells": part["cells"], "pattern": part["pattern"], "list": [o.tolist() for o in out]})

    return asking.mapInPandas(run, "cells array<double>, pattern string, list array<int>")


def _met(visits: DataFrame, listed: DataFrame, width: int, k: int) -> DataFrame:
    """The ``k`` nearest givers in every visited list, by pattern and missing column. A list goes to the blocks of its askers only."""
    each = visits.select("cells", "pattern", F.explode("list").alias("list"))
    sizes = each.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("blocks"))  # at most LISTS rows
    asking = each.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("pattern"), "blocks").cast("int")).drop("blocks")
    copies = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    giving = listed.join(F.broadcast(sizes), "list").select("cells", "pattern", "n", "list", copies.alias("block"))
    names = ["cells", "pattern", "col", "dist", "donor", "value", "n"]

    def meet(ask: pd.DataFrame, give: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(give):
            return pd.DataFrame({n: [] for n in names})
        give = give.sort_values("pattern")
        a, b = _matrix(ask["cells"]), _matrix(give["cells"])
        ma, mb = ~np.isnan(a), ~np.isnan(b)
        za, zb = np.nan_to_num(a), np.nan_to_num(b)
        fa, fb = ma.astype(float), mb.astype(float)
        square = (za * za) @ fb.T + fa @ (zb * zb).T - 2.0 * (za @ zb.T)
        both = fa @ fb.T
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = np.where(both > 0, np.round(np.sqrt(np.maximum(square, 0.0) * width / both), DIGITS), np.inf)
        parts = []
        who, cells, donor = ask["pattern"].to_numpy(), ask["cells"].to_numpy(), give["pattern"].to_numpy()
        count = give["n"].to_numpy()
        for c in range(width):
            rows, cols = np.flatnonzero(~ma[:, c]), np.flatnonzero(mb[:, c])
            if not len(rows) or not len(cols):
                continue
            r, j = _smallest(dist[np.ix_(rows, cols)], k)
            parts.append(pd.DataFrame({
                "cells": cells[rows[r]], "pattern": who[rows[r]], "col": c, "dist": dist[rows[r], cols[j]], "donor": donor[cols[j]],
                "value": b[cols[j], c], "n": count[cols[j]]}))
        return pd.concat(parts) if parts else pd.DataFrame({n: [] for n in names})

    schema = "cells array<double>, pattern string, col int, dist double, donor string, value double, n bigint"
    return asking.select("cells", "pattern", F.col("list").alias("of"), F.col("block").alias("part")).groupBy("of", "part").cogroup(giving.groupBy("list", "block")).applyInPandas(meet, schema)


def pattern_fills(df: DataFrame, columns: list[str], k: int = 5, list_rows: int = LIST_ROWS, report: dict | None = None) -> DataFrame:
    """Fill value per (distinct row pattern, missing column): the mean over the k nearest
    rows that have the column, by the distance over the columns both rows have.

    Copies of a row count as often as they occur but are compared once. Patterns lie in lists of neighbours by mask and value. A
    pattern first visits the lists of least lower bound that surely hold k givers; their distances limit the
    lists it visits then, so lists that cannot hold a nearer giver are never copied to it. ``report`` gets the
    number of visits and of all pairs of a pattern and a list.
    """
    width = len(columns)
    listed, bounds = listed_patterns(df, columns, list_rows)
    asking = listed.where(F.exists("cells", lambda x: x.isNull())).select("cells", "pattern")
    none = asking.withColumn("limit", F.lit(None).cast("array<double>")).withColumn("visited", F.array().cast("array<int>"))
    first = materialize(_visits(none, bounds, k), "first-visits")
    order = Window.partitionBy("pattern", "col").orderBy("dist", "donor").rowsBetween(Window.unboundedPreceding, 0)
    near = materialize(_met(first, listed, width, k), "first-givers")
    enough = near.withColumn("so_far", F.sum("n").over(order)).where(F.col("so_far") >= k).groupBy("pattern", "col").agg(F.min("dist").alias("dist"))
    limits = enough.groupBy("pattern").agg(F.map_from_entries(F.collect_list(F.struct("col", "dist"))).alias("m"))  # at most one entry a column
    limit = F.array(*[F.try_element_at("m", F.lit(i)) for i in range(width)])
    second = materialize(_visits(first.join(limits, "pattern", "left").select("cells", "pattern", limit.alias("limit"), F.col("list").alias("visited")), bounds, k), "more-visits")
    if report is not None:
        report["visits"] = first.union(second).agg(F.sum(F.size("list"))).first()[0] or 0
        report["pairs"] = asking.count() * len(bounds.lists)
    found = near.unionByName(_met(second, listed, width, k))
    before = Window.partitionBy("pattern", "col").orderBy("dist", "donor").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.least(F.col("n"), F.lit(k) - F.coalesce(F.sum("n").over(before), F.lit(0)))
    weighted = found.withColumn("w", taken).where("w > 0")
    return weighted.groupBy("cells", "col").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("fill"))


def knn_impute(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Fill nulls from the k nearest rows; a column nobody can give falls back to its mean."""
    df = spread(df)
    fills = pattern_fills(df, columns, k).groupBy("cells").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "fill"))).alias("_fills"))
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    joined = df.withColumn("cells", _cells(columns)).join(fills, "cells", "left")
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.try_element_at("_fills", F.lit(i)), F.lit(means[c]).cast("double"))
        for i, c in enumerate(columns)}
    return joined.withColumns(filled).select(*df.columns)
