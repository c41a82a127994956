"""Fitted trees as arrays: scores of many rows at once and exact contributions of the features.

The contribution of a feature is its Shapley value when features that are left out are averaged over the
training rows that reach each split. A leaf is reached along a path of a few features; for a row, each of them is met by
the row or not, and each has a share of the training rows that meet it. The sum over all subsets of the other
path features is the integral of a polynomial, so no subset is listed. Rows that meet the same features
of a path share the sum, and it is computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import evals
from tidewatch.runtime import shared_dir


@dataclass
class Tree:
    """Nodes in any order, the root first; ``feature`` is -1 at a leaf. ``left`` rows have a value of at most ``cut``,
    or one of ``kinds`` where that is given."""

    feature: np.ndarray
    cut: np.ndarray
    kinds: list
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        column = x[:, self.feature[node]]
        return column <= self.cut[node] if self.kinds[node] is None else np.isin(column, self.kinds[node])

    def values(self, x: np.ndarray) -> np.ndarray:
        """Value of the leaf of every row."""
        out, todo = np.empty(len(x)), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
                continue
            here = self.goes_left(node, x[rows])
            todo += [(self.left[node], rows[here]), (self.right[node], rows[~here])]
        return out

    def mean(self) -> float:
        """Value of a leaf over the training rows."""
        leaf = self.feature < 0
        return float((self.value[leaf] * self.cover[leaf]).sum() / max(self.cover[0], 1e-300))

    def contributions(self, x: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Rows by features; a row's add up to its value less the mean.

        ``kept`` holds what leaves with short paths give for all patterns of met features, for further calls.
        """
        x, out = np.asfortranarray(x), np.zeros(x.shape[::-1])
        todo = [(0, {})]  # path: by feature, which rows meet its splits and the share of training rows that do
        while todo:
            node, path = todo.pop()
            if self.feature[node] < 0:
                if path:
                    self._add_leaf(out, node, path, {} if kept is None else kept)
                continue
            f, here = int(self.feature[node]), self.goes_left(node, x)
            for child, met in ((self.left[node], here), (self.right[node], ~here)):
                share = self.cover[child] / self.cover[node] if self.cover[node] else 0.0
                known, part = path.get(f, (True, 1.0))
                todo.append((child, {**path, f: (met & known, share * part)}))
        return out.T

    def _add_leaf(self, out: np.ndarray, node: int, path: dict, kept: dict) -> None:
        features, m = list(path), len(path)
        shares = np.array([path[f][1] for f in features])
        code = np.zeros(out.shape[1], np.uint16 if m <= SHORT else np.int64)  # the features that a row meets, one bit each
        for i, f in enumerate(features):
            code |= path[f][0].astype(code.dtype) << code.dtype.type(i)
        if m <= SHORT:
            if (sums := kept.get(node)) is None:
                sums = self.value[node] * pattern_sums(np.arange(1 << m), shares).T
                if len(kept) < KEPT:
                    kept[node] = sums
        else:
            seen, code = np.unique(code, return_inverse=True)
            sums = self.value[node] * pattern_sums(seen, shares).T
        for f, own in zip(features, sums):
            out[f] += own[code]


#: Features of a path up to which all their patterns are listed, and leaves of a tree whose lists stay in memory (16 KB each at most).
SHORT, KEPT = 8, 1_024


def pattern_sums(codes: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Patterns of met features (one bit each) by features: what each adds to the value of a leaf of value 1.

    A subset of k of the m - 1 other features weighs k! (m - 1 - k)! / m!, the integral of t^k (1 - t)^(m - 1 - k). So the sum over
    all subsets is the integral of a product with one factor a feature, a polynomial for which Gauss' rule is exact.
    """
    m = len(shares)
    at, weight = np.polynomial.legendre.leggauss((m + 1) // 2)
    t = (at + 1) / 2
    patterns = (codes[:, None] >> np.arange(m) & 1).astype(float)
    factors = shares[:, None, None] * (1 - t) + patterns.T[:, :, None] * t
    before, after = np.ones_like(factors), np.ones_like(factors)
    before[1:] = np.cumprod(factors[:-1], axis=0)
    after[:-1] = np.cumprod(factors[:0:-1], axis=0)[::-1]
    return (patterns - shares) * ((before * after) @ (weight / 2)).T


def tree_of_nodes(rows: list, regression: bool) -> Tree:
    """A tree from the saved nodes of a library model; class trees give the share of class 1."""
    by_id = sorted(rows, key=lambda r: r["id"])
    place = {r["id"]: i for i, r in enumerate(by_id)}
    stats = [np.array(r["impurityStats"], float) for r in by_id]
    kinds = [None if r["split"]["numCategories"] < 0 else list(r["split"]["leftCategoriesOrThreshold"]) for r in by_id]
    return Tree(
        np.array([r["split"]["featureIndex"] for r in by_id]),
        np.array([r["split"]["leftCategoriesOrThreshold"][0] if k is None and r["split"]["leftCategoriesOrThreshold"] else 0.0 for r, k in zip(by_id, kinds)]), kinds,
        np.array([place.get(r["leftChild"], -1) for r in by_id]), np.array([place.get(r["rightChild"], -1) for r in by_id]),
        np.array([r["prediction"] if regression else (s[1] / s.sum() if len(s) > 1 and s.sum() else 0.0) for r, s in zip(by_id, stats)]),
        np.array([s[0] if regression else s.sum() for s in stats]))


#: Nodes up to which a single tree is read node by node instead of from a saved model.
FEW_NODES = 63


def _nodes(node, out: list) -> int:
    """Saved form of a small tree's nodes, read from the model itself."""
    at = len(out)
    row = {"id": at, "prediction": node.prediction(), "impurityStats": list(node.impurityStats().stats()), "leftChild": -1, "rightChild": -1,
           "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
    out.append(row)
    if "InternalNode" in node.getClass().getName():
        split = node.split()
        categorical = "Categorical" in split.getClass().getName()
        row["split"] = {"featureIndex": split.featureIndex(), "numCategories": split.numCategories() if categorical else -1,
                        "leftCategoriesOrThreshold": list(split.leftCategories()) if categorical else [split.threshold()]}
        row["leftChild"], row["rightChild"] = _nodes(node.leftChild(), out), _nodes(node.rightChild(), out)
    return at


def trees_of(fitted: Model, spark) -> tuple[list[Tree], list[float]]:
    """The trees of a decision tree, random forest, gradient-boosted or boosted-stump model, and their weights.

    The weighted sum of the trees' values is the probability of class 1 for a tree and a forest, and the margin of a
    boosted model. Node arrays are as large as the model, which its number of trees and depth bound.
    """
    if hasattr(fitted, "trees_and_weights"):
        return fitted.trees_and_weights
    if not hasattr(fitted, "trees") and fitted.numNodes <= FEW_NODES:
        rows: list = []
        _nodes(fitted._java_obj.rootNode(), rows)
        return [tree_of_nodes(rows, False)], [1.0]
    path = shared_dir(spark, "trees")
    fitted.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "treeID" not in nodes.columns:
        return [tree_of_nodes(nodes.collect(), False)], [1.0]
    by_tree: dict[int, list] = {}
    for r in nodes.collect():
        by_tree.setdefault(r["treeID"], []).append(r["nodeData"])
    regression = "GBT" in type(fitted).__name__
    weights = [float(w) for w in fitted.treeWeights] if regression else [1.0 / len(by_tree)] * len(by_tree)
    return [tree_of_nodes(by_tree[k], regression) for k in sorted(by_tree)], weights


def tree_contributions(fitted: Model, df: DataFrame, names: list[str], limit: int = 10, column: str = "features") -> DataFrame:
    """Add ``contributions`` (one number a feature), ``base_value``, ``margin`` (their sum) and the ``limit`` features that
    contribute most by absolute value."""
    trees, weights = trees_of(fitted, df.sparkSession)
    base = float(sum(w * t.mean() for t, w in zip(trees, weights)))
    sent = df.sparkSession.sparkContext.broadcast((trees, weights))

    @F.pandas_udf("array<double>")
    def explained(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept: list[dict] = [{} for _ in sent.value[0]]
        for x in batches:
            m = np.array(x.tolist(), float).reshape(len(x), -1)
            total = np.zeros(m.shape)
            for tree, weight, held in zip(*sent.value, kept):
                total += weight * tree.contributions(m, held)
            yield pd.Series(total.tolist())

    rows = df.withColumn("contributions", explained(vector_to_array(column))).withColumn("base_value", F.lit(base))
    rows = rows.withColumn("margin", F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c))
    return evals.top_contributions(rows, names, "contributions", limit)
