"""Contributions of trees against all subsets, and boosting against a plain loop."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewatch.operators import learn as M
from tidewatch.operators import trees as T
from tidewatch.operators.boosting import AdaBoost


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)) | (x[:, 2] > 1.2)
    flip = rng.random(400) < 0.08
    df = spark.createDataFrame([(i, *map(float, r), float(a != b)) for i, (r, a, b) in enumerate(zip(x, y, flip))], "id long, a double, b double, c double, d double, label double")
    return df.withColumn("features", array_to_vector(F.array("a", "b", "c", "d"))).repartition(3)


def expected(tree, x, known, node=0):
    """Value of a row when only the features in ``known`` are."""
    if tree.feature[node] < 0:
        return tree.value[node]
    left, right = int(tree.left[node]), int(tree.right[node])
    if tree.feature[node] in known:
        return expected(tree, x, known, left if tree.goes_left(node, x[None])[0] else right)
    return sum(tree.cover[c] / tree.cover[node] * expected(tree, x, known, c) for c in (left, right))


def by_subsets(trees, weights, x, width):
    out = np.zeros(width)
    for i in range(width):
        rest = [j for j in range(width) if j != i]
        for k in range(width):
            for chosen in itertools.combinations(rest, k):
                weight = math.factorial(k) * math.factorial(width - 1 - k) / math.factorial(width)
                out[i] += weight * sum(w * (expected(t, x, {*chosen, i}) - expected(t, x, set(chosen))) for t, w in zip(trees, weights))
    return out


@pytest.mark.parametrize("name, params", [("decision_tree", {"depth": 5}), ("random_forest", {"trees": 4, "depth": 4}), ("gradient_boosting", {"rounds": 4, "depth": 3}), ("ada_boost", {"rounds": 4, "depth": 2})])
def test_contributions_equal_all_subsets(spark, rows, name, params):
    fitted = M.make_model(name, **params).fit(rows)
    trees, weights = T.trees_of(fitted, spark)
    got = T.tree_contributions(fitted, M.score(fitted, rows), ["a", "b", "c", "d"], limit=2).orderBy("id").collect()
    assert len(got) == 400
    for r in got[:25]:
        x = np.array([r["a"], r["b"], r["c"], r["d"]])
        assert np.allclose(r["contributions"], by_subsets(trees, weights, x, 4), atol=1e-9)
    for r in got:
        score = r["margin"] if name in ("decision_tree", "random_forest") else 1 / (1 + math.exp(-(2 if name == "gradient_boosting" else 1) * r["margin"]))
        assert score == pytest.approx(r["score"], abs=1e-9) and r["margin"] == pytest.approx(r["base_value"] + sum(r["contributions"]))


def test_boosting_equals_a_plain_loop(spark, rows):
    fitted = AdaBoost(maxIter=7, stepSize=0.5).fit(rows)
    table = rows.orderBy("id").collect()
    x, y = np.array([r["features"].toArray() for r in table]), np.array([r["label"] for r in table])
    w, seen = np.ones(len(y)), []
    for tree, alpha in zip(fitted.trees, fitted.alphas):
        wrong = (tree.values(x) > 0) != (y == 1)
        error = w[wrong].sum() / w.sum()
        assert alpha == pytest.approx(0.5 * math.log((1 - error) / error), rel=1e-9)
        # no other stump on the same feature does better by the tree's own criterion than chance allows
        assert error < 0.5
        w[wrong] *= math.exp(alpha)
        seen.append(error)
    assert len(seen) == 7
    scored = M.score(fitted, rows).orderBy("id").collect()
    vote = sum(a * t.values(x) for t, a in zip(fitted.trees, fitted.alphas)) / sum(fitted.alphas)
    assert np.allclose([r["score"] for r in scored], 1 / (1 + np.exp(-vote)))
    one = M.evaluate(M.score(AdaBoost(maxIter=1).fit(rows), rows)).first()["accuracy"]
    assert M.evaluate(M.score(AdaBoost(maxIter=25, maxDepth=2).fit(rows), rows)).first()["accuracy"] > max(one, 0.8)


def test_boosting_ends_early(spark):
    clean = spark.createDataFrame([(float(i), float(i > 4)) for i in range(10)], "a double, label double").withColumn("features", array_to_vector(F.array("a")))
    fitted = AdaBoost(maxIter=9).fit(clean)
    assert fitted.alphas == [1.0] and M.score(fitted, clean).where("y_pred <> label").isEmpty()
    chance = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0)], "a double, label double").withColumn("features", array_to_vector(F.array("a")))
    assert AdaBoost(maxIter=3).fit(chance).alphas == [] and M.score(AdaBoost(maxIter=3).fit(chance), chance).count() == 2


def test_short_paths_are_looked_up_and_long_ones_agree(monkeypatch):
    """Rows are not sorted by what they meet of a short path: its patterns are listed once."""
    rng = np.random.default_rng(3)
    inner = np.arange(63)
    cover = np.r_[np.zeros(63), rng.integers(1, 9, 64)]
    for i in inner[::-1]:
        cover[i] = cover[2 * i + 1] + cover[2 * i + 2]
    feature, left = np.r_[rng.integers(0, 9, 63), np.full(64, -1)], np.r_[2 * inner + 1, np.full(64, -1)]
    tree = T.Tree(feature, np.zeros(127), [None] * 127, left, left + 1, rng.normal(size=127), cover)
    x = rng.normal(size=(500, 9))
    monkeypatch.setattr(T, "SHORT", 1)
    long = tree.contributions(x)
    assert np.allclose(long.sum(1), tree.values(x) - tree.mean())
    assert np.allclose(long[0], by_subsets([tree], [1.0], x[0], 9), atol=1e-9)
    monkeypatch.setattr(T, "SHORT", 8)
    monkeypatch.setattr(np, "unique", None)
    kept = {}
    assert np.allclose(tree.contributions(x[:200], kept), long[:200]) and len(kept) == 64
    assert np.allclose(tree.contributions(x, kept), long)
