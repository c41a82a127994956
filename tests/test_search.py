"""Model-based search: reproducible, inside its bounds, better than random draws on a fixed function."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewatch.operators.search import Parzen, Range, model_search, search

SPACE = {"rate": Range(1e-4, 1.0, log=True), "depth": Range(1, 12, whole=True), "kind": Range(choices=("a", "b", "c"))}


def surface(s):
    return -((math.log10(s["rate"]) + 2.2) ** 2) - 0.1 * (s["depth"] - 7) ** 2 - {"a": 1.0, "b": 0.0, "c": 2.0}[s["kind"]]


def test_search_is_reproducible_and_inside_its_bounds():
    one, two = (search(SPACE, lambda batch: [surface(s) for s in batch], 30, 4, seed=3) for _ in range(2))
    assert one == two and len(one) == 30 and one != search(SPACE, lambda batch: [surface(s) for s in batch], 30, 4, seed=4)
    for s, _ in one:
        assert 1e-4 <= s["rate"] <= 1.0 and 1 <= s["depth"] <= 12 and isinstance(s["depth"], int) and s["kind"] in "abc"


def test_search_beats_random_draws():
    gained = []
    for seed in range(12):
        found = max(x for _, x in search(SPACE, lambda batch: [surface(s) for s in batch], 40, 4, seed))
        rng = random.Random(1000 + seed)
        drawn = max(surface({n: r.draw(rng) for n, r in SPACE.items()}) for _ in range(40))
        gained.append(found - drawn)
    assert sum(gained) / len(gained) > 0 and sum(g > 0 for g in gained) >= 8, gained


def test_density_and_odd_results():
    p = Parzen(Range(0.0, 10.0), [2.0, 2.1, 8.0])
    assert p.log_density(2.05) > p.log_density(5.0) and all(0 <= p.draw(random.Random(i)) <= 10 for i in range(50))
    tried = search({"x": Range(0.0, 1.0)}, lambda batch: [math.nan for _ in batch], 14, 3, start=4)
    assert len(tried) == 14 and all(x == -math.inf for _, x in tried)
    assert len(search({"x": Range(1.0, 1.0)}, lambda batch: [0.0 for _ in batch], 13, 5, start=2)) == 13


def test_search_of_a_model(spark):
    rows = [(float(i % 17), float(i % 5), float((i % 17 > 8) != (i % 5 == 0))) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, label double").withColumn("features", array_to_vector(F.array("a", "b")))
    best, result, fitted = model_search(df, "decision_tree", {"maxDepth": Range(1, 6, whole=True)}, trials=6, batch=3, folds=2)
    assert 1 <= best["maxDepth"] <= 6 and result == pytest.approx(1.0, abs=0.15) and fitted.depth <= best["maxDepth"]
