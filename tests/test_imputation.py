"""Neighbour imputation against brute force, and how many lists its patterns visit."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import similarity as S


def plain_fills(rows, k):
    """By pattern and missing column the mean of the k nearest rows that have it."""
    width, out = len(rows[0]), {}
    name = lambda r: ",".join("_" if x is None else repr(float(x)) for x in r)
    for r in {name(x): x for x in rows}.values():
        for c in range(width):
            if r[c] is not None:
                continue
            givers = []
            for d in rows:
                both = [i for i in range(width) if r[i] is not None and d[i] is not None]
                if d[c] is not None and both:
                    givers.append((round(math.sqrt(width / len(both) * sum((r[i] - d[i]) ** 2 for i in both)), S.DIGITS), name(d), d[c]))
            if givers:
                best = sorted(givers)[:k]
                out[name(r), c] = sum(g[2] for g in best) / len(best)
    return out


def clustered(n, seed, width=5, holes=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-40, 40, (8, width))
    rows = [[float(x) for x in centres[i % 8] + rng.integers(-2, 3, width)] for i in range(n)]
    for r in rows:
        for c in range(width):
            if rng.random() < holes:
                r[c] = None
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("seed, k, list_rows", [(1, 3, 20), (2, 5, 7), (3, 1, 10_000)])
def test_fills_equal_brute_force(spark, seed, k, list_rows):
    rows = clustered(300, seed) + [(1.0, None, 2.0, None, 3.0)] * 40 + [(None,) * 5, (None, None, None, None, 1.0)] + [(1.0, 7.0, 2.0, 8.0, 3.0)] * 2
    columns = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    name = F.concat_ws(",", F.transform("cells", lambda x: F.coalesce(x.cast("string"), F.lit("_"))))
    got = {(r["p"], r["col"]): r["fill"] for r in S.pattern_fills(df, columns, k, list_rows).select(name.alias("p"), "col", "fill").collect()}
    want = plain_fills(rows, k)
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def test_patterns_visit_few_lists(spark):
    rows, columns, seen = clustered(3_000, 4, holes=0.05), [f"c{i}" for i in range(5)], {}
    S.pattern_fills(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)), columns, 3, 25, seen).count()
    assert 0 < seen["visits"] < 0.35 * seen["pairs"], seen


def test_empty_and_complete_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    assert S.pattern_fills(df, ["a", "b"]).count() == 0 and S.pattern_fills(df.limit(0), ["a", "b"]).count() == 0
    alone = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert sorted(map(tuple, S.knn_impute(alone, ["a", "b"]).collect()), key=str) == [(1.0, None), (1.0, None)]
