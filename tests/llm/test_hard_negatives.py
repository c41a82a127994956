"""Hard negatives against brute force, and the pruning of the tree."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import hard_negatives as hn

SHAPE = "vec_id long, embedding array<float>, label int, shard int, r string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], None if y is None else int(y), 1, "x") for i, v, y in rows], SHAPE)


def brute(rows, anchors, k=5, m=3):
    whole = {i: ([int(np.floor(256 * float(np.float32(x)))) for x in v], y) for i, v, y in rows}
    out = set()
    for a in whole:
        if not anchors(a):
            continue
        q, own = whole[a]
        score = {i: sum(x * y for x, y in zip(q, v)) for i, (v, _) in whole.items() if i != a}
        same = sorted((i for i in score if whole[i][1] == own), key=lambda i: (-score[i], i))[:k]
        for p in same:
            fits = sorted((i for i in score if whole[i][1] != own and 50 * score[p] <= 100 * score[i] <= 95 * score[p]), key=lambda i: (-score[i], i))[:m]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fits)}
    return out


@pytest.mark.parametrize("shard_rows, block_rows", [(60, 7), (10_000, 10_000)])
def test_hard_negatives_equal_brute_force(spark, shard_rows, block_rows):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 6))
    good = [(i, centres[i % 4] + 0.8 * rng.normal(size=6), (i % 4 + (i % 11 == 0)) % 4) for i in range(240)]
    good += [(1000 + i, centres[0], 0) for i in range(60)] + [(2000 + i, 0.7 * centres[0], 1) for i in range(30)]  # ties
    good += [(3000, np.zeros(6), 2), (3001, [1.0, 2.0], 3), (-10, centres[1], 9)]
    bad = [(4000, None, 1), (4010, [1, None, 0, 0, 0, 0], 1), (4020, [float("nan")] * 6, 1), (4030, [float("inf")] * 6, 1), (4040, centres[0], None), (None, centres[0], 1)]
    got = hn.hard_negatives(table(spark, good + bad + [good[10]]), F.col("vec_id") % 10 == 0, shard_rows=shard_rows, block_rows=block_rows).collect()
    assert {tuple(r) for r in got} == brute([(i, [*v] + [0] * (6 - len(v)), y) for i, v, y in good], lambda i: i % 10 == 0)
    assert len(got) == len(set(got))


def test_hard_negatives_of_few_rows(spark):
    rows = table(spark, [(0, [1.0], 0), (1, [2.0], 0), (2, [1.5], 1)])
    assert [tuple(r) for r in hn.hard_negatives(rows, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 512 * 256, 384 * 256)]
    assert hn.hard_negatives(rows.limit(0), F.lit(True)).count() == 0
    assert hn.hard_negatives(rows, F.lit(None).cast("boolean")).count() == 0
    alone = table(spark, [(0, [1.0], 0), (2, [1.5], 1)])
    assert hn.hard_negatives(alone, F.lit(True)).count() == 0


def test_components_beyond_the_exact_range(spark):
    rows = [(0, [3e9, 1.0], 0), (1, [3e9, 2.0], 0), (2, [2e9, 0.5], 1), (3, [2e9, 0.25], 1)]
    with pytest.raises(Exception, match="int64|overflow|too large|out of bounds"):
        hn.hard_negatives(table(spark, rows), F.col("vec_id") == 0).collect()


def test_boxes_prune_rows():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 5, 6000)
    x = np.floor(256 * (rng.normal(size=(5, 8))[labels] + 0.15 * rng.normal(size=(6000, 8))))
    tree = hn.RTree(np.arange(6000), labels, x)
    best = hn.Best(5)

    def take(rows, scores):
        best.add(scores, tree.ids[rows])

    scored = tree.search(x[3], lambda under, over, least, most: over >= best.least, take)
    exact = np.lexsort((np.arange(6000), -(x @ x[3])))[:5]
    assert list(best.ids) == list(exact) and scored < 2500 and sorted(tree.ids) == list(range(6000))
    low, high, _, _ = tree.levels[0]
    under, over = hn.bounds(low, high, x[3])
    for rows, a, b in zip(tree.leaves, under, over):
        s = tree.vectors[rows] @ x[3]
        assert a <= s.min() and s.max() <= b
