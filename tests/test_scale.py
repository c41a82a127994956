"""Shapes of the work: how often rows are copied."""

from __future__ import annotations

import numpy as np
import pytest

from tidewatch.operators import similarity as N


def test_cells_share_packs():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 60, 200)
    sizes[7] = 1_000
    chain = N._chain(rng.normal(size=(200, 4)))
    first, count = N._packs(sizes, chain, 100)
    assert sorted(chain) == list(range(200)) and count[7] == 10 and count.sum() == 209
    held = np.bincount(first[count == 1], sizes[count == 1])
    assert held.max() <= 100 and set(range(first[7] + 1, first[7] + 10)).isdisjoint(first)
    # packs follow the rows, not the cells: two that follow each other hold more than one can
    assert first.max() + 1 <= 2 * sizes.sum() // 100 + 2


@pytest.mark.parametrize("k", [1, 4, 50])
def test_rounded_ties_go_to_the_smaller_column(k):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 5, (30, 40)) + rng.uniform(-4e-10, 4e-10, (30, 40))
    values[3, :37] = np.inf
    rows, cols, value = N._smallest_rounded(values, k)
    for i in range(30):
        order = sorted((j for j in range(40) if np.isfinite(values[i, j])), key=lambda j: (round(values[i, j]), j))[:k]
        assert cols[rows == i].tolist() == order and value[rows == i].tolist() == [round(values[i, j]) for j in order]


def test_vectors_without_order_are_not_copied_to_cells(spark):
    """Nothing can be pruned, and still a query is copied to the chunks only."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = N.nearest(df, df, 2, skip_self=True, pivots=300)
    far = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(-1)).round(9)
    found = {(r.query_id, r.rank): r.item_id for r in got.where("query_id < 50").collect()}
    for q in range(50):
        order = sorted((j for j in range(2_000) if j != q), key=lambda j: (far[q, j], j))
        assert [found[q, 1], found[q, 2]] == order[:2]
