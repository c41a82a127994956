"""Components of dense groups."""

from __future__ import annotations

import random

import pytest

from tidewatch.llm import components


def plain(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return sorted((x, root(x)) for x in parent)


@pytest.mark.parametrize("held", [50, 700, 1 << 20])
def test_a_dense_group_is_thinned_and_stays_whole(spark, monkeypatch, held):
    rng = random.Random(held)
    edges = {(a, b) for a in range(60) for b in range(a)}  # all pairs of a group
    edges |= {(100 + i + 1, 100 + i) for i in range(40)} | {(1 << 40, 150), (1000, 2000)}
    edges |= {tuple(sorted(rng.sample(range(3000, 3400), 2), reverse=True)) for _ in range(300)}
    edges |= {(59, 3000 + rng.randrange(400))}
    df = spark.createDataFrame(sorted(edges, key=lambda e: rng.random()), "a long, b long").repartition(3)
    thin = components.thinned(df, held)
    nodes = {x for e in edges for x in e}
    assert {x for r in thin.collect() for x in r} == nodes
    assert thin.count() < (len(nodes) if held > len(edges) else len(edges))
    thinned = components.thinned
    monkeypatch.setattr(components, "thinned", lambda pairs: thinned(pairs, held))
    assert sorted(tuple(r) for r in components.components(df).collect()) == plain(edges)


def test_no_edges(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components.components(spark.createDataFrame([(4, 4)], "a long, b long")).collect() == []
