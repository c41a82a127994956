"""Top-k, neighbours and the Jaccard join against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import components, jaccard, neighbours, topk

SHAPE = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SHAPE)


def ranked(rows):
    out = {}
    for q, rank, v, s in rows:
        out.setdefault(q, []).append((rank, v, s))
    return {q: [x[1:] for x in sorted(own)] for q, own in out.items()}


def brute(rows, asks, k, score):
    return {q: sorted(((v, score(x, y)) for v, y in rows if v != q), key=lambda p: (-p[1], p[0]))[:k] for q, x in rows if asks(q)}


@pytest.mark.parametrize("shard_rows", [7, 1000])
def test_top_k_is_exact(spark, shard_rows):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=6).astype(np.float32)) for i in range(60)] + [(100 + i, np.array([1, 0, 0, 0, 0, 0], np.float32)) for i in range(20)]
    good += [(200, np.zeros(6, np.float32)), (300, np.array([2.0, -1.0], np.float32))]
    bad = [(400, None), (500, [1, None, 0, 0, 0, 0]), (600, [float("nan")] * 6), (700, [float("inf"), 0, 0, 0, 0, 0])]
    got = ranked(map(tuple, topk.top_k(vectors(spark, good + bad + [good[0]]), F.col("vec_id") % 10 == 0, k=5, shard_rows=shard_rows).collect()))
    whole = [(i, [int(np.floor(1024 * float(x))) for x in v] + [0] * (6 - len(v))) for i, v in good]
    assert got == brute(whole, lambda i: i % 10 == 0, 5, lambda x, y: sum(a * b for a, b in zip(x, y)))


def test_top_k_of_few_rows(spark):
    two = vectors(spark, [(0, [1.0]), (1, [2.0])])
    assert [tuple(r) for r in topk.top_k(two, F.lit(True), k=5).orderBy("query_id").collect()] == [(0, 1, 1, 1024 * 2048), (1, 1, 0, 1024 * 2048)]
    assert topk.top_k(two.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(two, F.lit(False)).count() == 0


def test_threshold_stops_before_the_end():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(5000, 3)))
    x[:40] *= 50
    best, scores, scored = topk.Shard(np.arange(5000), x).top(-1, np.array([1.0, 2.0, 0.5]), 5)
    assert scored < 1000 and list(best) == list(np.argsort(-(x @ [1.0, 2.0, 0.5]))[:5])


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=24).astype(np.float32) * (1 + i % 3)) for i in range(500)] + [(1000 + i, np.ones(24, np.float32)) for i in range(60)]
    bad = [(2000, None), (2020, [0.0] * 24), (2040, [None] * 24)]
    found = neighbours.nearest(vectors(spark, rows + bad), F.col("vec_id") % 20 == 0, k=10, shard_rows=150)
    got = ranked(map(tuple, found.collect()))
    exact = brute([(i, v.astype(float)) for i, v in rows], lambda i: i % 20 == 0, 10, lambda x, y: float((x * y).sum()))
    assert set(got) == set(exact)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in exact[q]}) for q in exact)
    assert hits >= 0.9 * sum(map(len, exact.values()))
    of = dict(rows)
    for q, own in got.items():
        assert all(abs(s - float((of[q].astype(float) * of[v].astype(float)).sum())) < 1e-9 for v, s in own)
        assert own == sorted(own, key=lambda p: (-p[1], p[0])) and q not in {v for v, _ in own}
    assert [v for v, _ in got[1000]] == [v for v, _ in exact[1000]]  # ties go to the smaller id


def test_neighbours_of_few_rows(spark):
    two = vectors(spark, [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0])])
    assert [tuple(r) for r in neighbours.nearest(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2.0)]
    assert neighbours.nearest(two.limit(0), F.lit(True)).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, words):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(zip(*(w[k:] for k in range(words)))) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset()


def plain_components(rows, words, percent):
    sets = [(i, plain_set(t, words)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed, group=40):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(80)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, n = [], 0
    shared = text(30)
    for size, copies, edits in ((60, group, 2), (200, 12, 6), (30, 10, 1), (5, 8, 1), (400, 6, 25)):
        base = text(size)
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n + k, " ".join(shared + text(rng.randint(5, 40)))) for k in range(25)]
    n += 25
    rows += [(n + k, t) for k, t in enumerate([None, "", " \t\n", "one", "ONE", "one two", "One  Two", "one\x0btwo", "été Été", "été été", "a b c", "a b c d"])]
    return rows


@pytest.mark.parametrize("words, percent, near, block", [(3, 90, 8, 250_000), (3, 90, 3, 600), (5, 80, 3, 900)])
def test_components_equal_all_pairs(spark, monkeypatch, words, percent, near, block):
    rows = corpus(words + near)
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n int, digest string").repartition(5)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard.near_pairs, "__defaults__", (near,))
    monkeypatch.setattr(jaccard.verified_links, "__defaults__", (block,))
    got = sorted(tuple(r) for r in jaccard.shingle_components(docs, words, percent).collect())
    assert got == plain_components(rows, words, percent)


def passages(seed):
    """Texts of own words and of passages that many of them share; every tenth has a near copy."""
    rng = random.Random(seed)
    common = [[f"p{k}x{j}" for j in range(40)] for k in range(6)]
    rows = []
    for k in range(150):
        parts = [[f"o{rng.randrange(10 ** 6)}" for _ in range(50 + k % 3)], *rng.sample(common, 2)]
        rng.shuffle(parts)
        own = [w for part in parts for w in part]
        rows.append((len(rows), " ".join(own)))
        if k % 10 == 0:
            own[rng.randrange(len(own))] = "changed"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_full_tables_do_not_tie_what_only_shares_passages(spark, monkeypatch, words, percent):
    rows = passages(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    full = b"\xff" * (1 << jaccard.SHARED_BITS - 3)  # every shingle may occur again, the frequency of none is known
    monkeypatch.setattr(jaccard, "count_shingles", lambda docs, words: (full, b"", b""))
    block, sizes = 1_000, []
    verified = jaccard.verified_links

    def counted(docs, clusters, *rest):
        sizes.append([r["n"] for r in clusters.groupBy("cluster").agg(F.count("*").alias("n")).collect()])
        return verified(docs, clusters, *rest, block)

    monkeypatch.setattr(jaccard, "verified_links", counted)
    monkeypatch.setattr(jaccard.cut_clusters, "__defaults__", (10 ** 9,))
    whole = sorted(tuple(r) for r in jaccard.shingle_components(docs, words, percent).collect())
    monkeypatch.setattr(jaccard.cut_clusters, "__defaults__", (block,))
    got = sorted(tuple(r) for r in jaccard.shingle_components(docs, words, percent).collect())
    assert got == whole == plain_components(rows, words, percent)
    assert max(sizes[0]) > 100  # tied by the passages
    assert max(sizes[1]) <= 4 and sum(sizes[1]) <= 3 * sum(i != c for i, _, c in got)


def test_rows_of_one_id_with_texts_of_one_size(spark):
    text = lambda k: " ".join(f"{k}w{j}" for j in range(40))
    rows = [(1, text("a")), (1, text("b")), (2, text("b")[:-1] + "z"), (3, text("a") + " more"), (4, text("c"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.shingle_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_jaccard_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.shingle_components(empty).count() == 0
    long = "w " * 60_000
    rows = spark.createDataFrame([(1, long), (2, long + "x"), (5, "lone text here"), (5, "lone text here"), (None, "lone text here")], "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.shingle_components(rows).collect())
    assert got == [(1, 1, 1), (2, 2, 2), (5, 1, 5), (5, 1, 5)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(10, 60)] + [(200, k) for k in range(201, 260)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 10 for k in range(10, 61)) and all(got[k] == 200 for k in range(200, 260)) and len(got) == 111
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_without_ids_in_a_table(spark):
    docs = spark.createDataFrame([(k, "t") for k in range(50)] + [(None, "t")], "doc_id long, text string")
    gone = spark.createDataFrame([(k,) for k in range(0, 50, 3)], "doc_id long")
    assert sorted(r["doc_id"] for r in jaccard.without(docs.where("doc_id IS NOT NULL"), gone).collect()) == [k for k in range(50) if k % 3]
    assert jaccard.without(docs, gone).where("doc_id IS NULL").count() == 1
