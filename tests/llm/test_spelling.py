"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import runs, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, slip=97):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 5
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(rows, slip=97):
    n = plain_counts(rows, slip)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def texts(seed, docs=60, words=220):
    rng = random.Random(seed)
    parts = ["ab", "ba", "aa", "an", "na", "é", "ÿ", "×", "n", "a", "B", "tÉ"]
    base = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 6))) for _ in range(40)]
    rows = []
    for d in range(docs):
        own = []
        for _ in range(words):
            w = base[min(int(rng.expovariate(0.12)), 39)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abné") + w[k:], w[:k] + rng.choice("abn") + w[k + 1:]])
            own.append(w)
        rows.append((d if d % 9 else -d, rng.choice([" ", "-", "1", "Ā", "\n\n", "’"]).join(own)))
    return rows + [(None, rows[0][1]), (3, rows[3][1]), (70, None), (71, ""), (72, "x" * 70_000 + " banana"), (73, ("q" * 80 + " ") * 4), (74, "中文")]


@pytest.mark.parametrize("seed, slip", [(1, 97), (2, 3), (3, 1)])
def test_variants_equal_brute_force(spark, seed, slip):
    rows = texts(seed)
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = spelling.variants(docs, slip=slip).collect()
    assert {r["word"]: tuple(r) for r in got} == plain_variants(rows, slip) and len(got) == len({r["word"] for r in got})
    assert any(r["form"] and r["root"] != r["form"] for r in got) or seed != 1


def test_variants_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "ab cd")], "doc_id long, text string")).count() == 0


def test_runs_and_checksums():
    texts = pa.array(["ab éc", None, "", "x" * 100 + " y", "ab"])
    found = []
    for _, flat, offsets in runs.slices(texts):
        start, length, row = runs.spans(flat != 32, offsets)
        crc = runs.crcs(flat, start, length, np.array([zlib.crc32(b"7:")] * len(start), np.uint32))
        same = runs.hashes(flat, start, length)
        raw = runs.strings(flat, start, length).to_pylist()
        found += list(zip(row.tolist(), raw))
        assert [zlib.crc32(b"7:" + x) for x in raw] == crc.tolist()
        assert len(set(same.tolist())) == len(set(raw)) and same[0] == same[-1]
    assert found == [(0, b"ab"), (0, "éc".encode()), (3, b"x" * 100), (3, b"y"), (4, b"ab")]
