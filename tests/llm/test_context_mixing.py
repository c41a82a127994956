"""The mixing model: base scores by brute force, counts across ranges, held-out bits, edge cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import context_mixing as cm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_base(rows):
    tokens = lambda t: [*WORD.findall((t or "").translate(LOW)), None]
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7
    counts = Counter(w for i, t in rows if fold(i) not in (2, None) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        own = tokens(t)
        out.append((i, fold(i) in (2, None), len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)))
    return sorted(out, key=str)


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    parts = ["th", "er", "in", "an", "re", "ou", "st", "É", "le", "on"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    text = lambda: " ".join(words[min(199, int(rng.expovariate(0.03)))] + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randint(1, 120)))
    rows = [(i, text()) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "x" * 31 + " " + "y" * 32 + " " + "z" * 33 + " " + "q" * 20_000), (n + 4, "中文" * 50 + " \0 a\0b"), (n + 5, "y" * 32 + " z" * 3)]
    return rows + [(None, "th er"), rows[4], rows[4], (rows[5][0], "another text")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "a", 2.0) for i, t in rows], "doc_id long, text string, bucket int, key string, bits double").repartition(4)


@pytest.mark.parametrize("frequent, bucket, ranges", [(20, 300, 90), (65_536, 10**7, 10**6)])
def test_base_scores_equal_brute_force(spark, monkeypatch, frequent, bucket, ranges):
    monkeypatch.setattr(cm, "FREQUENT", frequent)
    monkeypatch.setattr(cm, "RANGE_ROWS", ranges)
    monkeypatch.setattr(cm.score, "__defaults__", ("doc_id", "text", frequent, bucket))
    rows = corpus()
    got = cm.scored(table(spark, rows)).collect()
    mine = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=str)
    for a, b in zip(mine, plain_base(rows), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["bits"] == pytest.approx(-r["score"] / math.log10(2)) for r in got)
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 10]
    assert held
    assert sum(r["bits"] for r in held) / sum(r["bits"] / r["bits_per_byte"] for r in held) < 3.5
    assert len({round(r["score"], 9) for r in got if r["doc_id"] == rows[4][0]}) == 1


def test_scores_do_not_depend_on_ranges(spark, monkeypatch):
    rows, out = corpus(60), []
    for ranges in (120, 10**6):
        monkeypatch.setattr(cm, "RANGE_ROWS", ranges)
        out.append({(r["doc_id"], r["n_tokens"]): r["score"] for r in cm.scored(table(spark, rows)).collect()})
    assert out[0].keys() == out[1].keys()
    # counts are the same; the weights are learned range by range, here 120 spellings each
    assert sum(out[0].values()) == pytest.approx(sum(out[1].values()), rel=0.05)
    assert all(out[0][k] == pytest.approx(out[1][k], rel=0.25) for k in out[0])


def test_empty_tables(spark):
    assert cm.scored(table(spark, []).limit(0)).count() == 0
    only = cm.scored(table(spark, [(None, "a b")])).first()
    assert (only["n_tokens"], only["n_known"], only["train_tokens"], only["base_score"]) == (3, 0, 0, 0.0) and only["score"] < 0


def spellings(keys, counts):
    return cm.Spellings(pa.chunked_array([pa.array(keys, pa.binary())]), np.array(counts))


def test_counts_of_branches_across_ranges():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 7))) + b" " for _ in range(150)})
    counts = [rng.randint(0, 5) for _ in keys]

    def bits(s, carry=None):
        out = {}
        for at, (_, rows, bit, held, _, _, zeros, ones, *_) in enumerate(s.bits(carry)):
            branch = np.repeat(np.arange(len(held)), held)
            for r, b, g in zip(rows, bit, branch):
                pair = (ones[g], zeros[g])
                out[s.matrix[r].tobytes(), at] = pair if b else pair[::-1]
        return out

    whole = bits(spellings(keys, counts))
    for key, level in whole:  # by brute force
        text = key.rstrip(b"\0")
        prefix = lambda x, n: int.from_bytes(x.ljust(33, b"\0"), "big") >> 33 * 8 - n
        same = sum(c for k, c in zip(keys, counts) if prefix(k, level + 1) == prefix(text, level + 1))
        assert whole[key, level][0] == same and sum(whole[key, level]) == sum(c for k, c in zip(keys, counts) if prefix(k, level) == prefix(text, level))
    for cut in ([3, 4, 5, 30], [1], [20, 40], list(range(1, len(keys)))):
        parts = [spellings(keys[a:b], counts[a:b]) for a, b in zip([0, *cut], [*cut, len(keys)])]
        carry = cm.carries(np.array([p.matrix[0] for p in parts]), np.array([p.matrix[-1] for p in parts]), np.array([cm.edges(p) for p in parts]))
        assert {k: v for p, c in zip(parts, carry) for k, v in bits(p, c).items()} == whole


def test_probabilities_of_both_bits_add_up():
    keys = [bytes([a, b]) + b" " for a in b"abcx" for b in b"abcx"] + [b"\n"]
    s = spellings(keys, range(17))
    m = cm.Mixer(cm.context_counts(s))
    m.learn(s, None)
    cost = cm.Mixer(cm.context_counts(s), *cm.Mixer.of_sums(m.sums())).costs(s, None)
    whole = spellings(sorted({bytes([a, b]) for a in range(256) for b in range(256)}), [0] * 65_536)  # all spellings of two bytes
    assert np.isclose((2.0 ** -cm.Mixer(cm.context_counts(s), *cm.Mixer.of_sums(m.sums())).costs(whole, None)).sum(), 1)
    assert (2.0 ** -cost).sum() < 1 and (cost[s.counts > 10] < cost[s.counts == 0].min()).all()


def test_a_bucket_of_tokens_is_small():
    """A task holds the tokens of a bucket: 24 bytes each at most, hash, text and both counts."""
    assert cm.BUCKET * 24 <= 100_000_000
