"""The exact two-sample p-value against all interleavings, known values and the asymptotic one."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from tidewatch.operators import quality as Q


@pytest.mark.parametrize("n, m", [(1, 1), (3, 4), (5, 2), (4, 4), (1, 6)])
def test_equals_all_interleavings(n, m):
    gaps = []
    for first in itertools.combinations(range(n + m), n):
        i = j = worst = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in first else (i, j + 1)
            worst = max(worst, abs(i * m - j * n))
        gaps.append(worst)
    for apart in sorted({0, *gaps}):
        assert Q.exact_gap_p(apart / (n * m), n, m) == pytest.approx(sum(g >= apart for g in gaps) / len(gaps))


def test_known_and_large_values():
    assert Q.exact_gap_p(0.8, 5, 5) == pytest.approx(20 / 252) and Q.exact_gap_p(1.0, 5, 5) == pytest.approx(2 / 252)
    assert Q.exact_gap_p(0.0, 9, 9) == 1.0 and math.isnan(Q.exact_gap_p(0.5, 0, 3))
    n, m, gap = 3000, 2000, 0.04
    lam = math.sqrt(n * m / (n + m)) * gap
    tail = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    assert Q.exact_gap_p(gap, n, m) == pytest.approx(tail, rel=0.06) and Q.exact_gap_p(gap, n, m) == pytest.approx(Q.exact_gap_p(gap, m, n))


def test_report_takes_the_exact_value_of_small_samples(spark):
    rng = np.random.default_rng(1)
    table = lambda n, shift: spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.normal(size=n), rng.normal(shift, size=n))], "same double, moved double")
    base, now = table(30, 0.0), table(20, 1.5)
    exact = {r["feature"]: r for r in Q.drift_report(base, now, ["same", "moved"], exact_rows=100).collect()}
    plain = {r["feature"]: r for r in Q.drift_report(base, now, ["same", "moved"]).collect()}
    for name, r in exact.items():
        assert r["p_value"] == pytest.approx(Q.exact_gap_p(r["gap"], 30, 20)) and r["p_value"] != plain[name]["p_value"]
    assert not exact["moved"]["same_distribution"]
    limited = {r["feature"]: r["p_value"] for r in Q.drift_report(base, now, ["same", "moved"], exact_rows=25).collect()}
    assert limited == {k: r["p_value"] for k, r in plain.items()}
