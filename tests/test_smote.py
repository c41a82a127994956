"""Synthetic rows lie between a row and one of its nearest ones, whatever number of equal rows there is."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import sampling
from tidewatch.operators import similarity


def classes(spark):
    points = [(i, "a", float(i % 3), 0.0) for i in range(60)] + [(100, "a", 50.0, 50.0)]
    points += [(200 + i, "b", float(i % 7), float(i)) for i in range(75)] + [(300, "c", 1.0, 2.0)]
    return spark.createDataFrame(points, "id long, y string, a double, b double")


def test_only_rows_with_copies_ask_and_equal_ones_once(spark, monkeypatch):
    asked = []
    plain = similarity.nearest

    def counted(queries, items, *args, **named):
        asked.append((queries.count(), items.count()))
        return plain(queries, items, *args, **named)

    monkeypatch.setattr(similarity, "nearest", counted)
    out = sampling.balance(classes(spark), "y", ["id"], "smote", features=["a", "b"], neighbours=2)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {"a": 75, "b": 75, "c": 75}
    # 14 of the 61 rows of class a get a copy: they have 3 or 4 values; of each at most 3 rows give
    assert sorted(asked)[0] == (1, 1) and sorted(asked)[1][0] <= 4 and sorted(asked)[1][1] == 10


@pytest.mark.parametrize("k", [1, 3])
def test_copies_lie_between_near_rows(spark, k):
    df = spark.createDataFrame([(i, "b", float(i % 4), float(i % 4)) for i in range(40)] + [(100 + i, "s", float(i * i), 0.0) for i in range(6)], "id long, y string, a double, b double")
    out = sampling.balance(df, "y", ["id"], "smote", features=["a", "b"], neighbours=k).where("y = 's'")
    at = [float(i * i) for i in range(6)]
    for r in out.where(F.col("b") == 0).collect():
        own = float((r["id"] - 100) ** 2)
        near = sorted((x for x in at if x != own), key=lambda x: (abs(x - own), x))[:k]
        assert any(min(own, x) - 1e-9 <= r["a"] <= max(own, x) + 1e-9 for x in near)
