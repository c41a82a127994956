"""The registered queries with an SQL twin, on the smallest data set."""

from __future__ import annotations

import pytest
from compare import compare, duck

from tidewatch.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_a_row_for_every_input_row(spark, name):
    rows = QUERIES[name](spark, SF)
    table, key = ("embeddings", "vec_id") if name.startswith("op7") else ("pages", "page_id") if name.startswith("op10") else ("documents", "doc_id")
    if name.startswith("op13"):
        assert rows.count() > 0
        return
    own = spark.read.parquet(f"{SF}/{table}.parquet")
    if name.startswith("op7"):
        assert rows.select("query_id").distinct().count() == own.where("vec_id % 20 = 0").count()
    else:
        assert rows.select(key).distinct().count() == own.count()
