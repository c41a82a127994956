"""Every query with an SQL twin returns the same rows on the smallest data set."""

from __future__ import annotations

import pytest
from compare import compare, duck

from __spark_entry__ import oracle_sql, queries
from tidewatch.plans import load_catalog

SF = "/root/testdata/sf0.001"
#: rows-only queries of the catalogue: trained models, hashes and sketches
ROWS_ONLY = sorted(name for name, q in load_catalog().items() if not q.sql)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(name for name, q in load_catalog().items() if q.sql))
def test_equals_sql(spark, con, name):
    assert compare(queries()[name](spark, SF), con, oracle_sql()[name]) in (None, "EMPTY")


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, name):
    assert not queries()[name](spark, SF).isEmpty()


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 1
