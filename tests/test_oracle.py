"""Each query of the library gives the rows of its SQL counterpart."""

from __future__ import annotations

import pytest
from conftest import assert_same

from setphrase.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, name):
    assert_same(QUERIES[name](spark, str(data)), SQL[name])
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, str(data))
    assert df.columns
    df.collect()
    spark.catalog.clearCache()


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.queries().keys() >= QUERIES.keys()
    assert entry.entry(spark).columns == ["phrase", "freq"]
