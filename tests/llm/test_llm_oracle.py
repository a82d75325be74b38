"""The operators that SQL can express give the rows of their SQL."""

from __future__ import annotations

import pytest
from conftest import assert_same

from setphrase.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, name):
    assert_same(queries.queries()[name](spark, str(data)), SQL[name])
