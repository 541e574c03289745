"""Every registered query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import differs

from tomoframe.plans import data_work, particle_queries, vector_queries

QUERIES = data_work.QUERIES | particle_queries.QUERIES | vector_queries.QUERIES
SQL = data_work.SQL | particle_queries.SQL | vector_queries.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    assert not differs(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).limit(1).count() == 1
