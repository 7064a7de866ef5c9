"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_sql_belongs_to_queries():
    assert SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_flagship(spark):
    rows = {r["Service"]: r for r in entry.entry(spark).collect()}
    assert set(rows) == {"Nb Consultants", "Nb Consultations", "Paludisme", "Accouchements"}
