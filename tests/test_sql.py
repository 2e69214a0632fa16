"""Every registered query against its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, connect
from checks.oracle import FINAL
from checks.queries import QUERIES

SQL = {name: sql for name, sql in oracle_sql().items() if name in FINAL}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, small, name):
    ok, note = compare(spark, con, small, QUERIES[name], SQL[name])
    assert ok, note


def test_entry(spark):
    assert entry(spark).count() == 428
