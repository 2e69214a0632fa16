"""The corpus queries against their SQL."""

import pytest

from checks.compare import compare, connect
from fabtrace.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, small, name):
    ok, note = compare(spark, con, small, QUERIES[name], ORACLE_SQL[name])
    assert ok, note


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
