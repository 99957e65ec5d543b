"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    _, problem = compare(spark, con, SMALL, queries()[name], oracle_sql().get(name))
    assert problem is None


def test_entry(spark):
    assert entry(spark).count() > 0
