"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    fn = entry.queries()[name]
    if name not in SQL:
        assert fn(spark, FOLDER).count() > 0
        return
    rows, problem, _ = compare(spark, con, FOLDER, fn, SQL[name])
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
