"""Every registered query on the smallest tables, against its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, small, con, name):
    result = entry.queries()[name](spark, small)
    if name in SQL:
        assert difference(result, con, SQL[name]) is None
    else:
        assert result.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(entry.queries())
