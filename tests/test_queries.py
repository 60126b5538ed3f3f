"""Every registered query against its check SQL on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SQLS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_matches_the_check_sql(spark, sf, con, name):
    assert compare(entry.queries()[name](spark, sf), con, SQLS[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(SQLS) <= set(entry.queries())
