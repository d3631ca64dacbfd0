"""Every registered query against its SQL on the smallest given tables."""

import pytest
from oracle_check import difference, duck

import __spark_entry__ as entry
from strandline.plans import oracle, queries as registered

SF_DIR = entry.SMOKE_DIR


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert registered.QUERIES.keys() == oracle.SQL.keys()
    assert registered.QUERIES.keys() <= entry.queries().keys()


def test_flagship(spark):
    assert entry.entry(spark).columns == ["host", "pages", "crawled", "failed", "total", "bytes"]


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(spark, con, name):
    bad, rows = difference(spark, con, SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert bad is None
    assert rows > 0 or name.endswith("_hard")
