"""Every registered query equals its SQL on the smallest driver tables."""

import pytest

from checks import ORACLE, QUERIES
from checks.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLE[name], FOLDER) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())
