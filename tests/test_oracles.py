"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import TESTDATA, compare, connect

import __spark_entry__ as entry

FOLDER = str(TESTDATA / "sf0.001")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, db, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 500
