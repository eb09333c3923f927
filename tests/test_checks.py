"""Every registered check against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_check(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert difference(df, con, ORACLE[name]) is None
    else:
        assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    row = entry.entry(spark).first().asDict()
    assert row["rows_A"] == row["unchanged"] + row["exclusive_A"] + row["updated"]
