"""Each registered query beside its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from workload.check import compare, oracle

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return oracle(folder)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, folder, con, name):
    df = entry.queries()[name](spark, folder)
    if name in SQL:
        assert compare(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
