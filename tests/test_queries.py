"""Every query of the core with SQL gives the rows of its SQL; every other one runs."""

import pytest

from tests.oracle import DATA, canon, connect
from wavemill.plans import catalog


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = con.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    rows = catalog.QUERIES[name](spark, DATA)
    assert rows.columns
    rows.count()


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
