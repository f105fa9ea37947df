import pytest

from lychnos.plans import catalog, records
from tests.oracle import connect, rows

ALL = {**records.QUERIES, **catalog.QUERIES}
SQL = {**records.ORACLES, **catalog.ORACLES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    got = ALL[name](spark, sf_dir).toPandas()
    want = connect(sf_dir).execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert ALL[name](spark, sf_dir).count() >= 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
