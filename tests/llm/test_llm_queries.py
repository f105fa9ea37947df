import pytest

from lychnos.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(connect(sf_dir).execute(ORACLES[name]).df())
    else:
        assert len(got)
