"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from tracelode import plans

from .oracle import connection, oracle_rows, spark_rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.queries(), plans.oracles()


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SF)) == oracle_rows(duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and any(any(x not in (None, 0, "", False) for x in r) for r in rows)


def test_oracles_name_queries():
    assert not set(ORACLES) - set(QUERIES)
