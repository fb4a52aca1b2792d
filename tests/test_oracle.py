"""Every core query against its SQL, and the others for rows, on the smallest tables."""

import pytest

from hyperloom.plans import catalog
from tests.oracle import connect, rows_of, rows_of_sql

QUERIES, SQL = catalog.compared_queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    assert rows_of(df) == rows_of_sql(db, SQL[name], df.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
