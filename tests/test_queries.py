"""Every query with SQL against DuckDB; the others give rows with a stable schema."""

from __future__ import annotations

import pytest
from compare import differences, duck

from gantry.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


#: Larger than the other tests' tables: sums in another order and ties show.
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(LARGER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    assert not differences(QUERIES[name](spark, LARGER), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() > 0
