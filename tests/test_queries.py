"""Every registered query against its SQL twin on the smallest scale factor."""

import pytest

from tests.oracle import compare, duck
from tickloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    if q.oracle is None:
        assert q(spark, SF).count() >= 0
    else:
        assert compare(spark, con, q, SF) == ""


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
