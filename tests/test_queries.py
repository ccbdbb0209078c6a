"""Every query with a SQL twin equals it; the others give rows."""

import pytest

from loamspark.plans import catalogue

from .oracle import differences, duck

TINY = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(TINY)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert differences(spark, catalogue.queries()[name], SQL[name], TINY, con) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, TINY).count() > 0


def test_names():
    assert set(SQL) <= set(catalogue.queries())
