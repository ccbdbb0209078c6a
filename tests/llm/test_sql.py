"""Every corpus query with a SQL twin equals it."""

import pytest

from loamspark.llm.queries import oracle_sql, queries

from ..oracle import differences

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    assert differences(spark, queries()[name], oracle_sql()[name], SMALL) == ""
