"""Every registered query of the library against its SQL in another engine."""

import pytest

from gridlume.plans import QUERIES, SQL

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
