"""Every registered query runs; those with SQL give the same rows as it."""

import pytest

from sahaf import plans
from sahaf.plans import registry
from tests.oracle import database, rows

assert plans.__all__


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, data, name):
    ours, theirs = registry.QUERIES[name](spark, data).toPandas(), database(data).sql(registry.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
