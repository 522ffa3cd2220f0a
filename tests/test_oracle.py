"""Every archive query against its SQL."""

import pytest

from turnlake.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(name, compare):
    compare(registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(name, spark, data):
    assert registry.QUERIES[name](spark, data).limit(5).collect()


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
