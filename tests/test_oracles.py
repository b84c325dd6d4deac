"""Every planning query against its SQL, on the smallest tables."""

import pytest

from meshloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(name, same):
    same(catalog.queries()[name], catalog.oracle_sql()[name])


def test_names_of_sql_are_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_run(name, spark, data):
    assert catalog.queries()[name](spark, data).count() > 0


def test_entry_without_subpackage(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
