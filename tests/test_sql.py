"""Every registered query equals its SQL on the smallest tables; queries without SQL are tested elsewhere."""

import pytest
from compare import assert_same

from tideline import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.count()


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).schema == entry.entry(spark).schema
    assert set(entry.oracle_sql()) <= set(entry.queries())
