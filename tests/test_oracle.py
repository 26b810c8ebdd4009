import pytest

from folioweave.plans import catalog

from .oracle import differences


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    assert differences(spark, sf, catalog.queries()[name], catalog.oracle_sql()[name]) == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
