import pytest

from folioweave.llm import queries as llm

from ..oracle import differences


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    assert differences(spark, sf, llm.queries()[name], llm.oracle_sql()[name]) == []
