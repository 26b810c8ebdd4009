"""Operators over small literal inputs: extraction, captions, sources, sinks."""

import pytest

from .cases import exchange, fixtures
from .oracle import differences

QUERIES = fixtures.queries() | exchange.queries()
SQL = fixtures.oracle_sql() | exchange.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_case_gives_the_expected_rows(spark, sf, name):
    assert differences(spark, sf, QUERIES[name], SQL[name]) == []
