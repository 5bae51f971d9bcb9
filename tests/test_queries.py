"""Every query that has SQL gives the rows DuckDB gives."""

from __future__ import annotations

import pytest

from tests.compare import duck_rows, rows_of
from tierwise import plans, registry  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, data, name):
    assert rows_of(registry.queries()[name](spark, data)) == duck_rows(registry.oracle_sql()[name], data)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
