"""Every query against its DuckDB counterpart on the smallest tables."""

import pytest
from checks import agree

from reqloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, small, duck, name):
    agree(catalog.QUERIES[name](spark, small), duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_has_rows(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_imports_llm():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "reqloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "reqloom.llm" in p.read_text()]
