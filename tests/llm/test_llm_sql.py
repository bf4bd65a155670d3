import pytest
from checks import agree

from reqloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, small, duck, name):
    agree(queries.QUERIES[name](spark, small), duck, queries.SQL[name])
