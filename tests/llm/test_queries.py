import pytest

from casebook.llm import queries
from tests.conftest import against_sql


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, small, name):
    assert against_sql(spark, small, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0
