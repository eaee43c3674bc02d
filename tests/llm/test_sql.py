import pytest
from tests.conftest import same

from pointloom.llm import entries


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_against_sql(spark, duck, sf, name):
    same(entries.queries()[name](spark, sf), duck.sql(entries.oracle_sql()[name]))
