import pytest

from orospark.llm.queries import oracle_sql, queries
from tests.compare import same
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, name):
    same(queries()[name](spark, SF), oracle_sql()[name], SF)
