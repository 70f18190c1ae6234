import duckdb
import pytest

from orospark.plans.queries import ORACLES, QUERIES
from tests.compare import same
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_sizes_beyond_the_digits_of_a_double(spark, tmp_path):
    """Partkeys and suppkeys of a table 60 times sf0.1; the decimal digits alone would round each of them the other way."""
    rows = ((7945751, 5, 1042590, 52350), (5582316, 6, 751874, 37756), (8865877, 7, 1198033, 59334), (7597284, 2, 1009837, 50537), (5582316, 1, 744061, 37153), (7597284, 3, 1005925, 50387), (1, 1, 5, 3))
    values = ", ".join(f"({o}::bigint, {n}::int, {p}::bigint, {s}::bigint, 0.0::double)" for o, n, p, s in rows)
    duckdb.sql(f"copy (select * from (values {values}) t(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    same(QUERIES["display_numbers"](spark, str(tmp_path)), ORACLES["display_numbers"], str(tmp_path))
