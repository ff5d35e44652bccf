"""Every registered query against its DuckDB oracle at sf0.01."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF001
from tests.oracle import compare

QUERIES = {name: q for name, q in entry.queries().items() if name in entry.QUERIES}
SQL = entry.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    res = compare(spark, duck, name, QUERIES[name], SQL[name], SF001)
    assert res["ok"], res["problems"]
