"""Every query of the subpackage is registered, and agrees with its SQL."""

import pytest

import __spark_entry__ as entry
from loanlag.llm import queries
from tests.conftest import SF001
from tests.oracle import compare


def test_all_are_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    res = compare(spark, duck, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF001)
    assert res["ok"], res["problems"]
