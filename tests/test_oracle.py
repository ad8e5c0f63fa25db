"""Every query with SQL gives the rows DuckDB gives, on the smallest tables."""

import pytest

from checks.compare import connect, oracle_rows, spark_rows
from checks.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, con, name):
    got = spark_rows(spark, SF, name)
    if name in ORACLE:
        assert got == oracle_rows(con, name)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
