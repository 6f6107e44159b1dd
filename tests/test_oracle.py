"""Every registered query with SQL agrees with DuckDB on the smallest data set."""

import pytest
from oracle import connect, differences, types

from hearthmap.registry.spark_queries import QUERIES
from hearthmap.registry.sql import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_sql_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert differences(df, con, ORACLE[name]) == ""
    assert types(df, con, ORACLE[name]) == {}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0
    assert all(df.columns)
