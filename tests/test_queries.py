"""Every registered query against DuckDB on the smallest tables."""

import pytest
from conftest import SMALL
from oracle import compare, connect

import __spark_entry__ as app

ORACLES = app.oracle_sql()
QUERIES = app.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_reference_sql(name, spark, duck):
    assert compare(QUERIES[name](spark, SMALL), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_reference_sql_returns_rows(name, spark):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_has_rows_and_feature_columns(spark):
    df = app.entry(spark)
    assert {"target_id", "disease_id", "year", "target__tissue_specificity"} <= set(df.columns)
    assert df.count() == 18176
