"""Every registered query against the second engine, on the driver tables."""

import pytest
from oracle import connect, differences
from plans import bad_operators

from weft.queries.registry import QUERIES, flagship

WITH_SQL = sorted(n for n, (_, sql) in QUERIES.items() if sql is not None)
ROWS_ONLY = sorted(n for n, (_, sql) in QUERIES.items() if sql is None and n != "relational_model")


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", WITH_SQL)
def test_agrees_with_sql(spark, con, sf_dir, name):
    fn, sql = QUERIES[name]
    df = fn(spark, sf_dir)
    assert bad_operators(df) == []
    assert differences(df, con, sql) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name][0](spark, sf_dir).count() > 0


def test_flagship_has_a_row_per_order(spark, sf_dir):
    out = flagship(spark, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
