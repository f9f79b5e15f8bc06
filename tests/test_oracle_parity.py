"""t2: every registered query equals its DuckDB oracle on the driver's test tables."""

import pytest

from profitlens.plans.catalog import oracle_queries, spark_queries
from profitlens.verify import compare, duckdb_with_tables

from conftest import SF_SMALL

NAMES = sorted(spark_queries())


@pytest.fixture(scope="module")
def con():
    return duckdb_with_tables(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = spark_queries()[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(oracle_queries()[name])
    o_cols, o_rows = [d[0] for d in res.description], res.fetchall()
    assert compare(s_cols, s_rows, o_cols, o_rows) == "ok"
