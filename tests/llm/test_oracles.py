"""Queries with an oracle equal it; all are registered."""

import pytest

import __spark_entry__ as E
from profitlens.llm.queries import ORACLES, QUERIES
from profitlens.verify import compare, duckdb_with_tables

from conftest import SF_SMALL


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(E.queries()) and {*ORACLES} <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    res = duckdb_with_tables(SF_SMALL).execute(ORACLES[name])
    assert compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in res.description], res.fetchall()) == "ok"
