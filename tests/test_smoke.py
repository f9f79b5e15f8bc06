"""t1: the driver's smoke entry and the registry contract."""

import __spark_entry__ as E
from profitlens.plans.catalog import oracle_queries, spark_queries


def test_entry_runs_on_smallest_scale(spark):
    df = E.entry(spark)
    assert df.columns == ["margin_band", "num_records", "pct_transaction_volume", "total_profit", "avg_margin_pct"]
    rows = df.collect()
    assert len(rows) == 10  # all bands, including empty ones
    assert [r.margin_band for r in rows][0] == "0–9.99%"


def test_every_query_has_an_oracle_except_documented():
    q, o = spark_queries(), oracle_queries()
    assert set(o) <= set(q)
    assert set(q) == set(o), sorted(set(q) - set(o))


def test_registry_names_are_plain():
    for name in spark_queries():
        assert name.isidentifier() and name == name.lower()
