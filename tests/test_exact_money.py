"""Exact margins and sums, fresh listings, and customers without profits."""

from __future__ import annotations

import decimal
import shutil

import pytest
from pyspark.sql import functions as F

from profitlens.functions.measures import sum_cents
from profitlens.operators.clean import clean_view
from profitlens.plans.catalog import spark_queries
from profitlens.plans.customers import best_worst_customer

from conftest import SF_SMALL

FACT = "`Order ID` long, `Factory ID` long, `Product ID` long, Units int, Sales decimal(12,2), Cost decimal(12,2), `Gross Profit` decimal(12,2)"


def _fact(spark, rows):
    d = lambda x: None if x is None else decimal.Decimal(x)
    return spark.createDataFrame([(o, 1, 1, 1, d(s), d("0"), d(g)) for o, s, g in rows], FACT)


def test_margin_is_rounded_once(spark):
    rows = _fact(spark, [(1, "10119.99", "4047.49"), (2, "200.00", "-0.01"), (3, "0.00", "5.00"), (4, "9999999999.99", "9999999999.98"),
                         (5, "-100.00", "0.005"), (6, None, "1.00"), (7, "100.00", None)])
    got = {r["Order ID"]: r.gross_margin_pct for r in clean_view(rows).collect()}
    assert got[1] == 39.99 and got[2] == -0.01 and got[3] is None and got[4] == 100.0 and got[6] is None and got[7] is None


def test_margin_matches_exact_half_up_on_all_rows(spark):
    from profitlens.sources.proxy import Star

    rows = Star(spark, SF_SMALL).v.select("Sales", "Gross Profit", "gross_margin_pct").collect()
    for s, g, m in rows:
        exact = (100 * g / s).quantize(decimal.Decimal("0.01"), decimal.ROUND_HALF_UP) if s else None
        assert m == (None if exact is None else float(exact)), (s, g)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_sum_does_not_overflow(spark, ansi):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rows = spark.range(10_000_000).select(F.lit("9999999999.99").cast("decimal(12,2)").alias("x"))
        assert int(rows.agg(sum_cents("x").alias("s")).first().s) == 999_999_999_999 * 10_000_000
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_appended_files_are_seen(spark, tmp_out):
    for t in "region nation customer supplier part orders".split():
        shutil.copy(f"{SF_SMALL}/{t}.parquet", f"{tmp_out}/{t}.parquet")
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    lines.write.parquet(f"{tmp_out}/lineitem.parquet")
    count = spark_queries()["row_count"]
    n = count(spark, tmp_out).first()[0]
    lines.write.mode("append").parquet(f"{tmp_out}/lineitem.parquet")
    assert count(spark, tmp_out).first()[0] == 2 * n


def test_customer_without_profits_counts_as_zero(spark):
    fact = _fact(spark, [(1, "10.00", "-2.00"), (2, "10.00", "4.00"), (3, "10.00", None)])
    order = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "`Order ID` long, `Customer ID` long")
    got = {r.position: r["Customer ID"] for r in best_worst_customer(fact, order).collect()}
    assert sorted(got.values()) == [10, 20]
    assert 30 not in got.values()
