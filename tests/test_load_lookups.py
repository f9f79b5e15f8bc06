"""Load step: names are looked up before the joins, and orders are numbered in one range shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from profitlens.operators import load as L
from profitlens.operators.keys import dense_group_key, dense_surrogate_key, tagged
from profitlens.plans import load_reports as Ld
from profitlens.sources.proxy import Star
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("report", [Ld.enriched_raw, Ld.composite_order_ids])
def test_order_lines_are_read_once_with_many_names(spark, monkeypatch, report):
    few = {tuple(r) for r in report(Star(spark, SF_SMALL)).collect()}
    monkeypatch.setattr(L, "HOT_NAMES", 1)
    many = report(Star(spark, SF_SMALL))
    assert _plan(many).count("Relation [l_orderkey#") == 1
    assert {tuple(r) for r in many.collect()} == few


def _rows(spark):
    rng = random.Random(5)
    keys = [(rng.choice([None, 1, 2, 30]), rng.choice([None, "", "a", "b\n"]), rng.choice([None, 0.0, float("nan"), 2.5])) for _ in range(500)]
    keys += [(7, "hot", 1.0)] * 1500 + [(None, None, None)] * 300
    return spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "i int, k int, s string, d double").repartition(5)


def test_dense_group_key_is_the_dense_rank(spark):
    rows = tagged(_rows(spark))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {r.i: r.n for r in dense_group_key(rows, ["k", "s", "d"], "n", 2300).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rank = F.dense_rank().over(Window.orderBy(*(F.col(c).asc_nulls_first() for c in ("k", "s", "d"))))
    assert got == {r.i: r.n for r in rows.select("i", rank.alias("n")).collect()}
    assert dense_group_key(rows.where("i < 0"), ["k"], "n").collect() == []


def test_fact_orders_are_those_of_the_order_table(spark):
    raw = spark.createDataFrame(
        [(i, c, d, "2020-01-02", m, "p", "f", 1, "2.00", "1.00", "1.00")
         for i, (c, d, m) in enumerate([(2, "x", "A"), (1, None, "B"), (2, "x", "A"), (None, "x", None), (1, None, "B"), (1, "y", "B")])],
        "`Unnamed: 0` int, `Customer ID` int, `Order Date` string, `Ship Date` string, `Ship Mode` string, `Product Name` string,"
        " Factory string, Units int, Sales string, Cost string, `Gross Profit` string")
    ids = spark.createDataFrame([("p", 1), ("f", 2)], "name string, id int")
    got = [tuple(r) for r in L.fact_load(raw, ids, ids).select("Financial Figures ID", "Order ID").collect()]
    numbered = dense_surrogate_key(raw.select(*L.ORDER_NATURAL_KEY).distinct(), L.ORDER_NATURAL_KEY, "Order ID", 6, distinct=True)
    joined = L.fact_load(raw, ids, ids, keyed_orders=numbered)
    assert sorted(got) == sorted(tuple(r) for r in joined.select("Financial Figures ID", "Order ID").collect())
    assert sorted(got) == [(1, 4), (2, 2), (3, 4), (4, 1), (5, 2), (6, 3)]
