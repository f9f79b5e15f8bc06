"""Plan-shape checks: the properties the scale design relies on, read from ``explain``."""

import contextlib
import io

import pytest


from profitlens.plans.catalog import spark_queries

from conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: _plan(fn(spark, SF_SMALL)) for name, fn in spark_queries().items()}


def test_no_python_and_no_cartesian_product_anywhere(plans):
    for name, plan in plans.items():
        assert "EvalPython" not in plan, name
        assert "CartesianProduct" not in plan, name


def test_no_nested_loop_or_cross_join_anywhere(plans):
    # totals enter rows as scalar subqueries, ranges as equi-joins
    for name, plan in plans.items():
        assert "NestedLoopJoin" not in plan, name


def test_band_table_report_uses_an_equi_join(plans):
    plan = plans["margin_volume_all_bands"]
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BroadcastHashJoin" in plan and "RightOuter" in plan


@pytest.mark.parametrize("name", ["top_products_high_margin", "top_factories_high_margin",
                                  "top_products_per_band", "top_factories_per_band"])
def test_rank_filters_are_pruned_before_the_window(plans, name):
    assert "WindowGroupLimit" in plans[name]


def test_scans_read_only_needed_columns(plans):
    plan = plans["kpi_totals"]
    line = next(x for x in plan.splitlines() if "FileScan parquet" in x and "lineitem" in x)
    assert "l_shipdate" not in line and "l_returnflag" not in line and "l_suppkey" not in line
