"""Reports over the materialised star equal the reports over the source tables, and the margin
filter reaches the parquet scan."""

import pytest

from profitlens.plans.catalog import REPORTS, portable
from profitlens.sources.proxy import Star
from profitlens.sources.stored import materialize_star
from profitlens.verify import compare

from conftest import SF_SMALL

REPORT_NAMES = [
    "kpi_totals", "margin_volume_all_bands", "sub_band_share", "top_products_high_margin",
    "product_factory_dependency", "factory_margin_stability", "profit_concentration",
    "customer_profit", "top_cities_best_region", "loss_makers",
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    return materialize_star(Star(spark, SF_SMALL), str(tmp_path_factory.mktemp("star")))


@pytest.mark.parametrize("name", REPORT_NAMES)
def test_stored_star_gives_the_same_reports(spark, stored, name):
    a = portable(REPORTS[name](Star(spark, SF_SMALL)))
    b = portable(REPORTS[name](stored))
    assert compare(a.columns, [tuple(r) for r in a.collect()], b.columns, [tuple(r) for r in b.collect()]) == "ok"


def test_margin_filter_is_pushed_to_parquet(stored):
    import contextlib
    import io

    from profitlens.plans.overall import sub_band_share

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        sub_band_share(stored.v).explain()
    plan = buf.getvalue()
    assert "PushedFilters: [IsNotNull(gross_margin_pct), GreaterThanOrEqual(gross_margin_pct,40.0)" in plan
