"""t4: the semantic hazards — NULL/zero sales, negative margins, band boundaries, margins above
100, ties — on a hand-made fact."""

from decimal import Decimal as D

import pytest

from profitlens.operators.clean import clean_view
from profitlens.plans import overall as O
from profitlens.plans import products as P

SCHEMA = "`Order ID` long, `Factory ID` string, `Product ID` string, Units int, Sales decimal(12,2), Cost decimal(12,2), `Gross Profit` decimal(12,2)"


def _row(i, sales, cost, pid="A", fid="F1"):
    gp = None if sales is None or cost is None else D(sales) - D(cost)
    return (i, fid, pid, 1, None if sales is None else D(sales), None if cost is None else D(cost), gp)


CASES = [
    _row(1, None, "1.00"),      # sales NULL -> margin NULL
    _row(2, "0.00", "1.00"),    # sales 0 -> margin NULL
    _row(3, "100.00", "150.00"),  # margin -50
    _row(4, "100.00", "100.00"),  # margin 0
    _row(5, "100.00", "90.00"),   # margin 10
    _row(6, "100.00", "60.00"),   # margin 40
    _row(7, "100.00", "40.00"),   # margin 60
    _row(8, "100.00", "30.00"),   # margin 70
    _row(9, "100.00", "20.00"),   # margin 80
    _row(10, "100.00", "10.00"),  # margin 90
    _row(11, "100.00", "0.00"),   # margin 100
    _row(12, "200.00", "-1.00"),  # margin 100.5
    _row(13, "100.00", "-50.00"),  # margin 150
]


@pytest.fixture(scope="module")
def v(spark):
    return clean_view(spark.createDataFrame(CASES, SCHEMA))


def _as_dict(df, key, val):
    return {r[key]: r[val] for r in df.collect()}


def test_margin_is_null_for_missing_or_zero_sales(v):
    m = {r["Order ID"]: r.gross_margin_pct for r in v.collect()}
    assert m[1] is None and m[2] is None
    assert m[3] == -50.0 and m[5] == 10.0 and m[11] == 100.0 and m[12] == 100.5 and m[13] == 150.0


def test_five_bands_put_null_and_high_margins_in_else(v):
    got = _as_dict(O.margin_distribution(v), "margin_band", "num_records")
    # NULL x2 and 40..150 x8 fall to '>=40%'; -50, 0 -> '<10%'; 10 -> '10–19.99%'
    assert got == {"<10%": 2, "10–19.99%": 1, ">=40%": 10}


def test_quick_split_counts_null_nowhere(v):
    r = O.margin_quick_split(v).collect()[0]
    assert (r.lt_10, r.btw_10_40, r.ge_40) == (2, 1, 8)


def test_sub_bands_leave_margins_above_100_unlabelled(v):
    got = _as_dict(O.margin_sub_bands(v), "margin_sub_band", "num_records")
    assert got == {"40–49.99%": 1, "60–69.99%": 1, "70–79.99%": 1, "80–89.99%": 1, "90–100%": 2, None: 2}


def test_band_table_keeps_empty_bands_and_ends_at_101(v):
    rows = {r.margin_band: r for r in O.margin_volume_all_bands(v).collect()}
    assert len(rows) == 10
    # negative, NULL and 150 belong to no band; 100.5 is inside [90, 101)
    assert rows["0–9.99%"].num_records == 1
    assert rows["90–100%"].num_records == 3
    assert rows["20–29.99%"].num_records == 0 and rows["20–29.99%"].total_profit == 0.0
    assert rows["20–29.99%"].avg_margin_pct is None
    assert sum(r.num_records for r in rows.values()) == 9
    assert sum(r.pct_transaction_volume for r in rows.values()) == pytest.approx(100.0, abs=0.05)


def test_sub_band_share_caps_at_100(v):
    rows = O.sub_band_share(v).collect()
    assert sum(r.num_records for r in rows) == 6  # 40, 60, 70, 80, 90, 100
    assert {r.margin_sub_band for r in rows} == {"40–49.99%", "60–69.99%", "70–79.99%", "80–89.99%", "90–100%"}


def test_over_100_counter(v):
    assert O.margin_over_100(v).collect()[0].margin_over_100 == 2


def test_ties_break_by_product_id(spark):
    rows = [_row(i, "100.00", "50.00", pid=p) for i, p in enumerate(["B", "A", "C"])]
    v = clean_view(spark.createDataFrame(rows, SCHEMA))
    product = spark.createDataFrame([(p, None, f"name {p}", None) for p in "ABC"],
                                    "`Product ID` string, `Factory ID` string, `Product Name` string, Division string")
    top = P.top_products_in_band(v, product, "40–49.99%", 40, 60, k=2).collect()
    assert [r["Product ID"] for r in top] == ["A", "B"]
    ranked = P.top_products_high_margin(v, product).collect()
    assert {r.profit_rank for r in ranked} == {1}  # RANK keeps ties
