"""t3: the reports reproduce the reference's exported results on the replay fixture.

The expected tables are the reference's exported CSV files, stated here verbatim (fixed values)
and read back through the exported-CSV source (S3), literal ``NULL`` included."""

import os

import pytest

from profitlens.operators.clean import clean_view
from profitlens.plans import concentration as C
from profitlens.plans import overall as O
from profitlens.sources.files import read_interim_csv
from profitlens.verify import compare
from replay_fixture import replay_tables

# FIXED VALUES — exported results of the reference (CSV text as published)
GOLDEN = {
    "count_financial_figures_rows": "total_rows\n7957\n",
    "key_metrics_missing_values_check": "null_sales,null_cost,null_profit\n0,0,0\n",
    "check_negative_gross_profit": "loss_rows\n0\n",
    "overall_profitability_kpis": 'metric,amount\nSales,111471.06\nCost,38951.06\n"Gross Profit",72520.00\n',
    "margin_group_profit_summary": "margin_group,num_records,total_profit\n<10%,96,92.75\n>=40%,7861,72427.25\n",
    "overall_margin_volume": """margin_band,num_records,pct_transaction_volume,total_profit,avg_margin_pct
0–9.99%,96,1.21,92.75,7.69
10–19.99%,0,0.00,0.00,NULL
20–29.99%,0,0.00,0.00,NULL
30–39.99%,0,0.00,0.00,NULL
40–49.99%,17,0.21,40.50,45.49
50–59.99%,210,2.64,4100.70,51.14
60–69.99%,5838,73.37,51529.19,65.59
70–79.99%,1793,22.53,16652.86,71.36
80–89.99%,3,0.04,104.00,80
90–100%,0,0.00,0.00,NULL
""",
    "profit_concentration": """entity_type,entity_name,entity_id,num_records,pct_transaction_volume,total_cost,total_sales,total_gross_profit,pct_profit_share,pct_sales_share,gross_margin_pct
Factory,"Wicked Choccy's","Wicked Choccy's",4060,51.02,18855.86,54084.25,35228.39,48.58,48.52,65.14
Factory,"Lot's O' Nuts","Lot's O' Nuts",3567,44.83,14814.40,47708.56,32894.16,45.36,42.80,68.95
Product,"Wonka Bar - Triple Dazzle Caramel",WBTC,1989,25.00,9737.00,28087.50,18350.50,25.30,25.20,65.33
Product,"Wonka Bar - Milk Chocolate",WBMC,2071,26.03,9118.86,25996.75,16877.89,23.27,23.32,64.92
Product,"Wonka Bar - Nutty Crunch Surprise",WBNS,1789,22.48,6664.00,23257.36,16593.36,22.88,20.86,71.35
Product,"Wonka Bar - Fudge Mallows",WBFM,1778,22.35,8150.40,24451.20,16300.80,22.48,21.94,66.67
Factory,"Secret Factory","Secret Factory",213,2.68,4102.80,8307.50,4204.70,5.80,7.45,50.61
Product,"Lickable Wallpaper",LW,90,1.13,3790.00,7580.00,3790.00,5.23,6.80,50.00
Product,"Wonka Gum",WG,120,1.51,286.80,597.50,310.70,0.43,0.54,52.00
Factory,"The Other Factory","The Other Factory",100,1.26,1130.00,1282.25,152.25,0.21,1.15,11.87
Product,"Everlasting Gobstopper",EG,3,0.04,26.00,130.00,104.00,0.14,0.12,80.00
Product,Kazookles,KK,96,1.21,1113.00,1205.75,92.75,0.13,1.08,7.69
Product,"Hair Toffee",HT,4,0.05,17.00,76.50,59.50,0.08,0.07,77.78
Factory,"Sugar Shack","Sugar Shack",17,0.21,48.00,88.50,40.50,0.06,0.08,45.76
Product,SweeTARTS,ST,10,0.13,32.80,61.50,28.70,0.04,0.06,46.67
Product,Nerds,ND,4,0.05,8.00,15.00,7.00,0.01,0.01,46.67
Product,"Fun Dip",FD,3,0.04,7.20,12.00,4.80,0.01,0.01,40.00
""",
}

NUMERIC = [
    "total_rows", "null_sales", "null_cost", "null_profit", "loss_rows", "amount", "num_records",
    "total_profit", "pct_transaction_volume", "avg_margin_pct", "total_cost", "total_sales",
    "total_gross_profit", "pct_profit_share", "pct_sales_share", "gross_margin_pct",
]


@pytest.fixture(scope="module")
def replay(spark):
    fact, product = replay_tables(spark)
    return fact, clean_view(fact), product


def _golden(spark, tmp_out, name):
    path = os.path.join(tmp_out, f"{name}.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(GOLDEN[name])
    return read_interim_csv(spark, path, numeric=NUMERIC)


REPORTS = {
    "count_financial_figures_rows": lambda f, v, p: O.row_count(f),
    "key_metrics_missing_values_check": lambda f, v, p: O.null_counts(f),
    "check_negative_gross_profit": lambda f, v, p: O.loss_rows(f),
    "overall_profitability_kpis": lambda f, v, p: O.chart_overall_kpis(v),
    "margin_group_profit_summary": lambda f, v, p: O.margin_groups(v),
    "overall_margin_volume": lambda f, v, p: O.margin_volume_all_bands(v),
    "profit_concentration": lambda f, v, p: C.profit_concentration(v, p),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_report_reproduces_exported_result(spark, replay, tmp_out, name):
    got = REPORTS[name](*replay)
    want = _golden(spark, tmp_out, name)
    g_rows = [tuple(r) for r in got.collect()]
    w_rows = [tuple(r) for r in want.collect()]
    assert compare(got.columns, g_rows, want.columns, w_rows) == "ok"


def test_replay_fixture_has_the_published_size(replay):
    fact, v, product = replay
    assert fact.count() == 7957
    assert product.count() == 12


def test_no_product_is_shared_between_factories(replay):
    from profitlens.operators.quality import shared_products

    assert shared_products(replay[0]).count() == 0
