"""Factory reports.

Factories are a key of the fact itself, so these plans need no dimension join at all: filter,
aggregate by ``Factory ID`` with partial aggregation, then rank/sort the per-factory rows.  The
month-stability report (A21) is the one plan that joins the fact to ``Order`` (big ⋈ big).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profitlens import constants as K
from profitlens.functions.bands import band_by_ranges, band_by_upper
from profitlens.functions.dates import month_start
from profitlens.functions.measures import avg_money, avg_pct, dollars, money_sum, pct, sum_cents
from profitlens.operators.joins import scalar
from profitlens.operators.share import shared
from profitlens.operators.topk import rank_filter, top_n

FID, PID, PNAME = "Factory ID", "Product ID", "Product Name"


def _m():
    return F.col("gross_margin_pct")


def _between(lo, hi):
    return (_m() >= lo) & (_m() <= hi)


def top_factories_high_margin(v: DataFrame, k: int = 10) -> DataFrame:
    """Top-k factories by profit inside ``40 <= m <= 100``, DENSE_RANK."""
    lo, hi = K.HIGH_MARGIN
    agg = shared(
        v.filter(_between(lo, hi))
        .groupBy(FID)
        .agg(
            F.count(F.lit(1)).alias("num_records"),
            sum_cents("Cost").alias("cost_raw"),
            sum_cents("Sales").alias("sales_raw"),
            sum_cents("Gross Profit").alias("profit_raw"),
        )
    )
    total_transactions = scalar(agg.agg(F.sum("num_records")))
    rows = agg.select(
        FID,
        "num_records",
        pct(F.col("num_records"), total_transactions).alias("pct_transaction_volume"),
        dollars("cost_raw").alias("total_cost"),
        dollars("sales_raw").alias("total_sales"),
        dollars("profit_raw").alias("gross_profit"),
        pct("profit_raw", "sales_raw").alias("gross_margin_pct"),
    )
    return rank_filter(rows, [F.col("gross_profit").desc()], k, "profit_rank", fn=F.dense_rank).orderBy(
        "profit_rank", FID
    )


def top_factories_per_band(v: DataFrame, k: int = 10) -> DataFrame:
    """Top-k factories per core band by the rounded profit, ROW_NUMBER (ties by id)."""
    lo, hi = K.CORE_BANDS[0][1], K.CORE_BANDS[-1][2]
    agg = (
        v.filter((_m() >= lo) & (_m() < hi))
        .groupBy(band_by_ranges(_m(), K.CORE_BANDS).alias("margin_band"), FID)
        .agg(
            F.count(F.lit(1)).alias("num_records"),
            money_sum("Cost").alias("total_cost"),
            money_sum("Sales").alias("total_sales"),
            money_sum("Gross Profit").alias("gross_profit"),
            avg_pct(_m()).alias("avg_margin_pct"),
        )
    )
    return rank_filter(
        agg, [F.col("gross_profit").desc(), F.col(FID).asc()], k, "rn", fn=F.row_number, partition=["margin_band"]
    ).orderBy("margin_band", "rn")


def factory_profit_high_margin(v: DataFrame) -> DataFrame:
    """Every factory over its rows with ``m >= 40`` (no upper cap)."""
    return (
        v.filter(_m() >= 40)
        .groupBy(FID)
        .agg(
            F.count(F.lit(1)).alias("num_records"),
            money_sum("Sales").alias("sales"),
            money_sum("Gross Profit").alias("gross_profit"),
            pct(sum_cents("Gross Profit"), sum_cents("Sales")).alias("gross_margin_pct"),
        )
        .orderBy(F.col("gross_profit").desc(), FID)
    )


def extreme_margin_factories(v: DataFrame) -> DataFrame:
    """Watch-list of factories with rows in ``80 <= m <= 100``."""
    lo, hi = K.EXTREME_MARGIN
    return (
        v.filter(_between(lo, hi))
        .groupBy(FID)
        .agg(
            F.count(F.lit(1)).alias("num_records"),
            money_sum("Cost").alias("total_cost"),
            money_sum("Sales").alias("total_sales"),
            money_sum("Gross Profit").alias("gross_profit"),
            avg_pct(_m()).alias("avg_margin_pct"),
            F.round(F.min(_m()), 2).alias("min_margin_pct"),
            F.round(F.max(_m()), 2).alias("max_margin_pct"),
        )
        .orderBy(F.col("avg_margin_pct").desc(), F.col("num_records").desc(), FID)
    )


def product_factory_dependency(v: DataFrame, product: DataFrame, k: int = 10) -> DataFrame:
    """For the top-k products (by profit in ``40..100``), each factory's contribution.

    One pass over the fact: rows are aggregated at (product, factory) grain and that
    intermediate is shared.  Product totals are sums of its rows; the top-k products (k rows,
    broadcast) select their (product, factory) rows; the per-product volume that divides the
    share comes from the same k products — no window over a product's factories, which could
    be one huge partition for a hot product."""
    lo, hi = K.HIGH_MARGIN
    pf = shared(
        v.filter(_between(lo, hi))
        .groupBy(PID, FID)
        .agg(
            F.count(F.lit(1)).alias("num_records"),
            sum_cents("Sales").alias("sales_raw"),
            sum_cents("Cost").alias("cost_raw"),
            sum_cents("Gross Profit").alias("profit_raw"),
        )
    )
    per_product = pf.groupBy(PID).agg(F.sum("profit_raw").alias("_p"), F.sum("num_records").alias("_product_rows"))
    top = top_n(
        per_product.join(product.select(PID, PNAME), PID, "inner"),
        [F.col("_p").desc(), F.col(PID).asc()],
        k,
    ).select(PID, PNAME, "_product_rows")
    return (
        pf.join(F.broadcast(top), PID, "inner")
        .select(
            PNAME,
            PID,
            FID,
            "num_records",
            pct(F.col("num_records"), F.col("_product_rows")).alias("pct_product_volume_in_factory"),
            dollars("cost_raw").alias("total_cost"),
            dollars("sales_raw").alias("total_sales"),
            dollars("profit_raw").alias("total_gross_profit"),
            pct("profit_raw", "sales_raw").alias("gross_margin_pct"),
        )
        .orderBy(PNAME, F.col("total_gross_profit").desc(), FID)
    )


def factory_margin_stability(v: DataFrame, order: DataFrame) -> DataFrame:
    """Factory × month × margin band counts, share of the factory-month, profit.

    fact ⋈ Order on ``Order ID`` is the large-large join of the catalogue: both sides are
    projected to the join key plus what the aggregate needs before the shuffle, the order side
    is filtered to non-null dates first, and AQE splits a skewed order key at run time.  The
    window afterwards partitions by (factory, month) over at most ten band rows each."""
    o = order.where(F.col("Order Date").isNotNull()).select("Order ID", "Order Date")
    f = v.select("Order ID", FID, "gross_margin_pct", "Gross Profit")
    banded = f.join(o, "Order ID").select(
        FID,
        month_start("Order Date").alias("month_start"),
        band_by_upper(_m(), K.TEN_BANDS, K.TEN_BAND_UPPER).alias("margin_band"),
        "Gross Profit",
    )
    agg = banded.groupBy(FID, "month_start", "margin_band").agg(
        F.count(F.lit(1)).alias("num_records"), money_sum("Gross Profit").alias("total_profit_in_band")
    )
    month = Window.partitionBy(FID, "month_start")
    return agg.select(
        FID,
        "month_start",
        "margin_band",
        "num_records",
        pct(F.col("num_records"), F.sum("num_records").over(month)).alias("pct_volume_in_month"),
        "total_profit_in_band",
    ).orderBy(FID, "month_start", "margin_band")


def factory_unit_economics(v: DataFrame) -> DataFrame:
    """Cost, sales and profit per transaction inside ``40 <= m <= 100``."""
    lo, hi = K.HIGH_MARGIN
    return (
        v.filter(_between(lo, hi))
        .groupBy(FID)
        .agg(
            F.count(F.lit(1)).alias("num_records"),
            money_sum("Cost").alias("total_cost"),
            money_sum("Sales").alias("total_sales"),
            money_sum("Gross Profit").alias("total_gross_profit"),
            avg_money("Cost").alias("avg_cost_per_txn"),
            avg_money("Sales").alias("avg_sales_per_txn"),
            avg_money("Gross Profit").alias("avg_profit_per_txn"),
            pct(sum_cents("Gross Profit"), sum_cents("Sales")).alias("gross_margin_pct"),
        )
        .orderBy(F.col("avg_profit_per_txn").desc(), F.col("gross_margin_pct").desc(), FID)
    )
