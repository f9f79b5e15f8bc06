"""Product reports (A10-A15, A24-A31, G5) and their chart datasets.

Shape of every plan: filter the clean view → aggregate by ``Product ID`` (partial aggregation in
each task, one shuffle) → attach the product name to the aggregated rows → rank / sort.  The
dimension join therefore sees one row per product instead of one per order line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitlens import constants as K
from profitlens.functions.bands import band_by_ranges
from profitlens.functions.measures import average, avg_pct, dollars, money_sum, pct, per_unit, ratio, sum_cents, unrounded
from profitlens.operators.joins import attach_dim, scalar
from profitlens.operators.share import shared
from profitlens.operators.topk import first_and_last, rank_filter, top_n

PID, PNAME = "Product ID", "Product Name"
_EXACT = "_unrounded_margin"


def _m():
    return F.col("gross_margin_pct")


def _between(lo, hi):
    return (_m() >= lo) & (_m() <= hi)


def _named(agg: DataFrame, product: DataFrame) -> DataFrame:
    """Inner join to Product (drops facts without a resolvable product, as the reference does)."""
    return attach_dim(agg, product, PID, [PNAME])


# -- high-margin product ranking ---------------------------------------------------------------
def top_products_high_margin(v: DataFrame, product: DataFrame, k: int = 10) -> DataFrame:
    """A10: top-k products by profit inside ``40 <= m <= 100``, RANK (ties kept).

    The volume share's denominator counts every row of the universe, before the product join
    (H19): it is the sum of the per-product counts, read from the same materialised aggregate
    as the product rows, so the fact is scanned once."""
    lo, hi = K.HIGH_MARGIN
    agg = shared(
        v.filter(_between(lo, hi))
        .groupBy(PID)
        .agg(
            F.count(F.lit(1)).alias("num_records"),
            sum_cents("Cost").alias("cost_raw"),
            sum_cents("Sales").alias("sales_raw"),
            sum_cents("Gross Profit").alias("profit_raw"),
        )
    )
    total_transactions = scalar(agg.agg(F.sum("num_records")))
    rows = _named(agg, product).select(
        PNAME,
        PID,
        "num_records",
        pct(F.col("num_records"), total_transactions).alias("pct_transaction_volume"),
        dollars("cost_raw").alias("total_cost"),
        dollars("sales_raw").alias("sales"),
        dollars("profit_raw").alias("gross_profit"),
        pct("profit_raw", "sales_raw").alias("gross_margin_pct"),
    )
    return rank_filter(rows, [F.col("gross_profit").desc()], k, "profit_rank").orderBy("profit_rank", PID)


def top_products_in_band(v: DataFrame, product: DataFrame, label: str, lo: float, hi: float, k: int = 10) -> DataFrame:
    """Top-k products by profit inside ``lo <= m < hi`` (LIMIT; ties by Product ID)."""
    agg = (
        v.filter((_m() >= lo) & (_m() < hi))
        .groupBy(PID)
        .agg(
            F.count(F.lit(1)).alias("num_records"),
            money_sum("Sales").alias("sales"),
            money_sum("Gross Profit").alias("gross_profit"),
            avg_pct(_m()).alias("avg_margin_pct"),
        )
    )
    rows = _named(agg, product).select(
        F.lit(label).alias("margin_band"), PNAME, PID, "num_records", "sales", "gross_profit", "avg_margin_pct"
    )
    return top_n(rows, [F.col("gross_profit").desc(), F.col(PID).asc()], k)


def top_products_per_band(v: DataFrame, product: DataFrame, k: int = 10) -> DataFrame:
    """Top-k products per core band (60–70, 70–80) by the unrounded profit, ROW_NUMBER."""
    lo, hi = K.CORE_BANDS[0][1], K.CORE_BANDS[-1][2]
    agg = (
        v.filter((_m() >= lo) & (_m() < hi))
        .groupBy(band_by_ranges(_m(), K.CORE_BANDS).alias("margin_band"), PID)
        .agg(
            F.count(F.lit(1)).alias("num_records"),
            sum_cents("Sales").alias("sales_raw"),
            sum_cents("Cost").alias("cost_raw"),
            sum_cents("Gross Profit").alias("profit_raw"),
            avg_pct(_m()).alias("avg_margin_pct"),
        )
    )
    rows = _named(agg, product)
    ranked = rank_filter(
        rows, [F.col("profit_raw").desc(), F.col(PID).asc()], k, "rn", fn=F.row_number, partition=["margin_band"]
    )
    return ranked.select(
        "margin_band",
        PNAME,
        PID,
        "num_records",
        dollars("sales_raw").alias("sales"),
        dollars("cost_raw").alias("cost"),
        dollars("profit_raw").alias("gross_profit"),
        "avg_margin_pct",
        "rn",
    ).orderBy("margin_band", "rn")


def low_margin_products(v: DataFrame, product: DataFrame) -> DataFrame:
    """Products over their rows with ``m < 10``; margin recomputed from the sums."""
    agg = (
        v.filter(_m() < 10)
        .groupBy(PID)
        .agg(
            F.count(F.lit(1)).alias("num_records"),
            sum_cents("Sales").alias("sales_raw"),
            sum_cents("Gross Profit").alias("profit_raw"),
        )
    )
    return _named(agg, product).select(
        PNAME,
        PID,
        "num_records",
        dollars("sales_raw").alias("sales"),
        dollars("profit_raw").alias("gross_profit"),
        pct("profit_raw", "sales_raw").alias("gross_margin_pct"),
    ).orderBy(F.col("sales").desc(), PID)


def extreme_margin_products(v: DataFrame, product: DataFrame) -> DataFrame:
    """Watch-list of products with rows in ``80 <= m <= 100``."""
    lo, hi = K.EXTREME_MARGIN
    agg = (
        v.filter(_between(lo, hi))
        .groupBy(PID)
        .agg(
            F.count(F.lit(1)).alias("num_records"),
            money_sum("Sales").alias("sales"),
            money_sum("Cost").alias("total_cost"),
            money_sum("Gross Profit").alias("gross_profit"),
            avg_pct(_m()).alias("avg_margin_pct"),
            F.round(F.min(_m()), 2).alias("min_margin_pct"),
            F.round(F.max(_m()), 2).alias("max_margin_pct"),
            average(sum_cents("Cost"), F.count(F.lit(1))).alias("avg_cost_per_txn"),
        )
    )
    return _named(agg, product).select(
        PNAME, PID, "num_records", "sales", "total_cost", "gross_profit",
        "avg_margin_pct", "min_margin_pct", "max_margin_pct", "avg_cost_per_txn",
    ).orderBy(F.col("avg_margin_pct").desc(), F.col("num_records").desc(), PID)


# -- product profitability (load-side SQL and notebooks) ------------------------------------------
def _product_sums(ff: DataFrame) -> DataFrame:
    return ff.groupBy(PID).agg(
        sum_cents("Sales").alias("sales_raw"),
        sum_cents("Cost").alias("cost_raw"),
        sum_cents("Gross Profit").alias("profit_raw"),
        F.sum("Units").alias("units_raw"),
    )


def _profitability_rows(ff: DataFrame, product: DataFrame) -> DataFrame:
    """A24's rows, unordered, with the unrounded margin that they are ranked by."""
    return _named(_product_sums(ff), product).select(
        PID,
        PNAME,
        dollars("sales_raw").alias("total_sales"),
        dollars("cost_raw").alias("total_cost"),
        dollars("profit_raw").alias("total_gross_profit"),
        ratio("profit_raw", "sales_raw").alias("profit_margin"),
        per_unit("profit_raw", "units_raw").alias("profit_per_unit"),
        unrounded(dollars("profit_raw"), dollars("sales_raw")).alias(_EXACT),
    )


def product_profitability(ff: DataFrame, product: DataFrame) -> DataFrame:
    """Per-product totals, margin and profit per unit, best margin first."""
    return _profitability_rows(ff, product).orderBy(F.col(_EXACT).desc_nulls_last(), PID).drop(_EXACT)


def _extremes(rows: DataFrame, best: bool, n: int) -> DataFrame:
    """The n best or worst by the unrounded margin; NULL margins are the worst, as in MySQL."""
    order = F.col(_EXACT).desc_nulls_last() if best else F.col(_EXACT).asc_nulls_first()
    return top_n(rows, [order, F.col(PID).asc()], n).select(PID, PNAME, "total_sales", "total_gross_profit", "profit_margin")


def best_products_by_margin(ff: DataFrame, product: DataFrame, n: int = 5) -> DataFrame:
    """Highest margins."""
    return _extremes(_profitability_rows(ff, product), True, n)


def worst_products_by_margin(ff: DataFrame, product: DataFrame, n: int = 5) -> DataFrame:
    """Lowest margins."""
    return _extremes(_profitability_rows(ff, product), False, n)


def best_worst_6_products(ff: DataFrame, product: DataFrame) -> DataFrame:
    """Six best and six worst products by margin, labelled; the fact is aggregated once."""
    rows = shared(_profitability_rows(ff, product))
    best = _extremes(rows, True, 6).withColumn("position", F.lit("best"))
    worst = _extremes(rows, False, 6).withColumn("position", F.lit("worst"))
    return best.unionByName(worst).select("position", PID, PNAME, "total_sales", "total_gross_profit", "profit_margin")


def _name_totals(ff: DataFrame, product: DataFrame) -> DataFrame:
    named = _named(_product_sums(ff), product).filter(F.col(PNAME).isNotNull())
    sums = named.groupBy(PNAME).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sales_raw", "cost_raw", "profit_raw", "units_raw")])
    return sums.select(
        PNAME,
        dollars("sales_raw").alias("sales"),
        dollars("cost_raw").alias("cost"),
        dollars("profit_raw").alias("gross_profit"),
        F.col("units_raw").cast("bigint").alias("units"),
        "sales_raw",
        "profit_raw",
    )


def product_totals(ff: DataFrame, product: DataFrame) -> DataFrame:
    """Sales, cost, profit and units per product *name*, by profit desc.

    Two-phase: totals per Product ID (the big aggregation), then names attached to those rows
    and re-summed per name (several ids may share a name).  Nameless rows are dropped and empty
    sums are 0, as a pandas groupby-sum gives (H17)."""
    return _name_totals(ff, product).drop("sales_raw", "profit_raw").orderBy(F.col("gross_profit").desc(), PNAME)


def _margin_rows(ff: DataFrame, product: DataFrame) -> DataFrame:
    """A28's rows, unordered, with the unrounded margin that they are ranked by."""
    return _name_totals(ff, product).select(
        "*",
        ratio("profit_raw", "sales_raw").alias("profit_margin"),
        per_unit("profit_raw", "units").alias("profit_per_unit"),
        unrounded("profit_raw", "sales_raw").alias(_EXACT),
    ).drop("sales_raw")


def product_margin_table(ff: DataFrame, product: DataFrame) -> DataFrame:
    """Product totals plus margin and profit per unit, best margin first (NULL, not inf)."""
    return _margin_rows(ff, product).orderBy(F.col(_EXACT).desc_nulls_last(), PNAME).drop(_EXACT, "profit_raw")


def _first_and_last_by(ff: DataFrame, product: DataFrame, key: str) -> DataFrame:
    return first_and_last(
        _margin_rows(ff, product).select(PNAME, "sales", "gross_profit", "profit_margin", "profit_per_unit", _EXACT),
        [F.col(key).desc_nulls_last(), F.col(PNAME).asc()],
        [F.col(key).asc_nulls_first(), F.col(PNAME).desc()],
    ).drop(_EXACT)


def best_worst_product_by_margin(ff: DataFrame, product: DataFrame) -> DataFrame:
    """First and last row of the margin table (NULL margins sort last, as pandas does)."""
    return _first_and_last_by(ff, product, _EXACT)


def best_worst_product_by_gp(ff: DataFrame, product: DataFrame) -> DataFrame:
    """First and last product by gross profit."""
    return _first_and_last_by(ff, product, "gross_profit")


def product_profit_share(ff: DataFrame, product: DataFrame) -> DataFrame:
    """Each product's fraction of the total profit (total taken from the same rows)."""
    t = shared(_margin_rows(ff, product).drop(_EXACT))
    total_profit = scalar(t.agg(F.sum("profit_raw")))
    return t.withColumn("profit_share", ratio("profit_raw", total_profit)).orderBy(
        unrounded("profit_raw", total_profit).asc_nulls_first(), PNAME
    ).drop("profit_raw")


def chart_product_gp(ff: DataFrame, product: DataFrame) -> DataFrame:
    """Bars of total profit per product (margin-table order)."""
    return product_margin_table(ff, product).select(PNAME, "gross_profit")


def chart_product_margin(ff: DataFrame, product: DataFrame) -> DataFrame:
    """Horizontal bars of margin, ascending."""
    return _margin_rows(ff, product).orderBy(F.col(_EXACT).asc_nulls_first(), PNAME).select(PNAME, "profit_margin")


def chart_product_share(ff: DataFrame, product: DataFrame) -> DataFrame:
    """Horizontal bars of profit share, ascending."""
    return product_profit_share(ff, product).select(PNAME, "profit_share")
