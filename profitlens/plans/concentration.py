"""Profit concentration across factories and products (A23) and its chart datasets.

One scan of the clean view feeds all three aggregates (per factory, per product, grand total)
through ``GROUPING SETS``; that small result is materialised once, the factory and product rows
are read from it, and the grand total enters every row as a scalar subquery (no join).  Only the
product rows are joined to the product dimension, and the one-row total is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profitlens import constants as K
from profitlens.functions.measures import dollars, pct, sum_cents
from profitlens.operators.joins import scalar
from profitlens.operators.prefix import running_totals
from profitlens.operators.share import shared
from profitlens.operators.topk import top_n

FID, PID, PNAME = "Factory ID", "Product ID", "Product Name"

_SUMS = ["num_records", "total_sales", "total_cost", "total_gross_profit"]


def profit_concentration(v: DataFrame, product: DataFrame) -> DataFrame:
    """entity_type, entity_name, entity_id, volume / profit / sales shares and margin.

    Totals cover every fact row (before the product join, H19); factory names are the factory
    key, as in the reference."""
    g = shared(v.groupingSets([[FID], [PID], []], FID, PID).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("num_records"),
        sum_cents("Sales").alias("total_sales"),
        sum_cents("Cost").alias("total_cost"),
        sum_cents("Gross Profit").alias("total_gross_profit"),
    ))
    # the grand-total row, as one scalar subquery returning a struct
    totals = scalar(
        g.where(F.col("_set") == 3).select(
            F.struct(
                F.col("num_records").alias("txns"),
                F.col("total_sales").alias("sales"),
                F.col("total_gross_profit").alias("profit"),
            )
        )
    )
    factories = g.where(F.col("_set") == 1).select(
        F.lit(K.ENTITY_FACTORY).alias("entity_type"),
        F.col(FID).cast("string").alias("entity_name"),
        F.col(FID).cast("string").alias("entity_id"),
        *_SUMS,
    )
    products = (
        g.where(F.col("_set") == 2)
        .join(product.select(PID, PNAME), PID, "inner")
        .select(
            F.lit(K.ENTITY_PRODUCT).alias("entity_type"),
            F.col(PNAME).alias("entity_name"),
            F.col(PID).cast("string").alias("entity_id"),
            *_SUMS,
        )
    )
    c = factories.unionByName(products)
    return c.select(
        "entity_type",
        "entity_name",
        "entity_id",
        "num_records",
        pct(F.col("num_records"), totals.getField("txns")).alias("pct_transaction_volume"),
        dollars("total_cost").alias("total_cost"),
        dollars("total_sales").alias("total_sales"),
        dollars("total_gross_profit").alias("total_gross_profit"),
        pct("total_gross_profit", totals.getField("profit")).alias("pct_profit_share"),
        pct("total_sales", totals.getField("sales")).alias("pct_sales_share"),
        pct("total_gross_profit", "total_sales").alias("gross_margin_pct"),
    ).orderBy(F.col("total_gross_profit").desc(), "entity_type", "entity_id")


def _top_by_share(conc: DataFrame, entity_type: str, n: int, case_insensitive: bool = False) -> DataFrame:
    et = F.lower(F.col("entity_type")) == entity_type.lower() if case_insensitive else F.col("entity_type") == entity_type
    return top_n(conc.filter(et), [F.col("pct_profit_share").desc_nulls_last(), F.col("entity_id").asc()], n)


def pareto_profit_share(conc: DataFrame, entity_type: str = K.ENTITY_PRODUCT, top_n_: int = 10) -> DataFrame:
    """Top-n entities of a type by profit share with the running (cumulative) share.

    The running sum adds the reported (rounded) shares exactly, over at most n rows."""
    top = _top_by_share(conc, entity_type, top_n_)
    w = Window.orderBy(F.col("pct_profit_share").desc_nulls_last(), F.col("entity_id").asc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return top.withColumn(
        "cum_profit_share", F.sum(F.col("pct_profit_share").cast("decimal(18,2)")).over(w).cast("double")
    )


def running_profit_share(v: DataFrame) -> DataFrame:
    """W6/P1 over every product: profit, rank, and the running profit and share of the total, largest first.

    Shares are of exact running sums (P1 adds rounded shares over its few rows); ties go by product id."""
    sums = v.groupBy(PID).agg(sum_cents("Gross Profit").alias("profit_raw")).withColumn("one", F.lit(1))
    order = [F.col("profit_raw").desc_nulls_last(), F.col(PID).asc_nulls_first()]
    run = running_totals(sums, order, {"cum_raw": "profit_raw", "profit_rank": "one"})
    total = scalar(v.agg(sum_cents("Gross Profit")))
    return run.select(
        PID,
        dollars("profit_raw").alias("total_gross_profit"),
        F.col("profit_rank").cast("bigint").alias("profit_rank"),
        dollars("cum_raw").alias("cum_gross_profit"),
        pct("cum_raw", total).alias("cum_profit_share"),
    )


def volume_vs_margin(conc: DataFrame, entity_type: str = K.ENTITY_PRODUCT, top_n_: int = 25) -> DataFrame:
    """Scatter data — volume share vs margin for the top-n entities by profit share."""
    return _top_by_share(conc, entity_type, top_n_).select(
        "entity_type", "entity_name", "entity_id", "pct_transaction_volume", "gross_margin_pct", "pct_profit_share"
    )


def product_bubble(conc: DataFrame, top_n_: int = 15) -> DataFrame:
    """Bubble chart data — top products by share, bubble size = share × 40."""
    return _top_by_share(conc, K.ENTITY_PRODUCT, top_n_, case_insensitive=True).select(
        "entity_name",
        "entity_id",
        "pct_transaction_volume",
        "gross_margin_pct",
        "pct_profit_share",
        (F.col("pct_profit_share") * F.lit(40.0)).alias("bubble_size"),
    )


def top10_products_asc(conc: DataFrame, n: int = 10) -> DataFrame:
    """The n largest product shares, presented in ascending order."""
    return (
        _top_by_share(conc, K.ENTITY_PRODUCT, n, case_insensitive=True)
        .select("entity_name", "entity_id", "pct_profit_share")
        .orderBy(F.col("pct_profit_share").asc_nulls_first(), F.col("entity_id").desc())
    )
