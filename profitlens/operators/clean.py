"""V1: the clean fact view — typed money and a null-safe per-row gross margin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitlens.functions.measures import MONEY, cents

FACT_KEYS = ["Order ID", "Factory ID", "Product ID"]


def gross_margin_pct(sales="Sales", profit="Gross Profit"):
    """NULL when sales is NULL or 0, else ``100 * profit / sales`` rounded once, half away from zero, to
    two decimals (a double, H1).  Exact: whole hundredths from whole cents, all in ``long`` (at most
    20,000 times a 12-digit amount)."""
    s, g = cents(sales), cents(profit)
    size = F.call_function("div", F.lit(20000) * F.abs(g) + F.abs(s), F.nullif(F.lit(2) * F.abs(s), F.lit(0)))
    return F.when((g < 0) != (s < 0), -size).otherwise(size) / F.lit(100.0)


def clean_view(fact: DataFrame) -> DataFrame:
    """Cast units to int and money to DECIMAL(12,2); add ``gross_margin_pct``.

    Extra key columns of the fact (e.g. a surrogate id) are carried through untouched, so the
    view stays a pure projection: Catalyst inlines it into every report and prunes what a report
    does not read."""
    passthrough = [c for c in fact.columns if c not in ("Units", "Sales", "Cost", "Gross Profit")]
    return fact.select(
        *passthrough,
        F.col("Units").cast("int").alias("Units"),
        F.col("Sales").cast(MONEY).alias("Sales"),
        F.col("Cost").cast(MONEY).alias("Cost"),
        F.col("Gross Profit").cast(MONEY).alias("Gross Profit"),
    ).withColumn("gross_margin_pct", gross_margin_pct())
