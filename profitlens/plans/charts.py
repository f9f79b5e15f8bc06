"""Chart datasets with their printed labels (P5, P6); the figures themselves are not drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitlens.plans.overall import margin_groups, margin_volume_all_bands


def chart_margin_groups(v: DataFrame) -> DataFrame:
    """P5: profit per margin group with an ``"1,234 rows"`` label."""
    return margin_groups(v).withColumn(
        "label", F.concat(F.format_number(F.col("num_records"), 0), F.lit(" rows"))
    )


def chart_band_volume(v: DataFrame) -> DataFrame:
    """Volume share per band with a ``"12.34%"`` label."""
    return margin_volume_all_bands(v).select(
        "margin_band",
        "pct_transaction_volume",
        F.concat(F.format_number(F.col("pct_transaction_volume"), 2), F.lit("%")).alias("label"),
    )


def chart_band_profit(v: DataFrame) -> DataFrame:
    """Profit per band with a ``"1,234.56"`` label."""
    return margin_volume_all_bands(v).select(
        "margin_band",
        "total_profit",
        F.format_number(F.col("total_profit"), 2).alias("label"),
    )
