"""Overall profitability and margin-band reports.

Every report here is a single global or low-cardinality aggregation over the clean view: one
scan, partial aggregation in each task, and a shuffle of at most a handful of rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profitlens import constants as K
from profitlens.functions.bands import (
    band_by_ranges,
    band_by_upper,
    band_table_df,
    range_table_label,
    three_group,
)
from profitlens.functions.measures import average, avg_pct, dollars, hundredths, money_sum, pct, sum_cents
from profitlens.operators.intervals import range_join
from profitlens.operators.joins import scalar
from profitlens.operators.share import shared

MARGIN = "gross_margin_pct"
PROFIT = "Gross Profit"


def _m():
    return F.col(MARGIN)


def _gp():
    return F.col(PROFIT)


def _n_if(cond) -> F.Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` as bigint."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def _order_by_labels(df: DataFrame, col: str, labels) -> DataFrame:
    """ORDER BY CASE label WHEN l0 THEN 1 ... (O2), unknown labels last."""
    pos = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(col))
    return df.orderBy(F.when(pos == 0, F.lit(len(labels) + 1)).otherwise(pos).asc_nulls_last())


# -- data-quality checks on the base fact (Q1-Q6) ----------------------------------------------
def row_count(ff: DataFrame) -> DataFrame:
    return ff.agg(F.count(F.lit(1)).alias("total_rows"))


def null_counts(ff: DataFrame) -> DataFrame:
    return ff.agg(
        _n_if(F.col("Sales").isNull()).alias("null_sales"),
        _n_if(F.col("Cost").isNull()).alias("null_cost"),
        _n_if(_gp().isNull()).alias("null_profit"),
    )


def loss_rows(ff: DataFrame) -> DataFrame:
    return ff.filter(_gp() < 0).agg(F.count(F.lit(1)).alias("loss_rows"))


def zero_profit_rows(ff: DataFrame) -> DataFrame:
    return ff.filter(_gp() == 0).agg(F.count(F.lit(1)).alias("zero_profit_rows"))


def cost_gt_sales(ff: DataFrame) -> DataFrame:
    return ff.filter(F.col("Cost") > F.col("Sales")).agg(F.count(F.lit(1)).alias("cost_greater_than_sales"))


def margin_over_100(v: DataFrame) -> DataFrame:
    return v.filter(_m() > 100).agg(F.count(F.lit(1)).alias("margin_over_100"))


def quality_summary(ff: DataFrame) -> DataFrame:
    """Q1-Q5 folded into one pass over the fact (one scan instead of five)."""
    return ff.agg(
        F.count(F.lit(1)).alias("total_rows"),
        _n_if(F.col("Sales").isNull()).alias("null_sales"),
        _n_if(F.col("Cost").isNull()).alias("null_cost"),
        _n_if(_gp().isNull()).alias("null_profit"),
        F.count_if(_gp() < 0).alias("loss_rows"),
        F.count_if(_gp() == 0).alias("zero_profit_rows"),
        F.count_if(F.col("Cost") > F.col("Sales")).alias("cost_greater_than_sales"),
    )


# -- KPIs ------------------------------------------------------------------------------------
def kpi_totals(v: DataFrame) -> DataFrame:
    """A1: total sales, cost, profit and the guarded overall margin."""
    return v.agg(
        money_sum("Sales").alias("total_sales"),
        money_sum("Cost").alias("total_cost"),
        money_sum("Gross Profit").alias("total_gross_profit"),
        pct(sum_cents("Gross Profit"), sum_cents("Sales")).alias("gross_margin_pct"),
    )


def kpi_margin(v: DataFrame) -> DataFrame:
    """The headline margin only."""
    return v.agg(pct(sum_cents("Gross Profit"), sum_cents("Sales")).alias("gross_margin_pct"))


def chart_overall_kpis(v: DataFrame) -> DataFrame:
    """(metric, amount) for Sales, Cost, Gross Profit — one scan, then unpivot."""
    totals = v.agg(
        money_sum("Sales").alias("Sales"),
        money_sum("Cost").alias("Cost"),
        money_sum("Gross Profit").alias("Gross Profit"),
    )
    return totals.unpivot([], K.KPI_METRICS, "metric", "amount")


# -- margin distributions ----------------------------------------------------------------------
def margin_distribution(v: DataFrame) -> DataFrame:
    """A2: five bands by upper bound; NULL margins fall into ``>=40%`` (H3)."""
    out = (
        v.groupBy(band_by_upper(_m(), K.FIVE_BANDS, K.FIVE_BAND_UPPER).alias("margin_band"))
        .agg(F.count(F.lit(1)).alias("num_records"), money_sum("Gross Profit").alias("total_profit"))
    )
    return _order_by_labels(out, "margin_band", K.FIVE_BANDS)


def margin_min_max_avg(v: DataFrame) -> DataFrame:
    """A3."""
    return v.agg(
        F.round(F.min(_m()), 2).alias("min_margin_pct"),
        F.round(F.max(_m()), 2).alias("max_margin_pct"),
        avg_pct(_m()).alias("avg_margin_pct"),
    )


def margin_quick_split(v: DataFrame) -> DataFrame:
    """A4: NULL margins are counted in none of the three (H3)."""
    return v.agg(
        _n_if(_m() < 10).alias("lt_10"),
        _n_if((_m() >= 10) & (_m() < 40)).alias("btw_10_40"),
        _n_if(_m() >= 40).alias("ge_40"),
    )


def margin_sub_bands(v: DataFrame) -> DataFrame:
    """A5: bands inside ``m >= 40`` with no upper cap; ``m > 100`` gets a NULL band (H5)."""
    out = (
        v.filter(_m() >= 40)
        .groupBy(band_by_ranges(_m(), K.SUB_BANDS, closed_last=True).alias("margin_sub_band"))
        .agg(F.count(F.lit(1)).alias("num_records"), money_sum("Gross Profit").alias("total_profit"))
    )
    return _order_by_labels(out, "margin_sub_band", [b[0] for b in K.SUB_BANDS])


def margin_groups(v: DataFrame) -> DataFrame:
    """Three groups; empty groups are absent (plain GROUP BY)."""
    out = v.groupBy(three_group(_m()).alias("margin_group")).agg(
        F.count(F.lit(1)).alias("num_records"), money_sum("Gross Profit").alias("total_profit")
    )
    return _order_by_labels(out, "margin_group", K.THREE_GROUPS)


def margin_volume_all_bands(v: DataFrame) -> DataFrame:
    """All ten bands including empty ones, volume share, profit and average margin.

    The reference LEFT JOINs the band table to the fact on ``min <= m < max`` (a theta join that
    Spark can only run as a nested loop).  Since the bands are disjoint, each fact row is labelled
    in place instead, aggregated to at most ten rows (partial aggregation per task), and the ten
    constant bands are equi-joined to those aggregates.  Rows whose margin is NULL, negative or
    >= 101 belong to no band and are not counted, exactly as in the range join (H4)."""
    agg = (
        # Out-of-range rows get the empty label instead of NULL: the label is then non-nullable and
        # Catalyst does not infer a per-row NOT NULL filter that would re-derive the margin.
        v.select(F.coalesce(range_table_label(_m()), F.lit("")).alias("margin_band"), _m(), _gp())
        .groupBy("margin_band")
        .agg(
            F.count(_m()).alias("num_records"),
            money_sum("Gross Profit").alias("total_profit"),
            avg_pct(_m()).alias("avg_margin_pct"),
        )
    )
    # At most eleven aggregate rows (ten labels + the empty one): a proven bound, so they are broadcast
    # into the right outer join that keeps all ten bands; the empty-label row matches no band.
    joined = F.broadcast(agg).join(band_table_df(v.sparkSession), "margin_band", "right").select(
        "margin_band",
        "sort_band",
        F.coalesce(F.col("num_records"), F.lit(0).cast("bigint")).alias("num_records"),
        F.coalesce(F.col("total_profit"), F.lit(0.0)).alias("total_profit"),
        "avg_margin_pct",
    )
    everything = Window.partitionBy()  # ten rows only
    return joined.select(
        "margin_band",
        "num_records",
        pct(F.col("num_records"), F.sum("num_records").over(everything)).alias("pct_transaction_volume"),
        "total_profit",
        "avg_margin_pct",
        "sort_band",
    ).orderBy("sort_band").drop("sort_band")


def margin_volume_of(v: DataFrame, bands: DataFrame) -> DataFrame:
    """A8 over a band table given as data: margin_band, min_pct, max_pct, sort_band.

    Bands may overlap, leave gaps or be open (NULL bound); as in the source's LEFT JOIN on ``min <= m < max``,
    a row counts in every band that holds it and an empty band keeps its row.  Rows are first added up by
    margin (whole hundredths), then joined to the bands through an interval index; no nested loop."""
    m = hundredths(_m()).cast("long")
    by_margin = v.where(_m().isNotNull()).groupBy(m.alias("_m")).agg(F.count(F.lit(1)).alias("_n"), sum_cents(PROFIT).alias("_profit"))
    table = shared(bands.select(
        "margin_band", "sort_band",
        F.ceil(F.col("min_pct").cast("decimal(28,6)") * 100).cast("long").alias("_low"),
        F.ceil(F.col("max_pct").cast("decimal(28,6)") * 100).cast("long").alias("_high"),
    ), "bands")
    hits = range_join(by_margin, "_m", table, "_low", "_high").groupBy("margin_band", "sort_band").agg(
        F.sum("_n").alias("_n"), F.sum("_profit").alias("_profit"), F.sum(F.col("_n") * F.col("_m")).alias("_points"))
    rows = table.select("margin_band", "sort_band").distinct().join(hits, ["margin_band", "sort_band"], "left")
    n = F.coalesce("_n", F.lit(0))
    total = scalar(hits.agg(F.sum("_n")))
    return rows.select(
        "margin_band",
        "sort_band",
        n.alias("num_records"),
        pct(n, total).alias("pct_transaction_volume"),
        F.coalesce(dollars("_profit"), F.lit(0.0)).alias("total_profit"),
        average("_points", "_n").alias("avg_margin_pct"),
    ).orderBy("sort_band", "margin_band")


def sub_band_share(v: DataFrame) -> DataFrame:
    """Sub-bands inside ``40 <= m <= 100`` with volume share, average and sort helper.

    The share's denominator (rows in the filtered universe) equals the sum of the at most six
    group counts, so it is taken over the aggregated rows rather than by re-scanning the fact."""
    lo, hi = K.HIGH_MARGIN
    agg = (
        v.filter((_m() >= lo) & (_m() <= hi))
        .groupBy(band_by_ranges(_m(), K.SUB_BANDS, closed_last=True).alias("margin_sub_band"))
        .agg(
            F.count(F.lit(1)).alias("num_records"),
            money_sum("Gross Profit").alias("total_profit"),
            avg_pct(_m()).alias("avg_margin_pct"),
            F.min(_m()).alias("sort_margin"),
        )
    )
    everything = Window.partitionBy()  # at most six rows
    return agg.select(
        "margin_sub_band",
        "num_records",
        pct(F.col("num_records"), F.sum("num_records").over(everything)).alias("pct_transaction_volume"),
        "total_profit",
        "avg_margin_pct",
        "sort_margin",
    ).orderBy("sort_margin")
