"""Margin banding (V6-V11) as ``CASE`` expressions, plus the constant band table.

Every banding the reference uses is one of three shapes, all evaluated per row inside codegen:

* ``band_by_upper``  — ordered upper bounds with an ELSE label (NULL margin falls to ELSE);
* ``band_by_ranges`` — explicit half-open ranges, optional closed last range, no ELSE (NULL);
* ``range_table_label`` — the range table ``min <= m < max`` (null/negative/over-range → NULL).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profitlens import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band_by_upper(m, labels: Sequence[str], uppers: Sequence[float]) -> Column:
    """``CASE WHEN m < u0 THEN l0 WHEN m < u1 THEN l1 ... ELSE l_last END``."""
    m = _col(m)
    expr = None
    for label, upper in zip(labels, uppers):
        cond = m < F.lit(upper)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def band_by_ranges(m, ranges: Sequence[tuple], closed_last: bool = False) -> Column:
    """``CASE WHEN m >= lo AND m < hi THEN label ... END`` (no ELSE → NULL).

    ``closed_last`` makes the final range ``m <= hi`` (the ``90–100%`` sub-band)."""
    m = _col(m)
    expr = None
    for i, (label, lo, hi) in enumerate(ranges):
        upper = (m <= F.lit(hi)) if (closed_last and i == len(ranges) - 1) else (m < F.lit(hi))
        cond = (m >= F.lit(lo)) & upper
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def three_group(m) -> Column:
    """V7: ``<10%`` / ``10–39.99%`` / ``>=40%`` (ELSE, so NULL lands in ``>=40%``)."""
    m = _col(m)
    low, mid, high = K.THREE_GROUPS
    return (
        F.when(m < 10, F.lit(low))
        .when((m >= 10) & (m < 40), F.lit(mid))
        .otherwise(F.lit(high))
    )


def range_table_label(m) -> Column:
    """Label of the band-table row whose ``[min_pct, max_pct)`` contains ``m`` (else NULL).

    This is the per-row half of the range join J7: the bands do not overlap, so
    ``bands ⟕ fact ON min <= m < max`` equals "label each row, aggregate, then equi-join the
    ten bands to at most ten aggregates"."""
    return band_by_ranges(m, [(lab, lo, hi) for lab, lo, hi, _ in K.MARGIN_BAND_TABLE])


def band_table_df(spark: SparkSession) -> DataFrame:
    """The ten-row constant band table, built JVM-side (``inline`` of literal structs), so no
    Python worker is involved and the optimizer folds it into a local relation."""
    rows = [
        F.struct(
            F.lit(label).alias("margin_band"),
            F.lit(lo).cast("int").alias("min_pct"),
            F.lit(hi).cast("int").alias("max_pct"),
            F.lit(sort).cast("int").alias("sort_band"),
        )
        for label, lo, hi, sort in K.MARGIN_BAND_TABLE
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
