"""Ranking helpers: global rank filters, per-group top-k, first/last row of an ordering.

All of them run on already-aggregated rows.  Spark turns ``rank/row_number <= k`` into a
partial ``WindowGroupLimit`` in every task before the single-partition (or per-group) window, so
no task ever receives more than ``k`` (plus ties) rows per map partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profitlens.operators.share import shared


def rank_filter(df: DataFrame, order: Sequence[Column], k: int, name: str, fn=F.rank,
                partition: Sequence[str] = ()) -> DataFrame:
    """Add ``name = fn() OVER (PARTITION BY partition ORDER BY order)`` and keep ``name <= k``."""
    w = Window.partitionBy(*partition).orderBy(*order) if partition else Window.orderBy(*order)
    return df.withColumn(name, fn().over(w).cast("bigint")).filter(F.col(name) <= k)


def first_and_last(df: DataFrame, order: Sequence[Column], reverse: Sequence[Column],
                   label: str = "position", first: str = "best", last: str = "worst") -> DataFrame:
    """The first and the last row of ``df`` under ``order`` (``reverse`` is its exact inverse).

    ``df`` is an aggregated result (one row per entity).  It is materialised once, so the two
    one-row ``TakeOrderedAndProject`` passes read that copy instead of each re-aggregating the
    fact; the explicit tie-breaks in ``order`` keep the choice deterministic."""
    df = shared(df)
    head = df.orderBy(*order).limit(1).withColumn(label, F.lit(first))
    tail = df.orderBy(*reverse).limit(1).withColumn(label, F.lit(last))
    out = head.unionByName(tail)
    return out.select(label, *[c for c in df.columns])


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """ORDER BY ... LIMIT n (top-k, ``TakeOrderedAndProject``)."""
    return df.orderBy(*order).limit(n)
