"""Join building blocks.

* ``attach_dim`` — enrich aggregated rows with dimension attributes.  No broadcast hint: the
  dimension may grow with the data, so the planner decides from statistics
  (``spark.sql.autoBroadcastJoinThreshold``) and AQE re-plans from the real shuffle sizes.
* ``scalar`` — a one-row, one-column aggregate (a grand total) as a value usable in any
  expression: an uncorrelated scalar subquery, evaluated once and inlined — no join at all.  This
  replaces the source's ``CROSS JOIN totals``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def attach_dim(rows: DataFrame, dim: DataFrame, key: str, cols: Sequence[str], how: str = "inner") -> DataFrame:
    return rows.join(dim.select(key, *cols), key, how)


def scalar(one_value: DataFrame):
    """The single value of a one-row, one-column DataFrame as a Column (scalar subquery)."""
    return one_value.scalar()
