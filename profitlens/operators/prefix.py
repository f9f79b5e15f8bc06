"""Running totals over all rows without a single-partition window.

Rows are range-partitioned and sorted, and stored with their place; each partition's total is one row, their
prefix sum is broadcast, and inside a partition the window runs over that partition alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profitlens.operators.share import shared


def running_totals(df: DataFrame, order: Sequence[Column], totals: dict[str, str]) -> DataFrame:
    """``df`` with, for each output name of ``totals``, the sum of its column over this row and all before it.

    ``order`` must leave no ties that matter.  NULL values count as 0."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = shared(ranged.withColumn("_place", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    value = {out: F.coalesce(F.col(c), F.lit(0)) for out, c in totals.items()}
    sums = placed.groupBy("_part").agg(*[F.sum(v).alias(f"_{out}") for out, v in value.items()])
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)  # one row a partition
    offsets = sums.select("_part", *[(F.sum(f"_{out}").over(parts) - F.col(f"_{out}")).alias(f"_{out}") for out in value])
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.select("*", *[F.sum(v).over(inside).alias(f"_in_{out}") for out, v in value.items()])
    joined = run.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, *[(F.col(f"_{out}") + F.col(f"_in_{out}")).alias(out) for out in value])
