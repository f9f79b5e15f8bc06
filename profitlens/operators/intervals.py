"""Range joins against a table of intervals, as an equi-join.

Intervals are half-open over whole numbers and may overlap, be open on either side or empty.  Each is cut into
the cells of a binary tree that cover it exactly (at most two a level; a cell is a run of 2**level numbers),
and a value lies in one cell of each level.  An interval holds a value exactly if one of its cells is the
value's cell of that level, and never two: an equi-join on (level, cell), with as many rows a value as there
are levels in use, instead of a nested loop over all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitlens.operators.share import shared

#: Values and bounds are within this distance of 0; open sides end here.
REACH = 1 << 60
LEVELS = 62


def cells(intervals: DataFrame, low: str, high: str) -> DataFrame:
    """``intervals`` with a row (_level, _cell) for each cell of its cover; NULL bounds are open."""
    lo = F.greatest(F.coalesce(F.col(low).cast("long"), F.lit(-REACH)), F.lit(-REACH)) + F.lit(REACH)
    hi = F.least(F.coalesce(F.col(high).cast("long"), F.lit(REACH)), F.lit(REACH)) + F.lit(REACH)
    levels = F.array(*[F.lit(k) for k in range(LEVELS)])

    def at(k):
        # first cell that starts inside, and the one past the last that ends inside
        up = F.call_function("shiftright", F.col("_lo") + F.call_function("shiftleft", F.lit(1).cast("long"), k) - F.lit(1), k)
        down = F.call_function("shiftright", F.col("_hi"), k)
        first = F.when((up < down) & (up % 2 == 1), F.struct(k.alias("_level"), up.alias("_cell")))
        last = F.when((up < down) & (down % 2 == 1), F.struct(k.alias("_level"), (down - 1).alias("_cell")))
        return F.array(first, last)

    placed = intervals.select("*", lo.alias("_lo"), hi.alias("_hi"))
    cover = F.array_compact(F.flatten(F.transform(levels, at)))
    return placed.select(*intervals.columns, F.explode(cover).alias("_c")).select(*intervals.columns, "_c._level", "_c._cell")


def range_join(values: DataFrame, value: str, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Every row of ``values`` with every interval that holds it: ``low <= value AND value < high`` (inner).

    ``value``, ``low`` and ``high`` are whole numbers; rows with a NULL value match nothing.  Column names of the
    two sides must differ.  Values that many rows share are best added up before."""
    index = shared(cells(intervals, low, high), "interval-cells")
    used = sorted(r[0] for r in index.select("_level").distinct().collect())  # at most LEVELS numbers
    shifted = F.col(value).cast("long") + F.lit(REACH)
    own = [F.struct(F.lit(k).alias("_level"), F.shiftright(shifted, k).alias("_cell")) for k in used]
    if not own:
        return values.join(intervals, F.lit(False))
    spread = values.select("*", F.explode(F.array(*own)).alias("_v")).select(*values.columns, "_v._level", "_v._cell")
    return spread.join(index, ["_level", "_cell"]).drop("_level", "_cell")
