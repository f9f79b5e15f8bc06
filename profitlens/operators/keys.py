"""Dense surrogate keys (AUTO_INCREMENT) without a global single-partition window.

``row_number() OVER (ORDER BY k)`` would pull every row into one task.  Instead the rows are
range-partitioned and sorted on the natural key and written once, as parquet in the shared folder, with
their place (partition and position).  Each row's id is its partition's offset plus its position; the
offsets are a prefix sum over one row per partition, bounded by the partition count, and are broadcast.
What is written is fixed, so a lost executor cannot make rows change their numbers.

Rows that tie on the ordering columns are ordered by a hash of the whole row, then by the other columns,
so a hot value of the ordering key is spread over several range partitions.  Rows identical in every
column are interchangeable; a tag that is unique to each row, and was itself written before, spreads such
copies over several partitions too, and no copy can be routed twice when a task is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from profitlens.operators.share import shared

#: Rows that one task numbers, about 0.5 GB of a narrow fact.
ROWS_PER_TASK = 8_000_000
TAG = "_tag"


def tagged(df: DataFrame, name: str = "tagged") -> DataFrame:
    """``df`` stored with a column ``_tag`` that is unique to each row."""
    return shared(df.withColumn(TAG, F.monotonically_increasing_id()), name)


def _ranged(df: DataFrame, keys: list, rows: int | None) -> DataFrame:
    """``df`` in order: partitions are ranges of the keys, and are sorted."""
    if rows is None:
        return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(max(least, -(-rows // ROWS_PER_TASK)), *keys).sortWithinPartitions(*keys)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal, as are NaNs."""
    x, y = column.slice(1), column.slice(0, len(column) - 1)
    out = pc.or_kleene(pc.fill_null(pc.not_equal(x, y), False), pc.xor(pc.is_null(x), pc.is_null(y)))
    if pa.types.is_floating(column.type):
        out = pc.and_not(out, pc.fill_null(pc.and_(pc.is_nan(x), pc.is_nan(y)), False))
    return out.to_numpy(zero_copy_only=False)


def dense_group_key(df: DataFrame, key_cols: Sequence[str], name: str, rows: int | None = None) -> DataFrame:
    """Add ``name`` = 1..K to every row: the dense rank of its ``key_cols`` (ascending, NULLs first), as a join with
    the numbered distinct keys would, by one range shuffle of the rows.

    ``df`` carries the tag of ``tagged``; the tag orders rows of one key, so a hot key is spread over several range
    partitions.  Runs of equal keys are numbered inside each partition; a partition that begins with the key that
    the one before it ends with goes on with its number.  What is passed between partitions is one row each."""
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in key_cols]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, dtype=bool)
            new[0] = last is None
            for i, c in enumerate(key_cols):
                column = b.column(c)
                new[1:] |= _changes(column)
                if last is not None:
                    new[0] |= _changes(pa.concat_arrays([last[i], column.slice(0, 1)]))[0]
            number = run + np.cumsum(new)
            # copied, so that no batch is kept for its last row
            last, run = [pa.array(b.column(c).slice(b.num_rows - 1).to_pylist(), b.column(c).type) for c in key_cols], int(number[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number, pa.int64())], names=[*b.schema.names, "_run"])

    schema = StructType([*df.schema.fields, StructField("_run", LongType())])
    numbered = _ranged(df, [*keys, F.col(TAG).asc()], rows).mapInArrow(runs, schema)
    numbered = shared(numbered.withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)), "ranked")
    key = F.struct(*[F.col(f"`{c}`") for c in key_cols])
    bounds = numbered.groupBy("_part").agg(F.max("_run").alias("_n"), F.min(key).alias("_first"), F.max(key).alias("_last"))
    order = Window.orderBy("_part")
    bounds = bounds.withColumn("_n_new", F.col("_n") - F.lag("_last").over(order).eqNullSafe(F.col("_first")).cast("int"))
    before = F.sum("_n_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    offsets = bounds.select(F.col("_part").alias("_at"), before.alias("_before"))
    ids = numbered.join(F.broadcast(offsets), F.col("_part") == F.col("_at"))
    return ids.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_run")).alias(name))


def dense_surrogate_key(df: DataFrame, order_cols: Sequence[str], name: str, rows: int | None = None,
                        distinct: bool = False) -> DataFrame:
    """Add ``name`` = 1..N following ``order_cols`` (ascending, NULLs first).

    Rows that tie on all columns are interchangeable, so which of them gets which id does not change the
    result.  ``rows``, an upper bound of the number of rows, sets the number of partitions
    (``ROWS_PER_TASK`` each, at least the session's shuffle partitions).  ``distinct`` says that no two rows
    are equal in all columns; otherwise ``df`` is expected to carry the tag of ``tagged``, and is stored with
    one if it does not."""
    if not distinct and TAG not in df.columns:
        df = tagged(df)
        rows = df.count() if rows is None else rows
    cols = [c for c in df.columns if c != TAG]
    rest = [c for c in cols if c not in order_cols]
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in order_cols]
    if rest:
        keys += [F.xxhash64(*[F.col(f"`{c}`") for c in cols]).asc(), *[F.col(f"`{c}`").asc_nulls_first() for c in rest]]
    if TAG in df.columns:
        keys.append(F.col(TAG).asc())
    # the place of a row: (partition index << 33) + position inside the partition
    placed = shared(_ranged(df, keys, rows).select(*[F.col(f"`{c}`") for c in cols], F.monotonically_increasing_id().alias("_place")), "numbered")
    part = F.shiftright("_place", 33).alias("_part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    offsets = counts.select("_part", before.alias("_offset"))
    ids = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    position = F.col("_place") - F.shiftleft(F.col("_part"), 33)
    return ids.select(*[F.col(f"`{c}`") for c in cols], (F.col("_offset") + position + F.lit(1)).alias(name))
