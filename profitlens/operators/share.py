"""Compute an intermediate once when several branches of a plan consume it.

Spark re-executes a DataFrame for every branch that reads it; exchange reuse only kicks in when
the branches' plans are identical, and column pruning usually makes them differ (a totals
branch needs fewer columns than a rows branch).  For the reports that need both per-entity rows
and a grand total (shares, ranks against totals, top-k then drill-down), the aggregated
intermediate is therefore written once to the cluster's checkpoint folder as parquet — reliable
storage, so an executor loss never recomputes it from the fact, and each branch reads only the
columns it needs.

Reports pass only aggregated data through here (one row per entity).  The load step is the exception:
it stores the denormalised rows, which it reads several times, and the rows whose keys it numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from profitlens.session import ensure_checkpoint_dir

_SCRATCH: dict[str, list[str]] = {}


def shared(df: DataFrame, name: str = "shared") -> DataFrame:
    """Materialise ``df`` once (parquet in the shared folder) for several consumers."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_scratch(spark: SparkSession) -> int:
    """Delete what ``shared`` has written in this application, and return how many folders that were.

    Call it when no DataFrame that was built before is read any more: lazy results read those folders."""
    sc = spark.sparkContext
    paths = _SCRATCH.pop(sc.applicationId, [])
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)
