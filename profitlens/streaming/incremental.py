"""Keep the KPI totals and the margin-band distribution current while fact files arrive.

The reference has no stream; this module only re-runs its overall reports incrementally:
new parquet files of fact rows are read with ``readStream``, passed through the same clean view
and band expressions, and aggregated with Structured Streaming's state store (complete mode:
the result has at most ten band rows / one KPI row).  Checkpoints go to the cluster's checkpoint
folder, so a restarted query resumes from its state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profitlens.functions.bands import range_table_label
from profitlens.functions.measures import MONEY, money_sum, pct, sum_cents
from profitlens.operators.clean import clean_view

FACT_SCHEMA = T.StructType(
    [
        T.StructField("Order ID", T.LongType()),
        T.StructField("Factory ID", T.LongType()),
        T.StructField("Product ID", T.LongType()),
        T.StructField("Units", T.IntegerType()),
        T.StructField("Sales", T.DecimalType(12, 2)),
        T.StructField("Cost", T.DecimalType(12, 2)),
        T.StructField("Gross Profit", T.DecimalType(12, 2)),
    ]
)


def fact_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 64) -> DataFrame:
    """A streaming clean view over parquet fact files dropped into ``path``."""
    raw = spark.readStream.schema(FACT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
    return clean_view(raw.select(*[F.col(f"`{f.name}`").cast(MONEY) if isinstance(f.dataType, T.DecimalType)
                                   else F.col(f"`{f.name}`") for f in FACT_SCHEMA.fields]))


def streaming_kpis(v: DataFrame) -> DataFrame:
    """A1 on a stream: running totals and margin (one state row)."""
    return v.agg(
        money_sum("Sales").alias("total_sales"),
        money_sum("Cost").alias("total_cost"),
        money_sum("Gross Profit").alias("total_gross_profit"),
        pct(sum_cents("Gross Profit"), sum_cents("Sales")).alias("gross_margin_pct"),
    )


def streaming_band_counts(v: DataFrame) -> DataFrame:
    """A8's aggregate half on a stream: rows and profit per range-table band (≤ 11 state rows).

    The empty-band rows and the volume share are a final, batch-side projection over this
    result (``plans.overall.margin_volume_all_bands`` does both on a static DataFrame)."""
    m = F.col("gross_margin_pct")
    return (
        v.select(F.coalesce(range_table_label(m), F.lit("")).alias("margin_band"), m, F.col("Gross Profit"))
        .where(F.col("margin_band") != "")
        .groupBy("margin_band")
        .agg(F.count(m).alias("num_records"), money_sum("Gross Profit").alias("total_profit"))
    )


def start_memory_sink(df: DataFrame, name: str, checkpoint: str):
    """Run an aggregate stream into an in-memory table (tests, notebooks)."""
    return (
        df.writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .start()
    )
