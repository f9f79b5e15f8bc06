"""Load once, report many: the star schema materialised as parquet.

``materialize_star`` writes the clean view (margin included, so it is computed once per load
instead of once per report) and the dimensions.  Fact files are sorted by margin within each
task's output, so every row group covers a narrow margin range: the band filters of the
reports become parquet ``PushedFilters`` that skip whole row groups.  ``StoredStar`` then
exposes the same attributes as ``Star`` over those files, so every report runs unchanged.

Reports that need a row's order read a second copy of the fact, bucketed and sorted by ``Order ID``
like the order table: the large-large join and the sums per order then need no exchange of the fact.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profitlens.operators.keys import ROWS_PER_TASK
from profitlens.sources.proxy import Star

BUCKET_KEY = "Order ID"
DIMENSIONS = ("product", "factory", "order", "customer")


def materialize_star(star: Star, path: str, mode: str = "overwrite") -> "StoredStar":
    """Write ``star``'s clean view and dimensions under ``path`` (a shared folder on a cluster)."""
    path = path.rstrip("/")
    (
        star.v.sortWithinPartitions(F.col("gross_margin_pct").asc_nulls_first())
        .write.mode(mode)
        .parquet(f"{path}/fact_clean")
    )
    for name in DIMENSIONS:
        if name != "order":
            getattr(star, name).write.mode(mode).parquet(f"{path}/{name}")
    rows = star.spark.read.parquet(f"{path}/fact_clean").count()
    buckets = max(int(star.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))
    for name, df in (("fact_by_order", star.v), ("order", star.order)):
        # one task writes one bucket: the shuffle and the bucketing use the same hash
        dealt = df.repartition(buckets, BUCKET_KEY)
        dealt.write.mode(mode).bucketBy(buckets, BUCKET_KEY).sortBy(BUCKET_KEY).option("path", f"{path}/{name}").saveAsTable(_table_name(path, name))
    star.spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode(mode).parquet(f"{path}/layout")
    return StoredStar(star.spark, path, raw_source=star)


def _table_name(path: str, name: str) -> str:
    return f"star_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{name}"


class StoredStar(Star):
    """The star schema read back from ``materialize_star``'s output."""

    def __init__(self, spark: SparkSession, path: str, raw_source: Star | None = None):
        super().__init__(spark, raw_source.sf_dir if raw_source is not None else path)
        self.path = path.rstrip("/")
        self._raw_source = raw_source

    def _stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _bucketed(self, name: str) -> DataFrame:
        """A bucketed table; a session that did not write it learns of its layout first."""
        table = _table_name(self.path, name)
        if not self.spark.catalog.tableExists(table):
            buckets = self._stored("layout").first()["buckets"]
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._stored(name).schema)
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{BUCKET_KEY}`) SORTED BY (`{BUCKET_KEY}`) "
                           f"INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(table)

    @cached_property
    def v(self) -> DataFrame:
        return self._stored("fact_clean")

    @cached_property
    def v_by_order(self) -> DataFrame:
        return self._bucketed("fact_by_order")

    @cached_property
    def fact_by_order(self) -> DataFrame:
        return self.v_by_order.drop("gross_margin_pct")

    @cached_property
    def fact(self) -> DataFrame:
        return self.v.drop("gross_margin_pct")

    @cached_property
    def product(self) -> DataFrame:
        return self._stored("product")

    @cached_property
    def factory(self) -> DataFrame:
        return self._stored("factory")

    @cached_property
    def order(self) -> DataFrame:
        return self._bucketed("order")

    @cached_property
    def customer(self) -> DataFrame:
        return self._stored("customer")

    @cached_property
    def fact_keys(self) -> DataFrame:
        return self.v.select("Order ID", "Factory ID", "Product ID", "Units")

    def raw_of(self, *cols: str) -> DataFrame:
        if self._raw_source is None:
            raise ValueError("the denormalised source is not part of a stored star")
        return self._raw_source.raw_of(*cols)
