"""File sources and sinks of the reference's workflow.

* the raw denormalised sales CSV is matched by header name and cast to a fixed schema (no ``inferSchema`` pass);
* exported result CSVs (the reference's golden files) are read with ``NULL`` as the null token;
* lines of a raw CSV that do not parse (missing or extra fields, an open quote) are kept apart with the reason;
* results are written as CSV (part files, or one ordered file) or parquet, optionally partitioned;
* star tables are appended with ``insertInto``-like semantics through ``saveAsTable``, or load by load
  (``insert_select``), where repeating a load replaces it.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profitlens.operators.load import strip_column_names, to_numeric

# Raw sales CSV as exported from the source system (dates stay text until the load parses them).
RAW_SCHEMA = T.StructType(
    [
        T.StructField("Unnamed: 0", T.LongType()),
        T.StructField("Order Date", T.StringType()),
        T.StructField("Ship Date", T.StringType()),
        T.StructField("Ship Mode", T.StringType()),
        T.StructField("Customer ID", T.LongType()),
        T.StructField("Country/Region", T.StringType()),
        T.StructField("City", T.StringType()),
        T.StructField("State/Province", T.StringType()),
        T.StructField("Postal Code", T.StringType()),
        T.StructField("Division", T.StringType()),
        T.StructField("Region", T.StringType()),
        T.StructField("Product Name", T.StringType()),
        T.StructField("Sales", T.DecimalType(12, 2)),
        T.StructField("Units", T.IntegerType()),
        T.StructField("Gross Profit", T.DecimalType(12, 2)),
        T.StructField("Cost", T.DecimalType(12, 2)),
        T.StructField("Factory", T.StringType()),
        T.StructField("Latitude", T.DoubleType()),
        T.StructField("Longitude", T.DoubleType()),
    ]
)


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, bad_column: str = "_bad_columns") -> DataFrame:
    """The raw sales CSV with a header, columns matched by header name in any order and cast to ``schema``.

    A value that does not fit its type becomes NULL, and its column is named in ``bad_column`` (names joined
    by ``|``, NULL where all values were read); ``bad_values`` counts them."""
    text = strip_column_names(spark.read.option("header", True).option("enforceSchema", False).csv(path))
    return _typed(text, schema, bad_column)


def read_checked_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, bad_column: str = "_bad_columns") -> tuple[DataFrame, DataFrame]:
    """S1 with a quarantine: the rows of ``read_raw_csv``, and the lines it must not guess at as (file, line, reason).

    A line is a record (no field spans lines).  Reasons: ``open quote``, ``missing fields``, ``extra fields``
    (more or fewer than the header has).  Header lines and empty lines are neither."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    header = spark.read.text(path).first()
    names = [c.strip() for c in next(csv.reader([header["value"]]))] if header else [f.name for f in schema.fields]
    data = lines.where((F.trim("line") != "") & (F.col("line") != F.lit(header["value"] if header else "")))
    bare = F.regexp_replace("line", '"(?:[^"]|"")*"', "")  # without what is quoted
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    reason = F.when(F.contains(bare, F.lit('"')), F.lit("open quote")).when(fields < len(names), F.lit("missing fields")).when(fields > len(names), F.lit("extra fields"))
    judged = data.withColumn("reason", reason)
    parsed = judged.where(F.col("reason").isNull()).select(F.from_csv("line", _ddl(names), {"escape": '"'}).alias("_r"))
    columns = [F.col("_r").getField(f.name) if f.name in names else F.lit(None).cast("string") for f in schema.fields]
    rows = parsed.select(*[c.alias(f.name) for c, f in zip(columns, schema.fields)])
    return _typed(rows, schema, bad_column), judged.where(F.col("reason").isNotNull())


def _ddl(names: Sequence[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)


def _typed(text: DataFrame, schema: T.StructType, bad_column: str) -> DataFrame:
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema.fields}
    bad = [F.when(F.col(f"`{c}`").isNotNull() & x.isNull(), F.lit(c)) for c, x in typed.items()]
    return text.select(*[x.alias(c) for c, x in typed.items()], F.nullif(F.concat_ws("|", *bad), F.lit("")).alias(bad_column))


def bad_values(raw: DataFrame, bad_column: str = "_bad_columns") -> DataFrame:
    """Per column with unreadable values: (column_name, n_rows)."""
    names = raw.select(F.explode(F.split(bad_column, "[|]")).alias("column_name"))
    return names.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_rows"))


def read_interim_csv(spark: SparkSession, path: str, numeric: Sequence[str] = (),
                     schema: T.StructType | None = None) -> DataFrame:
    """S3: an exported result CSV; the literal ``NULL`` is a null, headers are trimmed (B12) and
    the named numeric columns are coerced, bad text becoming NULL (B13)."""
    reader = spark.read.option("header", True).option("nullValue", "NULL")
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    return to_numeric(strip_column_names(df), numeric)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a result as CSV with a header (no index column)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """S4 at scale: columnar output, optionally partitioned (e.g. by order month)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_table(df: DataFrame, table: str, path: str | None = None) -> None:
    """``INSERT INTO table SELECT ...`` — append a query result to a (parquet) table."""
    w = df.write.mode("append").format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)


def insert_select(df: DataFrame, path: str, load_id: str) -> int:
    """S6, repeatable: ``INSERT INTO table SELECT ...`` as the load ``load_id`` of the parquet table at ``path``;
    returns its rows.

    A load is a partition.  It is written beside the table and put in its place when all of it is there
    (dynamic partition overwrite), so running it again replaces it, and a run that is killed leaves the table
    as it was; other loads are not touched."""
    seen = Observation()
    rows = df.withColumn("load_id", F.lit(load_id)).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load_id").parquet(path)
    n = seen.get["n"]
    if not n:  # an empty load has no partition to put in place of an earlier one
        sc = df.sparkSession.sparkContext
        old = sc._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/load_id={load_id}")
        old.getFileSystem(sc._jsc.hadoopConfiguration()).delete(old, True)
    return n


def read_loads(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All loads of ``insert_select``, with their ``load_id`` (text)."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("load_id", T.StringType())])).parquet(path)


def write_ordered_csv(df: DataFrame, path: str, order: Sequence[Column]) -> None:
    """S4/S5 as one file: ``df`` in order, with one header line, at ``path``.

    The rows are sorted by ranges in parallel and written as parts; the parts are then joined in order on the
    file system, as a stream of bytes, under a temporary name that becomes ``path`` at the end."""
    spark, work = df.sparkSession, f"{path}.parts-{uuid.uuid4().hex}"
    df.orderBy(*order).write.csv(work)
    head = io.StringIO()
    csv.writer(head, lineterminator="\n").writerow(df.columns)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, folder, draft = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, work, f"{work}/joined"))
    fs = folder.getFileSystem(conf)
    parts = sorted(str(s.getPath().toString()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    out = fs.create(draft)
    out.write(bytearray(head.getvalue().encode()))
    for part in parts:
        source = fs.open(jvm.org.apache.hadoop.fs.Path(part))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
        source.close()
    out.close()
    fs.delete(target, True)
    fs.rename(draft, target)
    fs.delete(folder, True)


def create_view(df: DataFrame, name: str) -> DataFrame:
    """Register a DataFrame (e.g. the clean view) for SQL; Catalyst inlines it per query."""
    df.createOrReplaceTempView(name)
    return df
