"""Surrogate keys (B7), the raw CSV source (S1) and the load pipeline."""

import os

from pyspark.sql import functions as F

from profitlens import constants as K
from profitlens.operators import load as L
from profitlens.operators import quality as Q
from profitlens.operators.keys import dense_surrogate_key
from profitlens.sources.files import bad_values, create_view, read_raw_csv, write_csv, write_parquet

RAW_CSV = """Unnamed: 0,Order Date,Ship Date,Ship Mode,Customer ID,Country/Region,City,State/Province,Postal Code,Division,Region,Product Name,Sales,Units,Gross Profit,Cost,Factory,Latitude,Longitude
0,2021-03-31,2021-04-05,Standard Class,101,United States,Austin,Texas,73301,Chocolate,Central,Wonka Bar - Milk Chocolate,6.50,2,4.22,2.28,Wicked Choccy's,32.07,-81.09
1,2021-03-31,2021-04-05,Standard Class,101,United States,Dallas,Texas,75001,Chocolate,Central,Wonka Bar -Scrumdiddlyumptious,7.00,2,4.80,2.20,Wicked Choccy's,32.07,-81.09
2,2022-13-40,2022-01-09,First Class,202,Canada,Toronto,Ontario,M5V 2T6,Sugar,East,Laffy Taffy,3.00,1,1.00,2.00,Sugar Shack,48.11,-96.18
3,2022-01-07,2022-01-09,First Class,,Canada,Toronto,Ontario,M5V 2T6,Other,East,Mystery Candy,1.00,1,0.50,0.50,Secret Factory,41.44,-90.56
"""


def test_dense_surrogate_key_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("k"))
    out = dense_surrogate_key(df, ["k"], "sk", rows=5000).collect()
    ids = sorted(r.sk for r in out)
    assert ids == list(range(1, 5001))
    assert all(r.sk == r.k + 1 for r in out)


def test_load_pipeline_on_raw_csv(spark, tmp_out):
    path = os.path.join(tmp_out, "raw.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(RAW_CSV)
    raw = read_raw_csv(spark, path)
    assert raw.count() == 4
    pmap = spark.createDataFrame(K.PRODUCT_ID_BY_NAME_NOTEBOOK, "name string, id string")
    fmap = spark.createDataFrame(K.FACTORY_CODE_BY_NAME, "name string, id string")

    enriched = L.enrich_raw(raw, pmap, fmap)
    ids = {r["Order ID"]: (r["Product ID"], r["Factory ID"]) for r in enriched.collect()}
    assert ids[0] == ("WBMC", "WC") and ids[1] == ("WBSL", "WC") and ids[2] == ("LT", "SS") and ids[3] == (None, "SF")

    comp = {r["Unnamed: 0"]: r["Order ID"] for r in L.composite_order_id(L.map_by_name(raw, pmap, "Product Name", "Product ID")).collect()}
    assert comp[0] == "2021-03-31_101_WBMC" and comp[3] == "2022-01-07_nan_nan"

    orders = L.dim_order(raw).orderBy("Order ID").collect()
    assert [o["Order ID"] for o in orders] == [1, 2, 3]
    assert orders[0]["Customer ID"] is None  # NULL keys sort first
    by_customer = {o["Customer ID"]: o for o in orders}
    assert str(by_customer[101]["Order Date"]) == "2021-03-31"
    assert by_customer[202]["Order Date"] is None

    sql_map = spark.createDataFrame(K.PRODUCT_ID_BY_NAME_SQL, "name string, id string")
    products = {r["Product ID"] for r in L.dim_product(raw, sql_map).collect()}
    assert products == {"WBMC"}  # SQL map knows neither alternate spelling; unmapped names dropped (H8)

    fact = L.fact_load(raw, pmap, fmap).collect()
    assert sorted(r["Financial Figures ID"] for r in fact) == [1, 2, 3, 4]
    # ids follow the source row order, as AUTO_INCREMENT on insertion would
    assert {float(r["Sales"]): r["Financial Figures ID"] for r in fact} == {6.5: 1, 7.0: 2, 3.0: 3, 1.0: 4}
    assert all(r["Order ID"] is not None for r in fact)

    cities = {(r["Customer ID"], r["City"], r["n"]) for r in Q.distinct_values_per_key(raw, "Customer ID", "City", "n").collect()}
    assert cities == {(101, "Austin", 2), (101, "Dallas", 2), (202, "Toronto", 1)}
    located = L.dim_factory(raw).collect()
    assert {(r["Factory ID"], r["Longitude"], r["Latitude"]) for r in located} >= {("Sugar Shack", -96.18, 48.11)}
    customers = L.dim_customer(raw)
    bad = Q.pk_violations([("Customer", customers, "Customer ID")]).collect()
    assert {r.key_value for r in bad} == {"101", None}

    out = os.path.join(tmp_out, "enriched")
    write_csv(enriched, out)
    assert spark.read.option("header", True).csv(out).count() == 4
    write_parquet(L.dim_order(raw).withColumn("m", F.date_format("Order Date", "yyyy-MM")), out + "_pq", ["m"])
    assert spark.read.parquet(out + "_pq").count() == 3
    create_view(raw, "raw_sales")
    assert spark.sql("SELECT COUNT(*) AS n FROM raw_sales").collect()[0].n == 4


def test_raw_csv_is_read_by_header_name_and_bad_values_are_counted(spark, tmp_out):
    head, *rows = [line.split(",") for line in RAW_CSV.splitlines()]
    a, b = head.index("Sales"), head.index("Cost")
    for line in (head, *rows):
        line[a], line[b] = line[b], line[a]
    rows[1][a] = "abc"  # a cost that is no number
    path = os.path.join(tmp_out, "swapped.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("\n".join(",".join(line) for line in (head, *rows)) + "\n")
    raw = read_raw_csv(spark, path)
    got = {r["Unnamed: 0"]: (float(r["Sales"]), r["Cost"] and float(r["Cost"])) for r in raw.collect()}
    assert got[0] == (6.5, 2.28) and got[1] == (7.0, None)
    assert [tuple(r) for r in bad_values(raw).collect()] == [("Cost", 1)]


def test_pairs_keep_keys_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (2, None), (2, "b"), (None, "c")], "k long, v string")
    assert {tuple(r) for r in Q.distinct_values_per_key(df, "k", "v", "n").collect()} == {(1, None, 0), (2, "a", 2), (2, "b", 2)}


def test_unmapped_keys_counts_misses(spark):
    e = spark.createDataFrame([(1, "x"), (None, "x"), (None, None)], "`Product ID` long, `Factory ID` string")
    assert tuple(Q.unmapped_keys(e).first()) == (3, 2, 1, 1, 1)


def test_rank_by_the_unrounded_margin(spark):
    from profitlens.plans.products import best_products_by_margin, worst_products_by_margin

    rows = [(i, 1, 9_999_999_999.99, 5_000_000_000.00 + x, 0.0) for i, x in ((1, 0.0), (2, 150.0), (3, 75.0))]
    cols = "`Product ID` long, Units int, Sales double, `Gross Profit` double, Cost double"
    ff = spark.createDataFrame(rows, cols).select(
        "Product ID", "Units", *[F.col(c).cast("decimal(12,2)").alias(c) for c in ("Sales", "Gross Profit", "Cost")])
    product = spark.createDataFrame([(i, f"p{i}") for i in (1, 2, 3)], "`Product ID` long, `Product Name` string")
    best = best_products_by_margin(ff, product).collect()
    assert len({r.profit_margin for r in best}) == 1  # equal to six decimals
    assert [r["Product ID"] for r in best] == [2, 3, 1]
    assert [r["Product ID"] for r in worst_products_by_margin(ff, product).collect()] == [1, 3, 2]


def test_loss_makers_of_each_kind(spark):
    from profitlens.plans.customers import loss_makers

    rows = [(1, 10, 100, -5.0), (1, 11, 100, 2.0), (2, 11, 200, 3.0), (3, 10, 200, 1.0), (None, 11, 200, 1.0)]
    ff = spark.createDataFrame(rows, "`Order ID` long, `Product ID` long, `Factory ID` long, g double").withColumn(
        "Gross Profit", F.col("g").cast("decimal(12,2)"))
    order = spark.createDataFrame([(1, 7), (2, 8), (3, 7)], "`Order ID` long, `Customer ID` long")
    got = {(r.entity_type, r.entity_id, r.num_records, r.total_gross_profit) for r in loss_makers(ff, order).collect()}
    assert got == {("Product", "10", 2, -4.0), ("Factory", "100", 2, -3.0), ("Customer", "7", 3, -2.0)}


def test_strip_and_coerce(spark):
    df = spark.createDataFrame([(" 1.5", "x"), ("bad", "y")], "` a ` string, `b ` string")
    out = L.to_numeric(L.strip_column_names(df), ["a"])
    assert out.columns == ["a", "b"]
    assert [r.a for r in out.collect()] == [1.5, None]


def test_append_table_accumulates(spark, tmp_out):
    from profitlens.sources.files import append_table

    df = spark.range(3).withColumnRenamed("id", "k")
    table = "append_probe_" + os.path.basename(tmp_out).replace("-", "_")
    append_table(df, table, path=os.path.join(tmp_out, "tbl"))
    append_table(df, table)
    assert spark.table(table).count() == 6


def test_dense_key_spreads_a_hot_ordering_value(spark):
    # a third of the rows share one ordering value; ids stay dense and follow the order
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    out = dense_surrogate_key(df, ["k"], "sk", rows=3000)
    rows = out.collect()
    assert sorted(r.sk for r in rows) == list(range(1, 3001))
    by_sk = sorted(rows, key=lambda r: r.sk)
    assert all(a.k <= b.k for a, b in zip(by_sk, by_sk[1:]))
    sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in sizes) < 1000  # the 1,000 tied rows do not all land in one task


def test_fk_orphans_counts_missing_parents_in_one_pass(spark):
    child = spark.createDataFrame([(1, 10), (2, 99), (None, 10), (3, None), (4, 98)], "a long, b long")
    pa = spark.createDataFrame([(1,), (2,), (2,)], "a long")  # duplicate parent key must not multiply rows
    pb = spark.createDataFrame([(10,)], "b long")
    other = spark.createDataFrame([(7,)], "c long")
    out = {r.relationship: r.orphan_rows for r in Q.fk_orphans([
        ("child.a -> pa", child, "a", pa, "a"),
        ("child.b -> pb", child, "b", pb, "b"),
        ("other.c -> pa", other, "c", pa, "a"),
    ]).collect()}
    assert out == {"child.a -> pa": 2, "child.b -> pb": 2, "other.c -> pa": 1}
