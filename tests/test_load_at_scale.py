"""Exact ratios, numbering of equal rows, name lookups, key bitmaps, interval joins, running totals, the bucketed
star, repeatable loads, the CSV quarantine and the ordered CSV."""

from __future__ import annotations

import contextlib
import decimal
import io
import os
import random

import pytest
from pyspark.sql import Window, functions as F

from profitlens.functions.measures import half_up
from profitlens.operators import load as L
from profitlens.operators import quality as Q
from profitlens.operators.intervals import range_join
from profitlens.operators.keys import dense_surrogate_key, tagged
from profitlens.operators.prefix import running_totals
from profitlens.operators.share import release_scratch, shared
from profitlens.plans import load_reports as Ld
from profitlens.plans.catalog import REPORTS
from profitlens.plans.overall import kpi_totals, margin_volume_of
from profitlens.sources.files import insert_select, read_checked_csv, read_loads, write_ordered_csv
from profitlens.sources.proxy import Star
from profitlens.sources.stored import StoredStar, _table_name, materialize_star

from conftest import SF_SMALL

D = decimal.Decimal


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# -- ratios ---------------------------------------------------------------------------------------
def test_ratio_of_sums_is_rounded_once(spark):
    rows = [(D("4047.49"), D("10119.99"), D("6072.50"), 1)]
    v = spark.createDataFrame(rows, "`Gross Profit` decimal(12,2), Sales decimal(12,2), Cost decimal(12,2), Units int")
    assert kpi_totals(v).first().gross_margin_pct == 39.99


def test_half_up_is_exact(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(-10**k, 10**k), rng.randint(-10**j, 10**j)) for k in (2, 6, 18) for j in (1, 5, 18) for _ in range(40)]
    pairs += [(1, 8), (-1, 8), (1, -8), (5, 0), (0, 5), (10**30, 3), (615, 60000)]
    rows = [(i, D(a), D(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a decimal(38,0), b decimal(38,0)")
    for up, down in ((4, 2), (6, 6), (0, 2)):
        got = {r.i: r.x for r in df.select("i", half_up("a", "b", up, down).alias("x")).collect()}
        for i, a, b in rows:
            with decimal.localcontext() as c:
                c.prec = 80
                want = None if not b else float((a * 10**up / b).quantize(D(1), decimal.ROUND_HALF_UP)) / 10**down
            assert got[i] == want or got[i] == pytest.approx(want, rel=1e-15), (a, b)


# -- numbering -------------------------------------------------------------------------------------
def test_equal_rows_are_numbered_by_several_tasks(spark):
    rows = spark.range(120_000).select(F.lit(5).alias("k"), F.lit("same").alias("v")).unionByName(
        spark.range(1000).select(F.col("id").cast("int").alias("k"), F.lit("own").alias("v")))
    out = dense_surrogate_key(tagged(rows), ["k", "v"], "sk", rows=121_000)
    got = out.agg(F.count("*"), F.countDistinct("sk"), F.min("sk"), F.max("sk")).first()
    assert tuple(got) == (121_000, 121_000, 1, 121_000)
    assert out.where("k < 5").agg(F.max("sk")).first()[0] == 5 and out.where("k > 5").agg(F.min("sk")).first()[0] == 121_000 - 993
    files = out.where("v = 'same'").groupBy(F.spark_partition_id()).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 60_000
    assert "FileScan parquet" in _plan(out) and "ExistingRDD" not in _plan(out)


def test_scratch_is_released(spark, tmp_out):
    kept = shared(spark.range(3), "probe")
    folder = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].replace("//", "/")
    assert os.path.isdir(folder)
    assert release_scratch(spark) >= 1 and not os.path.isdir(folder) and release_scratch(spark) == 0


# -- names -----------------------------------------------------------------------------------------
def test_rare_names_are_looked_up_beside_frequent_ones(spark, monkeypatch):
    names = ["hot"] * 50 + ["warm"] * 20 + [f"n{i}" for i in range(30)] + [None, None, "unknown"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    mapping = spark.createDataFrame([("hot", 1), ("warm", 2), *((f"n{i}", 10 + i) for i in range(30))], "name string, id int")
    want = {(i, n, dict(mapping.collect()).get(n)) for i, n in enumerate(names)}
    for most in (1024, 2, 1):
        monkeypatch.setattr(L, "HOT_NAMES", most)
        assert {tuple(r) for r in L.map_by_name(df, mapping, "name", "id").select("i", "name", "id").collect()} == want


def test_no_row_is_shuffled_on_a_name(spark, no_broadcast):
    star = Star(spark, SF_SMALL)
    for report in (Ld.fact_load, Ld.enriched_raw, Ld.composite_order_ids, Ld.unmapped_keys):
        plan = _plan(report(star))
        assert "hashpartitioning(Product Name" not in plan and "hashpartitioning(Factory" not in plan, report.__name__


# -- keys ------------------------------------------------------------------------------------------
@pytest.mark.parametrize("kind", ["long", "string"])
def test_orphan_rows(spark, kind):
    rng = random.Random(3)
    keys = [rng.choice([0, 1, -1, -32768, 32768, 32769, 10**12, -10**12, rng.randint(-10**5, 10**5)]) for _ in range(400)]
    parent = {k for k in keys if rng.random() < 0.6}
    rows = [(i, k if rng.random() < 0.95 else None, rng.choice([1, 2, 3])) for i, k in enumerate(keys)]
    child = spark.createDataFrame(rows, "i int, k long, p int").withColumn("k", F.col("k").cast(kind))
    one = spark.createDataFrame([(k,) for k in sorted(parent)] * 2 + [(None,)], "k long").withColumn("k", F.col("k").cast(kind))
    two = spark.createDataFrame([(1,), (2,)], "q long")
    got = {(r.relationship, r.key_value, r.i) for r in Q.fk_orphan_rows(child, [("a", "k", one, "k"), ("b", "p", two, "q")]).collect()}
    want = {("a", str(k), i) for i, k, _ in rows if k is not None and k not in parent} | {("b", "3", i) for i, _, p in rows if p == 3}
    assert got == want
    counts = {r.relationship: r.orphan_rows for r in Q.fk_orphans([("a", child, "k", one, "k"), ("b", child, "p", two, "q")]).collect()}
    assert counts == {"a": sum(x[0] == "a" for x in want), "b": sum(x[0] == "b" for x in want)}


def test_large_bitmaps_are_shuffled(spark, monkeypatch, no_broadcast):
    monkeypatch.setattr(Q, "BITMAP_BYTES", 0)
    child, parent = spark.range(100_000).withColumnRenamed("id", "k"), spark.range(0, 100_000, 2).withColumnRenamed("id", "k")
    rows = Q.fk_orphan_rows(child, [("a", "k", parent, "k")])
    assert "BroadcastHashJoin" not in _plan(rows)
    assert tuple(rows.agg(F.count("*"), F.min("k"), F.max("k"), F.countDistinct("k")).first()) == (50_000, 1, 99_999, 50_000)


def test_orphans_read_the_fact_once(spark):
    star = Star(spark, SF_SMALL)
    for report in (Ld.fk_orphans, Ld.early_load_orphans):
        plan = _plan(report(star))
        assert sum("FileScan parquet" in x and "lineitem" in x for x in plan.split("== Physical Plan ==")[1].splitlines()) == 1, report.__name__


# -- intervals -------------------------------------------------------------------------------------
def test_interval_join_equals_the_theta_join(spark):
    rng = random.Random(8)
    values = [(i, rng.choice([None, rng.randint(-10**16, 10**16), rng.randint(-300, 300)])) for i in range(300)]
    bounds = [None, -10**16, -50, 0, 1, 10**16, *(rng.randint(-300, 300) for _ in range(30))]
    bands = [(f"b{i}", rng.choice(bounds), rng.choice(bounds)) for i in range(80)]
    v = spark.createDataFrame(values, "i int, x long")
    b = spark.createDataFrame(bands, "band string, lo long, hi long")
    got = sorted((r.i, r.band) for r in range_join(v, "x", b, "lo", "hi").collect())
    assert got == sorted((i, n) for i, x in values for n, lo, hi in bands if x is not None and (lo is None or x >= lo) and (hi is None or x < hi))
    assert range_join(v, "x", b.limit(0), "lo", "hi").count() == 0


def test_bands_given_as_a_table(spark):
    m = [0.5, 9.99, 10.0, 10.0, 33.33, 33.34, -4.0, None, 100.0]
    v = spark.createDataFrame([(x, D(i)) for i, x in enumerate(m)], "gross_margin_pct double, g decimal(12,2)").withColumn("Gross Profit", F.col("g"))
    rows = [("low", None, D("10"), 1), ("mid", D("9.985"), D("33.335"), 2), ("mid", D("100"), None, 2), ("none", D("40"), D("50"), 3), ("empty", D("5"), D("5"), 4)]
    bands = spark.createDataFrame(rows, "margin_band string, min_pct decimal(9,3), max_pct decimal(9,3), sort_band int")
    got = {r.margin_band: (r.num_records, r.pct_transaction_volume, r.total_profit, r.avg_margin_pct) for r in margin_volume_of(v, bands).collect()}
    # low holds 0.5, 9.99 and -4; mid holds 9.99, 10, 10, 33.33 and 100
    assert got == {"low": (3, 37.5, 7.0, 2.16), "mid": (5, 62.5, 18.0, 32.66), "none": (0, 0.0, 0.0, None), "empty": (0, 0.0, 0.0, None)}


# -- running totals --------------------------------------------------------------------------------
def test_running_totals_equal_the_window(spark):
    df = spark.range(3000).select("id", ((F.col("id") * 7919) % 1000 - 300).alias("x")).withColumn("x", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("x")))
    order = [F.col("x").desc_nulls_last(), F.col("id").asc()]
    got = running_totals(df, order, {"run": "x"})
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("run", F.sum(F.coalesce("x", F.lit(0))).over(w))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


# -- the bucketed star -------------------------------------------------------------------------------
def test_reports_by_order_do_not_move_the_fact(spark, no_broadcast, tmp_out):
    stored = materialize_star(Star(spark, SF_SMALL), f"{tmp_out}/star")
    again = StoredStar(spark, f"{tmp_out}/star", raw_source=Star(spark, SF_SMALL))
    for star in (stored, again):
        for name in ("factory_margin_stability", "customer_profit", "country_profit"):
            plan = _plan(REPORTS[name](star))
            assert "Exchange hashpartitioning(Order ID" not in plan and "Bucketed: true" in plan, name
    spark.sql(f"DROP TABLE {_table_name(f'{tmp_out}/star', 'order')}")
    assert "Bucketed: true" in _plan(REPORTS["customer_profit"](StoredStar(spark, f"{tmp_out}/star")))  # a session that did not write it


# -- loads -------------------------------------------------------------------------------------------
def test_a_repeated_or_broken_load_leaves_one_copy(spark, tmp_out):
    path = f"{tmp_out}/loads"
    one, two = spark.range(5), spark.range(100, 103)
    assert insert_select(one, path, "2024-01") == 5 and insert_select(two, path, "2024-02") == 3 and insert_select(one, path, "2024-01") == 5
    read = lambda: sorted((r.id, r.load_id) for r in read_loads(spark, path, one.schema).collect())
    want = [(i, "2024-01") for i in range(5)] + [(i, "2024-02") for i in range(100, 103)]
    assert read() == want
    broken = spark.range(0, 5, 1, 4).select(F.when(F.col("id") == 4, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        insert_select(broken, path, "2024-02")
    assert read() == want
    assert insert_select(two.limit(0), path, "2024-02") == 0 and read() == want[:5]


# -- CSV ---------------------------------------------------------------------------------------------
def test_lines_that_do_not_parse_are_kept_apart(spark, tmp_out):
    head = "Units,Product Name,Sales,Customer ID"
    lines = [head, '1,"Bar, dark",2.50,7', '2,"He said ""no""",x,8', "3,Plain,1.00", "4,Too,1.00,9,10", '5,"open,1.00,9', "", '6,"a""b",0.10,', head]
    path = f"{tmp_out}/raw.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    rows, bad = read_checked_csv(spark, path)
    got = {r["Units"]: (r["Product Name"], r["Sales"] and float(r["Sales"]), r["Customer ID"], r["_bad_columns"]) for r in rows.collect()}
    assert got == {1: ("Bar, dark", 2.5, 7, None), 2: ('He said "no"', None, 8, "Sales"), 6: ('a"b', 0.1, None, None)}
    assert {(r.line, r.reason) for r in bad.collect()} == {(lines[3], "missing fields"), (lines[4], "extra fields"), (lines[5], "open quote")}
    assert all(r.file.endswith("raw.csv") for r in bad.collect())


def test_one_ordered_csv(spark, tmp_out):
    df = spark.range(5000).select(((F.col("id") * 37) % 5000).alias("n"), F.concat(F.lit('a "b", '), F.col("id")).alias("The Text"))
    path = f"{tmp_out}/out.csv"
    for _ in range(2):  # written anew
        write_ordered_csv(df, path, [F.col("n").desc()])
    lines = open(path, encoding="utf-8").read().splitlines()
    assert lines[0] == "n,The Text" and [int(x.split(",")[0]) for x in lines[1:]] == list(range(4999, -1, -1))
    assert [f for f in os.listdir(tmp_out) if "parts" in f] == []
