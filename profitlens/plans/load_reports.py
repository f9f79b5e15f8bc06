"""Registered forms of the load pipeline and quality operators over the proxy star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitlens.functions.measures import money_sum
from profitlens.operators import load as L
from profitlens.operators import quality as Q
from profitlens.operators.keys import TAG, dense_surrogate_key, tagged
from profitlens.operators.share import shared
from profitlens.session import ensure_checkpoint_dir
from profitlens.sources.files import insert_select, read_loads
from profitlens.sources.proxy import Star

DOMAIN_COLUMNS = [
    "Product Name", "Factory", "State/Province", "City", "Gross Profit",
    "Ship Mode", "Country/Region", "Division", "Customer ID",
]
FACT_SOURCE = [
    "Unnamed: 0", *L.ORDER_NATURAL_KEY, "Units", "Sales", "Cost", "Gross Profit",
]


def enriched_raw(s: Star) -> DataFrame:
    return L.enrich_raw(lambda lookups: s.raw_of(lookups=lookups), s.product_name_map, s.factory_name_map)


def composite_order_ids(s: Star) -> DataFrame:
    product = lambda rows: L.map_by_name(rows, s.product_name_map, "Product Name", "Product ID")
    mapped = s.raw_of("Unnamed: 0", "Order Date", "Customer ID", lookups={"Product Name": product})
    return L.composite_order_id(mapped).select("Unnamed: 0", "Order ID")


def dim_customer(s: Star) -> DataFrame:
    return L.dim_customer(s.raw_of("Customer ID", "Country/Region", "State/Province", "City", "Postal Code"))


def _order_keys(s: Star) -> DataFrame:
    return L.order_keys(s.raw_of(*L.ORDER_NATURAL_KEY), s.fact_keys.count())


def dim_order(s: Star) -> DataFrame:
    return L.dim_order(None, _order_keys(s))


def dim_factory(s: Star) -> DataFrame:
    return L.dim_factory(s.raw_of("Factory", "Factory Nation"), attrs=("Factory Nation",))


def dim_product(s: Star) -> DataFrame:
    return L.dim_product(s.raw_of("Factory", "Product Name", "Division"), s.product_name_map)


def order_ids(s: Star) -> DataFrame:
    """B6; ids straight from the numbering, where each occurs once."""
    return _order_keys(s).select("Order ID")


def fact_load(s: Star) -> DataFrame:
    return L.fact_load(lambda lookups: s.raw_of(*FACT_SOURCE, lookups=lookups), s.product_name_map, s.factory_name_map)


PK_SOURCE = [
    "Unnamed: 0", *L.ORDER_NATURAL_KEY, "Country/Region", "State/Province", "City", "Postal Code", "Factory", "Factory Nation",
    "Product Name", "Division",
]


def pk_violations(s: Star) -> DataFrame:
    """Q7 over the five loaded tables; the denormalised rows are built once and stored, and each table's keys are
    counted on the columns that make them: generated ids are numbered without the rest of their rows."""
    raw = tagged(s.raw_of(*PK_SOURCE), "raw")
    rows = raw.count()
    lines = dense_surrogate_key(raw.select("Unnamed: 0", TAG), ["Unnamed: 0"], "Financial Figures ID", rows)
    return Q.pk_violations(
        [
            ("Customer", L.dim_customer(raw), "Customer ID"),
            ("Factory", L.dim_factory(raw, attrs=("Factory Nation",)), "Factory ID"),
            ("Product", L.dim_product(raw, s.product_name_map), "Product ID"),
            ("Order", L.order_keys(raw, rows), "Order ID"),
            ("Financial Figures", lines, "Financial Figures ID"),
        ]
    )


def fk_orphans(s: Star) -> DataFrame:
    """Q8; a product's factory is the one its order lines name, as the load step stores it.  The fact is read
    once: its rows are added up by product and factory, with the lines of each that lack an order."""
    lines = Q.with_misses(s.fact_keys.select("Order ID", "Product ID", "Factory ID"), [("_order", s.order, "Order ID", "Order ID")])
    made = lines.groupBy("Product ID", "Factory ID").agg(F.count(F.lit(1)).alias("n"), F.count_if("_order").alias("no_order"))
    made = Q.with_misses(made, [("_product", s.product, "Product ID", "Product ID"), ("_factory", s.factory, "Factory ID", "Factory ID")])
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    counts = made.agg(
        total(F.col("no_order")).alias("order"),
        total(F.when(F.col("_product"), F.col("n"))).alias("product"),
        total(F.when(F.col("_factory"), F.col("n"))).alias("factory"),
        F.count_if("_factory").alias("made_by"),
    )
    facts = Q.named_counts(counts, {
        "order": "Financial Figures.Order ID -> Order", "product": "Financial Figures.Product ID -> Product",
        "factory": "Financial Figures.Factory ID -> Factory", "made_by": "Product.Factory ID -> Factory",
    })
    return facts.unionByName(Q.fk_orphans([("Order.Customer ID -> Customer", s.order, "Customer ID", s.customer, "Customer ID")]))


def early_load_orphans(s: Star) -> DataFrame:
    """Q8 as rows: what a fact load would leave without parents while only orders before 1998, parts up to
    size 40 and suppliers that owe nothing are loaded; every line that breaks a key, once for each."""
    orders = s.order.where(F.col("Order Date") < F.lit("1998-01-01").cast("date"))
    parts = s.table("part").where("p_size <= 40").select(F.col("p_partkey").alias("Product ID"))
    makers = s.table("supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("Factory ID"))
    return Q.fk_orphan_rows(s.fact_keys, [
        ("Financial Figures.Order ID -> Order", "Order ID", orders, "Order ID"),
        ("Financial Figures.Product ID -> Product", "Product ID", parts, "Product ID"),
        ("Financial Figures.Factory ID -> Factory", "Factory ID", makers, "Factory ID"),
    ])


def repeated_load(s: Star) -> DataFrame:
    """The fact loaded year by year into one table, 1996 twice; rows and sales of each load as they ended up."""
    path = f"{ensure_checkpoint_dir(s.spark).rstrip('/')}/loads-{uuid.uuid4().hex}"
    years = s.order.select("Order ID", F.year("Order Date").alias("year"))
    lines = shared(s.fact.join(years, "Order ID"), "lines")
    for year in (1995, 1996, 1997, 1996):
        insert_select(lines.where(F.col("year") == year).drop("year"), path, str(year))
    loaded = read_loads(s.spark, path, lines.drop("year").schema)
    return loaded.groupBy("load_id").agg(F.count(F.lit(1)).alias("num_records"), money_sum("Sales").alias("sales")).orderBy("load_id")


def multi_city_customers(s: Star) -> DataFrame:
    return Q.distinct_values_per_key(s.raw_of("Customer ID", "City"), "Customer ID", "City", "n_cities")


def multi_postal_customers(s: Star) -> DataFrame:
    return Q.distinct_values_per_key(s.raw_of("Customer ID", "Postal Code"), "Customer ID", "Postal Code", "n_postal_codes")


def factory_products(s: Star) -> DataFrame:
    return Q.factory_products(s.fact_keys)


def shared_products(s: Star) -> DataFrame:
    return Q.shared_products(s.fact_keys)


def unmapped_keys(s: Star) -> DataFrame:
    return Q.unmapped_names(s.raw_of("Product Name", "Factory"), s.product_name_map, s.factory_name_map)


def column_domains(s: Star) -> DataFrame:
    """U5 with the domains of the mapped ids: the maps are joined to the distinct names."""
    domains = shared(Q.column_domains(s.raw_of(*DOMAIN_COLUMNS), DOMAIN_COLUMNS))
    out = domains
    for name, mapping, to in (("Product Name", s.product_name_map, "Product ID"), ("Factory", s.factory_name_map, "Factory ID")):
        names = domains.where(F.col("column_name") == name).select(F.col("value").alias("name"))
        ids = names.join(mapping, "name", "left").select(F.lit(to).alias("column_name"), F.col("id").cast("string").alias("value"))
        out = out.unionByName(ids.distinct())
    return out
