"""Customer reports (A32-A39) and the stated-but-uncoded questions on customers and geography
(G1-G4, G6, G7).

The customer of a fact row is only known through ``Order``.  Every plan therefore first sums the
fact per ``Order ID`` (partial aggregation, one shuffle on the order key) and joins ``Order`` to
those per-order rows: the join reuses the aggregate's hash partitioning, so the fact side is
shuffled exactly once, and a hot order key has been collapsed to one row before the join.
Higher levels (customer → state → country) aggregate the already-reduced rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitlens import constants as K
from profitlens.functions.measures import average, dollars, pct, sum_cents
from profitlens.operators.joins import attach_dim
from profitlens.operators.share import shared
from profitlens.operators.topk import first_and_last, top_n

CID, OID, PID, PNAME, FID = "Customer ID", "Order ID", "Product ID", "Product Name", "Factory ID"
TGP = "Total Gross Profit"

_RAW_SUMS = ["n_rows", "sales_raw", "cost_raw", "profit_raw", "units_raw"]


def _sum_cols(prefix_cols=_RAW_SUMS):
    return [F.sum(c).alias(c) for c in prefix_cols]


def order_totals(ff: DataFrame, order: DataFrame) -> DataFrame:
    """Per-order sums with the order's customer attached (fact rows without an order drop out)."""
    per_order = ff.groupBy(OID).agg(
        F.count(F.lit(1)).alias("n_rows"),
        sum_cents("Sales").alias("sales_raw"),
        sum_cents("Cost").alias("cost_raw"),
        sum_cents("Gross Profit").alias("profit_raw"),
        F.sum("Units").alias("units_raw"),
    )
    return per_order.join(order.select(OID, CID), OID, "inner")


def customer_totals(ff: DataFrame, order: DataFrame) -> DataFrame:
    """Per-customer sums plus the number of distinct orders (one per-order row each); the profit of a
    customer whose profits are all NULL is 0 (H17)."""
    return (
        order_totals(ff, order)
        .where(F.col(CID).isNotNull())
        .groupBy(CID)
        .agg(F.count(F.lit(1)).alias("n_orders"), *_sum_cols())
        .withColumn("profit_raw", F.coalesce("profit_raw", F.lit(0)))
    )


# -- A32-A33 -------------------------------------------------------------------------------------
def customer_profit(ff: DataFrame, order: DataFrame) -> DataFrame:
    """Total gross profit per customer, highest first (null customers dropped, H17)."""
    return _customer_profit_rows(ff, order).orderBy(F.col(TGP).desc(), CID)


def _customer_profit_rows(ff: DataFrame, order: DataFrame) -> DataFrame:
    return customer_totals(ff, order).select(CID, dollars("profit_raw").alias(TGP))


def best_worst_customer(ff: DataFrame, order: DataFrame) -> DataFrame:
    """First and last customer of A32's ordering (ties by Customer ID)."""
    return first_and_last(
        _customer_profit_rows(ff, order),
        [F.col(TGP).desc_nulls_last(), F.col(CID).asc()],
        [F.col(TGP).asc_nulls_first(), F.col(CID).desc()],
    )


# -- A34-A39: what the best / worst customer buys --------------------------------------------------
def _customer_product_sums(ff: DataFrame, order: DataFrame, product: DataFrame, positions, by: str) -> DataFrame:
    """Units and profit per (position, product key) for the best and/or worst customer.

    The chosen customers are at most two rows (broadcast).  Their orders are found by joining
    ``Order`` to them; how the fact then meets those orders is left to the planner, because a
    single customer may own a large share of all orders."""
    chosen = best_worst_customer(ff, order).where(F.col("position").isin(*positions)).select("position", CID)
    their_orders = order.select(OID, CID).join(F.broadcast(chosen), CID, "inner").select("position", OID)
    rows = ff.select(OID, PID, "Units", "Gross Profit").join(their_orders, OID, "inner")
    per_pid = rows.groupBy("position", PID).agg(
        F.sum("Units").alias("units_raw"), sum_cents("Gross Profit").alias("profit_raw")
    )
    if by == PID:
        keyed = per_pid.where(F.col(PID).isNotNull())
    else:
        keyed = (
            attach_dim(per_pid, product, PID, [PNAME])
            .where(F.col(PNAME).isNotNull())
            .groupBy("position", PNAME)
            .agg(F.sum("units_raw").alias("units_raw"), F.sum("profit_raw").alias("profit_raw"))
        )
    return keyed.select(
        "position",
        by,
        F.coalesce(F.col("units_raw"), F.lit(0)).cast("bigint").alias("Units"),
        F.coalesce(dollars("profit_raw"), F.lit(0.0)).alias("Gross Profit"),
    )


def customer_products_by_units(ff, order, product) -> DataFrame:
    """Units per product for the best and the worst customer, most units first."""
    s = _customer_product_sums(ff, order, product, ("best", "worst"), PNAME)
    return s.select("position", PNAME, "Units").orderBy("position", F.col("Units").desc(), PNAME)


def customer_products_by_gp(ff, order, product) -> DataFrame:
    """Profit per product for the best and the worst customer."""
    s = _customer_product_sums(ff, order, product, ("best", "worst"), PNAME)
    return s.select("position", PNAME, "Gross Profit").orderBy("position", F.col("Gross Profit").desc(), PNAME)


def customer_products_units_gp(ff, order, product) -> DataFrame:
    """Units and profit per product for the best and the worst customer."""
    s = _customer_product_sums(ff, order, product, ("best", "worst"), PNAME)
    return s.orderBy("position", F.col("Gross Profit").desc(), PNAME)


def best_customer_top5(ff, order, product, n: int = 5) -> DataFrame:
    """The best customer's n most profitable products (by name)."""
    s = _customer_product_sums(ff, order, product, ("best",), PNAME).drop("position")
    return top_n(s, [F.col("Gross Profit").desc(), F.col(PNAME).asc()], n)


def best_customer_top5_by_id(ff, order, product, n: int = 5) -> DataFrame:
    """The same keyed by Product ID."""
    s = _customer_product_sums(ff, order, product, ("best",), PID).drop("position")
    return top_n(s, [F.col("Gross Profit").desc(), F.col(PID).asc()], n)


def best_customer_bottom10(ff, order, product, n: int = 10) -> DataFrame:
    """Ascending sort then the first n — the best customer's *least* profitable products
    (the source labels this "top 10"; H6)."""
    s = _customer_product_sums(ff, order, product, ("best",), PNAME).drop("position")
    return top_n(s, [F.col("Gross Profit").asc(), F.col(PNAME).asc()], n)


# -- G1-G4, G6, G7 -----------------------------------------------------------------------------
def _geo_metrics(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum("n_rows").alias("num_records"),
        dollars(F.sum("sales_raw")).alias("total_sales"),
        dollars(F.sum("cost_raw")).alias("total_cost"),
        dollars(F.sum("profit_raw")).alias("total_gross_profit"),
        pct(F.sum("profit_raw"), F.sum("sales_raw")).alias("gross_margin_pct"),
    )


def _customer_geo(ff, order, customer, materialise: bool = False) -> DataFrame:
    geo = customer.select(CID, "Country/Region", "State/Province", "City")
    cg = customer_totals(ff, order).join(geo, CID, "inner")
    return shared(cg) if materialise else cg


def country_profit(ff, order, customer) -> DataFrame:
    """G1: records, sales, cost, profit and margin per country."""
    return _geo_metrics(_customer_geo(ff, order, customer), ["Country/Region"]).orderBy(
        F.col("total_gross_profit").desc(), "Country/Region"
    )


def _best_one(df: DataFrame, key: str) -> DataFrame:
    return top_n(df, [F.col("total_gross_profit").desc(), F.col(key).asc_nulls_last()], 1).select(key)


def top_states_best_country(ff, order, customer, n: int = 5) -> DataFrame:
    """The n most profitable states/provinces of the most profitable country."""
    cg = _customer_geo(ff, order, customer, materialise=True)
    best = _best_one(_geo_metrics(cg, ["Country/Region"]), "Country/Region")
    states = _geo_metrics(cg.join(F.broadcast(best), "Country/Region"), ["Country/Region", "State/Province"])
    return top_n(states, [F.col("total_gross_profit").desc(), F.col("State/Province").asc_nulls_last()], n).drop(
        "total_cost"
    )


def top_cities_best_region(ff, order, customer, n: int = 10) -> DataFrame:
    """The n most profitable cities of the best state of the best country."""
    cg = _customer_geo(ff, order, customer, materialise=True)
    best_country = _best_one(_geo_metrics(cg, ["Country/Region"]), "Country/Region")
    in_country = cg.join(F.broadcast(best_country), "Country/Region")
    best_state = _best_one(_geo_metrics(in_country, ["State/Province"]), "State/Province")
    cities = _geo_metrics(
        in_country.join(F.broadcast(best_state), "State/Province"), ["Country/Region", "State/Province", "City"]
    )
    return top_n(cities, [F.col("total_gross_profit").desc(), F.col("City").asc_nulls_last()], n).drop("total_cost")


def customer_profit_vs_orders(ff, order) -> DataFrame:
    """Profit relative to the number of orders, per customer."""
    return customer_totals(ff, order).select(
        CID,
        F.col("n_orders").alias("num_orders"),
        dollars("profit_raw").alias("total_gross_profit"),
        average("profit_raw", "n_orders").alias("profit_per_order"),
    ).orderBy(F.col("profit_per_order").desc(), CID)


def top_customers_discount(ff, order, n: int = 10) -> DataFrame:
    """Discount candidates — the n customers with the highest profit."""
    rows = customer_totals(ff, order).select(
        CID,
        F.col("n_orders").alias("num_orders"),
        dollars("sales_raw").alias("total_sales"),
        dollars("profit_raw").alias("total_gross_profit"),
    )
    return top_n(rows, [F.col("total_gross_profit").desc(), F.col(CID).asc()], n)


def loss_makers(ff, order) -> DataFrame:
    """Products, factories and customers whose summed profit is negative.

    One scan of the fact: its sums per product, factory and order (grouping sets) are stored once; customers
    come from the order rows."""
    g = shared(
        ff.groupingSets([[PID], [FID], [OID]], PID, FID, OID).agg(
            F.grouping_id().alias("_set"),
            F.count(F.lit(1)).alias("num_records"),
            sum_cents("Gross Profit").alias("profit_raw"),
        )
    )

    def entities(entity_type: str, key: str, grouping: int) -> DataFrame:
        rows = g.where((F.col("_set") == grouping) & F.col(key).isNotNull())
        return rows.select(F.lit(entity_type).alias("entity_type"), F.col(key).cast("string").alias("entity_id"),
                           "num_records", "profit_raw")

    prod, fac = entities(K.ENTITY_PRODUCT, PID, 0b011), entities(K.ENTITY_FACTORY, FID, 0b101)
    per_order = g.where(F.col("_set") == 0b110).select(OID, "num_records", "profit_raw")
    cust = (
        per_order.join(order.select(OID, CID).where(F.col(CID).isNotNull()), OID)
        .groupBy(CID)
        .agg(F.sum("num_records").alias("num_records"), F.sum("profit_raw").alias("profit_raw"))
        .select(F.lit("Customer").alias("entity_type"), F.col(CID).cast("string").alias("entity_id"), "num_records", "profit_raw")
    )
    return (
        prod.unionByName(fac)
        .unionByName(cust)
        .where(F.col("profit_raw") < 0)
        .select("entity_type", "entity_id", "num_records",
                dollars("profit_raw").alias("total_gross_profit"))
        .orderBy("total_gross_profit", "entity_type", "entity_id")
    )
