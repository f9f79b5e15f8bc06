"""Star-schema load from the denormalised sales table.

The reference's load script is broken as written (H7); this implements its evident intent:
dimensions are DISTINCT projections of the raw rows, names are mapped to ids through dictionary
tables, orders get a dense surrogate key, and the fact carries the resolved keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitlens.functions.dates import parse_date
from profitlens.functions.measures import MONEY
from profitlens.operators.keys import TAG, dense_group_key, dense_surrogate_key, tagged
from profitlens.operators.share import shared

ORDER_NATURAL_KEY = ["Customer ID", "Order Date", "Ship Date", "Ship Mode"]


# -- small column utilities (B11-B13) --------------------------------------------------------------
def strip_column_names(df: DataFrame) -> DataFrame:
    """Trim whitespace around every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text → double, unparsable → NULL (``pd.to_numeric(errors="coerce")``)."""
    present = [c for c in cols if c in df.columns]
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in present else F.col(c) for c in df.columns])


def rename_row_index(df: DataFrame, index_col: str = "Unnamed: 0", to: str = "Order ID") -> DataFrame:
    """The CSV row index becomes ``Order ID``; an earlier ``Order ID`` column is dropped
    first, since a second column of the same name would be ambiguous (H10)."""
    if to in df.columns:
        df = df.drop(to)
    return df.withColumnRenamed(index_col, to)


# -- dictionary lookups (B8, B9) --------------------------------------------------------------------
#: Names that are looked up by a broadcast: the most frequent ones.  Any other name holds at most
#: 1 / HOT_NAMES of the rows, so that the shuffle that looks it up has no hot key.
HOT_NAMES = 1024


def map_by_name(df: DataFrame, mapping: DataFrame, name_col: str, out_col: str, names: DataFrame | None = None) -> DataFrame:
    """Dictionary lookup ``df[name_col] → out_col``; unknown and NULL names give NULL (``Series.map``).

    ``mapping`` has columns ``name``, ``id`` with one row per name and may be of any size.  The distinct names
    of ``df`` are counted (one pass over that column, added up before any shuffle; ``names``, rows with the
    same names, spares the rest of a costly ``df``) and mapped once.  The most frequent ``HOT_NAMES`` of them
    are broadcast, so that rows with these names are not moved; only rows with a rarer name, if there are
    more names than that, are shuffled on it."""
    used = (df if names is None else names).groupBy(F.col(f"`{name_col}`").alias("_name")).agg(F.count(F.lit(1)).alias("_n")).where("_name is not null")
    ids = mapping.select(F.col("name").alias("_name"), F.col("id").alias(out_col))
    known = shared(used.join(ids, "_name", "left"), "names")
    name = F.col(f"`{name_col}`")
    if known.count() <= HOT_NAMES:
        return df.join(F.broadcast(known.drop("_n")), name == F.col("_name"), "left").drop("_name")
    hot = shared(known.orderBy(F.desc("_n"), "_name").limit(HOT_NAMES).drop("_n"), "hot-names")
    cold = known.drop("_n").join(F.broadcast(hot.select("_name")), "_name", "left_anti")
    tried = df.join(F.broadcast(hot), name == F.col("_name"), "left")
    done = tried.where(F.col("_name").isNotNull() | name.isNull())
    late = tried.where(F.col("_name").isNull() & name.isNotNull()).drop(out_col, "_name").join(cold, name == F.col("_name"), "left")
    return done.unionByName(late.select(*done.columns)).drop("_name")


def composite_order_id(df: DataFrame, out_col: str = "Order ID") -> DataFrame:
    """``<Order Date>_<Customer ID>_<Product ID>`` as text; a missing part prints ``nan``."""
    def part(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("nan"))

    return df.withColumn(out_col, F.concat_ws("_", part("Order Date"), part("Customer ID"), part("Product ID")))


Lookups = dict[str, Callable[[DataFrame], DataFrame]]


def name_lookups(product_map: DataFrame, factory_map: DataFrame, names: DataFrame | None = None) -> Lookups:
    """The lookups of the load step by the column they read; they add ``Product ID`` and ``Factory ID``."""
    return {
        "Product Name": lambda rows: map_by_name(rows, product_map, "Product Name", "Product ID", names),
        "Factory": lambda rows: map_by_name(rows, factory_map, "Factory", "Factory ID", names),
    }


def with_ids(raw: DataFrame | Callable[[Lookups], DataFrame], product_map: DataFrame, factory_map: DataFrame,
             names: DataFrame | None = None) -> DataFrame:
    """``raw`` with ``Product ID`` and ``Factory ID``.  Where the rows are joined from tables that have the names,
    ``raw`` is a function that applies the lookups to those tables, so that no raw row is moved for a lookup."""
    if not isinstance(raw, DataFrame):
        return raw(name_lookups(product_map, factory_map))
    for lookup in name_lookups(product_map, factory_map, names).values():
        raw = lookup(raw)
    return raw


def enrich_raw(raw: DataFrame | Callable[[Lookups], DataFrame], product_map: DataFrame, factory_map: DataFrame,
               names: DataFrame | None = None) -> DataFrame:
    """The notebook enrichment: map product and factory ids, then the row index as Order ID.  ``raw`` may be a
    function (see ``with_ids``); ``names`` has the two name columns of ``raw``, where they can be had for less
    than all of it."""
    mapped = with_ids(raw, product_map, factory_map, raw if names is None and isinstance(raw, DataFrame) else names)
    return rename_row_index(strip_column_names(mapped))


# -- dimensions (B1-B4, B6) -------------------------------------------------------------------------
def dim_customer(raw: DataFrame) -> DataFrame:
    """B1: distinct customer attributes (a customer with two cities yields two rows; Q7 reports it)."""
    return raw.select("Customer ID", "Country/Region", "State/Province", "City", "Postal Code").distinct()


def _order_groups(raw: DataFrame) -> DataFrame:
    return raw.select(*ORDER_NATURAL_KEY).distinct()  # GROUP BY the four columns


def order_keys(raw: DataFrame, rows: int | None = None) -> DataFrame:
    """Distinct raw order tuples with their surrogate ``Order ID`` (natural-key order); ``rows`` is the
    number of raw rows, where it is known."""
    return dense_surrogate_key(_order_groups(raw), ORDER_NATURAL_KEY, "Order ID", rows, distinct=True)


def dim_order(raw: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """B2: one row per (customer, order date, ship date, ship mode), dates parsed leniently."""
    keyed = keyed if keyed is not None else order_keys(raw)
    return keyed.select(
        "Order ID",
        "Customer ID",
        parse_date("Order Date").alias("Order Date"),
        parse_date("Ship Date").alias("Ship Date"),
        "Ship Mode",
    )


def dim_factory(raw: DataFrame, attrs: Sequence[str] = ("Longitude", "Latitude")) -> DataFrame:
    """Distinct factory name (the SQL key) with its location attributes."""
    return raw.select(F.col("Factory").alias("Factory ID"), *attrs).distinct()


def dim_product(raw: DataFrame, product_map: DataFrame) -> DataFrame:
    """Mapped id, factory, name, division — distinct, unmapped names dropped.  A name has one id, so
    DISTINCT comes before the mapping, which then sees one row per product and not one per order line."""
    products = raw.select(F.col("Factory").alias("Factory ID"), "Product Name", "Division").distinct()
    mapped = map_by_name(products, product_map, "Product Name", "Product ID")
    return mapped.where(F.col("Product ID").isNotNull()).select("Product ID", "Factory ID", "Product Name", "Division")


def order_ids(order: DataFrame) -> DataFrame:
    """Distinct order ids (GROUP BY ``Order ID``)."""
    return order.select("Order ID").distinct()  # GROUP BY ``Order ID``


# -- fact (B5) --------------------------------------------------------------------------------------
def fact_load(raw: DataFrame | Callable[[Lookups], DataFrame], product_map: DataFrame, factory_map: DataFrame,
              keyed_orders: DataFrame | None = None, row_index: str = "Unnamed: 0",
              rows: int | None = None) -> DataFrame:
    """Measures of every raw row with its order, product and factory keys and a dense
    ``Financial Figures ID``.

    An order's id is the dense rank of its natural key, which ``dense_group_key`` gives the raw rows in one range
    shuffle; ``keyed_orders``, if they are numbered already, are found by a null-safe equi-join on the four
    columns instead.  The names are looked up as in ``with_ids``.  Ids follow the source's row order
    (AUTO_INCREMENT numbers rows as they are inserted), with the fact columns as tie-breakers where the row index
    repeats.  ``raw`` is read several times (rows, names, numbering): unless it is the result of ``tagged``, it is
    stored first; where it is a function, with its ids in place of its names."""
    if not isinstance(raw, DataFrame):
        raw = mapped = tagged(with_ids(raw, product_map, factory_map), "raw")
    else:
        raw = raw if TAG in raw.columns else tagged(raw, "raw")
        mapped = with_ids(raw, product_map, factory_map, raw)
    rows = raw.count() if rows is None else rows
    source = F.col(f"`{row_index}`").alias("_source_row")
    measures = [F.col("Units").cast("int").alias("Units"), *(F.col(c).cast(MONEY).alias(c) for c in ("Sales", "Cost", "Gross Profit"))]
    ids = ["Factory ID", "Product ID", TAG]
    lines = mapped.select(*ORDER_NATURAL_KEY, source, *measures, *ids)
    if keyed_orders is None:
        lines = dense_group_key(lines, ORDER_NATURAL_KEY, "Order ID", rows)
    else:
        cond = [lines[c].eqNullSafe(keyed_orders[c]) for c in ORDER_NATURAL_KEY]
        lines = lines.join(keyed_orders, cond, "left").select(lines["*"], keyed_orders["Order ID"])
    cols = ["Units", "Sales", "Cost", "Gross Profit", "Order ID", "Factory ID", "Product ID"]
    fact = lines.select("_source_row", *cols, TAG)
    return dense_surrogate_key(fact, ["_source_row", *cols], "Financial Figures ID", rows).select(
        "Financial Figures ID", *cols
    )
