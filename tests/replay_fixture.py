"""The replay fixture: a synthetic 7,957-row sales fact whose reports reproduce the reference's
exported results.  Unit prices and costs were inferred from the exported product totals; each
product's units are spread over its rows as evenly as possible (first rows get the remainder).
Rows are generated JVM-side from a 12-row parameter table (``sequence`` + ``explode``)."""

from pyspark.sql import functions as F

# FIXED VALUES — (Product ID, Product Name, Factory, rows, units, unit price, unit cost)
PRODUCTS = [
    ("WBTC", "Wonka Bar - Triple Dazzle Caramel", "Wicked Choccy's", 1989, 7490, "3.75", "1.30"),
    ("WBMC", "Wonka Bar - Milk Chocolate", "Wicked Choccy's", 2071, 7999, "3.25", "1.14"),
    ("WBNS", "Wonka Bar - Nutty Crunch Surprise", "Lot's O' Nuts", 1789, 6664, "3.49", "1.00"),
    ("WBFM", "Wonka Bar - Fudge Mallows", "Lot's O' Nuts", 1778, 6792, "3.60", "1.20"),
    ("LW", "Lickable Wallpaper", "Secret Factory", 90, 379, "20.00", "10.00"),
    ("WG", "Wonka Gum", "Secret Factory", 120, 478, "1.25", "0.60"),
    ("EG", "Everlasting Gobstopper", "Secret Factory", 3, 13, "10.00", "2.00"),
    ("KK", "Kazookles", "The Other Factory", 96, 371, "3.25", "3.00"),
    ("HT", "Hair Toffee", "The Other Factory", 4, 17, "4.50", "1.00"),
    ("ST", "SweeTARTS", "Sugar Shack", 10, 41, "1.50", "0.80"),
    ("ND", "Nerds", "Sugar Shack", 4, 10, "1.50", "0.80"),
    ("FD", "Fun Dip", "Sugar Shack", 3, 8, "1.50", "0.90"),
]


def replay_tables(spark):
    """(fact, product) DataFrames of the replay fixture."""
    params = spark.createDataFrame(
        PRODUCTS, "pid string, pname string, factory string, n int, units int, price string, cost string"
    )
    rows = params.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    units = (F.floor(F.col("units") / F.col("n")) + F.when(F.col("i") <= F.col("units") % F.col("n"), 1).otherwise(0)).cast("int")
    price = F.col("price").cast("decimal(12,2)")
    cost = F.col("cost").cast("decimal(12,2)")
    fact = rows.select(
        F.monotonically_increasing_id().alias("Order ID"),
        F.col("factory").alias("Factory ID"),
        F.col("pid").alias("Product ID"),
        units.alias("Units"),
    ).join(params.select(F.col("pid").alias("Product ID"), price.alias("_p"), cost.alias("_c")), "Product ID")
    fact = fact.select(
        "Order ID", "Factory ID", "Product ID", "Units",
        (F.col("_p") * F.col("Units")).cast("decimal(12,2)").alias("Sales"),
        (F.col("_c") * F.col("Units")).cast("decimal(12,2)").alias("Cost"),
    ).withColumn("Gross Profit", (F.col("Sales") - F.col("Cost")).cast("decimal(12,2)"))
    product = params.select(
        F.col("pid").alias("Product ID"),
        F.col("factory").alias("Factory ID"),
        F.col("pname").alias("Product Name"),
        F.lit(None).cast("string").alias("Division"),
    )
    return fact, product
