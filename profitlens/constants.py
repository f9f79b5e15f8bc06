"""Fixed values that must equal the reference's for identical results.

Everything here is data, stated plainly and in the reference's own order.  Labels use the
en dash (U+2013) exactly where the reference does; ``<10%`` and ``>=40%`` are ASCII there.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# FIXED VALUES — margin band labels and edges (percent of sales).
# ---------------------------------------------------------------------------------------------

# Range table of the all-bands volume report: (label, min_pct, max_pct, sort_band); a row belongs
# to a band when min_pct <= margin < max_pct.  The last band deliberately ends at 101.
MARGIN_BAND_TABLE = [
    ("0–9.99%", 0, 10, 0),
    ("10–19.99%", 10, 20, 10),
    ("20–29.99%", 20, 30, 20),
    ("30–39.99%", 30, 40, 30),
    ("40–49.99%", 40, 50, 40),
    ("50–59.99%", 50, 60, 50),
    ("60–69.99%", 60, 70, 60),
    ("70–79.99%", 70, 80, 70),
    ("80–89.99%", 80, 90, 80),
    ("90–100%", 90, 101, 90),
]

# Five-band distribution: upper bounds checked in order, everything else (incl. null) is the last.
FIVE_BANDS = ["<10%", "10–19.99%", "20–29.99%", "30–39.99%", ">=40%"]
FIVE_BAND_UPPER = [10, 20, 30, 40]

# Three-group split: below 10, 10 up to 40, everything else (incl. null).
THREE_GROUPS = ["<10%", "10–39.99%", ">=40%"]

# Sub-bands inside the high-margin universe; the last one is closed at 100, no else-label.
SUB_BANDS = [
    ("40–49.99%", 40, 50),
    ("50–59.99%", 50, 60),
    ("60–69.99%", 60, 70),
    ("70–79.99%", 70, 80),
    ("80–89.99%", 80, 90),
    ("90–100%", 90, 100),
]

# Ten-label month-stability banding: upper bounds in order, else the last label (incl. null).
TEN_BANDS = [label for label, *_ in MARGIN_BAND_TABLE]
TEN_BAND_UPPER = [10, 20, 30, 40, 50, 60, 70, 80, 90]

# Two core-volume bands used by the per-band top-10 reports.
CORE_BANDS = [("60–69.99%", 60, 70), ("70–79.99%", 70, 80)]

# High-margin universe and watch-list windows (closed ranges).
HIGH_MARGIN = (40, 100)
EXTREME_MARGIN = (80, 100)

# Entity type labels of the concentration report.
ENTITY_FACTORY = "Factory"
ENTITY_PRODUCT = "Product"

# Metric labels of the overall KPI chart, in output order.
KPI_METRICS = ["Sales", "Cost", "Gross Profit"]

# ---------------------------------------------------------------------------------------------
# FIXED VALUES — product and factory name maps of the source system.
# ---------------------------------------------------------------------------------------------

# Product name -> Product ID as the SQL load defines it (unlisted names are dropped there).
PRODUCT_ID_BY_NAME_SQL = [
    ("Wonka Bar", "WB"),
    ("Wonka Bar - Triple Dazzle Caramel", "WBTC"),
    ("Wonka Bar - Scrumdiddlyumptious", "WBSL"),
    ("Wonka Bar - Fudge Mallows", "WBFM"),
    ("Wonka Bar - Milk Chocolate", "WBMC"),
    ("Wonka Bar - Nutty Crunch Surprise", "WBNS"),
    ("Wonka Gum", "WG"),
    ("SweeTARTS", "ST"),
    ("Lickable Wallpaper", "LW"),
    ("Kazookles", "KK"),
    ("Everlasting Gobstopper", "EG"),
    ("Fizzly Lifting Drinks", "FLD"),
    ("Nerds", "ND"),
    ("Fun Dip", "FD"),
    ("Laffy-Taffy", "LT"),
    ("Hair Toffee", "HT"),
]

# Product name -> Product ID as the notebooks define it (includes one alternate spelling).
PRODUCT_ID_BY_NAME_NOTEBOOK = [
    ("Wonka Bar", "WB"),
    ("Wonka Bar - Triple Dazzle Caramel", "WBTC"),
    ("Wonka Bar - Scrumdiddlyumptious", "WBSL"),
    ("Wonka Bar -Scrumdiddlyumptious", "WBSL"),
    ("Wonka Bar - Fudge Mallows", "WBFM"),
    ("Wonka Bar - Milk Chocolate", "WBMC"),
    ("Wonka Bar - Nutty Crunch Surprise", "WBNS"),
    ("Wonka Gum", "WG"),
    ("SweeTARTS", "ST"),
    ("Lickable Wallpaper", "LW"),
    ("Kazookles", "KK"),
    ("Everlasting Gobstopper", "EG"),
    ("Fizzy Lifting Drinks", "FL"),
    ("Nerds", "ND"),
    ("Fun Dip", "FD"),
    ("Laffy Taffy", "LT"),
    ("Hair Toffee", "HT"),
]

# Factory name -> short factory code (notebooks).
FACTORY_CODE_BY_NAME = [
    ("Wicked Choccy's", "WC"),
    ("Lot's O' Nuts", "LON"),
    ("Secret Factory", "SF"),
    ("Sugar Shack", "SS"),
    ("The Other Factory", "TOF"),
]
