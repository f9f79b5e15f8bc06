"""profitlens: sales and profitability analytics as Spark DataFrame plans.

Layout
------
- ``sources``   readers for the star schema (test-table proxy, raw CSV, exported CSV) and sinks
- ``functions`` column builders: margin, guarded ratios, shares, bands, month bucket
- ``operators`` reusable relational steps: clean view, quality checks, load, keys, joins, top-k
- ``plans``     the named reports, one ``DataFrame -> DataFrame`` function each, plus the catalog
- ``streaming`` the same band/KPI reports over a file stream of fact rows
"""

__version__ = "0.1.0"
