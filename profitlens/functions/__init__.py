"""Column builders shared by every report (all JVM-side ``pyspark.sql.functions``)."""

from profitlens.functions.measures import (  # noqa: F401
    MONEY,
    average,
    avg_money,
    avg_pct,
    cents,
    dollars,
    half_up,
    money_sum,
    pct,
    per_unit,
    ratio,
    sum_cents,
)
from profitlens.functions.bands import (  # noqa: F401
    band_by_ranges,
    band_by_upper,
    band_table_df,
    range_table_label,
    three_group,
)
from profitlens.functions.dates import month_start, parse_date  # noqa: F401
