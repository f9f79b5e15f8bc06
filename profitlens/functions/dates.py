"""Date helpers: tolerant parsing (STR_TO_DATE) and month buckets (DATE_FORMAT '%Y-%m-01')."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    """String → date, NULL on unparsable input (``try_to_date``; plain ``to_date`` raises)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_date(c.cast("string"), fmt)


def month_start(c) -> Column:
    """First day of the month as a ``yyyy-MM-01`` string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-01")
