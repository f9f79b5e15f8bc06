"""Readers and writers: the star schema over the driver's test tables, raw CSV, exported CSV."""

from profitlens.sources.proxy import Star, read_table  # noqa: F401
