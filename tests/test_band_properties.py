"""Property test: the Spark banding expressions agree with a plain statement of the CASE rules
for arbitrary margins (two decimals, NULL, band edges, negatives, > 100)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from profitlens import constants as K
from profitlens.functions.bands import band_by_ranges, band_by_upper, range_table_label, three_group

EDGES = [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 101]
margins = st.one_of(
    st.none(),
    st.sampled_from([float(e) for e in EDGES] + [e - 0.01 for e in EDGES] + [e + 0.01 for e in EDGES]),
    st.integers(min_value=-50000, max_value=50000).map(lambda c: c / 100.0),
)


def five(m):
    if m is not None:
        for label, upper in zip(K.FIVE_BANDS, K.FIVE_BAND_UPPER):
            if m < upper:
                return label
    return K.FIVE_BANDS[-1]


def three(m):
    if m is not None and m < 10:
        return "<10%"
    if m is not None and 10 <= m < 40:
        return "10–39.99%"
    return ">=40%"


def sub(m):
    if m is None:
        return None
    for i, (label, lo, hi) in enumerate(K.SUB_BANDS):
        last = i == len(K.SUB_BANDS) - 1
        if lo <= m and (m <= hi if last else m < hi):
            return label
    return None


def table(m):
    if m is None:
        return None
    for label, lo, hi, _ in K.MARGIN_BAND_TABLE:
        if lo <= m < hi:
            return label
    return None


@settings(max_examples=5, deadline=None)
@given(st.lists(margins, min_size=50, max_size=400))
def test_bands_match_the_case_rules(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, m double")
    m = F.col("m")
    rows = df.select(
        "i", "m",
        band_by_upper(m, K.FIVE_BANDS, K.FIVE_BAND_UPPER).alias("five"),
        three_group(m).alias("three"),
        band_by_ranges(m, K.SUB_BANDS, closed_last=True).alias("sub"),
        range_table_label(m).alias("table"),
    ).collect()
    for r in rows:
        assert (r.five, r.three, r.sub, r.table) == (five(r.m), three(r.m), sub(r.m), table(r.m)), r
