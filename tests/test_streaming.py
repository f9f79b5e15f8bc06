"""The streaming surface computes the same band counts and KPIs as the batch reports."""

import os
import tempfile

from profitlens.plans import overall as O
from profitlens.sources.proxy import Star
from profitlens.streaming.incremental import fact_stream, start_memory_sink, streaming_band_counts, streaming_kpis

from conftest import SF_SMALL


def test_stream_matches_batch(spark, tmp_out):
    star = Star(spark, SF_SMALL)
    src = os.path.join(tmp_out, "facts")
    fact = star.fact
    # two arrivals of fact files
    fact.where("`Order ID` % 2 = 0").write.parquet(os.path.join(src, "a"))
    fact.where("`Order ID` % 2 = 1").write.parquet(os.path.join(src, "b"))
    v = fact_stream(spark, os.path.join(src, "*"))
    q1 = start_memory_sink(streaming_band_counts(v), "band_counts", tempfile.mkdtemp())
    q2 = start_memory_sink(streaming_kpis(v), "kpis", tempfile.mkdtemp())
    try:
        q1.processAllAvailable()
        q2.processAllAvailable()
        got = {r.margin_band: (r.num_records, r.total_profit) for r in spark.table("band_counts").collect()}
        want = {
            r.margin_band: (r.num_records, r.total_profit)
            for r in O.margin_volume_all_bands(star.v).collect()
            if r.num_records > 0
        }
        assert got == want
        k = spark.table("kpis").collect()[0]
        b = O.kpi_totals(star.v).collect()[0]
        assert (k.total_sales, k.total_cost, k.total_gross_profit, k.gross_margin_pct) == tuple(b)
    finally:
        q1.stop()
        q2.stop()
