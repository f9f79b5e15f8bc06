"""What the driver holds for a step does not grow with copies of the classifier's sample or with tasks over few links."""

from __future__ import annotations

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from profitlens.llm import common, quality_knn


def test_the_fit_holds_the_sample_once(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(900)}" for _ in range(60))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    quality_knn.fit(docs.limit(3), labels, F.lit(True))  # what is loaded once
    tracemalloc.start()
    model = quality_knn.fit(docs, labels, F.lit(True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model["labels"].tolist() == [float(i % 2) for i in range(1500)]
    assert peak < 2 * 1500 * quality_knn.DIMS * 4


@pytest.mark.parametrize("few", [1 << 17, 0])
def test_few_links_stay_in_one_partition(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    draw = random.Random(5)
    links = [(i, i + 1) for i in range(0, 30)] + [(draw.randrange(100, 400), draw.randrange(100, 400)) for _ in range(250)] + [(500, 500), (600, 601), (601, 600)]
    root = {n: n for link in links for n in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = common.components(spark.createDataFrame(links, "a long, b long"))
        rows, parts = got.collect(), got.rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, rows)) == sorted((n, r) for n, r in root.items() if n != 500)
    assert parts == 1 if few else parts > 1
