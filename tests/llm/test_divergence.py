"""The source divergence audit against a plain Python version, on a table full of edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from profitlens.llm import source_divergence
from profitlens.llm.common import reach

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    docs = [(t or "", lang or "", source or "") for _, t, lang, source in rows]
    groups, df, count = sorted({(la, so) for _, la, so in docs}), defaultdict(Counter), defaultdict(Counter)
    for t, la, so in docs:
        terms = Counter(w.translate(LOWER) for w in TERM.findall(t))
        df[la].update(terms.keys())
        count[la, so].update(terms)
    out = set()
    for la, so in groups:
        kept = sorted(w for w, n in df[la].items() if n >= 3)
        v = len(kept)
        own = [g for g in groups if g[0] == la]
        total = {g: sum(count[g][w] for w in kept) for g in own}
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + v)
        gap = lambda p, q: (p - q) ** 2 // q
        me = (la, so)
        pairs = [(g[1], sum(gap(share(count[me][w], total[me]), share(count[g][w], total[g])) for w in kept)) for g in own if g != me]
        whole = sum(total.values())
        terms = []
        for w in kept:
            p, q = share(count[me][w], total[me]), share(sum(count[g][w] for g in own), whole)
            if count[me][w] and p > q:
                terms.append((w, gap(p, q)))
        for part, items, top in (("pair", pairs, None), ("term", terms, 200)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(la, so, part, item, value, i + 1) for i, (item, value) in enumerate(items[:top])}
    return out


def _rows():
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(400)] + ["don't", "Zoë", "ZOË", "end.", "END", "a1b", "x_y", "漢字", "é", "é", "foo bar"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(160):
        text = " ".join(rng.choices(words, weights, k=rng.randint(0, 60))) + rng.choice(["", "\n", "\t!", "..."])
        rows.append((i, text, rng.choice(["en", "de", None, ""]), rng.choice(["hot", "hot", "hot", "a", "b", None])))
    rows += [(None, None, None, None), (None, "", "fr", "only"), (7, "word " * 3, "fr", "only"), (7, "word " * 3, "fr", "only"), (8, "word", "fr", "only"),
             (9, "empty source", "fr", "none"), (10, " ".join(f"w{i}x" for i in range(5000)), "en", "long"), (11, "x" * 100_000, "en", "long")]
    return rows


def test_equals_brute_force(spark):
    reach(spark)
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("row", F.lit("clash")).withColumn("chunk", F.lit(1)).withColumn("x.y", F.lit(2))
    got = source_divergence.divergence(docs.repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_empty_table_and_no_kept_terms(spark):
    reach(spark)
    docs = spark.createDataFrame([(1, "one", "en", "a"), (2, "two", "en", "b"), (3, None, "en", "c")], "doc_id long, text string, lang string, source string")
    assert source_divergence.divergence(docs.limit(0)).count() == 0
    assert {tuple(r) for r in source_divergence.divergence(docs).collect()} == {
        ("en", a, "pair", b, 0, i + 1) for a in "abc" for i, b in enumerate(x for x in "abc" if x != a)}


def test_slices_and_partitions_do_not_change_the_result(spark, monkeypatch):
    reach(spark)
    rows = _rows()[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for parts in (1, 7):
        assert {tuple(r) for r in source_divergence.divergence(docs.repartition(parts)).collect()} == brute(rows)
