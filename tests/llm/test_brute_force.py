"""Whole results of the operators that SQL can't express, against plain Python on small inputs."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from profitlens.llm import class_lm, decontaminate, html_extract, quality_knn, quality_rules, suffix_dedup
from profitlens.llm.common import crc_mod, reach, table
from profitlens.llm.queries import op9_quality_rules, op10_lm_score

from conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- suffix-array dedup -----------------------------------------------------------------------------
def _repeats(texts):
    """Removed bytes of each text: all LENGTH-byte strings, by a dictionary."""
    n, seen = suffix_dedup.LENGTH, {}
    for i, t in enumerate(texts):
        for p in range(len(t) - n + 1):
            seen.setdefault(t[p: p + n], []).append((i, p))
    gone = [np.zeros(len(t), dtype=bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p: p + n] = True
    return gone


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 2])
def test_repeated_bytes(spark, monkeypatch, group):
    reach(spark)
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # with 2 an anchor of three contexts leaves the suffix sort
    rng = random.Random(9)
    noise = lambda k: "".join(rng.choice("abcdefgh é") for _ in range(k))
    long, short = noise(700), noise(380)
    edge = [long[:n] for n in (399, 400, 401, 450)]
    texts = [noise(rng.randint(0, 300)) + rng.choice([long, short, long[100:], *edge, long[:350] + "#" + long[350:], ""]) + noise(rng.randint(0, 300)) for _ in range(40)]
    texts += ["ab" * 700, "x" * 399, "x" * 400, "y" * 401, "", long + long, noise(5) + long + noise(5), "tail " + texts[0]]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x.y", F.lit(1)).repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.dedup_substrings(docs).collect()}
    for i, gone in enumerate(_repeats([t.encode() for t in texts])):
        data = np.frombuffer(texts[i].encode(), dtype=np.uint8)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(data), int(gone.sum()), runs), i
        assert bytes(got[i].kept) == data[~gone].tobytes()


def test_an_anchor_with_very_many_contexts(spark):
    reach(spark)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(410))
    n = suffix_dedup.GROUP + 150  # more contexts of one anchor than a task sorts
    rows = [(i, f"{i:06d}" * 20 + passage + f"{i * 7919 % 1000003:06d}" * 20) for i in range(n)]
    rows.append((n, "own " + passage[:399] + "!" + "end " * 50))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.dedup_substrings(docs).select("doc_id", "n_removed", "kept").collect()}
    assert got[n][0] == 0 and all(v[0] >= 410 for i, v in got.items() if i < n)
    for (i, t), gone in zip(rows, _repeats([t.encode() for _, t in rows])):
        assert got[i] == (int(gone.sum()), hashlib.sha256(np.frombuffer(t.encode(), dtype=np.uint8)[~gone].tobytes()).hexdigest())


# -- quality rules ----------------------------------------------------------------------------------
def _base(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i: i + 3]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_base_counts_on_the_table(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF_SMALL, "documents").collect()}
    got = op9_quality_rules(spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        n, chars, symbols, dup, again = _base(docs[r.doc_id])
        failed = n < 50 or 100 * again > 50 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, again, failed)
        assert not (failed and r.kept)


def _concentrate(x, subset, floor, steps=30):
    """Plain concentration steps; the determinant's half logarithm, mean and covariance at their end."""
    h = int(np.ceil(quality_rules.H * len(x)))
    for _ in range(steps):
        mean, cov = x[subset].mean(axis=0), np.cov(x[subset].T, bias=True) + np.diag(floor)
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        subset = np.argsort(d, kind="stable")[:h]
    return np.linalg.slogdet(np.cov(x[subset].T, bias=True) + np.diag(floor))[1] / 2, d


def _two_clouds(seed=1):
    """A long thin cloud, and a compact one beside its middle that the medians are near to."""
    rng = np.random.default_rng(seed)
    main = rng.normal(size=(300, 1)) * 6 * np.array([[1, 1, 1, 1]]) + rng.normal(size=(300, 4)) * 0.05
    off = rng.normal(size=(95, 4)) * 0.3 + np.array([1.5, -1.5, 1.5, -1.5])
    return np.vstack([main, off])


def test_the_least_determinant_wins_over_single_starts(spark):
    reach(spark)
    x = _two_clouds()
    q = np.round(x * 1e6).astype(int)
    rows = [(0, "en", "s", i, *map(int, r)) for i, r in enumerate(q)]
    df = spark.createDataFrame(rows, "level int, lang string, source string, seed long, x0 long, x1 long, x2 long, x3 long").repartition(4)
    alone = [quality_rules.group_estimates(df, only=k).first().det for k in range(3)]
    best = quality_rules.group_estimates(df)
    assert best.count() == 1
    det = best.first().det
    assert all(det <= a + 1e-6 for a in alone)
    floor = np.array(quality_rules.FLOOR) ** 2
    truth, _ = _concentrate(x, np.arange(300), floor)
    assert det <= truth + 0.02  # as low as from the uncontaminated rows
    again = quality_rules.group_estimates(df.repartition(1)).first()
    assert again.det == det  # does not depend on how rows are dealt
    far = quality_rules._distance(df, best, quality_rules._GROUP).orderBy("seed").select("d2").toPandas()["d2"].to_numpy()
    assert far[300:].min() > np.quantile(far[:300], 0.99)


# -- language model ---------------------------------------------------------------------------------
def test_counts_and_base_scores_on_the_table(spark):
    import math
    import zlib
    from collections import Counter

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = {r.doc_id: [*(w.translate(low) for w in WORD.findall(r.text or "")), None] for r in table(spark, SF_SMALL, "documents").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    count = Counter(w for i, words in docs.items() if not held[i] for w in words)
    total = sum(count.values())
    down = math.log10(total + 0.1 * (len(count) + 1))
    got = op10_lm_score(spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    gain = tokens = 0
    for r in got:
        words = docs[r.doc_id]
        want = sum(math.log10(count[w] + 0.1) - down for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words), sum(count[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(want, rel=1e-9, abs=1e-9)
        if r.held_out:
            gain, tokens = gain + r.score - r.base_score, tokens + r.n_tokens
    assert gain / tokens > 0.1  # digits a held-out token better than the base


# -- quality classifier -----------------------------------------------------------------------------
def test_words_alone_tell_documents_apart(spark):
    reach(spark)
    rng = random.Random(11)
    good, bad = ([f"{a}{b}{c}a" for b in "aeiou" for c in "lmnr"] for a in "bd")  # one shape
    text = lambda kind: " ".join(rng.choice(kind) for _ in range(60))
    rows = [(i, text(bad if i % 2 else good)) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, None), (900, ""), (7, rows[7][1])], "doc_id long, text string").withColumn("x.y", F.lit(1))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] * 2 + [(5000, 1), (3, None)], "doc_id long, quality int")
    model = quality_knn.fit(docs, labels, crc_mod("doc_id", 4) != 2)
    got = quality_knn.classify(docs, model).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got)
    late = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 400]
    assert all(r.predicted == 1 - r.doc_id % 2 for r in late)
    assert len({r.score for r in got if r.doc_id == 7}) == 1


def test_no_labels_and_ties(spark):
    reach(spark)
    docs = spark.createDataFrame([(i, "the same text") for i in range(60)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_knn.classify(docs, quality_knn.fit(docs, none, F.lit(True))).collect()} == {0.5}
    half = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")  # all neighbours tie
    scores = {round(r.score, 6) for r in quality_knn.classify(docs, quality_knn.fit(docs, half, F.lit(True))).collect()}
    assert scores == {0.5}


# -- benchmark decontamination ----------------------------------------------------------------------
def test_items_without_windows_are_found_whole(spark):
    reach(spark)
    items = [(1, "Paris is the capital"), (2, "Compute 3 + 4 * 5 - 6 / 7 + 8 * 9"), (3, "42"), (4, "1 2 3 4 5 6 7 8 9 10 11 12"), (5, ""), (None, "no id here"), (6, "two words")]
    docs = [(10, "We know that PARIS is the capital of France."), (11, "compute 3 + 4 * 5 - 6 / 7 + 8 * 9 now"), (12, "compute 3 + 4 * 5 - 6 / 7 + 8 * 1 now"), (13, "42"), (14, "it is 42"),
            (15, "0 1 2 3 4 5 6 7 8 9 10 11 12 13"), (16, "1 2 3 4 5 6 7 8 9 10 11 13"), (17, "paris the capital is"), (18, None), (19, "There is no id here."), (20, "Two words"), (21, "two words more")]
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.leaked} == {(10, 1), (11, 2), (13, 3), (15, 4), (19, None), (20, 6)}


def test_copied_items_on_the_table(spark):
    """Every item whose tokens stand in a document is found, and nothing that shares no window of 8 tokens."""
    docs = table(spark, SF_SMALL, "documents")
    bench = table(spark, SF_SMALL, "benchmark")
    split = re.compile(r"[^\W_]+(?:[.,]\d+)*")
    tokens = lambda t: [w.lower() for w in split.findall(t or "")]
    items = {r.item_id: tokens(r.text) for r in bench.collect()}
    got = {(r.doc_id, r.item_id): r.leaked for r in decontaminate.matches(docs, bench).collect()}
    for r in docs.collect():
        text = f" {' '.join(tokens(r.text))} "
        for i, words in items.items():
            if len(words) >= 3 and f" {' '.join(words)} " in text:
                assert got.get((r.doc_id, i)), (r.doc_id, i)
    texts = {r.doc_id: set(tokens(r.text)) for r in docs.collect()}
    for (d, i), leaked in got.items():
        if leaked:
            assert len(texts[d] & set(items[i])) >= 4


def test_large_benchmarks_are_shuffled(spark, monkeypatch):
    reach(spark)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    item = "how many apples does Mary sell if she sells 12 apples for 3 dollars and then another 12 apples later today"
    docs = spark.createDataFrame([(1, "so " + item.replace("Mary", "Peter").replace("12", "57")), (2, "nothing of it")], "doc_id long, text string")
    got = decontaminate.matches(docs, spark.createDataFrame([(9, item), (8, "Paris is the capital")], "item_id long, text string"))
    assert [(r.doc_id, r.item_id, r.leaked) for r in got.collect()] == [(1, 9, True)]
    assert decontaminate.matches(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


# -- HTML extraction ----------------------------------------------------------------------------------
KEPT = {
    '<p title="The hidden valley">Kept</p>': "Kept",
    '<p title="x class=ad y">Kept</p>': "Kept",
    '<div data-role="navigation">Kept</div>': "Kept",
    '<p>a <a href="/hidden-gems">link</a></p>': "a link",
    '<article><section id="notice-period"><p>Kept</p></section><div class="social-history">too</div><div class="cookie-notice">no</div></article>': "Kept\ntoo",
    "<article><p>one</p></article><article><p>two</p></article>": "one\ntwo",
    "<p>a < b and <b>c</b></p>": "a < b and c",
    "<p>x<br>y<div>z</div>": "x y\nz",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc",
    "<p hidden>no</p><p style='color:red; display : none'>no</p><p>yes &amp; &eacute;</p>": "yes & é",
    "<script>if (a < b) '</p>'</script>t<!-- <p>no</p> -->u": "tu",
    '<p>before</p><a href="never closed': "before",
    "text only": "text only",
}


def test_what_is_kept_of_a_page():
    for page, text in KEPT.items():
        assert "\n".join(html_extract.blocks(page)[1]) == text, page


@pytest.mark.parametrize("page", ["<a " * 350_000, "<b>" * 100_000 + "</i>" * 100_000, '<a x="' * 170_000, "<script></script " * 60_000, "<div>" * 60_000 + "<li>x</li>" * 60_000,
                                  "<b>" * 60_000 + "<p>x</p>" * 60_000, "<a " + "x=1 " * 250_000 + ">t", "&amp" * 250_000, "<" * 1_000_000])
def test_long_pages_take_time_in_proportion(page):
    import time

    t = time.process_time()
    html_extract.blocks(page)
    assert time.process_time() - t < 20  # a quadratic parser takes minutes


def test_templates_alone_change_the_result(spark):
    reach(spark)
    page = "<body><div><b>Fresh {} today</b></div><section>Read more of our stories</section><div>Own words of page {}</div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i, i)) for i in range(6)] + [(9, "http://other.example/", page.format(1, 9))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("x.y", F.lit(1))
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == {i: f"Fresh {i} today\nOwn words of page {i}" for i in range(6)} | {9: "Fresh 1 today\nRead more of our stories\nOwn words of page 9"}
    off = {r.page_id: r.text for r in html_extract.extract(pages, min_pages=100).collect()}
    assert all("Read more" in t for t in off.values())
