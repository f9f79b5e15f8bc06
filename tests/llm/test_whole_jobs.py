"""What an operator must not leave out: small inputs on which a cut would show."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from profitlens.llm import class_lm, decontaminate, html_extract, quality_rules
from profitlens.llm.common import reach


def _text(name: str, n: int = 60) -> str:
    return " ".join(f"{name}{i}" for i in range(n))


def test_distinct_texts_under_null_and_repeated_ids_stay(spark, tmp_out):
    reach(spark)
    rows = [(None, _text("a")), (None, _text("b")), (None, _text("c")), (None, _text("c") + " end"),
            (7, _text("d")), (7, _text("e")), (8, _text("d") + " end"), (9, _text("e") + " end"), (None, "")]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), tmp_out).collect()
    got = sorted((r.doc_id or 0, r.text.split(" ")[0]) for r in out)
    assert got == [(0, ""), (0, "a0"), (0, "b0"), (0, "c0"), (7, "d0"), (7, "e0")]


def test_copies_of_a_page_are_no_template(spark):
    reach(spark)
    layouts = ["<body><article><div><p>Own text {}</p></div></article></body>", "<body><div><p>Own text {}</p></div></body>", "<body><p>Own text {}</p></body>"]
    rows = [(i, url, page.format(i)) for i, page in enumerate(layouts) for url in (f"http://c{i}.example/", None) for _ in range(3)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in out) == [(i, f"Own text {i}") for i in range(3) for _ in range(6)]


def test_rotating_blocks_of_a_large_host_are_templates(spark):
    reach(spark)
    page = "<body><div><b>Block {}</b></div><article><h1>Head {}</h1><p>Own text {}</p><div><i>Offer {}</i></div></article></body>"
    bare = "<body><div><b>Block {}</b></div><p>Own text {}</p></body>"
    rows = [(i, f"http://h.example/{i}", bare.format(i % 40, i) if i % 2 else page.format(i % 40, i, i, i % 40)) for i in range(400)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: f"Own text {i}" if i % 2 else f"Head {i}\nOwn text {i}" for i in range(400)}


def test_outliers_of_small_sources_are_judged(spark):
    reach(spark)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    plain = lambda: " ".join(word() for _ in range(80))
    planted = lambda: " ".join(word() + "#$%&" * 5 for _ in range(80))
    rows = [(i, plain(), "en", f"s{i % 30}") for i in range(90)]  # small sources of a large lang
    rows += [(100 + i, plain(), "de", "big") for i in range(40)]  # a large source
    rows += [(200 + i, plain(), f"l{i}", None) for i in range(5)]  # small langs
    bad = [(300, planted(), "en", "s1"), (301, planted(), "l1", "x"), (302, planted(), None, None), (303, planted(), "de", "tiny")]
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string")
    got = quality_rules.apply_rules(docs).collect()
    assert len(got) == len(rows) + len(bad) and not any(r.base_failed or r.d2 is None for r in got)
    assert sorted(r.doc_id for r in got if not r.kept) == [300, 301, 302, 303]
    few = quality_rules.apply_rules(docs.where("doc_id < 3")).collect()
    assert len(few) == 3 and all(r.kept and r.d2 is not None for r in few)


def test_items_in_other_case_are_leaks(spark):
    reach(spark)
    item = "Today Mary Smith sells 12 red apples in Old Town. Then Peter Miller buys another 7 of them from Mary Smith for 3 dollars"
    cased = [item.upper(), item.lower(), item.title(), item.swapcase(), "so " + item.replace("12", "57").upper() + " AND MORE"]
    docs = [(i, t) for i, t in enumerate(cased)] + [(10, "A TEXT IN CAPITALS THAT HOLDS NOTHING OF THE ITEM BUT A FEW RED APPLES")]
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect() if r.leaked) == [0, 1, 2, 3, 4]


def test_all_words_above_the_threshold_are_clustered(spark):
    reach(spark)
    rng = random.Random(6)
    kinds = [[f"{a}{i}x" for i in range(1500)] for a in "pqr"]  # one surface; the kinds take turns

    def text():
        return " ".join(rng.choice(kinds[j % 3]) for j in range(300))

    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    model, counts = class_lm.fit(docs, F.lit(True))
    often = counts.where((F.col("c") >= class_lm.MIN_COUNT) & (F.col("c") != 400)).count()
    assert often > 4000 and len(model["known"]) >= often and (model["class"] < model["classes"]).all()
    scored = class_lm.score(docs, F.lit(True)).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (scored[0] - scored[1]) / scored[2] > 0.3  # log10(3) = 0.48 a token is the best
