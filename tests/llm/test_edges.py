"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from profitlens.llm import (bpe, chat_format, class_lm, decontaminate, html_extract, jaccard_join, line_dedup, quality_knn,
                            quality_rules, suffix_dedup)
from profitlens.llm.common import crc_mod, reach
from profitlens.llm.queries import vocabulary_path

LONG = " ".join(f"w{i}x" for i in range(40_000))
SHARED = " ".join(f"shared passage word number {i}" for i in range(40))
TEXTS = [(1, "alpha beta gamma delta epsilon zeta eta"), (2, None), (3, ""), (None, "a line that repeats here\nanother one"), (None, None),
         (4, LONG), (5, LONG), (6, "a line that repeats here\nown words"), (6, "a line that repeats here\nown words"),
         (7, SHARED + " one"), (8, "x " + SHARED), (9, " \t\n\x0b "), (10, "é" * 3000), (11, "ab" * 2000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["h", "dkey", "tkey", "sid", "salt", "ids", "score", "kept", "keep", "w", "rid", "c", "n", "host", "templates"]


@pytest.fixture(scope="module")
def docs(spark):
    reach(spark)
    rows = [(i, t, None if i == 1 else "en", None if i == 4 else "s", len(t or "")) for i, t in TEXTS]
    out = spark.createDataFrame(rows, SCHEMA)
    for c in CLASH:
        out = out.withColumn(c, F.lit("clash"))
    return out.cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 1), (6, None, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")


def _operators(spark, labels):
    benchmark = spark.createDataFrame([(1, SHARED), (2, None), (3, "too short"), (None, "")], "item_id long, text string")
    source = bpe.vocabulary(spark, vocabulary_path())
    learn = crc_mod("doc_id", 4) != 2
    return {
        "quality": lambda d: quality_knn.classify(d, quality_knn.fit(d, labels, learn)),
        "lines": line_dedup.dedup_lines,
        "jaccard": jaccard_join.similar,
        "bpe": lambda d: bpe.decode(bpe.encode(d, source), source),
        "suffix": suffix_dedup.dedup_substrings,
        "rules": quality_rules.apply_rules,
        "lm": lambda d: class_lm.score(d, crc_mod("doc_id", 10) != 0),
        "leaks": lambda d: decontaminate.matches(d, benchmark),
    }


@pytest.mark.parametrize("name", ["quality", "lines", "jaccard", "bpe", "suffix", "rules", "lm", "leaks"])
def test_edges(spark, docs, empty, labels, name):
    run = _operators(spark, labels)[name]
    assert run(empty).count() == 0
    got = run(docs).collect()
    if name != "leaks":
        assert len(got) == len(TEXTS)
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in TEXTS)
    if name == "quality":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    if name == "lines":
        kept = {(r.doc_id, r.kept_text) for r in got}
        assert (6, "a line that repeats here\nown words") in kept and (None, "another one") in kept and (5, "") in kept
    if name == "jaccard":
        by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
        assert by[5, 39_996] == 4 and by[2, 0] == 2 and by[None, 0] is None
        assert by[8, 197] == 7 and by[7, 197] == 7
    if name == "bpe":
        assert sorted(r.decoded for r in got) == sorted(t or "" for _, t in TEXTS)
    if name == "suffix":
        by = {r.doc_id: r for r in got}
        assert by[4].n_removed == by[4].n_bytes and bytes(by[5].kept) == b"" and by[2].n_bytes == 0 and by[6].n_removed == 0
        assert by[10].n_removed == 6000 and by[11].n_removed == 4000  # a text that repeats itself
    if name == "rules":
        assert all(not r.kept for r in got if r.base_failed) and {r.n_words for r in got if r.doc_id == 4} == {40_000}
    if name == "lm":
        assert {r.n_tokens for r in got if r.doc_id in (2, 3, 9)} == {1}
    if name == "leaks":
        assert sorted(r.doc_id for r in got if r.leaked) == [7, 8]


def test_stages(spark, docs, empty, labels, tmp_out):
    labels.write.parquet(f"{tmp_out}/labels.parquet")
    spark.createDataFrame([(1, SHARED)], "item_id long, text string").write.parquet(f"{tmp_out}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tmp_out).count() == 0
        out = stage(spark, docs, tmp_out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        got = [r.doc_id for r in out.collect()]
        if name == "n-gram Jaccard join":
            assert 5 not in got and 8 not in got and 2 in got and got.count(None) == 2
        if name == "benchmark decontamination":
            assert 7 not in got and 8 not in got and len(got) == len(TEXTS) - 2
        if name == "line dedup":
            assert len(got) == len(TEXTS)


def test_reparameterised_question(spark):
    reach(spark)
    item = "how many apples does Mary sell if she sells 12 apples for 3 dollars and then another 12 apples later today"
    same = item.replace("Mary", "Peter").replace("12", "57").replace("3 dollars", "eight euros")
    mixed = item.replace("12 apples for", "57 apples for")  # 12 stands for two values
    docs = spark.createDataFrame([(1, "so " + same), (2, mixed), (3, item.upper())], "doc_id long, text string")
    got = decontaminate.matches(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert {r.doc_id: r.leaked for r in got} == {1: True, 2: False, 3: True}


def test_pages(spark):
    reach(spark)
    page = ("<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div>"
            "<article><h1>Head &amp; line</h1><p><b>One\n  two<br><p>Three</p><div class='comments'><p>nice</p></div></article><footer>f</footer>")
    bare = "<body><div>Every page says this</div><p>Own {} text</p></body>"
    rows = [(1, "http://a.example/1", page), (2, None, None), (3, "x", ""), (3, "x", "")]
    rows += [(10 + i, f"http://b.example/{i}", bare.format(i)) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    got = [(r.page_id, r.text) for r in html_extract.extract(pages).collect()]
    assert (1, "Head & line\nOne two\nThree") in got and (2, "") in got and got.count((3, "")) == 2
    assert (12, "Own 2 text") in got
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_chat(spark):
    reach(spark)
    calls = '{"tool_calls":[{"id":"b","name":"t","arguments":{"x":1},"after":["a"]},{"id":"a","name":"t","arguments":{"x":"no"}}]}'
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (2, 0, "assistant", calls), (2, 1, "tool", '{"tool_call_id":"a","content":2}'),
            (2, 2, "tool", '{"tool_call_id":"z"}'), (3, 0, None, None), (None, None, "user", ""),
            (4, 0, "assistant", '{"tool_calls":[{"id":"p","name":"t","arguments":{"x":1},"after":["q"]},{"id":"q","name":"u","after":["p"]}]}')]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    schemas = chat_format.SCHEMAS | {"t": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}}
    got = {(r.conv_id, r.kind, r.id): r for r in chat_format.link_tool_calls(table, schemas).collect()}
    assert got[1, "call", "1:0"].status == "linked" and got[1, "result", "1:0"].status == "linked"
    assert got[2, "call", "a"].status == "linked" and not got[2, "call", "a"].valid and got[2, "call", "b"].status == "open"
    assert got[2, "call", "a"].rank < got[2, "call", "b"].rank
    assert got[2, "result", "z"].status == "orphan" and got[4, "call", "p"].status == "cycle"
    assert got[2, "call", "b"].json == '{"arguments":{"x":1},"id":"b","name":"t"}'
    assert chat_format.link_tool_calls(table.limit(0)).count() == 0


def test_bpe_equals_the_library():
    import numpy as np
    import pyarrow as pa
    from hypothesis import given, settings, strategies as st
    from tokenizers import Tokenizer

    coder, library = bpe.Encoder(open(vocabulary_path()).read()), Tokenizer.from_file(vocabulary_path())

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(max_size=60) | st.text(alphabet="ab the'sll.,!\n\t 019é日", max_size=60) | st.just("x<|endoftext|> y"), max_size=6))
    def check(texts):
        values, first = coder.encode_array(pa.array(texts, pa.string()))
        for t, i, j in zip(texts, first[:-1], first[1:]):
            want = library.encode(t, add_special_tokens=False).ids
            assert values[i:j].tolist() == want
            assert coder.decode(np.array(want, dtype=np.int64)).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)

    check()


def test_suffix_sort_against_plain_sorting():
    import numpy as np
    import random

    rng = random.Random(3)
    for _ in range(20):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 60))]
        group = np.sort(np.array([rng.randint(0, 5) for _ in texts]))
        end = np.cumsum([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        order, lcp = suffix_dedup.suffix_sort(data, end - [len(t) for t in texts], end, group)
        assert [(group[i], texts[i]) for i in order] == sorted((group[i], texts[i]) for i in range(len(texts)))
        for j in range(1, len(texts)):
            x, y = texts[order[j - 1]], texts[order[j]]
            same = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert lcp[j] == (same if group[order[j - 1]] == group[order[j]] else -1)


def test_digest_of_an_empty_text(spark):
    from profitlens.llm.queries import bpe_digests

    reach(spark)
    r = bpe_digests(spark.createDataFrame([(1, None)], "doc_id long, text string"), vocabulary_path()).first()
    assert r.n_tokens == 0 and r.ids_sha256 == r.decoded_sha256 == hashlib.sha256(b"").hexdigest()
