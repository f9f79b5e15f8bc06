"""Token files, alignment and byte-pair encoding against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from profitlens.llm import bpe, token_align, token_file
from profitlens.llm.common import reach, table
from profitlens.llm.queries import bpe_digests, vocabulary_path

from conftest import SF_MEDIUM

ODD = ["", None, " ", "  ", "a ", " a", "a  b", "a\n b", "\n\n", "▁", "x ▁y", "<|endoftext|>", "a<|startoftext|>b", "<s> </s>", "\x00a", "a\x1cb c", "a\u0085 b",
       "ﬁ ① Å é é", "👩‍👩‍👧 x", "﻿bom", "İstanbul Ĳ ŉ ſ", "'LL don'T we're 12 345", "漢字かな交じり", "a b　c", "é" * 3000, "ab" * 2000, "w " * 3000 + "end"]


def _texts(n: int = 300) -> list:
    rng = random.Random(2)
    parts = list("ab \n\t .,'1é漢😀▁<|") + ["<|endoftext|>", "'s", "  ", "\r\n", "foo", "Ünï", "The", " the", " of"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def _docs(spark, texts, copies: bool = True):
    rows = [(i, t) for i, t in enumerate(texts)] + ([(None, "no id"), (None, None), (3, "same id"), (5, texts[5]), (5, texts[5])] if copies else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("slice", F.lit(1)).withColumn("x.y", F.lit(2))
    return rows, docs.withColumn("seq", F.lit(0)).repartition(4)


# -- the codec ------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, token_file.MAX_ID - 1), max_size=400), st.integers(1, 90))
def test_blocks_round_trip(ids, block):
    blocks = token_file.encode_blocks(np.array(ids, dtype=np.int64), block)
    assert len(blocks) == -(-len(ids) // block)
    assert token_file.decode_blocks(blocks).tolist() == ids


def test_blocks_compress_and_stand_alone():
    rng = np.random.default_rng(3)
    phrase = rng.integers(0, 49_408, 40)
    ids = np.concatenate([phrase if rng.random() < 0.7 else rng.integers(0, 49_408, 40) for _ in range(600)])
    blocks = token_file.encode_blocks(ids, 2048)
    assert sum(map(len, blocks)) < 0.6 * 2 * len(ids)  # repeated phrases are predicted by their last two ids
    assert token_file.decode_blocks([blocks[3]]).tolist() == ids[3 * 2048: 4 * 2048].tolist()
    assert sum(map(len, token_file.encode_blocks(np.zeros(8192, dtype=np.int64)))) < 800
    with pytest.raises(ValueError):
        token_file.encode_blocks(np.array([token_file.MAX_ID]))


def test_damage_is_named():
    blocks = token_file.encode_blocks(np.arange(9000) % 300, 1000)
    for at, what in ((0, "damaged"), (token_file.HEADER.size + 40, "checksum")):
        bad = bytearray(blocks[2])
        bad[at] ^= 1
        with pytest.raises(ValueError, match=f"block 2 .*{what}"):
            token_file.decode_blocks([*blocks[:2], bytes(bad), *blocks[3:]])
    with pytest.raises(ValueError, match="block 0 is damaged"):
        token_file.decode_blocks([blocks[0][:-2]])


# -- token files ----------------------------------------------------------------------------------
def _library(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


def _expected_file(rows):
    library, at, out = _library("word_bpe_49k.json"), 0, []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((i, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    return out


def test_token_file_equals_the_library(spark, monkeypatch):
    reach(spark)
    rows, docs = _docs(spark, _texts(), copies=False)
    source = token_file.vocabulary(spark, vocabulary_path("word_bpe_49k.json"))
    assert sorted(map(tuple, token_file.read(token_file.write(docs, source, 1)).collect())) == _expected_file(rows)
    assert token_file.read(token_file.write(docs.limit(0), source, 1)).count() == 0


def test_token_file_of_null_and_repeated_ids(spark):
    reach(spark)
    rows, docs = _docs(spark, ODD)
    source = token_file.vocabulary(spark, vocabulary_path("word_bpe_49k.json"))
    got = sorted(map(tuple, token_file.read(token_file.write(docs, source, 1)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got[-2:]] == [None, None]
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((r[0], r[2], r[3]) for r in _expected_file(rows))


def test_segments_split_between_documents():
    source = open(vocabulary_path("word_bpe_49k.json"), encoding="utf-8").read()
    words = token_file.Words(source)
    texts = [t or "" for t in _texts(50)]
    ids, first = words.encode(pa.array(texts, pa.string()))
    full = _library("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)
    assert all(ids[first[i]: first[i + 1]].tolist() == full[i].ids for i in range(len(texts)))


# -- alignment ------------------------------------------------------------------------------------
def _brute_alignment(texts):
    """Results by comparing all pairs of byte ranges, and the links of each text."""
    aligner = token_align.Aligner(open(vocabulary_path(), encoding="utf-8").read(), open(vocabulary_path("piece_bpe_32k.model"), "rb").read())
    rows, links = [], []
    for t in texts:
        got, own = (0, 0, 0, 0, ""), Counter()
        if t:
            a, b = aligner.a.encode(" " + t, add_special_tokens=False).ids, aligner.b.encode(t)
            parts = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
            if b"".join(parts[0]) == b"".join(parts[1]) == (" " + t).encode():
                ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
                cuts, groups, i, j = sorted({*ends[0]} & {*ends[1]}), [], 0, 0
                for c in cuts:
                    x, y = ends[0].index(c) + 1, ends[1].index(c) + 1
                    groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
                    i, j = x, y
                spans = [list(zip([0, *e[:-1]], e)) for e in ends]
                near = zip(np.searchsorted(ends[1], [s + 1 for s, _ in spans[0]]).tolist(), np.searchsorted(ends[1], [e for _, e in spans[0]]).tolist())
                for k, (lo, hi) in enumerate(near):
                    for m in range(lo, hi + 1):
                        assert spans[0][k][0] < spans[1][m][1] and spans[1][m][0] < spans[0][k][1]
                        own[a[k], b[m]] += 1
                got = (len(a), len(b), len(groups), sum(own.values()), hashlib.sha256(";".join(groups).encode()).hexdigest())
        rows.append(got)
        links.append(own)
    return rows, links


def test_alignment_equals_brute_force(spark, monkeypatch):
    reach(spark)
    rows, docs = _docs(spark, _texts())
    plain, links = _brute_alignment([t for _, t in rows])
    total = sum(links, Counter())
    most: dict = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    want = Counter()
    for (i, _), (na, nb, ng, nl, sha), own in zip(rows, plain, links):
        best = sum(n for p, n in own.items() if total[p] == most[p[1]])
        want[i, na, nb, ng, nl, best, sum(n * total[p] for p, n in own.items()), sha] += 1
    source = token_align.vocabularies(spark, vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))
    assert Counter(tuple(r) for r in token_align.align(docs, source).collect()) == want
    assert token_align.align(docs.limit(0), source).count() == 0


@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40))
def test_shared_cuts_are_all_shared_ends(x, y):
    x, y = [*x, max(0, sum(y) - sum(x))], [*y, max(0, sum(x) - sum(y))]
    a, b = (np.cumsum([v for v in z if v]).tolist() for z in (x, y))
    got = token_align.shared_cuts(a, b)
    assert [a[i - 1] for i, _ in got] == [b[j - 1] for _, j in got] == sorted({*a} & {*b})


# -- byte-pair encoding ----------------------------------------------------------------------------
def test_bpe_equals_the_library_on_the_table(spark):
    reach(spark)
    docs = table(spark, SF_MEDIUM, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(_texts())], "doc_id long, text string")
    both = docs.unionByName(extra)
    got = {r.doc_id: r for r in bpe_digests(both, vocabulary_path()).collect()}
    library, sha = _library("byte_bpe_50k.json"), lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = both.collect()
    for r, e in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True):
        g = got[r.doc_id]
        assert g.n_tokens == len(e.ids) and g.ids_sha256 == sha(",".join(map(str, e.ids))), r.text
        assert g.decoded_sha256 == sha(library.decode(e.ids, skip_special_tokens=False))


def test_ids_and_digests_agree(spark):
    reach(spark)
    rows, docs = _docs(spark, ODD)
    source = bpe.vocabulary(spark, vocabulary_path())
    long = Counter((r.doc_id, len(r.ids), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in bpe.decode(bpe.encode(docs, source), source).collect())
    assert long == Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.digests(docs, source).collect())
