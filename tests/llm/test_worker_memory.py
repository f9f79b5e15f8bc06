"""What a Python worker holds at once is bounded by bytes, not by how many rows come in."""

from __future__ import annotations

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from profitlens.llm import bpe, source_divergence, suffix_dedup, token_align
from profitlens.llm.queries import vocabulary_path
from profitlens.llm.slices import sliced


def test_suffixes_are_sorted_in_bunches_of_whole_anchors(monkeypatch):
    draw = random.Random(3)
    text = lambda n: bytes(draw.choices(b"abcdefgh", k=n))
    rows, k = [], 0
    for anchor in range(60):
        middle = text(500)
        for _ in range(4):
            left, right = text(draw.randrange(1, 60)), text(draw.randrange(1, 60))
            rows.append((1, anchor, 0, k, k, len(left) + 200, 0, len(left) + len(right) + 100, left + middle + right))
            k += 1
    rows.insert(1, rows[0])  # a repeated row of one document
    types = [pa.int32(), *[pa.int64()] * 7, pa.binary()]
    names = ["kind", "k1", "k2", "dkey", "tkey", "a", "lo", "hi", "bytes"]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    sort, sizes = suffix_dedup.repeated_windows, []
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda texts, *a: sizes.append(sum(map(len, texts))) or sort(texts, *a))

    def found(limit: int, batch: int) -> list[dict]:
        monkeypatch.setattr(suffix_dedup, "BUNCH", limit)
        sizes.clear()
        return sorted((r for b in suffix_dedup._sort_groups(iter(table.to_batches(max_chunksize=batch))) for r in b.to_pylist()), key=str)

    whole = found(1 << 30, 1000)
    assert len(sizes) == 1 and {r["dkey"] for r in whole} == set(range(240))
    for batch in (1000, 3):
        assert found(10_000, batch) == whole
        assert len(sizes) > 10 and max(sizes) <= 10_000


def test_divergence_counts_leave_a_task_in_small_batches():
    texts = [" ".join(f"w{i}" for i in range(k, 50_000, 2)) + f" w{k} both both" for k in (0, 1)]
    columns = [pa.array(["en", "en"]), pa.array(["x", "x"]), pa.array(texts), pa.array([5, 3])]
    batch = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "text", "row"])
    got = list(source_divergence._chunk_counts(iter([batch])))
    assert max(b.num_rows for b in got) <= 20_000
    rows = {r["chunk"]: (r["n"], r["docs"], r["lo"], r["hi"]) for b in got for r in b.to_pylist()}
    want = {f"w{i}": (1 + (i < 2), 1, 5 - 2 * (i % 2), None) for i in range(50_000)}
    assert rows == want | {"both": (4, 2, 3, 5)}


def test_bpe_digests_hold_a_small_slice_of_a_batch():
    with open(vocabulary_path(), encoding="utf-8") as f:
        source = SimpleNamespace(value=f.read())
    draw = np.random.default_rng(2)
    words = ["".join(draw.choice(list("etaoinsr"), 6)) for _ in range(3000)]
    texts = [" ".join(draw.choice(words, 3000)) for _ in range(400)]  # 8 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["doc_id", "text"])
    list(bpe.digest_batches(iter([batch.slice(0, 1)]), source))  # the tables
    tracemalloc.start()
    got = [r for b in bpe.digest_batches(iter([batch]), source) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["doc_id"] for r in got] == list(range(400)) and min(r["n_tokens"] for r in got) > 3000
    assert peak < 16 << 20


def test_slices_of_aligned_tokens_are_small_rows():
    with open(vocabulary_path(), encoding="utf-8") as a, open(vocabulary_path("piece_bpe_32k.model"), "rb") as b:
        aligner = token_align.Aligner(a.read(), b.read())
    draw = np.random.default_rng(2)
    words = ["".join(draw.choice(list("etaoinsr"), 5)) for _ in range(20_000)]
    texts = [" ".join(draw.choice(words, 3000)) for _ in range(400)]  # 7 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["doc_id", "text"])
    rows = [token_align._slice(i, b.column("doc_id"), aligner, b.column("text")) for i, b in enumerate(sliced(iter([batch]), "text", token_align.SLICE))]
    assert sum(len(r.column("doc_id")[0]) for r in rows) == 400
    assert max(r.nbytes for r in rows) < 2 << 20  # such rows are stored, shuffled and sorted
    assert sum(r.nbytes for r in rows) < batch.nbytes


def test_packed_numbers_are_given_back():
    for values in ([], [0], [5, 0, 255, 256, 70_000, 2**32 - 1]):
        got = token_align.unpacked(token_align.packed(np.array(values, dtype=np.int64)))
        assert got.tolist() == values
