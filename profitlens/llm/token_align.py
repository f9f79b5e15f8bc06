"""Alignment of two tokenizers: which tokens of A and of B cover the same bytes, and which ids go together.

``shared_cuts`` divides and conquers: the end of an A token near the middle is looked up among the B ends by
bisection, its neighbours outwards if it is none; at a shared end both halves are aligned apart, and an interval
without one is a group.  Two tokens are linked where their byte ranges overlap.

Both tokenizers start a token at a space between two non-spaces, so such places are shared cuts known
beforehand: a text factors into chunks (a space and what follows it), and each distinct chunk is encoded and
aligned once a slice of texts, through a memo of bounded size.  Texts where white space stands before a space, or
at the end, are encoded and aligned whole.

How often an id pair is linked in the corpus is counted from slices: a slice keeps its documents' chunks, its
chunks' links as places in its list of distinct pairs, and how often each pair is linked in it.  Only the
lists are exploded and summed; the counts are joined back to the lists, one row a pair and slice however hot
the pair, and each slice adds them up for its documents.  A slice's list is bounded by the slice.  Slices are stored
and shuffled as rows, so their numbers are packed and a slice is small: executors hold several such rows at once.

Defined results: a text that is null, empty, or not given back byte by byte by B's pieces has no tokens (zeros
and ''); its id stays.  Strings of special tokens are plain text.  A repeated row counts again; null ids are passed
on; an empty table gives no rows; extra columns are not read; texts of any length are taken whole."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from profitlens.llm.common import small, stored
from profitlens.llm.slices import Memo, cut, filled, gathered, released, sliced

#: Bytes of text aligned at once inside a task, and chunks in one generation of a worker's memo.
SLICE = 1 << 21
MEMO = 200_000

_SPACE = "▁"
_WHOLE = re.compile(r"\s | $")  # texts whose chunks do not stand alone
_PLAIN = re.compile(r"[!-~]+")
_BITS = 32
_HEAD = struct.Struct("<4i")  # A tokens, B tokens, groups, links


def shared_cuts(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Ends of the groups, as numbers of A and of B tokens, in order; ``a`` and ``b`` are the tokens' ends and
    have the last one in common."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        if hi - lo > 1 and high - low > 1:
            i = middle = (lo + hi) >> 1
            j = bisect_left(b, a[i - 1], low, high)
            if b[j] != a[i - 1]:
                for step in range(1, hi - lo):
                    i = middle + step
                    if i < hi:
                        j = bisect_left(b, a[i - 1], low, high)
                        if b[j] == a[i - 1]:
                            break
                    i = middle - step
                    if i > lo:
                        j = bisect_left(b, a[i - 1], low, high)
                        if b[j] == a[i - 1]:
                            break
                else:
                    i = 0
            if i:
                todo.append((i, hi, j + 1, high))
                todo.append((lo, i, low, j + 1))
                continue
        out.append((hi, high))
    return out


def _overlaps(a: list[int], b: list[int]) -> Iterator[tuple[int, int]]:
    """Places of the A and B tokens that overlap, by the tokens' ends."""
    i = j = 0
    while i < len(a) and j < len(b):
        yield i, j
        x, y = a[i], b[j]
        i += x <= y
        j += y <= x


class Aligner:
    """Both tokenizers, the bytes of their entries, and the memo of aligned chunks."""

    def __init__(self, a_source: str, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_source)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        own = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
        symbols = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
        size = self.a.get_vocab_size()
        self.a_bytes, self.a_first = [b""] * size, np.zeros(size, dtype=bool)
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(symbols[c] for c in entry) if all(c in symbols for c in entry) else entry.encode()
            self.a_first[i] = self.a_bytes[i][:1] == b" "
        self.a_size = list(map(len, self.a_bytes))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.b_first = np.array([p.startswith(_SPACE) for p in pieces])
        self.names = [str(i) for i in range(max(size, len(pieces)))]
        self.memo = Memo(MEMO)

    def _both(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        a = [e.ids for e in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        return list(zip(a, self.b.encode(texts, num_threads=1) if texts else [], strict=True))

    def _many(self, chunks: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of chunks; plain ones are encoded as one text and cut where entries start with a space."""
        out: list = [None] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if _PLAIN.fullmatch(c)]
        for lo in range(0, len(plain), 5000):
            part = plain[lo: lo + 5000]
            text = " ".join([chunks[i] for i in part])
            ids = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
            cuts = [np.flatnonzero(first[np.array(x)]).tolist() for first, x in zip((self.a_first, self.b_first), ids, strict=True)]
            if any(len(c) != len(part) or c[0] for c in cuts):
                continue  # not as expected: one by one
            for k, i in enumerate(part):
                out[i] = tuple(x[c[k]: c[k + 1] if k + 1 < len(c) else None] for x, c in zip(ids, cuts, strict=True))
        late = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(late, self._both([chunks[i] for i in late]), strict=True):
            out[i] = v
        return out

    def _aligned(self, text: str, a: list[int], b: list[int]) -> bytes:
        """The packed result of a chunk: its counts (``_HEAD``), its pairs, and its groups as text; b"" for none."""
        whole = b" " + text.encode()
        b_bytes = [self.b_bytes[i] for i in b]
        # A's bytes are the text's by its construction; that they are as many is checked
        a_ends, b_ends = list(accumulate([self.a_size[i] for i in a])), list(accumulate(map(len, b_bytes)))
        if not a_ends or a_ends[-1] != len(whole) or b"".join(b_bytes) != whole:
            return b""
        groups, i, j, names = [], 0, 0, self.names
        for x, y in shared_cuts(a_ends, b_ends):
            if x - i == 1 and y - j == 1:
                groups.append(f"{a[i]}|{b[j]}")
            else:
                groups.append(",".join([names[k] for k in a[i:x]]) + "|" + ",".join([names[k] for k in b[j:y]]))
            i, j = x, y
        pairs = array("q", [(a[i] << _BITS) | b[j] for i, j in _overlaps(a_ends, b_ends)])
        return _HEAD.pack(len(a), len(b), len(groups), len(pairs)) + pairs.tobytes() + ";".join(groups).encode()

    def _make(self, chunks: list[str]) -> list[bytes]:
        return [self._aligned(c, a, b) for c, (a, b) in zip(chunks, self._many(chunks), strict=True)]

    def align(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Packed results of the distinct chunks, the chunk of each place, and the first place of each text."""
        values = texts.to_pylist()
        whole = [i for i, t in enumerate(values) if _WHOLE.search(" " + t)]
        nothing = [i for i, t in enumerate(values) if not t or _SPACE in t]
        quick = np.ones(len(values), dtype=bool)
        quick[whole], quick[nothing] = False, False
        chunks, place, first = cut(texts.filter(pa.array(quick)), " ")
        results = self.memo.fill(chunks.to_pylist(), self._make)
        size = np.zeros(len(values), dtype=np.int64)
        size[quick] = np.diff(first)
        alone = sorted({*whole} - {*nothing})
        for i in alone:
            (a, b), = self._both([values[i]])
            results.append(self._aligned(values[i], a, b))
        size[alone] = 1
        ends = np.concatenate([[0], np.cumsum(size)])
        places = np.empty(int(ends[-1]), dtype=np.int32)
        own = np.repeat(quick, size)
        places[own] = place
        places[~own] = len(chunks) + np.arange(len(alone))
        return results, places, ends


_WORKER: dict = {}


def _aligner(source) -> Aligner:
    """One a Python worker (reused by its later tasks)."""
    if "aligner" not in _WORKER or _WORKER["aligner"][0] != hash(source.value):
        _WORKER["aligner"] = (hash(source.value), Aligner(*source.value))
    return _WORKER["aligner"][1]


def vocabularies(spark: SparkSession, a_path: str, b_path: str):
    """Both tokenizer files, read on the driver and broadcast (their size is fixed, a few MB)."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


_SLICES = ("slice long, doc_id array<long>, counts array<array<long>>, sha array<string>, first array<int>, place binary, "
           "many binary, link binary, pair array<long>, times array<long>")


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 to 2**32 - 1: their lowest bytes, then the next ones and so on, compressed."""
    return zlib.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _sums(values: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values at the places of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(values[place])])[first])


def _slice(number: int, ids: pa.Array, aligner: Aligner, texts: pa.Array) -> pa.RecordBatch:
    results, place, first = aligner.align(texts)
    width = np.array([len(r) for r in results], dtype=np.int64)
    lost = _sums((width == 0).astype(np.int64), place, first) > 0  # a chunk that B does not give back
    size = np.diff(first)
    if lost.any():
        place = place[np.repeat(~lost, size)]
        size = np.where(lost, 0, size)
        first = np.concatenate([[0], np.cumsum(size)])
    # unpack: counts, pairs and groups of every chunk
    nothing = _HEAD.pack(0, 0, 0, 0)
    joint = np.frombuffer(b"".join([r or nothing for r in results]), dtype=np.uint8)
    width = np.maximum(width, _HEAD.size)
    at = np.cumsum(width) - width
    head = gathered(joint, at, np.full(len(at), _HEAD.size)).view("<i4").reshape(-1, 4).astype(np.int64)
    counts = [_sums(np.ascontiguousarray(head[:, k]), place, first) for k in range(4)]
    many = head[:, 3]
    pairs = gathered(joint, at + _HEAD.size, 8 * many).view("<i8")
    texts_at = at + _HEAD.size + 8 * many
    data = gathered(joint, texts_at, at + width - texts_at)
    ends = np.concatenate([[0], np.cumsum(at + width - texts_at)]).astype(np.int32)
    strings = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data)).take(pa.array(place))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), strings), ";")
    sha = [hashlib.sha256(s.as_buffer()).hexdigest() if n else "" for s, n in zip(joined, size.tolist(), strict=True)]
    distinct, link = np.unique(pairs, return_inverse=True)
    used = np.bincount(place, minlength=len(results))
    times = np.bincount(link, weights=np.repeat(used, many), minlength=len(distinct)).astype(np.int64)  # exact below 2**53
    lists = [("doc_id", ids.to_pylist(), pa.list_(pa.int64())), ("counts", [c.tolist() for c in counts], pa.list_(pa.list_(pa.int64()))),
             ("sha", sha, pa.list_(pa.string())), ("first", first.astype(np.int32), pa.list_(pa.int32())), ("place", packed(place), pa.binary()),
             ("many", packed(many), pa.binary()), ("link", packed(link), pa.binary()),
             ("pair", distinct, pa.list_(pa.int64())), ("times", times, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([v], t) for _, v, t in lists)], names=["slice", *(n for n, _, _ in lists)])


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _WORKER.clear()  # the tokenizers, if this worker had them, are done
    for b in small(batches, 1):
        number = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False)
        places = lambda c: unpacked(b.column(c)[0].as_py())
        order = np.argsort(number("known"))  # the same pairs as the slice's, which are sorted
        first, place, link = number("first"), places("place"), places("link")
        begin = np.concatenate([[0], np.cumsum(places("many"))])
        sums = []
        for values in (number("best"), number("total")):
            run = np.concatenate([[0], np.cumsum(values[order].astype(np.int64)[link])])
            sums.append(_sums(np.diff(run[begin]), place, first))
        counts = b.column("counts").flatten()
        names = [f.split(" ")[0] for f in _RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").flatten(), *(counts[k].values for k in range(4)), pa.array(sums[0]), pa.array(sums[1]), b.column("sha").flatten()], names=names)


def align(docs: DataFrame, source) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(source), TaskContext.get().partitionId() << 32
        for b in sliced(batches, "text", SLICE):
            yield _slice(number, b.column("doc_id"), aligner, filled(b.column("text")))
            number += 1

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slices = stored(texts.mapInArrow(released(run), _SLICES), "token-slices")
    listed = slices.select("slice", F.explode(F.arrays_zip("pair", "times")).alias("x")).select("slice", "x.pair", "x.times")
    totals = listed.groupBy("pair").agg(F.sum("times").alias("total")).withColumn("b", F.expr(f"pair & {(1 << _BITS) - 1}"))
    totals = stored(totals, "token-pairs")
    most = totals.groupBy("b").agg(F.max("total").alias("most"))  # at most one row an id of B
    ranked = totals.join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    back = listed.select("slice", "pair").join(ranked, "pair").groupBy("slice").agg(F.collect_list(F.struct("pair", "total", "best")).alias("y"))
    rows = slices.join(back, "slice", "left").select(
        "doc_id", "counts", "sha", "first", "place", "many", "link", F.col("y.pair").alias("known"), F.col("y.total").alias("total"), F.col("y.best").alias("best"))
    return rows.mapInArrow(released(_counted), _RESULT)
