"""Token ids as compressed files: an adaptive context-mixing range coder over independent blocks.

Model of an id, given those before it in its block: order 2 predicts the id that last followed the two before
it, order 1 the one that last followed the one before it, order 0 has adaptive counts of logarithmic id ranges
and of sixteenths of them (ids of one sixteenth are equally likely), brought up to date every few ids.  A prediction's reliability is learnt by its
confidence; the orders are mixed with weights that follow how well each did.  A 64-bit range coder with
carries codes every id with the mixed probability.  All arithmetic is integer or plain float multiplication and
division, so that coder and decoder agree on every machine.

Blocks have up to ``BLOCK`` ids, are coded from a fresh model and carry a header (magic, ids, bytes, CRC-32 of
the ids), so any block is decoded alone and a damaged one is named.  The blocks of a segment are coded side by
side as lanes of numpy arrays: a step codes one id of each.

``write`` deals the texts by range of document id, encodes them, and writes rows of Parquet, a segment each: whole
documents in order (ids and lengths) and their blocks.  ``read`` adds up the segments' sizes (per partition, then
within it), decodes every segment and gives each document its place, its length and its ids' checksum.

Memory: a segment holds at most ``SEGMENT`` ids, or one document.  Defined results: a null or empty text has
the end id alone; rows without doc_id come last; rows equal in doc_id are ordered by a hash of the text, and rows
equal in both are interchangeable; an empty table gives no rows; extra columns are not read."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from profitlens.llm.common import keyed, small, stored
from profitlens.llm.slices import Memo, cut, filled, gathered, sliced

MAGIC = b"TKR1"
HEADER = struct.Struct("<4sIII")  # magic, ids, bytes of code, CRC-32 of the ids as little-endian 32-bit integers
BLOCK = 4096
SEGMENT = 2048 * BLOCK
#: Bytes of text encoded at once inside a task, and chunks kept in a worker's memo (two generations).
SLICE = 1 << 23
MEMO = 250_000

#: Ids must be smaller than this (the last range ends here).
MAX_ID = (1 << 20) - 16
_SLOTS = 11  # bits of a context table
_ONE = 1 << 16
_TOP = np.uint64(1 << 48)
_16, _32, _48 = np.uint64(16), np.uint64(32), np.uint64(48)
_BYTES = 0x0101010101010101
_HASH = -7046029254386353131  # an odd 64-bit factor
_SUMS = np.triu(np.ones((16, 16), dtype=np.float32))  # counts times this are their running sums (exact: whole, below 2**24)
_FLOOR = np.arange(1, 17, dtype=np.float32) * 24  # each of 16 symbols has 24 of 2**16 at least
_INC, _FULL = 24, 6000
#: By confidence (0: an empty slot), and again for a prediction that came true: the probability of a predicted id, how
#: an order's weight changes against order 0, and how the slot's confidence does (a step up, or halved).
_TRUST = np.array([0.0] + [(c + 0.4) / (c + 1.6) for c in range(1, 16)], dtype=np.float32)
_GAIN = np.concatenate([1 - _TRUST, [1.0], 200 * _TRUST[1:]]).astype(np.float32)
_STEP = np.array([-((c + 1) >> 1) for c in range(16)] + [c < 15 for c in range(16)], dtype=np.int32)


class _Model:
    """The state of the lanes of one segment; the first ``n`` lanes are at work in a step."""

    def __init__(self, lanes: int) -> None:
        self.tables = [np.full(lanes << _SLOTS, -16, dtype=np.int32) for _ in range(2)]  # id << 4 | confidence
        self.base = (np.arange(lanes) << _SLOTS) + (1 << _SLOTS - 1)
        self.weight = [np.full(lanes, w, dtype=np.float32) for w in (1.0, 1.5)]  # order 1 and order 2; order 0 has 1
        self.last = np.zeros(lanes, dtype=np.int64)
        self.pair = np.zeros(lanes, dtype=np.int64)

    def predict(self, n: int) -> None:
        """Predicted ids and the code space of 2**16: order 2's id to ``end2``, order 1's to ``end1``, all others."""
        base, self.n = self.base[:n], n
        one = self.last[:n] * _HASH
        two = (one + self.pair[:n]) * _HASH
        self.pair[:n] = one
        self.slot = [(h >> 64 - _SLOTS) + base for h in (one, two)]
        self.entry = [t.take(s) for t, s in zip(self.tables, self.slot, strict=True)]
        self.sure = [e & 15 for e in self.entry]
        self.guess = [e >> 4 for e in self.entry]
        first, second = (w[:n] for w in self.weight)
        scale = np.float32(64000) / (first + second + np.float32(1))
        first = (first * _TRUST.take(self.sure[0]) * scale).astype(np.int64)
        second = (second * _TRUST.take(self.sure[1]) * scale).astype(np.int64)
        self.end1 = first + second
        self.end2 = second + first * (self.guess[0] == self.guess[1])

    def learn(self, ids: np.ndarray) -> None:
        n, fresh = self.n, (ids << 4) | 1
        for k in range(2):
            case = self.sure[k] + ((self.guess[k] == ids).view(np.int8) << 4)
            # a slot that is hardly sure takes the id
            self.tables[k][self.slot[k]] = np.where(case <= 1, fresh, self.entry[k] + _STEP.take(case))
            weight = self.weight[k][:n]
            np.clip(weight * _GAIN.take(case), np.float32(0.02), np.float32(50), out=weight)
        self.last[:n] = ids


class _Counts:
    """Adaptive counts of 16 symbols in each row, and the code space that follows from them: the ends of the
    symbols in 2**16.  Counted symbols count from the next ``update`` on."""

    def __init__(self, rows: int) -> None:
        self.counts = np.ones((rows, 16), dtype=np.float32)
        self.ends = np.tile((np.arange(1, 17, dtype=np.int32) << 12), (rows, 1))

    def update(self, row: np.ndarray, symbol: np.ndarray) -> None:
        seen = np.bincount((row << 4) + symbol, minlength=self.counts.size).astype(np.float32).reshape(-1, 16)
        at = np.flatnonzero(np.bincount(row, minlength=len(seen)))
        counts = self.counts[at] + seen[at] * _INC
        sums = counts @ _SUMS
        full = sums[:, 15] > _FULL
        if full.any():
            counts[full] = np.floor(counts[full] * 0.5) + 1
            sums[full] = counts[full] @ _SUMS
        self.counts[at] = counts
        ends = np.floor(sums * (np.float32(_ONE - 24 * 16) / sums[:, 15:])) + _FLOOR
        ends[:, 15] = _ONE
        self.ends[at] = ends

    def span(self, row: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of symbols of the rows."""
        flat, at = self.ends.ravel(), (row << 4) + symbol
        start = flat.take(np.maximum(at - 1, 0)) * (symbol > 0)
        return start, flat.take(at) - start

    def find(self, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of the rows that hold the places, with their start and size."""
        passed = (self.ends.take(row, axis=0) <= place[:, None]).view(np.int64)  # eight flags of a byte in each
        symbol = ((passed[:, 0] + passed[:, 1]) * _BYTES) >> 56
        return symbol, *self.span(row, symbol)


class _Ranges:
    """Order 0: an id + 16 is 2**(4 + range) and more; counts of the range, of its sixteenth, and the bits below."""

    def __init__(self, lanes: int) -> None:
        self.coarse, self.fine, self.lanes = _Counts(lanes), _Counts(lanes * 16), lanes

    def update(self, ids: np.ndarray, last: int) -> None:
        """Count ids (steps by lanes); the last lane has ``last`` steps."""
        e, s, _ = self.parts(ids)
        row = np.broadcast_to(np.arange(self.lanes), ids.shape)
        keep = np.ones(ids.shape, dtype=bool)
        keep[max(last, 0):, -1] = False
        e, s, row = e[keep], s[keep], row[keep]
        self.coarse.update(row, e)
        self.fine.update((row << 4) + e, s)

    @staticmethod
    def parts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = ids.astype(np.int64) + 16
        e = (np.frexp(x.astype(np.float32))[1] - 5).astype(np.int64)  # exact: below 2**24
        return e, (x >> e) & 15, x & ((1 << e) - 1)

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start and size in 2**32 of the range and sixteenth of ids (steps by lanes), and the bits below: how many,
        and which."""
        e, s, low = self.parts(ids)
        row = np.broadcast_to(np.arange(self.lanes), ids.shape)
        start, size = self.coarse.span(row, e)
        start2, size2 = self.fine.span((row << 4) + e, s)
        size = size.astype(np.uint64)
        return (start.astype(np.uint64) << _16) + size * start2.astype(np.uint64), size * size2.astype(np.uint64), e.view(np.uint64), low.view(np.uint64)


def _updates(block: int) -> list[int]:
    """The steps before which order 0 is brought up to date: soon at first, then every 32."""
    return [t for t in (0, 4, 8, 16) if t < block] + list(range(32, block, 32))


class _Writer:
    def __init__(self, lanes: int, block: int) -> None:
        self.low = np.zeros(lanes, dtype=np.uint64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        self.width = 4 * block + 8
        self.out = np.zeros(lanes * self.width, dtype=np.uint32)
        self.pos = np.arange(lanes) * self.width

    def carry(self, lanes: np.ndarray) -> None:
        self.out[self.pos[lanes] - 1] += 1

    def shift(self, n: int) -> None:
        need = np.flatnonzero(self.range[:n] < _TOP)
        while len(need):
            low, pos = self.low[need], self.pos[need]
            self.out[pos] = low >> _48
            self.pos[need] = pos + 1
            self.low[need] = low << _16
            narrow = self.range[need] << _16
            self.range[need] = narrow
            need = need[narrow < _TOP]

    def end(self) -> list[bytes]:
        for _ in range(4):
            self.out[self.pos] = self.low >> _48
            self.pos += 1
            self.low <<= _16
        out = self.out.reshape(-1, self.width)
        used = self.pos - np.arange(len(self.pos)) * self.width
        out = out[:, : int(used.max())]
        while True:  # carries move to the word before
            carry = out >> 16
            if not carry.any():
                break
            out = out & 0xFFFF
            out[:, :-1] += carry[:, 1:]
        return [row[:k].astype("<u2").tobytes() for row, k in zip(out, used.tolist(), strict=True)]


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The blocks of an array of ids, of ``block`` ids each and fewer in the last."""
    total = len(ids)
    if not total:
        return []
    if int(ids.max()) >= MAX_ID or int(ids.min()) < 0:
        raise ValueError(f"ids must be from 0 to {MAX_ID - 1}")
    lanes = -(-total // block)
    short = total - (lanes - 1) * block
    padded = np.zeros(lanes * block, dtype=np.int32)
    padded[:total] = ids
    columns = np.ascontiguousarray(padded.reshape(lanes, block).T)
    model, ranges, w, steps = _Model(lanes), _Ranges(lanes), _Writer(lanes, block), min(block, total)
    marks = [*_updates(steps), steps]
    with np.errstate(over="ignore"):
        for before, begin, end in zip([0, *marks], marks, marks[1:]):
            if begin:
                ranges.update(columns[before:begin], short - before)
            spans = ranges.spans(columns[begin:end])
            for t in range(begin, end):
                n = lanes if t < short else lanes - 1
                x = columns[t, :n]
                model.predict(n)
                end2, end1 = model.end2, model.end1
                hit2, hit1 = model.guess[1] == x, model.guess[0] == x
                start = np.where(hit2, 0, np.where(hit1, end2, end1))
                size = np.where(hit2, end2, np.where(hit1, end1, _ONE)) - start
                step = w.range[:n] >> _16
                low = w.low[:n]
                new = low + step * start.view(np.uint64)
                narrow = step * size.view(np.uint64)
                rest = np.flatnonzero(~(hit2 | hit1))
                if len(rest):
                    first, extent, bits, below = (part[t - begin].take(rest) for part in spans)
                    step = narrow.take(rest) >> _32
                    extent = step * extent >> bits
                    new[rest] += step * first + extent * below
                    narrow[rest] = extent
                over = np.flatnonzero(new < low)  # what is added is less than the range
                if len(over):
                    w.carry(over)
                w.low[:n], w.range[:n] = new, narrow
                w.shift(n)
                model.learn(x)
    flat = padded[:total].astype("<u4")
    out = []
    for i, code in enumerate(w.end()):
        part = flat[i * block: (i + 1) * block]
        out.append(HEADER.pack(MAGIC, len(part), len(code), zlib.crc32(part)) + code)
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of blocks of one size (fewer ids in the last), checked against their checksums."""
    heads = [HEADER.unpack_from(b) for b in blocks]
    for i, (magic, _, size, _) in enumerate(heads):
        if magic != MAGIC or len(blocks[i]) != HEADER.size + size:
            raise ValueError(f"block {i} is damaged")
    if not blocks:
        return np.zeros(0, dtype=np.int32)
    lanes, block, short = len(blocks), heads[0][1], heads[-1][1]
    width = max(h[2] for h in heads) // 2 + 4
    words = np.zeros((lanes, width), dtype=np.uint16)
    for i, b in enumerate(blocks):
        code = np.frombuffer(b, dtype="<u2", offset=HEADER.size)
        words[i, : len(code)] = code
    flat = words.ravel()
    pos = np.arange(lanes) * width + 4
    codes = np.zeros(lanes, dtype=np.uint64)
    for k in range(4):
        codes = (codes << _16) | words[:, k]
    extents = np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    columns = np.zeros((block, lanes), dtype=np.int32)
    model, ranges = _Model(lanes), _Ranges(lanes)
    steps = short if lanes == 1 else block
    marks = [*_updates(steps), steps]
    with np.errstate(over="ignore"):
        for before, begin, end in zip([0, *marks], marks, marks[1:]):
            if begin:
                ranges.update(columns[before:begin], short - before)
            for t in range(begin, end):
                n = lanes if t < short else lanes - 1
                model.predict(n)
                end2, end1 = model.end2, model.end1
                step = extents[:n] >> _16
                place = np.minimum((codes[:n] // step).view(np.int64), _ONE - 1)
                hit2, known = place < end2, place < end1
                start = np.where(hit2, 0, np.where(known, end2, end1))
                size = np.where(hit2, end2, np.where(known, end1, _ONE)) - start
                code = codes[:n] - step * start.view(np.uint64)
                narrow = step * size.view(np.uint64)
                x = np.where(hit2, model.guess[1], model.guess[0])
                rest = np.flatnonzero(~known)
                if len(rest):
                    own = code.take(rest)
                    step = narrow.take(rest) >> _32
                    place = np.minimum(own // step, np.uint64((1 << 32) - 1)).view(np.int64)
                    e, start, size = ranges.coarse.find(rest, (place >> 16).astype(np.int32))
                    inside = np.minimum((place - (start.astype(np.int64) << 16)) // size, _ONE - 1).astype(np.int32)
                    s, start2, size2 = ranges.fine.find((rest << 4) + e, inside)
                    size = size.astype(np.uint64)
                    own = own - step * ((start.astype(np.uint64) << _16) + size * start2.astype(np.uint64))
                    extent = step * (size * size2.astype(np.uint64)) >> e.view(np.uint64)
                    low = np.minimum((own // extent).view(np.int64), (1 << e) - 1)
                    code[rest], narrow[rest] = own - extent * low.view(np.uint64), extent
                    x[rest] = (((s + 16) << e) | low) - 16
                columns[t, :n] = x
                need = np.flatnonzero(narrow < _TOP)
                while len(need):
                    at = pos[need]
                    code[need] = (code[need] << _16) | flat.take(at)
                    pos[need] = at + 1
                    wide = narrow[need] << _16
                    narrow[need] = wide
                    need = need[wide < _TOP]
                codes[:n], extents[:n] = code, narrow
                model.learn(x)
    ids = columns.T.ravel()[: (lanes - 1) * block + short]
    for i, (_, many, _, crc) in enumerate(heads):
        if zlib.crc32(ids[i * block: i * block + many].astype("<u4")) != crc:
            raise ValueError(f"block {i} does not have its checksum")
    return ids


class Words:
    """Ids of texts under a tokenizers file whose entries end words: white space cuts a text into chunks, and
    the ids of each distinct chunk are kept in a memo.  Chunks of printable ASCII and Latin letters are encoded
    many at once, and cut at the ends of their words; others one by one."""

    _WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")  # fixed value: the file's words
    _PLAIN = re.compile(r"[!-;=-~À-ÖØ-öø-įı-ſ]+")  # characters that stay one when composed and lower-cased

    def __init__(self, source: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
        for entry, i in self.library.get_vocab().items():
            self.ends[i] = entry.endswith("</w>")
        self.memo = Memo(MEMO)

    def _one_by_one(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=np.int32).tobytes() for e in self.library.encode_batch(chunks, add_special_tokens=False)]

    def _encode(self, chunks: list[str]) -> list[bytes]:
        out: list = [None] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if self._PLAIN.fullmatch(c)]
        for lo in range(0, len(plain), 5000):
            part = plain[lo: lo + 5000]
            many = np.array([len(self._WORDS.findall(chunks[i].lower())) for i in part])
            ids = np.array(self.library.encode(" ".join([chunks[i] for i in part]), add_special_tokens=False).ids, dtype=np.int32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != many.sum():
                continue  # not as expected: one by one
            packed, last = ids.tobytes(), 0
            for i, stop in zip(part, stops[np.cumsum(many) - 1].tolist(), strict=True):
                out[i], last = packed[4 * last: 4 * stop], stop
        late = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(late, self._one_by_one([chunks[i] for i in late]), strict=True):
            out[i] = v
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) and the first of each text (n + 1)."""
        chunks, place, first = cut(texts, None)
        values = self.memo.fill(chunks.to_pylist(), self._encode)
        flat = np.frombuffer(b"".join(values), dtype=np.int32)
        size = np.array([len(v) // 4 for v in values], dtype=np.int64)
        many = size[place]
        ends = np.concatenate([[0], np.cumsum(many)])
        return gathered(flat, (np.cumsum(size) - size)[place], many), ends[first]


_WORKER: dict = {}


def _words(source) -> Words:
    """One table a Python worker (reused by its later tasks)."""
    if "words" not in _WORKER or _WORKER["words"][0] != hash(source.value):
        _WORKER["words"] = (hash(source.value), Words(source.value))
    return _WORKER["words"][1]


_FILE = "part int, seq int, n_ids long, doc_ids array<long>, lengths array<long>, blocks array<binary>"


def _segment(part: int, seq: int, docs: list, lengths: list, ids: list) -> pa.RecordBatch:
    flat = np.concatenate(ids)
    block = min(BLOCK, max(256, len(flat) // 512))  # a small segment has shorter blocks, so that lanes are many
    values = [[part], [seq], [len(flat)], [docs], [lengths], [encode_blocks(flat, block)]]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
    names = ["part", "seq", "n_ids", "doc_ids", "lengths", "blocks"]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)


def write(docs: DataFrame, source, end: int, name: str = "token-file") -> DataFrame:
    """The token file of ``docs`` (doc_id, text), as the table that was written: the ids of each text under the
    broadcast tokenizer file, and the id ``end`` after each, by ascending doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq = _words(source), TaskContext.get().partitionId(), 0
        ids, lengths, names, total = [], [], [], 0
        for b in sliced(batches, "text", SLICE):
            values, first = words.encode(filled(b.column("text")))
            n = b.num_rows
            more = np.insert(values, first[1:], end)  # the end id after each text
            first = first + np.arange(n + 1)
            lo = 0
            while lo < n:
                fit = int(np.searchsorted(first, first[lo] + SEGMENT - total, side="right")) - 1
                hi = min(n, fit if fit > lo or total else lo + 1)
                if hi > lo:
                    ids.append(more[first[lo]: first[hi]])
                    lengths += np.diff(first[lo: hi + 1]).tolist()
                    names += b.column("doc_id").slice(lo, hi - lo).to_pylist()
                    total += int(first[hi] - first[lo])
                if hi < n:
                    yield _segment(part, seq, names, lengths, ids)
                    ids, lengths, names, total, seq = [], [], [], 0, seq + 1
                lo = hi
        if names:
            yield _segment(part, seq, names, lengths, ids)

    rows = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange("dkey", "tkey").sortWithinPartitions("dkey", "tkey")
    return stored(rows.select("doc_id", "text").mapInArrow(run, _FILE), name)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches, 1):
        ids = decode_blocks(b.column("blocks")[0].as_py()).astype("<u4")
        lengths = np.array(b.column("lengths")[0].as_py(), dtype=np.int64)
        ends = np.cumsum(lengths)
        crc = [zlib.crc32(ids[e - n: e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_ids").flatten(), pa.array(ends - lengths + b.column("before")[0].as_py()), pa.array(lengths), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(file: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a token file, from its decoded blocks."""
    sizes = file.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a partition
    earlier = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    inside = Window.partitionBy("part").orderBy("seq")
    heads = file.select("part", "seq", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("inside"))  # a row a segment
    places = heads.join(earlier, "part").select("part", "seq", (F.col("inside") + F.col("earlier")).alias("before"))
    rows = file.join(places, ["part", "seq"]).select("before", "doc_ids", "lengths", "blocks")
    return rows.mapInArrow(_checked, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary(spark, path: str):
    """The tokenizer file, read on the driver and broadcast (its size is fixed, a few MB)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())
