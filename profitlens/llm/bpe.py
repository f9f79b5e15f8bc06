"""Byte-level BPE encoding and decoding without training.

Encoder: a longest-match automaton proposes, at each byte, the longest vocabulary entry that starts
there (Aho-Corasick over the reversed entries, so that the first match that ends at a reversed place is
the longest one that starts at the mirrored place).  A proposed token is accepted if the pair it forms
with its predecessor is compatible, that is, if the merges that made both would not have merged across
their border first; else the next shorter entry is tried, and if none is left the predecessor is taken
back.  A place from which no way led on is never tried again, so the work is linear in the text.  Pair
compatibility is a memo table.  The result equals the one of applying the merges by rank.

Decoder: all entries lie in one byte array; an offset table gives each id's span, and a batch of ids is
decoded by one gather.  Bytes that are no UTF-8 become U+FFFD.

Defined results: a null text is an empty text with no ids; special entries found in a text become their id
(``special=False`` treats them as ordinary text); texts of any length are handled whole; extra columns are
passed through (``ids`` and ``decoded`` replace same-named input columns)."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from profitlens.llm.common import small, widened
from profitlens.llm.slices import Memo, cut, filled, gathered, released, sliced

#: Fixed value: the pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Strings in one generation of a Python worker's memo of pieces (twice as many of chunks), and bytes of text
#: encoded at once inside a task (which takes some 50 times that).
MEMO = 50_000
SLICE = 1 << 20


def _byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: a printable Latin-1 byte stands for itself, the others for
    the code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(source: str) -> tuple[dict[bytes, int], dict[str, int], list[tuple[bytes, bytes]]]:
    """Ids by entry, ids by special string, and the merges in order."""
    spec = json.loads(source)
    symbols = _byte_symbols()
    raw = lambda s: bytes(symbols[c] for c in s)
    pairs = (p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"])
    return ({raw(k): v for k, v in spec["model"]["vocab"].items()}, {t["content"]: t["id"] for t in spec["added_tokens"]},
            [(raw(a), raw(b)) for a, b in pairs])


class Decoder:
    """Offset table over all entries of a vocabulary, built from the text of its JSON file."""

    def __init__(self, source: str) -> None:
        vocab, self.special, _ = read_vocabulary(source)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        entries = [b""] * self.size
        for k, v in [*vocab.items(), *((s.encode(), i) for s, i in self.special.items())]:
            entries[v] = k
        self.offsets = np.concatenate([[0], np.cumsum(np.array([len(x) for x in entries], dtype=np.int64))])
        self.blob = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
        return self.blob[at].tobytes()


class Encoder(Decoder):
    """Automaton, merges and memos of one vocabulary."""

    def __init__(self, source: str) -> None:
        super().__init__(source)
        vocab, _, merges = read_vocabulary(source)
        size = self.size
        self.length = np.diff(self.offsets).tolist()
        self.merge: dict[tuple[int, int], int] = {}
        self.rank = [-1] * size
        self.parts = [(0, 0)] * size
        for rank, (left, right) in enumerate(merges):
            a, b, ab = vocab[left], vocab[right], vocab[left + right]
            self.merge[a, b] = rank
            if self.rank[ab] < 0:
                self.rank[ab], self.parts[ab] = rank, (a, b)
        self.shorter = [-1] * size
        self.longest = ahocorasick.Automaton()
        for k, v in vocab.items():
            self.shorter[v] = next((vocab[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in vocab), -1)
            self.longest.add_word(k[::-1].decode("latin-1"), v)
        self.longest.make_automaton()
        self.fits: dict[int, bool] = {}
        self.lengths = np.array(self.length + [0], dtype=np.int64)
        self.shorters = np.array(self.shorter + [-1], dtype=np.int64)
        self.slot_key = np.full(1 << 20, -1, dtype=np.int64)
        self.slot_fit = np.zeros(1 << 20, dtype=bool)
        self.known = Memo(MEMO)  # ids of pieces
        self.spaced = Memo(2 * MEMO)  # ids of a space and the chunk that follows
        self.pieces = regex.compile(PATTERN)
        marks = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges can leave a border between a and b: undo their merges, the latest first, and
        look for a merge over the border that would have come before the undone one."""
        key = a * self.size + b
        limit, good = len(self.merge) + 1, True
        while True:
            if self.merge.get((a, b), limit) < limit:
                good = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            elif rb >= 0:
                limit, b = rb + 1, self.parts[b][0]  # equal ranks merge from the left
            else:
                break
        if len(self.fits) >= 4 * MEMO:
            self.fits.clear()
        self.fits[key] = good
        return good

    def encode_piece(self, text: str) -> bytes:
        """The ids of a piece as packed int32."""
        piece = text.encode()
        n, size = len(piece), self.size
        match = [0] * n
        last = -1
        for end, token in self.longest.iter(piece[::-1].decode("latin-1")):
            if end != last:  # the first match at a place is the longest
                match[n - 1 - end], last = token, end
        fits, length, shorter = self.fits, self.length, self.shorter
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token, before = 0, match[0], -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if not dead[end]:
                    if before < 0:
                        break
                    good = fits.get(before * size + token)
                    if good or good is None and self.compatible(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, before = end, token
                token = match[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else -1
                token = shorter[token]
        packed = array("i", out).tobytes()
        return packed

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs, through a direct-mapped table."""
        key = a * self.size + b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        for i in np.flatnonzero(self.slot_key[slot] != key).tolist():
            k, j = int(key[i]), slot[i]
            if self.slot_key[j] != k:
                got = self.fits.get(k)
                self.slot_key[j], self.slot_fit[j] = k, self.compatible(k // self.size, k % self.size) if got is None else got
        good = self.slot_fit[slot]
        for i in np.flatnonzero(self.slot_key[slot] != key).tolist():  # two pairs of the batch share a slot
            good[i] = self.fits[int(key[i])] if int(key[i]) in self.fits else self.compatible(int(a[i]), int(b[i]))
        return good

    def encode_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of many pieces at once: the steps of ``encode_piece`` on arrays, one candidate of each piece
        a round; the few pieces that take many rounds are ended one by one."""
        pieces = [t.encode() for t in texts]
        size = np.array([len(x) for x in pieces], dtype=np.int64)
        base = np.concatenate([[0], np.cumsum(size + 1)])  # a place more each, for the end
        n = int(base[-1])
        match = [-1] * n
        last = -1
        whole = "\u0100".join(x[::-1].decode("latin-1") for x in reversed(pieces))  # a mark that no entry holds
        for end, token in self.longest.iter(whole):
            if end != last:
                match[n - 2 - end], last = token, end
        match = np.array(match, dtype=np.int64)
        stack = np.zeros(n, dtype=np.int32)
        depth, at, stop = np.zeros(len(pieces), dtype=np.int64), base[:-1].copy(), base[:-1] + size
        token = match[at]
        dead = np.zeros(n, dtype=bool)
        live = np.flatnonzero(size > 0)
        rounds = 0
        while len(live):
            rounds += 1
            if rounds > 60 and len(live) < 200:
                break
            t = token[live]
            end = at[live] + self.lengths[t]
            good = ~dead[end]
            d = depth[live]
            pair = np.flatnonzero(good & (d > 0))
            before = stack[base[live[pair]] + d[pair] - 1].astype(np.int64)
            good[pair] = self._fit(before, t[pair])
            x = live[good]
            stack[base[x] + depth[x]] = t[good]
            depth[x] += 1
            at[x] = end[good]
            token[x] = match[at[x]]
            y = live[~good]
            token[y] = self.shorters[t[~good]]
            y = y[token[y] < 0]
            while len(y):  # nothing shorter is left: take the predecessor back
                dead[at[y]] = True
                depth[y] -= 1
                back = stack[base[y] + depth[y]].astype(np.int64)
                at[y] -= self.lengths[back]
                token[y] = self.shorters[back]
                y = y[token[y] < 0]
            live = live[at[live] < stop[live]]
        packed = stack.tobytes()
        out = [packed[4 * i: 4 * (i + k)] for i, k in zip(base[:-1].tolist(), depth.tolist(), strict=True)]
        for i in live.tolist():
            out[i] = self.encode_piece(texts[i])
        return out

    def _chunks(self, chunks: list[list[str]]) -> list[bytes]:
        """Ids of chunks given as their pieces."""
        names = list(dict.fromkeys(p for c in chunks for p in c))
        ids = dict(zip(names, self.known.fill(names, self.encode_pieces), strict=True))
        return [ids[c[0]] if len(c) == 1 else b"".join([ids[p] for p in c]) for c in chunks]

    def _spaced(self, chunks: list[str]) -> list[bytes]:
        """Ids of a space and each chunk; letters alone are one piece with it."""
        return self._chunks([[" " + c] if c.isalpha() else self.pieces.findall(" " + c) for c in chunks])

    def encode_coded(self, texts: pa.Array, special: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """All texts (no nulls) as runs of entries: the ids of each entry (packed int32), the entry of each place,
        and the first place of each text (n + 1).

        No piece crosses from a non-space to a space, so single spaces cut a text into chunks, and each
        distinct chunk is looked up once.  Where white space stands before a space the pattern looks at the
        whole run; such texts, and those with special entries, are cut by the pattern alone."""
        pieces, slow, heads, marked = self.pieces.findall, [], [], {}
        for i, t in enumerate(texts.to_pylist()):
            cuts = self.split.split(t) if special and self.split else [t]
            if len(cuts) > 1:
                marked[i] = b"".join([array("i", [self.special[part]]).tobytes() if k % 2 else b"".join(self._chunks([pieces(part)]))
                                      for k, part in enumerate(cuts)])
            if len(cuts) > 1 or _RUN.search(t):
                slow.append(i)
                heads.append([] if len(cuts) > 1 else pieces(t))
            else:
                heads.append(pieces(t.split(" ", 1)[0]))
        if slow:
            quick = np.ones(len(texts), dtype=bool)
            quick[slow] = False
            texts = pc.if_else(pa.array(quick), texts, "")
        chunks, place, first = cut(texts, " ")  # the first chunk of a text has no space before it
        head = first[:-1]
        rest = np.ones(len(place), dtype=bool)
        rest[head] = False
        used = np.unique(place[rest])
        values = self.spaced.fill(chunks.take(pa.array(used)).to_pylist(), self._spaced)
        own = self._chunks(heads)
        for i, v in marked.items():
            own[i] = v
        entry = np.searchsorted(used, place)
        entry[head] = len(values) + np.arange(len(head))
        return values + own, entry, first

    def encode_array(self, texts: pa.Array, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), and the first of each text (n + 1)."""
        values, entry, first = self.encode_coded(texts, special)
        flat = np.frombuffer(b"".join(values), dtype=np.int32)
        size = np.array([len(v) // 4 for v in values], dtype=np.int64)
        many = size[entry]
        return gathered(flat, (np.cumsum(size) - size)[entry], many), np.concatenate([[0], np.cumsum(many)])[first]

    def encode(self, text: str, special: bool = True) -> list[int]:
        return self.encode_array(pa.array([text], pa.string()), special)[0].tolist()


_RUN = re.compile(r"\s ")
_TABLES: dict[tuple, Decoder] = {}


def _tables(source, kind: type):
    """One table a Python worker (reused by its later tasks)."""
    key = (kind, hash(source.value))
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = kind(source.value)
    return _TABLES[key]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read on the driver and broadcast (its size is fixed, about 2 MB)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, source, special: bool = True) -> DataFrame:
    """Input columns and ``ids`` (array of int): the text column's ids under the broadcast vocabulary."""
    names = [c for c in docs.columns if c != "ids"]
    rest, at = F.struct(*(F.col(f"`{c}`") for c in names)), names.index("text")  # a struct, so that no name clashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tables(source, Encoder)
        for b in small(batches):
            values, first = bpe.encode_array(filled(b.column("rest").field(at)), special)
            ids = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column("rest"), ids], names=["rest", "ids"])

    rows = docs.select(rest.alias("rest"))
    return rows.mapInArrow(run, widened(rows, ids="array<int>")).select("rest.*", "ids")


def digest_batches(batches: Iterator[pa.RecordBatch], source, special: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches of ``doc_id`` and ``text`` to the columns of ``digests``."""
    bpe = _tables(source, Encoder)
    for b in sliced(batches, "text", SLICE):
        values, entry, first = bpe.encode_coded(filled(b.column("text")), special)
        flat = np.frombuffer(b"".join(values), dtype=np.int32)
        size = np.array([len(v) // 4 for v in values], dtype=np.int64)
        texts = pa.array([",".join(map(str, array("i", v))) for v in values], pa.string())
        stops = np.concatenate([[0], np.cumsum(size)])
        width = np.diff(np.concatenate([[0], np.cumsum(bpe.lengths[flat])])[stops])  # bytes of each entry
        data = gathered(np.frombuffer(bpe.decode(flat.astype(np.int64)), dtype=np.uint8), (np.cumsum(width) - width)[entry], width[entry])
        ends = np.concatenate([[0], np.cumsum(width[entry])])[first].tolist()
        full = size[entry] > 0
        starts = np.concatenate([[0], np.cumsum(full)])[first].astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), texts.take(pa.array(entry[full]))), ",")
        ids = [hashlib.sha256(t.as_buffer()).hexdigest() for t in joined]
        raw = memoryview(data)
        plain = [hashlib.sha256(bytes(raw[x:y]).decode("utf-8", "replace").encode()).hexdigest() for x, y in zip(ends[:-1], ends[1:], strict=True)]
        count = np.diff(np.concatenate([[0], np.cumsum(size[entry])])[first])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count), pa.array(ids, pa.string()), pa.array(plain, pa.string())],
                                         names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, source, special: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 (of the decoded text) of
    doc_id and text: encoded, decoded and digested in one pass, entry by entry."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run = released(lambda it: digest_batches(it, source, special))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_batches(batches: Iterator[pa.RecordBatch], source) -> Iterator[pa.RecordBatch]:
    """Batches of ``rest`` and ``ids`` to ``rest`` and ``decoded``."""
    table = _tables(source, Decoder)
    for b in small(batches):
        texts = []
        for ids in b.column("ids"):
            values = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)
            texts.append(table.decode(values.astype(np.int64)).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(texts, pa.string())], names=["rest", "decoded"])


def decode(tokens: DataFrame, source) -> DataFrame:
    """Input columns and ``decoded`` (string): the text of ``ids``."""
    rest = F.struct(*(F.col(f"`{c}`") for c in tokens.columns if c != "decoded"))
    rows = tokens.select(rest.alias("rest"), "ids")
    return rows.mapInArrow(lambda it: decode_batches(it, source), widened(rows.select("rest"), decoded="string")).select("rest.*", "decoded")
