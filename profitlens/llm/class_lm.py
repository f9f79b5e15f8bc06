"""Language-model scoring with Brown classes.

Tokens: the words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) of a text, then one end token.  Learning counts all
tokens of the training texts.  Every word of at least ``MIN_COUNT`` occurrences is assigned to one of
``CLASSES`` classes by exchange clustering.  The ``CLUSTERED`` most frequent words start it on the driver (each
word moves to the class that raises the class-bigram likelihood most, until no word moves or ``ROUNDS`` are
done).  Then ``SPREAD`` rounds on Spark move all words: a round counts, for each word, the classes before and
after it (sparse rows), and the words' partitions find the best class of each against the class bigrams of
the round; after the first, every other word moves in a round, and a round that lowers the likelihood is
undone and ends them.  The rounds read the training texts as stored codes of their words, not as texts, and a
round's counts are shuffled as packed blocks of words.  Only a rarer word, known or not, has a class by its surface (last character, foreign
letters, length), and the end token one of its own.  The model is

    P(w | previous) = P(class(w) | class(previous)) * (c(w) + a) / (N_class + a * (V_class + 1))

with add-a transitions, a = 0.1, and a text's score is the sum of log10 over its tokens.

At scale: word counts, their number and total cover all training texts and stay a distributed table.  Only
words at or above a count that at most ``TOP`` words reach are broadcast (12 bytes each, 13 MB at most; the
threshold comes from a histogram of counts); tokens of rarer words leave as (text, word, n) rows and are
joined with the table.  The clustered words are broadcast whole (10 bytes each), and grow with the corpus.

Words are told apart by 64-bit hashes.  Defined results: a null or empty text is one end token; without
training tokens every base score is that of an empty table; repeated rows are scored, and counted, each;
extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from profitlens.llm.common import chunks, signed, stored, word_hashes, words

ALPHA = 0.1
CLUSTERED = 1000
CLASSES = 64
ROUNDS = 8
#: Occurrences from which a word is clustered, and the rounds on Spark.
MIN_COUNT = 10
SPREAD = 4
TOP = 1 << 18
#: Distinct words that a task gathers before it sends their counts.
GATHER = 2_000_000

END = np.uint64(0x0E4D0E4D0E4D0E4D)
#: Surface classes: 7 kinds of last byte x foreign letters or not x longer than 6 bytes or not; then the end token's.
SURFACES = 29


def _last_kinds() -> np.ndarray:
    kind = np.full(256, 5, dtype=np.int64)
    kind[97:123] = 0
    kind[128:] = 1
    kind[48:58] = 6
    kind[ord(".")], kind[ord(",")], kind[ord("!")] = 2, 3, 4
    return kind


_LAST = _last_kinds()


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and surface classes of the tokens of a chunk, each document's end token last; first token of
    each document (n + 1)."""
    low, start, end, first = words(data, offsets)
    foreign = np.concatenate([[0], np.cumsum(low >= 128)])
    h = word_hashes(low, start, end)
    surface = (_LAST[low[end - 1]] * 2 + (foreign[end] > foreign[start])) * 2 + (end - start > 6) if len(start) else np.zeros(0, np.int64)
    n = len(offsets) - 1
    place = np.arange(len(start)) + np.searchsorted(first[1:], np.arange(len(start)), side="right")
    hashes = np.full(len(start) + n, END, dtype=np.uint64)
    surfaces = np.full(len(start) + n, SURFACES - 1, dtype=np.int64)
    hashes[place], surfaces[place] = h, surface
    return hashes, surfaces, first + np.arange(n + 1)


def _sum_by(keys: np.ndarray, values: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, the sums of their values and, of each further array, the first element."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return (k[at], np.add.reduceat(values[order], at) if len(at) else values[:0], *(m[order][at] for m in more))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, ...]:
        return _sum_by(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def send(k: np.ndarray, c: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(c), pa.array(s.astype(np.int32))], names=["h", "c", "surface"])

    size = 0
    for b in batches:
        for _, _, data, off in chunks(b.column("text")):
            h, surface, _ = _tokens(data, off)
            held.append(_sum_by(h, np.ones(len(h), dtype=np.int64), surface))
            size += len(held[-1][0])
            if size > GATHER:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > GATHER // 2:
                    yield send(*held.pop())
                    size = 0
    if held:
        yield send(*merged())


def count_words(docs: DataFrame, learn: Column) -> DataFrame:
    """(h, c, surface) of every word of the texts for which ``learn`` holds."""
    rows = docs.where(learn).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = rows.mapInArrow(_count_words, "h long, c long, surface int")
    return counts.groupBy("h").agg(F.sum("c").alias("c"), F.min("surface").alias("surface"))


def frequent(counts: DataFrame, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (sorted), counts and surfaces of the words at or above the least count that at most ``top``
    words reach: the count comes from a histogram over finer and finer ranges of counts."""
    level = F.floor(F.log2("c") * 64).cast("int")  # at most 64 * 63 levels
    total, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if total + r.n > top:
            break
        total, least = total + r.n, r.level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.where(level >= least).select("h", "c", "surface").toPandas()  # at most `top` rows
    h = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["c"].to_numpy()[order], rows["surface"].to_numpy()[order].astype(np.int64)


class Index:
    """Places of hashes in a sorted array: a table by their first bits, then the few with the same bits."""

    def __init__(self, known: np.ndarray) -> None:
        self.known, self.bits = known, max(1, int(len(known)).bit_length() + 2)
        self.shift = np.uint64(64 - self.bits)
        self.first = np.searchsorted(known >> self.shift, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is not known."""
        out = np.full(len(h), -1, dtype=np.int32)
        if not len(self.known):
            return out
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.first.take(slot), self.first.take(slot + 1)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            here = at[open_]
            hit = self.known.take(here) == h[open_]
            out[open_[hit]] = here[hit]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


def _unit_of(h: np.ndarray, surface: np.ndarray, known: Index, units: np.ndarray, base: int) -> np.ndarray:
    """Unit of each token: that of a clustered word, else base + surface."""
    at = known.find(h)
    return np.where(at >= 0, units[at], base + surface) if len(units) else base + surface


def _code_texts(batches: Iterator[pa.RecordBatch], known: Index) -> Iterator[pa.RecordBatch]:
    """Texts as codes (packed int32), many in a row: the place of a clustered word, else -1 - surface.  A text
    ends with the end token, whose surface is the last."""
    for b in batches:
        for _, _, data, off in chunks(b.column("text")):
            h, surface, _ = _tokens(data, off)
            at = known.find(h)
            yield pa.RecordBatch.from_arrays([pa.array([np.where(at >= 0, at, -1 - surface).astype("<i4").tobytes()], pa.binary())], names=["codes"])


def code_texts(docs: DataFrame, learn: Column, known: np.ndarray) -> DataFrame:
    """The training texts as codes, stored: what clustering counts over and over."""
    rows = docs.where(learn).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(known)
    return stored(rows.mapInArrow(lambda it: _code_texts(it, Index(shared.value)), "codes binary"), "coded-texts")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for x in b.column("codes"):
            yield np.frombuffer(x.as_buffer(), dtype="<i4")


def _units(codes: np.ndarray, of: np.ndarray, base: int) -> np.ndarray:
    """Unit of each code: that of a clustered word, else base + surface."""
    return np.where(codes >= 0, of.take(codes, mode="clip"), base - 1 - codes) if len(of) else base - 1 - codes


def _before(units: np.ndarray, end: int) -> np.ndarray:
    """The unit before each; a text begins after the end token."""
    out = np.empty_like(units)
    out[1:] = units[:-1]
    out[:1] = end
    return out


def _count_pairs(batches: Iterator[pa.RecordBatch], of: np.ndarray, m: int) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring units, of which the first ``m`` are words."""
    size = m + SURFACES
    total = np.zeros(size * size, dtype=np.int64)
    for codes in _coded(batches):
        u = _units(codes, of, m).astype(np.int64)
        np.add.at(total, _before(u, size - 1) * size + u, 1)
    at = np.flatnonzero(total)
    for lo in range(0, len(at), 100_000):
        part = at[lo: lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["pair", "n"])


def pair_counts(coded: DataFrame, of: np.ndarray, m: int) -> np.ndarray:
    """Matrix of unit bigrams over the training texts; ``of`` is the unit of each known word."""
    size, shared = m + SURFACES, coded.sparkSession.sparkContext.broadcast(of)
    sums = coded.mapInArrow(lambda it: _count_pairs(it, shared.value, m), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size, dtype=np.int64)
    out[sums["pair"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange(pairs: np.ndarray, m: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit: the first m units (most frequent first) are exchanged among ``classes`` classes,
    the others keep a class each.

    The likelihood of a class bigram model is, but for a constant, the sum of f(N(c, d)) - f(N(c, .)) -
    f(N(., d)) with f(x) = x log x; a move changes only two rows and columns."""
    size = len(pairs)
    classes = min(classes, m)
    k = classes + size - m
    of = np.concatenate([np.arange(m) % max(classes, 1), classes + np.arange(size - m)])
    p = pairs.astype(np.float64)
    onto = np.zeros((size, k))
    onto[np.arange(size), of] = 1
    n = onto.T @ p @ onto
    for _ in range(rounds):
        moved = 0
        for w in range(m):
            own = of[w]
            row = np.bincount(of, weights=p[w], minlength=k)
            col = np.bincount(of, weights=p[:, w], minlength=k)
            loop = p[w, w]
            row[own] -= loop
            col[own] -= loop
            n[own] -= row
            n[:, own] -= col
            n[own, own] -= loop
            left, right = n.sum(axis=1), n.sum(axis=0)
            f = _xlogx(n)
            gain = (_xlogx(n[:classes] + row) - f[:classes]).sum(axis=1) + (_xlogx(n[:, :classes] + col[:, None]) - f[:, :classes]).sum(axis=0)
            at = np.arange(classes)
            d = n[at, at]  # the cell that both sums touch
            gain += _xlogx(d + row[:classes] + col[:classes] + loop) - _xlogx(d + row[:classes]) - _xlogx(d + col[:classes]) + _xlogx(d)
            out, into = row.sum() + loop, col.sum() + loop
            gain -= _xlogx(left[:classes] + out) - _xlogx(left[:classes]) + _xlogx(right[:classes] + into) - _xlogx(right[:classes])
            new = int(np.argmax(gain))
            if gain[new] <= gain[own] + 1e-9:
                new = own
            moved += new != own
            of[w] = new
            n[new] += row
            n[:, new] += col
            n[new, new] += loop
        if not moved:
            break
    return of


#: Words whose contexts go together; a block's counts are a table of BLOCK x 2 k cells (1.5 MB).
BLOCK = 1024
_CONTEXTS = "block int, cells binary, times binary"


def _count_contexts(batches: Iterator[pa.RecordBatch], of: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Counts of the class after (cell word * 2 k + class) and before (k further) each known word, by its place: a
    row a block of words, its cells and their counts packed."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _sum_by(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def send(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = key // (BLOCK * 2 * k)
        cuts = [*np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:]):
            own = int(block[lo])
            packed = (key[lo:hi] - own * BLOCK * 2 * k).astype("<i4").tobytes(), n[lo:hi].astype("<u4").tobytes()  # a task has fewer than 2**32 tokens
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["block", "cells", "times"])

    size, keys, many = 0, [], 0
    for codes in _coded(batches):
        cls = _units(codes, of, k - SURFACES).astype(np.int64)
        before = _before(cls, k - 1)
        t = np.flatnonzero(codes >= 0)  # never the last token of a text
        base = codes[t].astype(np.int64) * (2 * k)
        keys += [base + cls[t + 1], base + k + before[t]]
        many += 2 * len(t)
        if many > GATHER // 4:
            held.append(_sum_by(np.concatenate(keys), np.ones(many, dtype=np.int64)))
            keys, many = [], 0
            size += len(held[-1][0])
            if size > GATHER:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > GATHER // 2:
                    yield from send(*held.pop())
                    size = 0
    if many:
        held.append(_sum_by(np.concatenate(keys), np.ones(many, dtype=np.int64)))
    if held:
        yield from send(*merged())


def _best_classes(word: np.ndarray, slot: np.ndarray, n: np.ndarray, of: np.ndarray, pairs: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (each's rows are neighbours) and the class of each that raises the likelihood most."""
    k = len(pairs)
    start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words_, times = word[start], np.diff(np.append(start, len(word)))
    own = of[words_].astype(np.int64)
    mine = own[:, None] == np.arange(classes)
    after, d = slot < k, slot % k
    r = n[:, None].astype(np.float64)
    cells = np.where(after[:, None], pairs[:classes, d].T, pairs[d, :classes])
    cells = np.maximum(cells - np.where(np.repeat(mine, times, axis=0), r, 0.0), 0.0)  # without the word itself
    gain = np.add.reduceat(_xlogx(cells + r) - _xlogx(cells), start)
    for side, sums in ((after, pairs.sum(axis=1)), (~after, pairs.sum(axis=0))):
        c = np.add.reduceat(np.where(side, n, 0), start)[:, None].astype(np.float64)
        rest = np.maximum(sums[:classes] - np.where(mine, c, 0.0), 0.0)
        gain -= _xlogx(rest + c) - _xlogx(rest)
    new = gain.argmax(axis=1)
    at = np.arange(len(new))
    inside = own < classes
    stay = inside & (gain[at, new] <= gain[at, np.where(inside, own, 0)] + 1e-9)
    return words_, np.where(stay, own, new)


def _moves(batches: Iterator[pa.RecordBatch], of: np.ndarray, pairs: np.ndarray, classes: int, parity: int | None) -> Iterator[pa.RecordBatch]:
    """(word, class) of rows sorted by block; with a parity, of every other word."""
    k = len(pairs)
    table, block = np.zeros(BLOCK * 2 * k, dtype=np.int64), None

    def found() -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(table)
        word = at // (2 * k) + block * BLOCK
        if parity is not None:
            keep = word % 2 == parity
            at, word = at[keep], word[keep]
        lo = 0
        while lo < len(at):
            hi = int(np.searchsorted(word, word[min(len(at) - 1, lo + 20_000)])) if lo + 20_000 < len(at) else len(at)  # whole words
            w, c = _best_classes(word[lo:hi], at[lo:hi] % (2 * k), table[at[lo:hi]], of, pairs, classes)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(c)], names=["word", "class"])
            lo = hi

    for b in batches:
        for own, cells, times in zip(b.column("block").to_pylist(), b.column("cells"), b.column("times"), strict=True):
            if own != block:
                if block is not None:
                    yield from found()
                table[:], block = 0, own
            table[np.frombuffer(cells.as_buffer(), dtype="<i4")] += np.frombuffer(times.as_buffer(), dtype="<u4")  # the cells of a row differ
    if block is not None:
        yield from found()


def _likelihood(pairs: np.ndarray) -> float:
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(axis=1)).sum() - _xlogx(pairs.sum(axis=0)).sum())


def spread(coded: DataFrame, of: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all known words by exchange rounds on Spark, and the class bigrams; words not yet clustered
    have a surface class in ``of``."""
    k = classes + SURFACES
    best, context = None, coded.sparkSession.sparkContext
    for i in range(SPREAD + 1):
        pairs = pair_counts(coded, of, classes).astype(np.float64)
        if i > 1 and _likelihood(pairs) <= _likelihood(best[1]):
            break
        best = of, pairs
        if i == SPREAD:
            break
        shared = context.broadcast(of)
        counts = coded.mapInArrow(lambda it, shared=shared: _count_contexts(it, shared.value, k), _CONTEXTS)
        moves = counts.repartition("block").sortWithinPartitions("block").mapInArrow(
            lambda it, shared=shared, pairs=pairs, i=i: _moves(it, shared.value, pairs, classes, i % 2 if i else None), "word long, class long").toPandas()
        of = of.copy()
        of[moves["word"].to_numpy()] = moves["class"].to_numpy()
    return best


def fit(docs: DataFrame, learn: Column) -> tuple[dict, DataFrame]:
    """The broadcastable model, and the table of all word counts."""
    counts = stored(count_words(docs, learn), "word-counts")
    by_surface = {r.surface: (r.c, r.v) for r in counts.groupBy("surface").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    h, c, surface = frequent(counts, TOP)
    words_only = np.flatnonzero(h != END)
    best = words_only[np.lexsort((h[words_only], -c[words_only]))][:CLUSTERED]  # most frequent first, as the exchange starts from that order
    rows = counts.where((F.col("c") >= MIN_COUNT) & (F.col("h") != int(END.view(np.int64)))).select("h", "c", "surface").toPandas()
    more = ~np.isin(rows["h"].to_numpy().view(np.uint64), h[best])
    known = np.concatenate([h[best], rows["h"].to_numpy().view(np.uint64)[more]])
    order = np.argsort(known)
    known = known[order]
    known_c = np.concatenate([c[best], rows["c"].to_numpy()[more]])[order]
    known_surface = np.concatenate([surface[best], rows["surface"].to_numpy()[more]])[order].astype(np.int64)
    coded = code_texts(docs, learn, known)
    m = len(best)
    seed = np.full(len(known), -1, dtype=np.int64)
    seed[np.searchsorted(known, h[best])] = np.arange(m)
    seeded = seed >= 0
    pairs = pair_counts(coded, np.where(seeded, seed, m + known_surface), m)
    of = exchange(pairs, m)
    classes = min(CLASSES, m)
    k = classes + SURFACES
    unit_class = np.where(seeded, of[:m].take(seed, mode="clip") if m else 0, classes + known_surface).astype(np.int64)
    if more.any():
        unit_class, n = spread(coded, unit_class, classes)
    else:
        onto = np.zeros((m + SURFACES, k))
        onto[np.arange(m + SURFACES), of] = 1
        n = onto.T @ pairs @ onto
    step = np.log10((n + ALPHA) / (n.sum(axis=1, keepdims=True) + ALPHA * k))
    tokens, kinds = np.zeros(k), np.zeros(k)
    for s, (total, v) in by_surface.items():
        tokens[classes + s], kinds[classes + s] = total, v
    np.add.at(tokens, unit_class, known_c)
    np.add.at(kinds, unit_class, 1)
    np.subtract.at(tokens, classes + known_surface, known_c)
    np.subtract.at(kinds, classes + known_surface, 1)
    total, v = sum(x for x, _ in by_surface.values()), sum(x for _, x in by_surface.values())
    return {"h": h, "log": np.log10(c + ALPHA), "known": known, "class": unit_class.astype(np.int16), "classes": classes, "step": step,
            "emit": np.log10(tokens + ALPHA * (kinds + 1)), "tokens": total, "base": math.log10(total + ALPHA * (v + 1))}, counts


def _score(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """A row a text with what the frequent words give (n = 0), and a row for each rarer word of a text."""
    top, k = model["h"], len(model["emit"])
    index, frequent_ = Index(model["known"]), Index(top)
    for b in batches:
        at = b.column("rid").to_numpy()
        for lo, hi, data, off in chunks(b.column("text")):
            h, surface, first = _tokens(data, off)
            uniq, place, inv = np.unique(h, return_index=True, return_inverse=True)
            cls = _unit_of(uniq, surface[place], index, model["class"], model["classes"]).astype(np.int64)
            log, found = np.zeros(len(uniq)), np.zeros(len(uniq), dtype=bool)
            if len(top):
                t = frequent_.find(uniq)
                found = t >= 0
                log = np.where(found, model["log"][t], 0.0)
            c = cls[inv]
            before = np.empty_like(c)
            before[1:] = c[:-1]
            before[first[:-1]] = k - 1
            extra = model["step"][before, c] - model["emit"][c]
            logs, extras, known = (np.add.reduceat(x, first[:-1]) for x in (log[inv], extra, found[inv].astype(np.int64)))
            n = hi - lo
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[lo:hi]), *(b.column(x).slice(lo, n) for x in ("doc_id", "held_out")), pa.array(np.diff(first)), pa.array(known),
                 pa.array(logs), pa.array(extras), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, dtype=np.int32))], names=_PARTS)
            rare = np.flatnonzero(~found[inv])
            if len(rare):
                doc = np.searchsorted(first, rare, side="right") - 1
                cell, times = np.unique(doc * len(uniq) + inv[rare], return_counts=True)
                m = len(cell)
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[lo + cell // len(uniq)]), none, pa.nulls(m, pa.bool_()), none, none, pa.nulls(m, pa.float64()),
                     pa.nulls(m, pa.float64()), pa.array(signed(uniq[cell % len(uniq)])), pa.array(times.astype(np.int32))], names=_PARTS)


_PARTS = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "logs", "extra", "h", "n"]
_TYPES = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, extra double, h long, n int"


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity (10 to the mean
    negative score of a token)."""
    model, counts = fit(docs, learn)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), (~learn).alias("held_out"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # both kinds of rows come from one run, so a row number means the same in both
    parts = stored(rows.mapInArrow(lambda it: _score(it, shared.value), _TYPES), "score-parts")
    rare = parts.where("n > 0").select("rid", "h", "n").join(counts.select("h", "c"), "h", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("rid").agg(F.sum(F.col("n") * F.log10(c + ALPHA)).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("seen"))
    out = parts.where("n = 0").drop("h", "n").join(rare, "rid", "left").withColumn("logs", F.col("logs") + F.coalesce("more", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(model["tokens"]).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * model["base"]).alias("base_score"),
        (F.col("logs") + F.col("extra")).alias("score"), F.pow(F.lit(10.0), -(F.col("logs") + F.col("extra")) / F.col("n_tokens")).alias("perplexity"))
