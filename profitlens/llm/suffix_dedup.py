"""Substring dedup by hash-compared suffix sorting.

Texts are UTF-8 bytes; matches never cross documents.  Every byte covered by a ``LENGTH``-byte string that
also starts anywhere else (same document included) is removed; overlaps count, and strings are judged on
the input.

1. Anchors.  Of the ``GRAM``-byte strings inside each LENGTH-byte window the one of least hash (leftmost of
   equals) is the window's anchor, so equal windows have equal anchors at the same offset.  Windows in a row
   with one anchor are a context: about one for every 185 bytes leaves the map side, as hashes only.
2. Contexts are range-partitioned and sorted by (anchor hash, context hash, document, place), which spreads
   a passage held by very many documents over tasks.  Equal contexts are copies: all their windows repeat.
   Contexts that share an anchor but differ (at the edges of passages and edits) are left for step 3, with
   one representative of each set of copies.  A task's first and last anchor may go on in its neighbours, so
   their contexts are always left for step 3.  State is one row.
3. The bytes of those contexts meet by anchor.  Their suffixes from the anchor on, and their reversed
   prefixes before it, are each sorted by a mergesort that compares two strings by the length of their
   common extension, found by binary search over prefix polynomial hashes; neighbours in the order are then
   verified byte by byte (where a hash collided the order is made by plain comparison).  The common lengths
   of neighbours give, for each offset, the classes of contexts with equal left and right parts: a window
   repeats if its class pair has two members.  An anchor with more than ``GROUP`` different contexts is not
   gathered: its windows go by their 128-bit hashes instead, as rows of their own, and repeat if a hash does.
4. Intervals return to their documents, one list each, in the one join that moves texts.

Defined results: a null or empty text, or one shorter than LENGTH, keeps all its bytes; rows equal in
doc_id and text are one document, which does not repeat itself by that; an empty table gives an empty
result; texts of any length are handled whole (a text is held by one task, as its row is); extra columns are
passed through (``kept``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` replace same-named ones)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from profitlens.llm.common import NULL_ID, chunks, keyed, maybe_in, mix, prefix_hash, signed, small, span_hash, stored, widened
from profitlens.llm.slices import released

LENGTH = 400
GRAM = 32
#: Grams in a window.
SPAN = LENGTH - GRAM + 1
#: Most different contexts of an anchor that one task sorts together.
GROUP = 2048
#: Bytes of contexts sorted at once (one anchor at least); a sort takes some 40 times that.
BUNCH = 1 << 20


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, anchor, first window, last window) of every context, places in ``data``."""
    n, q = len(data), len(data) - LENGTH + 1
    if q <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = np.arange(n - GRAM + 1)
    gram = mix(span_hash(prefix_hash(data), at, at + GRAM))
    bits = np.uint64(int(n).bit_length())  # low bits hold the place: the least key is the leftmost of equals
    key = (gram >> bits << bits) | at.astype(np.uint64)
    blocks = np.full(-(-len(key) // SPAN) * SPAN, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(blocks, axis=1).ravel()
    least = np.minimum(ahead[:q], back[SPAN - 1: SPAN - 1 + q])
    anchor = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    p = np.arange(q)
    doc = np.searchsorted(offsets, p, side="right") - 1
    valid = p + LENGTH <= offsets[doc + 1]
    new = np.ones(q, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    last = np.ones(q, dtype=bool)
    last[:-1] = new[1:] | ~valid[1:]
    lo, hi = np.flatnonzero(new & valid), np.flatnonzero(last & valid)
    return doc[lo], gram[anchor[lo]], anchor[lo], lo, hi


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, _, data, off in chunks(b.column("text")):
            doc, h, a, lo, hi = anchors(data, off)
            if not len(doc):
                continue
            view = memoryview(data)
            c = np.array([xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(lo.tolist(), (hi + LENGTH).tolist(), strict=True)], dtype=np.uint64)
            row = pa.array(first + doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(h)), pa.array(signed(c)), b.column("dkey").take(row), b.column("tkey").take(row),
                 *(pa.array((x - off[doc]).astype(np.int64)) for x in (a, lo, hi))], names=_ROW)


_ROW = ["h", "c", "dkey", "tkey", "a", "lo", "hi"]
_ROW_TYPES = "h long, c long, dkey long, tkey long, a long, lo long, hi long"


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted contexts to rows of kind 0 (all windows repeat) and 1 (left for the suffix sort)."""
    carry = None  # first row of the last run of equal contexts
    copied = sent = False  # whether its windows are known to repeat, whether it was left for the sort
    several = True  # whether its anchor has several contexts; an anchor at the partition's edge may have
    last = None

    def rows(kind: int, cols: list[np.ndarray], at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, dtype=np.int32)), *(pa.array(c[at]) for c in cols)], names=["kind", *_ROW])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(7)]
        same = np.zeros(b.num_rows, dtype=bool)  # a repeated row of one document
        same[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols[:5]])
        if last is not None:
            same[0] = all(c[0] == x for c, x in zip(cols[:5], last, strict=True))
        last = [c[-1] for c in cols[:5]]
        cols = [c[~same] for c in cols]
        held = carry is not None
        if held:
            cols = [np.concatenate([[x], c]) for x, c in zip(carry, cols, strict=True)]
        h, c, _, _, a, lo, hi = cols
        n = len(h)
        new_h = np.ones(n, dtype=bool)
        new_h[1:] = h[1:] != h[:-1]
        new = new_h.copy()
        new[1:] |= (c[1:] != c[:-1]) | (hi[1:] - lo[1:] != hi[:-1] - lo[:-1]) | (a[1:] - lo[1:] != a[:-1] - lo[:-1])
        head = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        group = np.cumsum(new_h) - 1
        twice = np.bincount(run) > 1
        many = np.bincount(group[head]) > 1
        if held:
            twice[0] |= copied
            many[0] |= several
        elif several:
            many[0] = True
        out = twice[run]
        leave = many[group[head]]
        if held and copied:
            out[0] = False
        if held and sent:
            leave[0] = False
        if out.any():
            yield rows(0, cols, np.flatnonzero(out))
        if leave.any():
            yield rows(1, cols, head[leave])
        end = head[-1]
        sent = bool(leave[-1]) or (held and sent and end == 0)
        copied = bool(twice[-1])
        several = bool(many[-1])
        carry = [x[end] for x in cols]
    if carry is not None and not sent:
        yield rows(1, [np.array([x]) for x in carry], np.array([0]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their lists of contexts to a row a context with its bytes, or, for anchors with very
    many contexts, a row a window with its hash."""
    names = ["kind", "k1", "k2", "dkey", "tkey", "a", "lo", "hi", "bytes"]
    for b in small(batches):
        out: list[list] = [[] for _ in names]

        def send() -> pa.RecordBatch:
            types = [pa.int32(), *[pa.int64()] * 7, pa.binary()]
            got = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)
            for x in out:
                x.clear()
            return got

        for dkey, tkey, text, needs in zip(*(b.column(c).to_pylist() for c in ("dkey", "tkey", "text", "needs")), strict=True):
            data = text.encode()
            for x in needs:
                a, lo, hi = x["a"], x["lo"], x["hi"]
                if not x["large"]:
                    values = [(1, x["h"], 0, dkey, tkey, a, lo, hi, data[lo: hi + LENGTH])]
                else:
                    values = []
                    for p in range(lo, hi + 1):
                        w = xxhash.xxh3_128_intdigest(data[p: p + LENGTH])
                        values.append((0, (w >> 64) - (1 << 63), (w & (1 << 64) - 1) - (1 << 63), dkey, tkey, p, p, p, None))
                for v in values:
                    for y, z in zip(out, v, strict=True):
                        y.append(z)
                if len(out[0]) >= 8192:
                    yield send()
        yield send()


def _common(s: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common extensions of the strings that start at x and y, up to ``most``, by binary
    search over prefix hashes ``s``."""
    lo, hi = np.zeros(len(x), dtype=np.int64), most.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_] + 1) // 2
        xs, ys = x[open_], y[open_]
        good = span_hash(s, xs, xs + mid) == span_hash(s, ys, ys + mid)
        lo[open_[good]] = mid[good]
        hi[open_[~good]] = mid[~good] - 1


def suffix_sort(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings [start, end) inside their groups (rows come sorted by group), and the common
    length of each with the one before it in the order (-1 at the start of a group).

    A bottom-up mergesort of all groups at once: in each round every string finds its place in the sibling
    run by binary search, and a comparison takes the common extension and then the next byte."""
    n = len(start)
    s = prefix_hash(data)
    size = end - start
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    base = np.repeat(first, np.diff(np.concatenate([first, [n]])))
    count = np.repeat(np.diff(np.concatenate([first, [n]])), np.diff(np.concatenate([first, [n]])))
    order = np.arange(n)
    r = np.arange(n) - base
    width = 1
    while n and width < int(count.max()):
        own = r // width
        sib_lo = np.where(own % 2 == 0, (own + 1) * width, (own - 1) * width)
        sib_hi = np.minimum(sib_lo + width, count)
        lo, hi = np.minimum(sib_lo, count), np.maximum(sib_hi, np.minimum(sib_lo, count))
        at0 = lo.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            me, other = order[open_], order[base[open_] + mid]
            most = np.minimum(size[me], size[other])
            k = _common(s, start[me], start[other], most)
            inside = k < most
            edge = np.zeros(len(me), dtype=np.int64)
            edge[inside] = data[start[other[inside]] + k[inside]].astype(np.int64) - data[start[me[inside]] + k[inside]]
            edge[~inside] = size[other[~inside]] - size[me[~inside]]
            before = (edge < 0) | ((edge == 0) & (own[open_] % 2 == 1))  # of equals the left run comes first
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]
        place = np.minimum(own, own - own % 2) * width + (r - own * width) + (lo - at0)
        merged = np.empty(n, dtype=np.int64)
        merged[base + place] = order
        order = merged
        width *= 2
    lcp = np.full(n, -1, dtype=np.int64)
    inner = np.flatnonzero(r > 0)
    if len(inner):
        x, y = order[inner - 1], order[inner]
        k = _common(s, start[x], start[y], np.minimum(size[x], size[y]))
        lcp[inner] = k
        # verification: the bytes of neighbours agree over the common length, differ after it, and ascend
        total = np.cumsum(k)
        step = np.arange(int(total[-1])) - np.repeat(total - k, k)
        wrong = bool((data[np.repeat(start[x], k) + step] != data[np.repeat(start[y], k) + step]).any())
        inside = k < np.minimum(size[x], size[y])
        wrong |= bool((data[start[x[inside]] + k[inside]] >= data[start[y[inside]] + k[inside]]).any()) or bool((size[x[~inside]] > size[y[~inside]]).any())
        if wrong:  # a collision of hashes
            texts = [data[i:j].tobytes() for i, j in zip(start.tolist(), end.tolist(), strict=True)]
            order = np.array(sorted(range(n), key=lambda i: (group[i], texts[i], i)), dtype=np.int64)
            for j in inner.tolist():
                u, v = texts[order[j - 1]], texts[order[j]]
                lcp[j] = next((i for i, (p, q) in enumerate(zip(u, v, strict=False)) if p != q), min(len(u), len(v)))
    return order, lcp


def repeated_windows(texts: list[bytes], offset: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, least offset, greatest offset) of runs of windows that repeat among contexts with one anchor.

    texts: the contexts; offset: of the anchor in each; group: the anchors, sorted.  A window is named by its
    distance to the anchor."""
    n = len(texts)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    anchor = begin[:-1] + offset
    right, lcp_r = suffix_sort(data, anchor, begin[1:], group)
    total = len(data)
    left, lcp_l = suffix_sort(data[::-1].copy(), total - anchor, total - begin[:-1], group)
    far, near = offset, offset - (size - LENGTH)
    mark = np.zeros((n, SPAN + 2), dtype=bool)
    cl, cr = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for i in range(max(0, int(near.min())), int(far.max()) + 1):
        live = np.flatnonzero((near <= i) & (i <= far))
        if len(live) < 2:
            continue
        cl[left] = np.cumsum(lcp_l < i)
        cr[right] = np.cumsum(lcp_r < LENGTH - i)
        key = cl[live] * (n + 1) + cr[live]
        order = np.argsort(key, kind="stable")
        k = key[order]
        equal = k[1:] == k[:-1]
        twice = np.zeros(len(k), dtype=bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        mark[live[order[twice]], i + 1] = True
    rise = mark[:, 1:].astype(np.int8) - mark[:, :-1].astype(np.int8)
    x, lo = np.nonzero(rise == 1)
    _, hi = np.nonzero(rise == -1)
    return x, lo, hi - 1


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, k1, k2, dkey, tkey, a) to intervals of repeated bytes."""
    names = ["dkey", "tkey", "start", "end"]
    held: list[tuple] = []  # contexts of the anchor that may go on
    bunch: list[tuple] = []  # contexts of whole anchors, not yet sorted
    size = 0  # bytes of the bunch
    prev = None  # the window row before

    def work(rows: list[tuple]) -> pa.RecordBatch:
        group = np.unique(np.array([r[0] for r in rows], dtype=np.int64), return_inverse=True)[1]
        a = np.array([r[3] for r in rows], dtype=np.int64)
        lo = np.array([r[4] for r in rows], dtype=np.int64)
        x, near, far = repeated_windows([r[5] for r in rows], a - lo, group)
        ids = np.array([[r[1], r[2]] for r in rows], dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids[x, 0]), pa.array(ids[x, 1]), pa.array(a[x] - far), pa.array(a[x] - near + LENGTH)], names=names)

    for b in batches:
        kind = b.column("kind").to_numpy()
        w = np.flatnonzero(kind == 0)
        if len(w):
            cols = [b.column(c).to_numpy()[w] for c in ("k1", "k2", "dkey", "tkey", "a")]
            if prev is not None:
                cols = [np.concatenate([[x], c]) for x, c in zip(prev[0], cols, strict=True)]
            same = np.logical_and(cols[0][1:] == cols[0][:-1], cols[1][1:] == cols[1][:-1])
            other = ~np.logical_and.reduce([c[1:] == c[:-1] for c in cols[2:]])
            hit = np.zeros(len(cols[0]), dtype=bool)
            hit[1:] |= same & other
            hit[:-1] |= same & other
            if prev is not None and prev[1]:
                hit[0] = False
            g = np.flatnonzero(hit)
            if len(g):
                yield pa.RecordBatch.from_arrays([pa.array(cols[2][g]), pa.array(cols[3][g]), pa.array(cols[4][g]), pa.array(cols[4][g] + LENGTH)], names=names)
            prev = ([c[-1] for c in cols], bool(hit[-1]) or (prev is not None and prev[1] and len(cols[0]) == 1))
        c = np.flatnonzero(kind == 1)
        if len(c):
            part = b.slice(int(c[0]), len(c))
            for row in zip(*(part.column(x).to_pylist() for x in ("k1", "dkey", "tkey", "a", "lo", "bytes")), strict=True):
                if held and row[0] != held[-1][0]:
                    more = sum(len(r[5]) for r in held)
                    if bunch and size + more > BUNCH:
                        yield work(bunch)
                        bunch, size = [], 0
                    bunch += held
                    size, held = size + more, []
                elif held and row[:4] == held[-1][:4]:
                    continue  # a repeated row of one document
                held.append(row)
    if bunch and size + sum(len(r[5]) for r in held) > BUNCH:
        yield work(bunch)
        bunch = []
    if bunch or held:
        yield work(bunch + held)


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """(dkey, tkey, start, end) of byte intervals that are made of repeated LENGTH-byte strings."""
    rows = keyed(docs).select("dkey", "tkey", "text")
    contexts = stored(rows.mapInArrow(released(_contexts), _ROW_TYPES), "contexts")
    order = ["h", "c", "dkey", "tkey", "a"]
    marks = contexts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(released(_copies), "kind int, " + _ROW_TYPES)
    marks = stored(marks, "context-marks")
    known = marks.where("kind = 0").select("dkey", "tkey", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))
    left = marks.where("kind = 1").select("h", "dkey", "tkey", "a", "lo", "hi")
    sizes = left.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    left = left.join(sizes, "h").select("h", "dkey", "tkey", "a", "lo", "hi", (F.col("n") > GROUP).alias("large"))
    needs = stored(left.groupBy("dkey", "tkey").agg(F.collect_list(F.struct("h", "a", "lo", "hi", "large")).alias("needs")), "context-needs")
    texts = maybe_in(rows, needs, "dkey", "tkey").join(needs, ["dkey", "tkey"])
    cut = texts.mapInArrow(released(_cut), "kind int, k1 long, k2 long, dkey long, tkey long, a long, lo long, hi long, bytes binary")
    cut = cut.repartition("kind", "k1", "k2").sortWithinPartitions("kind", "k1", "k2", "dkey", "tkey", "a")
    found = cut.mapInArrow(released(_sort_groups), "dkey long, tkey long, start long, end long")
    return known.unionByName(found)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        kept, sizes, gone, runs, spans = [], [], [], [], []
        for text, found in zip(b.column("text").to_pylist(), b.column("intervals").to_pylist(), strict=True):
            data = text.encode()
            merged: list[list[int]] = []
            for x in sorted((i["start"], i["end"]) for i in found or ()):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append([*x])
            edges = [0, *(e for m in merged for e in m), len(data)]
            kept.append(b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)))
            sizes.append(len(data))
            gone.append(len(data) - len(kept[-1]))
            runs.append(len(merged))
            spans.append([e for m in merged for e in m])
        rest = [i for i, n in enumerate(b.schema.names) if n not in ("text", "intervals")]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in rest), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs)),
             pa.array(spans, pa.list_(pa.int64()))],
            names=[*(b.schema.names[i] for i in rest), "kept", "n_bytes", "n_removed", "n_spans", "spans"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Input columns but text; kept (bytes), n_bytes, n_removed, n_spans and spans (start, end, start, ...)."""
    rest = [c for c in docs.columns if c not in ("text", "kept", "n_bytes", "n_removed", "n_spans", "spans")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), text.alias("text"),  # a struct, so that no name clashes
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("dkey"), F.xxhash64(text).alias("tkey"))
    lists = repeated_intervals(docs).groupBy("dkey", "tkey").agg(F.collect_list(F.struct("start", "end")).alias("intervals"))
    joined = rows.join(lists, ["dkey", "tkey"], "left").select("rest", "text", "intervals")
    types = {"kept": "binary", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "spans": "array<long>"}
    return joined.mapInArrow(released(_remove), widened(rows.select("rest"), **types)).select("rest.*", *types)
