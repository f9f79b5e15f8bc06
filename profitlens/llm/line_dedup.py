"""Line dedup over whole texts.

A text is split at \\n (a null or empty text is one empty line).  A line's key is the line stripped of
[\\x20\\x09-\\x0D] at both ends with A-Z lower-cased.  A key of at least ``min_chars`` code points that
occurs in two documents loses all its lines but those in the smallest doc_id; other lines stay.

Method: 128-bit hashes of the keys are range-partitioned by (hash, document, position) and sorted inside
each partition.  Each task streams its rows and notes what is not a first occurrence; since the range
also covers document and position, a line that fills a third of the corpus is spread over many tasks.  A
key can then run over a partition border: the task sends its leading and trailing key as border rows (at
most two keys for each partition), and the least document of those decides the leading key's lines.  The
drops of a document travel back as one zlib-packed keep bitmap; texts take part in one join only.

Defined results: a null doc_id is the largest id; rows of one doc_id are one document, none deletes the
other's lines; repeated rows give equal results; an empty table gives an empty result; columns other than
doc_id and text are passed through by ``dedup_lines`` (``kept_text``, ``n_lines`` and ``n_dropped`` replace
same-named input columns)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from profitlens.llm.common import NULL_ID, keyed, small, stored, widened

MIN_CHARS = 10
_STRIP = " \t\n\x0b\x0c\r"


def _hash_lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        rows, pos, digests = [], [], []
        for r, text in enumerate(b.column("text").to_pylist()):
            for p, line in enumerate(text.split("\n")):
                key = line.strip(_STRIP)
                if len(key) >= min_chars:
                    rows.append(r)
                    pos.append(p)
                    digests.append(xxhash.xxh3_128_digest(key.encode().lower()))
        h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), b.column("dkey").take(at), b.column("tkey").take(at),
             pa.array(pos, pa.int32())], names=["h1", "h2", "dkey", "tkey", "pos"])


#: kind 0: drop; 1: a line of a partition's leading key in its first document there; 2: trailing key.
_MARKS = "kind int, h1 long, h2 long, dkey long, tkey long, pos int"


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lead = key = first = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, d, t, p = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if key == (h1[0], h2[0]):
            new[0] = False
        else:
            lead = lead or (h1[0], h2[0])
        run = np.cumsum(new)
        heads = np.concatenate([[first if first is not None else 0], d[new]])
        firsts = heads[run]
        key, first = (h1[-1], h2[-1]), firsts[-1]
        leading = (h1 == lead[0]) & (h2 == lead[1])
        drop = d != firsts
        mark = drop | leading
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(drop, 0, 1)[mark].astype(np.int32)), *(pa.array(x[mark]) for x in (h1, h2, d, t)),
             pa.array(p[mark])], names=["kind", "h1", "h2", "dkey", "tkey", "pos"])
    if key is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([2], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in (*key, first, 0)), pa.array([0], pa.int32())],
            names=["kind", "h1", "h2", "dkey", "tkey", "pos"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = []
        for drops in b.column("drops"):
            at = drops.values.to_numpy()
            keep = np.ones((int(at.max()) // 8 + 1) * 8, dtype=bool)  # whole bytes: no padding
            keep[at] = False
            packed.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("dkey"), b.column("tkey"), pa.array(packed, pa.binary())],
                                         names=["dkey", "tkey", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(dkey, tkey, keep): a document's zlib-packed keep bitmap; no row if every line stays, and lines
    after the bitmap's last bit stay."""
    lines = keyed(docs).select("dkey", "tkey", "text").mapInArrow(
        lambda it: _hash_lines(it, min_chars), "h1 long, h2 long, dkey long, tkey long, pos int")
    lines = stored(lines, "line-hashes")
    order = ["h1", "h2", "dkey", "tkey", "pos"]
    marks = stored(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_first_occurrences, _MARKS), "line-marks")
    # two keys a partition at most, whatever the corpus
    border = marks.where("kind > 0").groupBy("h1", "h2").agg(F.min("dkey").alias("first"))
    late = marks.where("kind = 1").join(border, ["h1", "h2"]).where("dkey > first").select("dkey", "tkey", "pos")
    drops = marks.where("kind = 0").select("dkey", "tkey", "pos").unionByName(late)
    return drops.groupBy("dkey", "tkey").agg(F.collect_set("pos").alias("drops")).mapInArrow(
        _pack, "dkey long, tkey long, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        kept, total, gone = [], [], []
        for text, keep in zip(b.column("text").to_pylist(), b.column("keep").to_pylist(), strict=True):
            lines = text.split("\n")
            total.append(len(lines))
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8))[: len(lines)].tolist()
                lines = [x for x, k in zip(lines, bits + [1] * (len(lines) - len(bits)), strict=True) if k]
            gone.append(total[-1] - len(lines))
            kept.append("\n".join(lines))
        rest = [i for i, n in enumerate(b.schema.names) if n not in ("text", "keep")]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in rest), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
            names=[*(b.schema.names[i] for i in rest), "kept_text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Input columns but text, then kept_text, n_lines (before) and n_dropped."""
    rest = [c for c in docs.columns if c not in ("text", "kept_text", "n_lines", "n_dropped")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), text.alias("text"),  # a struct, so that no name clashes
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("dkey"), F.xxhash64(text).alias("tkey"))
    joined = rows.join(keep_bitmaps(docs, min_chars), ["dkey", "tkey"], "left").select("rest", "text", "keep")
    schema = widened(rows.select("rest"), kept_text="string", n_lines="long", n_dropped="long")
    return joined.mapInArrow(_apply, schema).select("rest.*", "kept_text", "n_lines", "n_dropped")
