"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A document becomes two bags of terms: its words and pairs of neighbouring words (A-Z lower-cased), hashed into
``WORDS`` places, and their shapes and pairs of shapes (letters, capitals, digits and marks of a word, runs
collapsed; a word equal to the one before it has a shape of its own), hashed into ``SHAPES`` places.  Words tell
what a text is about, shapes how it is written, in any language; no id, label, language or source is a term.
Both bags weigh the same.  A bounded sample of labelled rows (``SAMPLE``, the rows of least id hash) gives idf
weights, a truncated SVD of the weighted terms (``RANK``), and the labelled latent-semantic vectors.  The model has
a fixed size (at most (WORDS + SHAPES + SAMPLE) x RANK floats, 2 MB) and is broadcast.  Every
document's vector is multiplied with all of them in blocks (exact cosines, no index); its ``NEIGHBOURS``
nearest vote with weight cosine**``POWER``.

Defined results: a null or empty text has the zero vector, which no neighbour is near to, so it scores the
sample's mean label; without labelled rows every score is 0.5; ties at the rank of the last neighbour share
its vote; null labels are not learnt from; repeated rows score equal; an empty table gives an empty result;
extra columns are passed through (``score`` and ``predicted`` replace same-named input columns)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from profitlens.llm.common import chunks, mix, small, widened, word_hashes, words

WORDS = 3072
SHAPES = 1024
DIMS = WORDS + SHAPES
RANK = 64
#: Most labelled rows that are learnt from.
SAMPLE = 4096
NEIGHBOURS = 25
POWER = 8
THRESHOLD = 0.7
_BLOCK = 128

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_REPEAT = np.uint64(0x5DEECE66D)


def _counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Counts of hashed words and word pairs, then of shapes and shape pairs, a row a document, in blocks of at most
    _BLOCK rows."""
    for at in range(0, len(texts), _BLOCK):
        block = texts.slice(at, _BLOCK)
        out = np.zeros((len(block), DIMS), dtype=np.float32)
        for lo, hi, data, off in chunks(block):
            low, start, end, first = words(data, off)
            if not len(start):
                continue
            word = word_hashes(low, start, end)
            shape = _SHAPE[data]
            keep = np.ones(len(shape), dtype=bool)
            keep[1:] = shape[1:] != shape[:-1]
            keep[start] = True
            place = np.concatenate([[0], np.cumsum(keep)])
            small = shape[keep]
            h = word_hashes(small, place[start], place[end])
            doc = np.searchsorted(first, np.arange(len(start)), side="right") - 1
            same = np.zeros(len(start), dtype=bool)
            same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
            h[same] = _REPEAT
            inside = doc[1:] == doc[:-1]
            pair_doc, cells = doc[:-1][inside], []
            for term, base, size in ((word, 0, WORDS), (h, WORDS, SHAPES)):
                with np.errstate(over="ignore"):
                    pair = mix(term[:-1] * np.uint64(3) + term[1:])[inside]
                cells += [doc * DIMS + base + (mix(term) % np.uint64(size)).astype(np.int64),
                          pair_doc * DIMS + base + (pair % np.uint64(size)).astype(np.int64)]
            out[lo:hi] = np.minimum(np.bincount(np.concatenate(cells), minlength=(hi - lo) * DIMS), 65535).reshape(hi - lo, DIMS)
        yield out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term weights, both bags of unit length."""
    x = np.log1p(counts) * idf
    return np.hstack([_unit(x[:, :WORDS]), _unit(x[:, WORDS:])])


def _axes(z: np.ndarray) -> np.ndarray:
    """The RANK leading right singular vectors of ``z``, by subspace iteration from a fixed start."""
    rank = min(RANK + 16, *z.shape)
    basis = np.random.default_rng(7).standard_normal((z.shape[1], rank)).astype(np.float32)
    for _ in range(12):
        basis = np.linalg.qr(z.T @ (z @ basis))[0]
    _, _, rows = np.linalg.svd(z @ basis, full_matrices=False)
    return (basis @ rows.T)[:, :RANK].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE) -> dict | None:
    """The broadcastable model from ``labels`` (doc_id, quality) rows for which ``learn`` (a condition on
    doc_id) holds and a document exists."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = rows.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(learn)
    rows = rows.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    have = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    picked = rows.join(have, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            at = 0
            for x in _counts(b.column("text")):
                cells = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(x)), b.column("quality").slice(at, len(x)),
                     pa.array([c.astype("<u2").tobytes() for c in cells], pa.binary()),
                     pa.array([r[c].astype("<u2").tobytes() for r, c in zip(x, cells, strict=True)], pa.binary())],
                    names=["doc_id", "quality", "cells", "counts"])
                at += len(x)

    got = texts.mapInArrow(featurise, "doc_id long, quality int, cells binary, counts binary").toArrow()  # at most `sample` rows
    if not got.num_rows:
        return None
    got = got.sort_by("doc_id").combine_chunks()
    y = got.column("quality").to_numpy().astype(np.float32)
    seen = np.zeros(DIMS, dtype=np.int64)  # documents with a term
    for r in got.column("cells"):
        seen[np.frombuffer(r.as_buffer(), dtype="<u2")] += 1
    idf = np.log((1 + len(y)) / (1 + seen)).astype(np.float32) + 0.1
    z = np.empty((len(y), DIMS), dtype=np.float32)  # the one array of this size: the weights are made in blocks of rows
    for at in range(0, len(y), _BLOCK):
        x = np.zeros((min(_BLOCK, len(y) - at), DIMS), dtype=np.float32)
        for row, c, n in zip(x, *(got.column(name).slice(at, _BLOCK) for name in ("cells", "counts")), strict=True):
            row[np.frombuffer(c.as_buffer(), dtype="<u2")] = np.frombuffer(n.as_buffer(), dtype="<u2")
        z[at: at + _BLOCK] = _weighted(x, idf)
    top = _axes(z)
    return {"idf": idf, "axes": top, "vectors": _unit(z @ top), "labels": y}


def vote(model: dict | None, texts: pa.Array) -> np.ndarray:
    """Scores between 0 and 1 of the texts."""
    if model is None:
        return np.full(len(texts), 0.5)
    out = [np.zeros(0)]
    y, mean, k = model["labels"], float(model["labels"].mean()), min(NEIGHBOURS, len(model["labels"]))
    for x in _counts(texts):
        q = _unit(_weighted(x, model["idf"]) @ model["axes"])
        cosine = q @ model["vectors"].T
        least = np.partition(cosine, -k, axis=1)[:, -k, None]
        weight = np.where(cosine >= least, np.maximum(cosine, 0), 0) ** POWER
        total = weight.sum(axis=1)
        out.append(np.where(total > 1e-9, (weight @ y) / np.maximum(total, 1e-9), mean).astype(np.float64))
    return np.clip(np.concatenate(out), 0.0, 1.0)


def classify(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """Input columns, then score (double) and predicted (int)."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    rest = F.struct(*(F.col(f"`{c}`") for c in names))  # a struct, so that no name clashes
    shared, at = docs.sparkSession.sparkContext.broadcast(model), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            s = vote(shared.value, b.column("rest").field(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["rest", "score", "predicted"])

    rows = docs.select(rest.alias("rest"))
    return rows.mapInArrow(run, widened(rows, score="double", predicted="int")).select("rest.*", "score", "predicted")
