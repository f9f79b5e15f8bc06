"""Shared helpers of the training-data operators.

Document identity.  Operators that join results back to documents key a row by ``dkey`` (doc_id,
with a null doc_id mapped to the largest long, so it sorts after every other id) and ``tkey`` (a hash
of the text).  Rows equal in both are the same document: they get the same result, and such a
repeated row is never "another document".  A null text is an empty text.  Every operator selects the
columns it needs by name first, so extra columns cannot clash with its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from profitlens.operators.share import shared

NULL_ID = 9223372036854775807
#: Bytes of text handled at once inside a task; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19

_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, survives executors.

    ``release_scratch`` of the core deletes what was written."""
    return shared(df, name)


def reach(spark: SparkSession) -> None:
    """Let Python workers import this library from where it is installed, whatever their working folder."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, dkey, tkey, text (never null) and the named extra columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("dkey"),
                       F.xxhash64(text).alias("tkey"), text.alias("text"), *extra)


def crc_mod(column: str, m: int):
    """crc32 of the id as text, modulo m (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over slices of at most ``limit`` bytes (one row at least)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, ob, db = texts.buffers()
    off = np.frombuffer(ob, dtype=np.int64)[texts.offset: texts.offset + n + 1]
    data = np.frombuffer(db, dtype=np.uint8) if db is not None and db.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
        lo = hi


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.p = self.q = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.p) < n + 1:
            m = max(n + 1, CHUNK_BYTES + 1)
            inv = pow(_BASE, -1, 1 << 64)
            out = []
            for b in (_BASE, inv):
                x = np.full(m, b, dtype=np.uint64)
                x[0] = 1
                with np.errstate(over="ignore"):
                    out.append(np.cumprod(x, dtype=np.uint64))
            self.p, self.q = out
        return self.p, self.q


POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum over j < i of (byte j + 1) * base**j, modulo 2**64."""
    p, _ = POWERS.upto(len(data))
    s = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the byte spans [start, end), equal for equal strings at any place."""
    _, q = POWERS.upto(len(s))
    with np.errstate(over="ignore"):
        return (s[end] - s[start]) * q[start]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) bytes, starts and ends of the words, and the first word of each document (n + 1).

    Words are maximal runs outside [\\x20\\x09-\\x0D]; no word crosses a document."""
    low = _LOWER[data]
    ink = ~_WS[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = ink[:-1]
    start = np.flatnonzero(ink & (~before | cut[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = ink[1:]
    end = np.flatnonzero(ink & (~after | cut[1:])) + 1
    return low, start, end, np.searchsorted(start, offsets)


def word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = span_hash(prefix_hash(low), start, end)
    with np.errstate(over="ignore"):
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def widened(df: DataFrame, **types: str) -> StructType:
    """The schema of ``df`` with more columns, by SQL type name."""
    more = [StructField(n, _parse_datatype_string(t)) for n, t in types.items()]
    return StructType([*df.schema.fields, *more])


#: Bits of the filter of ``may_hold``: its broadcast is at most this / 64 rows of two longs, 2 MB.
FILTER_BITS = 1 << 23


def may_hold(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """Rows with ``_may``: whether their key columns may be among ``keys``, by a bitmap of fixed size.

    No row of ``keys`` is missed; others pass by chance (and all do once keys by far outnumber the bits),
    so what follows must be exact.  It spares shuffling texts that no join needs."""
    bit = F.xxhash64(*names).bitwiseAND(FILTER_BITS - 1)
    words_ = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("_bits"))
    probed = rows.withColumn("_bit", bit).withColumn("_at", F.shiftright("_bit", 6))
    probed = probed.join(F.broadcast(words_), F.col("_at") == F.col("_word"), "left")
    may = F.coalesce(F.expr("(shiftright(_bits, cast(_bit & 63 as int)) & 1) = 1"), F.lit(False))
    return probed.select(*(F.col(f"`{c}`") for c in rows.columns), may.alias("_may"))


def maybe_in(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """Rows whose key columns may be among ``keys`` (see ``may_hold``): a semi-join to be made exact."""
    return may_hold(rows, keys, *names).where("_may").drop("_may")


def _all_stars(e: DataFrame, held: Callable[[DataFrame], DataFrame]) -> bool:
    """Whether every u of the edges (u > v) has one v, which is no u itself; ``held`` deals rows as those of ``e``."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = held(ends).groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up + down > 1 and up > 0").agg(F.count("*")).first()[0] == 0


#: Links that a task may hold (16 bytes each): so few are resolved by one task a step, more are shuffled.
FEW = 1 << 17


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (a, b: long): root is the least node linked with it.

    Alternating large-star and small-star steps until only stars are left (a logarithmic number of rounds);
    each round is stored, and a node with very many links is split by the skew join.  No step adds links; up to ``FEW``
    of them are kept in one partition, so that rounds over few links are not dealt over all shuffle partitions."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    few = e.count() <= FEW
    held = lambda rows: rows.coalesce(1) if few else rows
    e = held(e)
    while not _all_stars(e, held):
        both = held(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = held(stored(large, "links-large"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                                F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        e = held(stored(small.select("p.u", "p.v").where("u <> v").distinct(), "links-small"))
    return held(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def without(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """Rows whose key columns are not among ``keys``: an anti-join that shuffles only the rows that a bitmap
    of fixed size (see ``may_hold``) cannot rule out."""
    marked = may_hold(rows, keys, *names)
    clear = marked.where("not _may").drop("_may")
    return clear.unionByName(marked.where("_may").drop("_may").join(keys.select(*names).distinct(), list(names), "left_anti").select(*clear.columns))


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, to keep what a worker holds as Python objects low."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds nothing back
