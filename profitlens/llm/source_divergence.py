"""Source divergence audit: how far the words of each source of a language are from those of the others.

Terms are runs of letters A-Z and a-z and of characters beyond ASCII, A-Z lower-cased.  No term holds ASCII
white space, so a text factors into white-space chunks:

1. each document's chunks are counted (``_chunk_counts``, Arrow and numpy inside tasks); a task puts out one row
   a chunk of a (lang, source) group in a slice of its texts: occurrences, documents and two document keys;
2. rows are dealt and sorted by chunk, and each globally distinct chunk is cut into its terms once
   (``_terms``); the terms are joined to the chunk's rows, which lie side by side;
3. occurrences are summed and distinct documents counted by (lang, term) (``term_counts``).  A language
   keeps the terms in at least 3 of its documents.  A chunk with three or more documents settles that; of others
   the keys of their one or two documents are exact, and the distinct keys of a term's chunks are counted;
4. ``divergence`` compares integer probabilities of every group with those of each other source of the language
   (all kept terms: the terms that both hold are joined, the rest follows from counts of equal probabilities),
   and with those of the language (term by term, the 200 that tell most).

Hot groups: a chunk or term has at most one row a group and slice; nothing is gathered by group.  The pairs of
sources of a language are what the audit reports; no pairs of documents or terms are made.

Defined results: null text, lang and source count as ''.  A document is a row, so a repeated row is a document
of its own.  A group without terms is compared as well (count 0 everywhere); a language without kept terms has
pairs of value 0 and no terms; an empty table gives no rows.  Texts and chunks of any length are taken whole;
extra columns are not read.  Ties in a ranking go by the item's UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from profitlens.llm.common import stored
from profitlens.llm.slices import cut, filled, released, sliced

#: Bytes of text whose chunks are counted at once inside a task.
SLICE = 1 << 25
#: Rows in a batch that a task puts out.
ROWS = 20_000
SCALE = 1_000_000_000
TOP_TERMS = 200
_NOT_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_COUNTS = "lang string, source string, chunk string, n long, docs long, lo long, hi long"
_TERMS = "lang string, source string, term string, n long, docs long, lo long, hi long"
_NAMES = ["lang", "source", "chunk", "n", "docs", "lo", "hi"]


def _groups(b: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Lang and source of each (lang, source) of a batch, and the group of each row."""
    lang, source = b.column("lang").dictionary_encode(), b.column("source").dictionary_encode()
    k = len(source.dictionary)
    at, group = np.unique(lang.indices.to_numpy().astype(np.int64) * k + source.indices.to_numpy(), return_inverse=True)
    return lang.dictionary.take(pa.array(at // k)), source.dictionary.take(pa.array(at % k)), group


def _runs(keys: np.ndarray) -> np.ndarray:
    """First place of each run of equal keys."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def _chunk_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, "text", SLICE):
        chunks, place, first = cut(filled(b.column("text")), None)
        rows = b.column("row").to_numpy()
        langs, sources, group = _groups(b)
        order = np.lexsort((rows, group))  # documents by group, then by key
        rank = np.empty(len(rows), dtype=np.int64)
        rank[order] = np.arange(len(rows))
        key = place.astype(np.int64)  # a chunk of a document
        key *= len(rows)
        key += np.repeat(rank.astype(np.int32), np.diff(first))
        empty = pc.index(chunks, "").as_py()
        if empty >= 0:
            key = key[place != empty]
        if not len(key):
            continue
        place = None
        key.sort()
        begin = _runs(key)
        count = np.diff(begin, append=len(key))
        key = key[begin]
        code, at = key // len(rows), order[key % len(rows)]
        start = _runs(code * len(langs) + group[at])
        n, docs = np.add.reduceat(count, start), np.diff(start, append=len(key))
        key = count = None
        for lo in range(0, len(start), ROWS):  # a batch is held by the task's two sides
            s, d = start[lo: lo + ROWS], docs[lo: lo + ROWS]
            g = pa.array(group[at[s]])
            yield pa.RecordBatch.from_arrays(
                [langs.take(g), sources.take(g), chunks.take(pa.array(code[s])), pa.array(n[lo: lo + ROWS]), pa.array(d),
                 pa.array(rows[at[s]]), pa.array(rows[at[s + d - 1]], mask=d == 1)], names=_NAMES)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, lang and source become rows of terms: rows of one chunk and group are added up, each
    distinct chunk is cut once, and its terms are joined to its rows."""
    for b in batches:
        if not b.num_rows:
            continue
        coded = [b.column(c).dictionary_encode() for c in ("chunk", "lang", "source")]
        code, lang, source = (c.indices.to_numpy().astype(np.int64) for c in coded)
        start = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(lang) != 0) | (np.diff(source) != 0)]))
        n, docs, lo = (b.column(c).to_numpy() for c in ("n", "docs", "lo"))
        hi = pc.coalesce(b.column("hi"), b.column("lo")).to_numpy()
        n, docs = np.add.reduceat(n, start), np.add.reduceat(docs, start)
        lo, hi = np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start)
        low = pc.ascii_lower(pc.replace_substring_regex(coded[0].dictionary, _NOT_TERM, " "))
        found = pc.split_pattern(low, " ")
        first = found.offsets.to_numpy().astype(np.int64)
        terms = found.flatten().dictionary_encode()
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        blank = pc.index(terms.dictionary, "").as_py()
        keep = terms.indices.to_numpy() != blank
        width = len(terms.dictionary) + 1
        pair, times = np.unique(owner[keep] * width + terms.indices.to_numpy()[keep], return_counts=True)  # (chunk, term)
        begin = np.searchsorted(pair // width, np.arange(len(first)))
        many = np.diff(begin)[code[start]]  # terms of each row's chunk
        row = np.repeat(np.arange(len(start)), many)
        at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + begin[code[start]][row]
        out = start[row]
        yield pa.RecordBatch.from_arrays(
            [coded[1].dictionary.take(pa.array(lang[out])), coded[2].dictionary.take(pa.array(source[out])),
             terms.dictionary.take(pa.array(pair[at] % width)), pa.array(n[row] * times[at]), pa.array(docs[row]), pa.array(lo[row]),
             pa.array(hi[row], mask=lo[row] == hi[row])], names=["lang", "source", "term", "n", "docs", "lo", "hi"])


def _named(docs: DataFrame) -> DataFrame:
    """lang, source and text, never null."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term and its occurrences ``count`` there, of the terms in at least 3 documents of the lang."""
    rows = _named(docs).withColumn("row", F.monotonically_increasing_id())
    chunks = rows.mapInArrow(released(_chunk_counts), _COUNTS).repartition("chunk").sortWithinPartitions("chunk", "lang", "source")
    terms = chunks.mapInArrow(released(_terms), _TERMS).repartition("lang", "term")
    # one row a document while few are known; a row without a document: three or more are
    each = F.when(F.col("docs") >= 3, F.array(F.lit(None).cast("long"))).otherwise(F.array_compact(F.array("lo", "hi")))
    spread = terms.select("lang", "source", "term", "n", F.posexplode(each).alias("pos", "doc"))
    by_doc = spread.groupBy("lang", "term", "source", "doc").agg(F.sum(F.when(F.col("pos") == 0, F.col("n")).otherwise(0)).alias("n"))
    by_source = by_doc.groupBy("lang", "term", "source").agg(
        F.sum("n").alias("count"), F.count("doc").alias("docs"), F.bool_or(F.col("doc").isNull()).alias("many"))
    term = Window.partitionBy("lang", "term")
    judged = by_source.withColumn("all", F.sum("docs").over(term)).withColumn("any", F.bool_or("many").over(term))
    return judged.where("any or all >= 3").select("lang", "source", "term", "count")


def _share(count: str, total: str, size: str):
    """1 + floor(SCALE * (count + 1) / (total + size)), exact beyond the range of a long product."""
    return F.expr(f"1 + ((cast({count} as decimal(28,0)) + 1) * {SCALE}) div nullif({total} + {size}, 0)")


def _gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = stored(term_counts(docs), "term-counts")
    groups = _named(docs).select("lang", "source").distinct()
    sizes = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("term").alias("held"))
    by_lang = counts.groupBy("lang", "term").agg(F.sum("count").alias("in_lang"))
    langs = by_lang.groupBy("lang").agg(F.count("term").alias("size"), F.sum("in_lang").alias("lang_total"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "held", "size", "lang_total"])
    groups = stored(groups.withColumn("p0", _share("0", "total", "size")), "term-groups")  # null without kept terms
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share("count", "total", "size"))

    terms = shares.join(by_lang, ["lang", "term"]).withColumn("q", _share("in_lang", "lang_total", "size")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))

    # pairs: over all kept terms, f(p, q) is f(p, q0) + f(p0, q) - f(p0, q0) but for terms that both sources hold
    own = shares.select("lang", "term", F.col("source").alias("source"), "p", "p0")
    other = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = own.join(other, ["lang", "term"]).where("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(F.expr(f"{_gap('p', 'q')} - {_gap('p', 'q0')} - {_gap('p0', 'q')} + {_gap('p0', 'q0')}")).alias("shared"))
    mine = groups.select("lang", "source", "size", "held", "p0")
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("item_held"), F.col("p0").alias("q0"))
    pairs = mine.join(theirs, "lang").where("source <> item")
    equal = shares.groupBy("lang", "source", "p").agg(F.count("term").alias("m"))  # terms of one probability
    left = equal.join(pairs, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.expr(f"m * ({_gap('p', 'q0')})")).alias("only"))
    right = equal.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "m").join(pairs, ["lang", "item"])
    right = right.groupBy("lang", "source", "item").agg(F.sum(F.expr(f"m * ({_gap('p0', 'q')})")).alias("only_item"))
    keys = ["lang", "source", "item"]
    whole = pairs.join(both, keys, "left").join(left, keys, "left").join(right, keys, "left")
    value = F.expr(f"(size - held - item_held) * ({_gap('p0', 'q0')})")
    for part in ("shared", "only", "only_item"):
        value = value + F.coalesce(part, F.lit(0))
    whole = whole.select("lang", "source", F.lit("pair").alias("part"), "item",
                         F.when(F.col("size") == 0, F.lit(0)).otherwise(value).cast("long").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    return terms.unionByName(whole.withColumn("rank", F.row_number().over(order)))
