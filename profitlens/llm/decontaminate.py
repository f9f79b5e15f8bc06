"""Benchmark decontamination by templates.  DataFrame functions only.

A text's tokens (runs of letters and digits, decimals whole) are canonicalised: numbers (digits and number
words) become <num>, units <unit>, capitalised tokens <name>, others are lower-cased.  Each token is hashed
once; the hashes of pairs, fours and eights (``WINDOW`` tokens) follow from those of half the size.  Windows of
documents are hash-joined with those of benchmark items that keep ``MIN_LITERALS`` plain words.  Windows that
match at one alignment of a document and an item are counted together, and their slots must be consistent: one
benchmark value, wherever it recurs, stands for one document value.  So a question asked anew with other
numbers, names or units is found, and a chance mix of slots is not.  Case is no proof of a name: each window
that holds a <name> is also hashed with its words lower-cased, so an item in an upper-cased, lower-cased or
title-cased text, or one whose sentences start elsewhere, is found by its words.  A pair is a leak if it is
consistent and at one alignment at least ``MIN_WINDOWS`` windows (or all of the item's, if it has fewer) match;
the windows with names in slots count for this alone, and together with the lower-cased ones.

An item that no such window covers (too short, or mostly numbers) is found where all its tokens stand in a
document, case aside: joined by its first tokens (at most ``WINDOW``), then compared whole.  With fewer than
``MIN_TOKENS`` tokens it is found only as a whole document.

The benchmark's windows are broadcast only up to ``MAX_BROADCAST`` narrow rows, by their count; beyond that the
join is a shuffled one.  What is joined are hashes and places; the tokens of a match are fetched from the
documents that have one.  A document's windows are made and probed inside one stage, and only matches are
shuffled, keyed by document and item, so a passage that many documents hold is no hot key.

Defined results: null or empty texts match nothing, nor do items without tokens; repeated rows are one document; a
null id is kept as null; empty tables give empty results; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from profitlens.llm.common import keyed, maybe_in, stored

WINDOW = 8
MIN_LITERALS = 4
MIN_WINDOWS = 6
MIN_TOKENS = 3
#: Rows of three longs and two numbers, about 100 bytes each when broadcast: 100 MB.
MAX_BROADCAST = 1_000_000

# Spelled numbers and units of measure.
NUMBER_WORDS = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
                "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split()
UNITS = ("mm cm m km kilometer kilometers kilometre kilometres meter meters metre metres inch inches foot feet ft yard yards "
         "mile miles mph kmh mg g kg gram grams kilogram kilograms ton tons tonne tonnes oz ounce ounces lb lbs pound pounds "
         "ml l liter liters litre litres gallon gallons sec secs second seconds min mins minute minutes hour hours day days "
         "week weeks month months year years dollar dollars cent cents euro euros usd eur gbp percent degree degrees "
         "hz khz mhz ghz w kw watt watts volt volts amp amps joule joules kb mb gb tb").split()


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _tokens(rows: DataFrame) -> DataFrame:
    """Input columns but text, then raw (tokens)."""
    rest = [c for c in rows.columns if c != "text"]
    return rows.selectExpr(*rest, r"array_remove(split(text, '[^\\p{L}\\p{N}.,]+|[.,]+(?!\\d)|(?<!\\d)[.,]+'), '') raw")


def _pairs(name: str, step: int) -> str:
    """Hashes of an array's elements and those ``step`` places on; null where none is."""
    return f"zip_with({name}, slice({name}, {step + 1}, size({name})), (a, b) -> if(b is null, null, xxhash64(a, b)))"


def _eights(rows: DataFrame, *names: str) -> DataFrame:
    """The arrays of token hashes ``names`` replaced by those of the windows that start at each token."""
    for step in (1, 2, 4):
        rows = rows.withColumns({c: F.expr(_pairs(c, step)) for c in names})
    return rows


def _kinds(rows: DataFrame) -> DataFrame:
    """raw, and kind: lower-cased tokens with <num> and <unit>."""
    rows = rows.withColumn("low", F.expr("transform(raw, x -> lower(x))"))
    return rows.withColumn("kind", F.expr(f"transform(low, y -> case when substr(y, 1, 1) between '0' and '9' or y in ({_list(NUMBER_WORDS)}) then '<num>' "
                                          f"when y in ({_list(UNITS)}) then '<unit>' else y end)"))


_NAMES = "zip_with(raw, low, (x, y) -> substr(x, 1, 1) <> substr(y, 1, 1))"
_PLACEHOLDERS = "(xxhash64('<num>'), xxhash64('<unit>'))"


def _windows(rows: DataFrame) -> DataFrame:
    """Rows with raw: the other input columns, n (tokens) and hashes, of the windows with slots that start at each
    of the n tokens, then of those with names as words (null where it is the same, or no window is).

    Explode ``hashes`` with an outer generator: for an inner one Spark infers a size filter and pushes it
    below the projections, which writes the token expressions out inside the lambda, anew for each window."""
    rest = [c for c in rows.columns if c != "raw"]
    rows = _kinds(rows).selectExpr(*rest, f"{_NAMES} named", "transform(kind, y -> xxhash64(y)) words")
    rows = rows.selectExpr(*rest, "words", f"zip_with(named, words, (b, h) -> if(b and h not in {_PLACEHOLDERS}, xxhash64('<name>'), h)) slots")
    rows = _eights(rows, "words", "slots")
    return rows.selectExpr(*rest, "size(words) n", "concat(slots, zip_with(slots, words, (a, b) -> if(a = b, null, b))) hashes")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, place, h, kinds and item_raw (the canonical and raw tokens) of each usable window, slotted
    (whether its names are slots), and the item's counts of windows: item_windows with lower-cased ones and
    slotted_windows without."""
    tokens = _items(benchmark)
    rows = _windows(tokens.select("item", "raw")).select("item", "n", F.posexplode_outer("hashes").alias("at", "h")).where("h is not null")
    rows = rows.withColumns({"place": F.pmod("at", F.col("n")), "slotted": F.col("at") < F.col("n")}).drop("at", "n")
    canon = _kinds(tokens).select("item_id", "item", "raw", "kind", F.expr(f"zip_with({_NAMES}, kind, (b, y) -> if(b and not startswith(y, '<'), '<name>', y))").alias("canon"))
    cut = lambda c: F.slice(c, F.col("place") + 1, F.lit(WINDOW))
    rows = rows.join(canon, "item").select("item_id", "item", "place", "h", "slotted", cut(F.col("raw")).alias("item_raw"), cut(F.col("canon")).alias("kinds"),
                                           F.when(F.col("slotted"), cut(F.col("canon"))).otherwise(cut(F.col("kind"))).alias("literals"))
    plain = F.size(F.filter("literals", lambda x: ~F.startswith(x, F.lit("<"))))
    rows = rows.where(plain >= MIN_LITERALS).drop("literals")
    totals = rows.groupBy("item").agg(F.countDistinct("place").alias("item_windows"), F.countDistinct(F.when(F.col("slotted"), F.col("place"))).alias("slotted_windows"))
    return rows.join(totals, "item")


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, item (a key of id and text) and raw of each distinct item."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.select("item_id", F.xxhash64(F.col("item_id").cast("string"), text).alias("item"), text.alias("text")).distinct()
    return _tokens(items)


def _looked_up(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Rows joined to a narrow table, which is broadcast up to MAX_BROADCAST rows, by its count."""
    return rows.join(F.broadcast(table) if table.count() <= MAX_BROADCAST else table, key)


def _with_tokens(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with the raw tokens of their documents, which are read again for the documents with a hit alone."""
    found = maybe_in(docs, hits.select("dkey", "tkey"), "dkey", "tkey").select("dkey", "tkey", "text")
    return hits.join(_tokens(found).dropDuplicates(["dkey", "tkey"]), ["dkey", "tkey"])


def _template_matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    narrow = windows.select("h", "item", "place", "slotted")
    rows = _windows(_tokens(docs)).select("doc_id", "dkey", "tkey", "n", F.posexplode_outer("hashes").alias("at", "h"))
    rows = rows.select("doc_id", "dkey", "tkey", F.pmod("at", F.greatest("n", F.lit(1))).alias("at"), "h")
    hits = stored(_looked_up(rows, narrow, ["h"]), "window-hits")
    hits = _with_tokens(docs, hits).withColumn("doc_raw", F.slice("raw", F.col("at") + 1, F.lit(WINDOW))).drop("raw", "h")
    hits = hits.join(windows.drop("h"), ["item", "place", "slotted"]).withColumn("shift", F.col("at") - F.col("place"))
    pairs = F.expr("transform(filter(arrays_zip(kinds, item_raw, doc_raw), x -> startswith(x.kinds, '<')),"
                   " x -> named_struct('k', x.kinds, 'i', lower(x.item_raw), 'd', lower(x.doc_raw)))")
    whole = ["doc_id", "dkey", "tkey", "item_id", "item", "item_windows"]
    aligned = hits.withColumn("pairs", pairs).groupBy(*whole, "slotted_windows", "shift").agg(
        F.size(F.collect_set("place")).cast("long").alias("n_windows"),
        F.size(F.collect_set(F.when(F.col("slotted"), F.col("place")))).cast("long").alias("n_slotted"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("slots"))
    values = F.array_distinct(F.transform("slots", lambda s: F.struct(s["k"], s["i"])))
    aligned = aligned.select("*", F.size("slots").cast("long").alias("n_slots"), (F.size(values) == F.size("slots")).alias("consistent"))
    least = lambda c: F.least(F.lit(MIN_WINDOWS), F.col(c))
    enough = (F.col("n_windows") >= least("item_windows")) | (F.col("n_slotted") > 0) & (F.col("n_slotted") >= least("slotted_windows"))
    aligned = aligned.withColumn("leaked", F.col("consistent") & enough)
    best = F.max(F.struct("leaked", "n_windows", F.col("consistent"), "n_slots")).alias("best")
    return aligned.groupBy(*whole).agg(best).select(
        "doc_id", "dkey", "tkey", "item_id", "best.n_windows", "item_windows", "best.n_slots", "best.consistent", "best.leaked")


def _heads(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows with raw: the other input columns, n and heads: for each of ``lengths`` in turn (at most WINDOW), the
    hashes of so many tokens, case aside, from each of the n tokens on."""
    rest = [c for c in rows.columns if c != "raw"]
    rows = rows.selectExpr(*rest, "transform(raw, x -> xxhash64(lower(x))) w1")
    for step in (1, 2, 4):
        rows = rows.withColumn(f"w{2 * step}", F.expr(_pairs(f"w{step}", step)))
    parts = []
    for k in lengths:
        half = max(p for p in (1, 2, 4, 8) if p <= k)
        parts.append(f"w{k}" if half == k else f"zip_with(w{half}, slice(w{half}, {k - half + 1}, size(w{half})), (a, b) -> if(b is null, null, xxhash64(a, b, {k})))")
    return rows.selectExpr(*rest, "size(w1) n", f"concat({', '.join(parts)}) heads")


def _whole_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold all tokens of an item of ``items`` (item_id, item, raw), one after the other."""
    items = stored(items.select("item_id", "item", F.expr("transform(raw, x -> lower(x))").alias("item_low")).where("size(item_low) > 0"), "whole-items")
    lengths = sorted(r[0] for r in items.select(F.least(F.size("item_low"), F.lit(WINDOW))).distinct().collect())  # at most WINDOW numbers
    if not lengths:
        return None
    own = _heads(items.select("item", F.col("item_low").alias("raw"), F.least(F.size("item_low"), F.lit(WINDOW)).alias("k")), lengths)
    own = own.select("item", "k", F.element_at("heads", F.expr("1 + n * (array_position(array({}), k) - 1)".format(", ".join(map(str, lengths)))).cast("int")).alias("h"))
    own = stored(own, "item-heads")
    rows = _heads(_tokens(docs), lengths).select("doc_id", "dkey", "tkey", "n", F.posexplode_outer("heads").alias("at", "h"))
    k = F.element_at(F.array(*map(F.lit, lengths)), (F.col("at") / F.greatest("n", F.lit(1))).cast("int") + 1)
    rows = rows.where("h is not null").select("doc_id", "dkey", "tkey", "n", k.alias("k"), F.pmod("at", F.greatest("n", F.lit(1))).alias("at"), "h")
    hits = stored(_looked_up(rows, own, ["k", "h"]), "item-hits")
    hits = _with_tokens(docs, hits).join(items, "item")
    here = F.expr("transform(slice(raw, at + 1, size(item_low)), x -> lower(x))")
    alone = (F.size("item_low") >= MIN_TOKENS) | (F.size("item_low") == F.col("n"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    found = hits.where((here == F.col("item_low")) & alone).select("doc_id", "dkey", "tkey", "item_id").distinct()
    return found.select("*", one.alias("n_windows"), one.alias("item_windows"), none.alias("n_slots"), F.lit(True).alias("consistent"), F.lit(True).alias("leaked"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that share a window: doc_id, item_id, n_windows (most at one
    alignment), item_windows, n_slots, consistent, leaked.  An item without windows counts as one."""
    windows = stored(item_windows(benchmark), "item-windows")
    rows = keyed(docs).select("doc_id", "dkey", "tkey", "text")
    found = _template_matches(rows, windows)
    whole = _whole_matches(rows, _items(benchmark).join(windows.select("item").distinct(), "item", "left_anti"))
    return found if whole is None else found.unionByName(whole)
