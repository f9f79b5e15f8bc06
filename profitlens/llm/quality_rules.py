"""Quality rules: base counts, then robust multivariate outliers by language and source.  DataFrame
functions only.

Words are runs of [^\\x20\\x09-\\x0D]+.  Base counts of a whole text: n_words; word_chars (code points in
words); n_symbols (characters of [#*$%&|<>]); n_dup_lines (lines with a word that equal an earlier line);
n_repeat_words (words covered by a 3-word window that occurs twice or more in the text).  A text fails the
base rules with fewer than 50 words or with more than half of its words repeated.

Method: the texts that pass have a vector of transformed statistics (log mean word length, log symbol
share, and the angles of the shares of repeated lines and words).  A text is judged in its (lang, source)
group, if that has ``MIN_GROUP`` passing texts; else among all texts of its lang, if those are as many; else
among all texts: an estimate of four means and ten covariances needs so many, and every passing text so has a
distance.  For each such group the minimum covariance determinant is sought from several starts: the ``H`` share
of rows nearest to the medians by sum of squares, by sum and by maximum of the scaled deviations, and ``DRAWS``
draws of ``DRAWN`` rows (those of least hash).  A concentration step estimates mean and covariance of a subset
and takes the H share nearest by that estimate, which never raises the determinant; each start takes ``TRIAL``
steps, the start with the least determinant goes on until it falls no more, and the least is what counts.
``FLOOR`` is added to each variance, as statistics that are 0 in most texts have none.  A text is rejected
if its squared Mahalanobis distance exceeds the chi-square quantile, corrected for the share H.

Statistics are whole millionths and their sums exact; quantiles are taken over counts of fixed bins (an H share
is rounded up to a whole bin).  So no estimate depends on how rows are dealt.  All of it is aggregates with partial
sums, so a source with a third of all rows is no larger task than another; the estimates are one row a group.

Defined results: a null or empty text has no words and fails; null lang or source is a value of its own; rows of the
last bin of an H share are all inside; repeated rows count each; an empty table gives an empty result; of the input
columns only doc_id is passed on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from profitlens.llm.common import stored

H = 0.75
DRAWS = 6
DRAWN = 8
TRIAL = 2
#: Most concentration steps of the best start; they end long before, when the determinant falls no more.
STEPS = 30
QUANTILE = 0.99999
MIN_GROUP = 30
#: Standard deviations added to each transformed statistic.
FLOOR = (0.1, 0.5, 0.1, 0.1)
_WS = r"[\\x20\\x09-\\x0D]"


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.selectExpr(
        "doc_id", "lang", "source", f"array_remove(split(text, '{_WS}+'), '') w",
        f"filter(split(text, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]') lines",
        "cast(char_length(text) - char_length(regexp_replace(text, '[#*$%&|<>]', '')) as bigint) n_symbols")
    rows = rows.selectExpr(
        "doc_id", "lang", "source", "n_symbols", "cast(size(w) as bigint) n_words",
        "aggregate(w, 0L, (a, x) -> a + char_length(x)) word_chars",
        "cast(size(lines) as bigint) n_lines", "cast(size(lines) - size(array_distinct(lines)) as bigint) n_dup_lines",
        "if(size(w) < 3, array(), transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64(w[i], w[i + 1], w[i + 2]))) g")
    rows = rows.selectExpr("*", "size(g) m", "size(array_distinct(g)) < size(g) again",
                           "cast(ceil(log2(size(g) + 1)) as int) b")
    # the windows' hashes with their places in the low bits, sorted: equal windows are neighbours
    rows = rows.selectExpr("*", "if(again, sort_array(transform(g, (h, i) -> shiftleft(h, b) | cast(i as bigint))), array()) k",
                           "shiftleft(1L, b) - 1 low")
    rows = rows.selectExpr("*", "transform(k, x -> cast(x & low as int)) at")
    rows = rows.selectExpr("*", "if(again, transform(at, x -> g[x]), array()) s")
    rows = rows.selectExpr("*", "if(again, sort_array(filter(at, (x, j) -> (j > 0 and s[j] = s[j - 1]) or (j < m - 1 and s[j] = s[j + 1]))),"
                           " array()) places")
    return rows.selectExpr(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        "aggregate(places, named_struct('last', cast(-3 as bigint), 'n', 0L), "
        "(a, p) -> named_struct('last', cast(p as bigint), 'n', a.n + least(3, p - a.last)), a -> a.n) n_repeat_words")


def _chi_cdf(x: float, d: int) -> float:
    """P(chi-square with d degrees <= x), by the series of the incomplete gamma function."""
    a, t = d / 2, x / 2
    if t <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while abs(term) > total * 1e-16:
        n += 1
        term *= t / (a + n)
        total += term
    return total * math.exp(-t + a * math.log(t) - math.lgamma(a))


def _chi_quantile(p: float, d: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi_cdf(mid, d) < p else (lo, mid)
    return lo


def _vector() -> list[Column]:
    share = lambda n, d: F.asin(F.sqrt(F.col(n) / F.greatest(F.col(d), F.lit(1))))
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
            F.log1p(100.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
            share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]


_D = len(FLOOR)
_X = [f"x{i}" for i in range(_D)]
_UNIT = 1_000_000


_GROUP = ["level", "lang", "source"]


def _same_group(a: DataFrame, b: DataFrame, keys: list[str] = _GROUP) -> DataFrame:
    b = b.withColumnsRenamed({c: f"_{c}" for c in keys})
    return a.join(b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]).drop(*(f"_{c}" for c in keys))


def _levels(passing: DataFrame) -> DataFrame:
    """A row for each lang and source: level (0: judged in its own group, 1: in its lang, 2: among all), and
    whether its texts are needed for an estimate of their lang (of_lang) and of all texts (of_all)."""
    sizes = stored(passing.groupBy("lang", "source").agg(F.count("*").alias("n")), "group-sizes")
    langs = sizes.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("n_lang"), (F.min("n") < MIN_GROUP).alias("some_small"))
    known = sizes.join(langs, F.col("lang").eqNullSafe(F.col("_lang")))
    level = F.when(F.col("n") >= MIN_GROUP, 0).when(F.col("n_lang") >= MIN_GROUP, 1).otherwise(2)
    known = stored(known.select("lang", "source", level.alias("level"), (F.col("some_small") & (F.col("n_lang") >= MIN_GROUP)).alias("of_lang")), "levels")
    return known.withColumn("of_all", F.lit(not known.where("level = 2").isEmpty()))


def _grouped(passing: DataFrame, levels: DataFrame) -> DataFrame:
    """The rows of each group that needs an estimate: a text is in its own, its lang's and that of all texts."""
    rows = _same_group(passing, levels.withColumnRenamed("level", "judged"), ["lang", "source"])
    none = F.lit(None).cast("string")
    group = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"))
    groups = F.array(F.when(F.col("judged") == 0, group(0, F.col("lang"), F.col("source"))),
                     F.when(F.col("of_lang"), group(1, F.col("lang"), none)), F.when(F.col("of_all"), group(2, none, none)))
    rows = rows.select(*_X, "seed", F.explode(groups).alias("g")).where("g is not null")
    return rows.select("g.*", *_X, "seed")


def _quantile(rows: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The least value (long) of each key that a share of its rows does not exceed; values are few a key."""
    bins = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(value)
    bins = bins.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    return bins.where(F.col("_upto") >= F.ceil(share * F.col("_all"))).groupBy(*keys).agg(F.min(value).alias(name))


#: Bins of a squared distance for each time it doubles.
_BINS = 512


def _nearest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with their squared distance d2, the H share of each key with the least."""
    rows = rows.withColumn("bin", F.floor(F.log2(F.greatest("d2", F.lit(1e-12))) * _BINS).cast("long"))
    return _same_group(rows, stored(_quantile(rows, keys, "bin", H, "cut"), "mcd-cut"), keys).where("bin <= cut")


def _estimate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, Cholesky factor of the covariance and half the log determinant of each key, one row a key."""
    pairs = [(i, j) for i in range(_D) for j in range(i + 1)]
    whole = lambda c: F.sum(c.cast("decimal(38,0)")).cast("double")
    x = [F.col(c) for c in _X]
    out = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(whole(c).alias(f"s{i}") for i, c in enumerate(x)),
                                  *(whole(x[i] * x[j]).alias(f"s{i}{j}") for i, j in pairs))
    out = out.select(*keys, *((F.col(f"s{i}") / F.col("_n") / _UNIT).alias(f"m{i}") for i in range(_D)),
                     *((F.col(f"s{i}{j}") / F.col("_n") / _UNIT / _UNIT).alias(f"p{i}{j}") for i, j in pairs))
    for i, j in pairs:  # row by row: each factor from those before it
        rest = F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
        if i == j:
            rest = F.greatest(rest, F.lit(0.0)) + FLOOR[i] ** 2
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    half = sum((F.log(f"l{i}{i}") for i in range(1, _D)), F.log("l00"))
    return out.withColumn("det", half).drop(*(f"p{i}{j}" for i, j in pairs))


def _distance(rows: DataFrame, estimate: DataFrame, keys: list[str]) -> DataFrame:
    out = _same_group(rows, estimate, keys)
    for i in range(_D):
        rest = F.col(_X[i]) / _UNIT - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return out.select(*rows.columns, sum((F.col(f"z{i}") ** 2 for i in range(1, _D)), F.col("z0") ** 2).alias("d2"))


def _starts(rows: DataFrame) -> DataFrame:
    """The rows of each group's starting subsets, with ``start``: the nearest by three distances, and the draws."""
    spread = rows.select(*_GROUP, F.posexplode(F.array(*(F.col(x) for x in _X))).alias("axis", "x"))
    spread = spread.withColumn("bin", F.floor(F.col("x") / 1000).cast("long"))
    axis = [*_GROUP, "axis"]
    medians = stored(_quantile(spread, axis, "bin", 0.5, "med"), "mcd-medians")
    off = _same_group(spread, medians, axis).withColumn("off", F.abs(F.col("bin") - F.col("med")))
    mads = _quantile(off, axis, "off", 0.5, "mad")
    wide = lambda df, c: df.groupBy(*_GROUP).agg(*(F.max(F.when(F.col("axis") == i, F.col(c))).alias(f"{c}{i}") for i in range(_D)))
    centre = stored(_same_group(wide(medians, "med"), wide(mads, "mad"), _GROUP), "mcd-centres")
    z = [F.abs(F.col(x) / _UNIT - F.col(f"med{i}") / 1000) / (1.4826 * F.col(f"mad{i}") / 1000 + FLOOR[i]) for i, x in enumerate(_X)]
    at = _same_group(rows, centre, _GROUP).select(*rows.columns, F.array(*z).alias("z"))
    total = lambda f: F.aggregate("z", F.lit(0.0), lambda a, v: a + f(v))
    kinds = F.array(total(lambda v: v * v), total(lambda v: v), F.array_max("z"))
    near = at.select(*rows.columns, F.posexplode(kinds).alias("start", "d2"))
    draws = rows.select(*rows.columns, F.explode(F.sequence(F.lit(3), F.lit(2 + DRAWS))).alias("start"))
    order = Window.partitionBy(*_GROUP, "start").orderBy(F.xxhash64("start", "seed", *_X), "seed")
    drawn = draws.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= DRAWN)
    keys = [*_GROUP, "start"]
    return _nearest(near, keys).select(*keys, *_X).unionByName(drawn.select(*keys, *_X))


def group_estimates(passing: DataFrame, trial: int = TRIAL, steps: int = STEPS, only: int | None = None) -> DataFrame:
    """Minimum-covariance-determinant estimates of rows with level, lang, source, seed and x0... (whole
    millionths): one row a group.  ``only`` names a single start, to see what it finds alone."""
    keys = [*_GROUP, "start"]
    begin = _starts(passing)
    trials = stored(_estimate(begin if only is None else begin.where(F.col("start") == only), keys), "mcd-trials")
    all_starts = passing.select(*_GROUP, *_X, F.explode(F.sequence(F.lit(0), F.lit(2 + DRAWS))).alias("start"))
    for _ in range(trial):
        trials = stored(_estimate(_nearest(_distance(all_starts, trials, keys), keys), keys), "mcd-trials")
    # the start of least determinant (ties: the first) goes on
    first = trials.groupBy(*_GROUP).agg(F.min(F.struct("det", "start")).alias("best")).select(*_GROUP, F.col("best.start").alias("start"))
    best = stored(_same_group(trials, first, keys).drop("start"), "mcd-best")
    own = [c for c in best.columns if c not in _GROUP]
    both = lambda df, name: df.select(*_GROUP, F.struct(*own).alias(name))
    for _ in range(steps):
        # one table a step: each group's estimate, and whether it is a lower one
        step = _estimate(_nearest(_distance(passing, best, _GROUP), _GROUP), _GROUP)
        lower = _same_group(both(best, "old"), both(step, "new"), _GROUP).withColumn("moved", F.col("new.det") < F.col("old.det") - 1e-9)
        lower = stored(lower.select(*_GROUP, F.when(F.col("moved"), F.col("new")).otherwise(F.col("old")).alias("e"), "moved"), "mcd-best")
        best = lower.select(*_GROUP, "e.*")
        if lower.where("moved").isEmpty():
            break
    return best


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, d2 (null if the base rules fail) and kept."""
    counts = base_counts(docs).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    counts = stored(counts, "base-counts")
    # whole millionths; the seed of the draws is the row's text statistics and id, so equal rows draw alike
    vectors = counts.select("*", *(F.round(v * _UNIT).cast("long").alias(x) for v, x in zip(_vector(), _X, strict=True)),
                            F.xxhash64("doc_id", "n_words", "word_chars").alias("seed"))
    passing = vectors.where(~F.col("base_failed"))
    levels = _levels(passing)
    # the steps read the rows of the groups often: their plans are to be small, as the driver keeps what it knows of each
    estimate = group_estimates(stored(_grouped(passing, levels), "mcd-rows"))
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    judged = _same_group(passing, levels, ["lang", "source"]).drop("of_lang", "of_all")
    judged = judged.withColumns({"lang": F.when(F.col("level") < 2, F.col("lang")).otherwise(text),
                                 "source": F.when(F.col("level") < 1, F.col("source")).otherwise(text)})
    known = _distance(judged, estimate, _GROUP)
    limit = H / _chi_cdf(_chi_quantile(H, _D), _D + 2) * _chi_quantile(QUANTILE, _D)
    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return (known.select(*own, "d2", (F.col("d2") <= limit).alias("kept"))
            .unionByName(vectors.where("base_failed").select(*own, none.alias("d2"), F.lit(False).alias("kept"))))
