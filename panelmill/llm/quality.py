"""Operator 9: quality rules with robust multivariate outliers.

Base rules are fixed counts. Beyond them each text becomes a vector of transformed statistics, and for
each (language, source) a minimum-covariance-determinant estimate of centre and scatter is found by
concentration steps over all rows, from two starts: medians with median deviations, and the moments of all rows. Each
start is followed on its own: again and again take the nearer half of the group, (n + 8) / 2 rows (the share that bears
most outliers, just short of half), and re-estimate from it, until its determinant does not fall any more; the start
that ends with the smaller determinant counts. As usual the estimate is then reweighted: taken once more from all rows
within its 0.975 quantile. Rows whose Mahalanobis distance exceeds the cutoff, a quantile of the
chi-square distribution, are rejected. Spark does the steps: quantiles from counted bins, moments from sums, each
combined map-side; only one row per group and start goes through Python, to factor its 7 x 7 matrix.

Rates of a short text are noisy, so all but two are those of the text followed by ``PRIOR_WORDS`` ordinary words.
Symbols, duplicate lines and repeated words are 0 in most texts: the determinant of their scatter within the nearer
half would be 0 and any text with one of them an outlier, so the method alone can't give right results there. The
scatter therefore has the lower bound ``FLOOR`` in every direction. It is wide for those three (and echoes), what counts
as natural for them, and for the others only guards against singular matrices: length of text and words and capitals
are judged by the group's own scatter and correlations. It is a bound, not an addition. Groups of fewer than
``LEAST`` rows use their language's estimate; where that has too few as well, base rules alone decide.

Defined cases: null text has no words and fails the base rules; null lang or source form a group of their
own; rows that fail the base rules shape no estimate; repeated rows count each; extra columns of any name are ignored;
an empty table gives no rows; a text of any length is counted whole, in one task's memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, fitting, free_worker, hash_spans, held, mix, rows, small, small_batches, stash, utf8, windows, word_spans

WINDOW = 8
#: A group has settled when a step lowers the log determinant of its scatter by no more than this; it is bounded below, so all do.
SETTLED = 1e-3
#: What makes the covariance of the nearer half of a 7-dimensional normal distribution consistent.
CONSISTENT = 1.6942
LEAST = 60
#: log words, log characters a word, and log(1 + percent) of symbols a word, duplicate lines a line, repeated words, capitals, words
#: equal to the one before.
STATS = ("s_words", "s_length", "s_symbols", "s_lines", "s_repeats", "s_capitals", "s_echoes")
FLOOR = (0.1, 0.02, 0.5, 0.7, 0.7, 0.02, 0.3)
#: Correlation of the floors of duplicate lines and repeated words: a line of eight words said twice counts in both.
TOGETHER = 0.5
#: Ordinary words that rates count with: of so many characters, this share of them capitals, without echoes or repeats.
PRIOR_WORDS, PRIOR_LENGTH, PRIOR_CAPITALS = 150, 5, 0.02
#: The median and the cutoff of the chi-square distribution with 7 degrees of freedom (the cutoff: probability 1e-4 beyond).
MEDIAN, CUTOFF = 6.346, 29.88
#: Its 0.975 quantile, and what makes the covariance of the rows within it consistent.
NATURAL, NATURAL_CONSISTENT = 16.01, 1.0446
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, np.int8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _per_row(mark: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base columns, and n_lines (with a word), n_capitals (A-Z) and n_echoes, of each text."""
    raw, offsets = utf8(texts)
    buf, at = apart(raw, offsets)
    n = len(texts)
    space = _SPACES[buf]
    starts, ends = word_spans(buf)
    words = np.searchsorted(starts, at)
    row = np.repeat(np.arange(n), np.diff(words))
    out = {"n_words": np.diff(words), "word_chars": _per_row(((buf & 0xC0) != 0x80) & ~space, at), "n_symbols": _per_row(_SYMBOL[buf], at), "n_capitals": _per_row((buf >= 65) & (buf <= 90), at)}
    # lines with a word; the separator before each text is a line feed, so lines never span texts
    edges = np.flatnonzero(buf == 10)
    line_start, line_end = edges + 1, np.concatenate([edges[1:], [len(buf)]])
    filled = np.concatenate([[0], np.cumsum(~space)])
    has_word = filled[line_end] > filled[np.minimum(line_start, len(buf))]
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_row = np.searchsorted(at, line_start, "right") - 1
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    key = hash_spans(buf, line_start, line_end) ^ salt[line_row] if len(line_start) else np.zeros(0, np.uint64)
    _, first = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_row[first], minlength=n)
    # words in windows of eight that occur twice or more
    words_hash = hash_spans(buf, starts, ends)
    echo = np.zeros(len(starts), bool)
    echo[1:] = (words_hash[1:] == words_hash[:-1]) & (row[1:] == row[:-1])
    out["n_echoes"] = _per_row(echo, words)
    grams = windows(words_hash, WINDOW)
    whole = np.flatnonzero(row[: len(grams)] == row[WINDOW - 1 :]) if len(grams) else np.zeros(0, np.int64)
    grams = grams[whole] ^ salt[row[whole]] if len(whole) else np.zeros(0, np.uint64)
    _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
    found = whole[times[back] > 1] if len(whole) else whole
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, found, 1)
    np.add.at(step, found + WINDOW, -1)
    out["n_repeat_words"] = _per_row(np.cumsum(step[:-1]) > 0, words)
    return out


def count_base(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with the base counts."""
    names = (*BASE, "n_lines", "n_capitals", "n_echoes")
    kept = [f for f in df.schema.fields if f.name != text_col and f.name not in names]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in small_batches(batches, text_col, 1 << 20):
            counts = base_counts(batch.column(text_col))
            columns = {f.name: batch.column(f.name) for f in kept} | {c: pa.array(counts[c].astype(np.int64)) for c in names}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return df.mapInArrow(run, T.StructType(kept + [T.StructField(c, T.LongType()) for c in names]))


def _statistics() -> dict[str, Column]:
    words, more, letters = F.greatest(F.col("n_words"), F.lit(1)), F.col("n_words") + PRIOR_WORDS, F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH
    percent = lambda a, b: F.log1p(100.0 * a / b)
    return {
        "s_words": F.log1p(F.col("n_words")),
        "s_length": F.log(letters / more),
        "s_symbols": percent(F.col("n_symbols"), words),
        "s_lines": percent(F.col("n_dup_lines"), F.greatest(F.col("n_lines"), F.lit(1))),
        "s_repeats": percent(F.col("n_repeat_words"), more),
        "s_capitals": percent(F.col("n_capitals") + PRIOR_WORDS * PRIOR_LENGTH * PRIOR_CAPITALS, letters),
        "s_echoes": percent(F.col("n_echoes"), more),
    }


def _reached(rows: DataFrame, keys: list[str], value: str, aim: Column, name: str) -> DataFrame:
    """The first bin of ``value`` (a long) at which ``aim`` rows of each group (``_all``: its size) are reached, and as
    ``part`` the share of that bin's rows still needed: counted map-side, so any group size will do."""
    bins = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*keys)
    reached = bins.withColumn("_c", F.sum("_n").over(own.orderBy(value))).withColumn("_all", F.sum("_n").over(own)).where(F.col("_c") >= aim)
    part = (aim - F.col("_c") + F.col("_n")) / F.col("_n")
    return reached.groupBy(*keys).agg(F.min(F.struct(F.col(value).alias("b"), part.alias("part"))).alias("_e")).select(*keys, F.col("_e.b").alias(name), "_e.part")


GROUP = ["g_lang", "g_source"]
_FITTED = "g_lang string, g_source string, g_start int, mean array<double>, factor array<double>, logdet double, moved boolean"


def _floored(cov: np.ndarray) -> np.ndarray:
    """``cov`` with the floors' scatter as its lower bound in every direction."""
    floor = np.diag(np.square(FLOOR))
    i, j = STATS.index("s_lines"), STATS.index("s_repeats")
    floor[i, j] = floor[j, i] = TOGETHER * FLOOR[i] * FLOOR[j]
    lower = np.linalg.cholesky(floor)
    inverse = np.linalg.inv(lower)
    values, vectors = np.linalg.eigh(inverse @ cov @ inverse.T)
    return lower @ (vectors * np.maximum(values, 1)) @ vectors.T @ lower.T


def _factor(consistent: float):
    """Mean, inverse Cholesky factor and log determinant of each group's moments, one row each; the estimate before where it is no worse."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(STATS)
        upper = np.triu_indices(d)
        names = ["g_lang", "g_source", "g_start", "mean", "factor", "logdet", "moved"]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mean = np.array(r["sums"]) / r["n"]
                cov = np.zeros((d, d))
                cov[upper] = np.array(r["squares"]) / r["n"]
                cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
                lower = np.linalg.cholesky(_floored(consistent * cov))
                logdet = 2 * float(np.log(np.diag(lower)).sum())
                who = (r["g_lang"], r["g_source"], r["g_start"])
                if logdet < r["before"] - SETTLED:
                    out.append((*who, mean.tolist(), np.linalg.inv(lower)[np.tril_indices(d)].tolist(), logdet, True))
                else:
                    out.append((*who, r["old_mean"], r["old_factor"], r["before"], False))
            reals = pa.list_(pa.float64())
            kinds = (pa.string(), pa.string(), pa.int32(), reals, reals, pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)], names)

    return run


def _squared_distance() -> Column:
    terms, at = [], 0
    for i in range(len(STATS)):
        parts = [F.col("factor")[at + j] * (F.col(STATS[j]) - F.col("mean")[j]) for j in range(i + 1)]
        at += i + 1
        total = reduce(lambda a, b: a + b, parts)
        terms.append(total * total)
    return reduce(lambda a, b: a + b, terms)


def _moments(rows: DataFrame, weight: Column) -> DataFrame:
    d = len(STATS)
    return rows.withColumn("_w", weight).groupBy(*GROUP, "g_start").agg(
        F.sum("_w").alias("n"),
        F.array(*[F.sum(F.col("_w") * F.col(s)) for s in STATS]).alias("sums"),
        F.array(*[F.sum(F.col("_w") * F.col(STATS[i]) * F.col(STATS[j])) for i in range(d) for j in range(i, d)]).alias("squares"),
    )


def _nearer_half(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the nearer half of each group, in one pass over its rows: moments by bins of distance, then bins cumulated. Of the
    bin where the half ends, the share still needed counts."""
    d = len(STATS)
    names = [f"_s{i}" for i in range(d)] + [f"_q{i}_{j}" for i in range(d) for j in range(i, d)]
    sums = [F.sum(s) for s in STATS] + [F.sum(F.col(STATS[i]) * F.col(STATS[j])) for i in range(d) for j in range(i, d)]
    bins = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), *[s.alias(n) for s, n in zip(sums, names)])
    # some hundred bins a group, whatever its rows
    own = Window.partitionBy(*keys)
    before = F.sum("_n").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    half = F.floor((F.sum("_n").over(own) + d + 1) / 2)
    part = F.least(F.lit(1.0), (half - before) / F.col("_n"))
    weighed = bins.withColumn("_part", part).where("_part > 0")
    total = lambda column: F.sum(F.col("_part") * F.col(column))
    return weighed.groupBy(*keys).agg(total("_n").alias("n"), F.array(*map(total, names[:d])).alias("sums"), F.array(*map(total, names[d:])).alias("squares"))


def _start(fits: DataFrame) -> DataFrame:
    """Moments, without correlations, that have each group's medians and median deviations, on a grid of hundredths."""
    keys = ["g_lang", "g_source"]
    long = fits.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.floor(F.col(s) * 100).alias("b")) for i, s in enumerate(STATS)])).alias("x")).select(*keys, "x.k", "x.b")
    long = stash(long.groupBy(*keys, "k", "b").agg(F.count("*").alias("_n")), "bins")
    own = Window.partitionBy(*keys, "k")
    long = long.withColumn("_all", F.sum("_n").over(own))
    half = lambda by: F.min(F.when(2 * F.col("_c") >= F.col("_all"), F.col(by)))
    middle = long.withColumn("_c", F.sum("_n").over(own.orderBy("b"))).withColumn("m", half("b").over(own)).withColumn("a", F.abs(F.col("b") - F.col("m")))
    away = middle.withColumn("_c", F.sum("_n").over(own.orderBy("a"))).groupBy(*keys, "k").agg(F.max("m").alias("m"), half("a").alias("a"), F.max("_all").alias("n"))
    v = F.struct("k", (F.col("m") / 100.0).alias("m"), (1.4826 * F.col("a") / 100.0).alias("s"))
    away = away.where(F.col("n") >= LEAST).groupBy(*keys).agg(F.max("n").cast("double").alias("n"), F.sort_array(F.collect_list(v)).alias("v"))
    d = len(STATS)
    squares = [F.col("n") * (F.col("v")[i]["m"] * F.col("v")[j]["m"] + (F.pow(F.col("v")[i]["s"], 2) if i == j else F.lit(0.0))) for i in range(d) for j in range(i, d)]
    return away.select(*keys, "n", F.array(*[F.col("n") * F.col("v")[i]["m"] for i in range(d)]).alias("sums"), F.array(*squares).alias("squares"))


def estimates(stats: DataFrame) -> DataFrame:
    """g_lang, g_source (``*``: the whole language), n, mean, factor, scale (of the distances' median)."""
    keys = [*GROUP, "g_start"]
    fits = stats.where(~F.col("base_failed")).withColumn("g_source", F.explode(F.array("g_source", F.lit("*"))))
    no = F.array().cast("array<double>")

    def scaled(fitted: DataFrame) -> DataFrame:
        middle = _reached(binned(fitted, fitted), GROUP, "_b", F.ceil(F.col("_all") / 2), "_middle")
        # a scale below 1 would only sharpen the cutoff where the floors rule the scatter
        scale = F.greatest(F.exp((F.col("_middle") + 1) / 20.0) / MEDIAN, F.lit(1.0))
        return stash(fitted.join(middle, GROUP).select(*GROUP, "mean", "factor", scale.alias("scale")), "scaled")

    # a row of 42 numbers for a group and start: broadcast only up to a bound, by what the written table that they are of takes
    binned = lambda fitted, table: fits.join(fitting(fitted, held(table, 600)), GROUP).withColumn("_b", F.floor(20 * F.log(_squared_distance() + 1e-9)))
    # a start is no estimate from a half, so any first step is better
    worst = F.lit(float("inf"))
    starts = _start(fits).withColumn("g_start", F.lit(0)).unionByName(_moments(fits.withColumn("g_start", F.lit(1)), F.lit(1.0)).where(F.col("n") >= LEAST))
    begun = starts.withColumns({"old_mean": no, "old_factor": no, "before": worst})
    stepped = stash(begun.mapInArrow(_factor(1.0), _FITTED), "fitted")
    moving, n_moving = stepped.withColumn("logdet", worst), rows(stepped)
    settled: list[DataFrame] = []
    while n_moving:
        moments = _nearer_half(binned(moving, stepped), keys)
        old = moving.select(*keys, F.col("mean").alias("old_mean"), F.col("factor").alias("old_factor"), F.col("logdet").alias("before"))
        moved = Observation()
        stepped = stash(moments.join(old, keys).mapInArrow(_factor(CONSISTENT), _FITTED).observe(moved, F.count_if("moved").alias("n")), "fitted")
        settled.append(stepped.where(~F.col("moved")))
        moving, n_moving = stepped.where("moved"), moved.get["n"]
    ended = reduce(DataFrame.unionAll, settled, moving)
    fitted = ended.groupBy(*GROUP).agg(F.min(F.struct("logdet", "g_start", "mean", "factor")).alias("_f")).select(*GROUP, "_f.g_start", "_f.mean", "_f.factor")
    raw = scaled(stash(fitted, "fitted"))
    # reweighting: every row within the 0.975 quantile shapes the final estimate, which small groups need
    inner = fits.join(small(raw, 600), GROUP).where(_squared_distance() <= NATURAL * F.col("scale"))
    begun = _moments(inner.withColumn("g_start", F.lit(2)), F.lit(1.0)).withColumns({"old_mean": no, "old_factor": no, "before": worst})
    final = scaled(stash(begun.mapInArrow(_factor(NATURAL_CONSISTENT), _FITTED), "fitted"))
    size = fits.groupBy(*GROUP).agg(F.count("*").alias("n"))
    return stash(final.join(size, GROUP).select(*GROUP, "n", "mean", "factor", "scale"), "estimates")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, base columns, base_failed, kept, distance (squared, scaled; null where no estimate)."""
    # a null is no name, nor is the mark of a whole language
    named = lambda column: F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))
    counted = count_base(df.select(F.col(id_col).alias("_id"), named(lang_col).alias("g_lang"), named(source_col).alias("g_source"), F.col(text_col).alias("text")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = stash(counted.withColumns(_statistics()).withColumn("base_failed", failed), "statistics")
    found = estimates(stats)
    own = found.where("g_source != '*'").drop("n")
    shared = found.where("g_source = '*'").select("g_lang", *[F.col(c).alias("l_" + c) for c in ("mean", "factor", "scale")])
    scored = stats.join(own, ["g_lang", "g_source"], "left").join(shared, "g_lang", "left")
    scored = scored.withColumns({c: F.coalesce(c, "l_" + c) for c in ("mean", "factor", "scale")}).withColumn("distance", _squared_distance() / F.col("scale"))
    return scored.select(
        F.col("_id").alias(id_col), *BASE, "base_failed", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"), "distance"
    )
