"""Descriptive profiles: shares, summaries, histograms, age windows, density grids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(df: DataFrame, column: str, *, nulls: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of categories; with ``nulls`` the missing ones are a category."""
    rows = df if nulls else df.where(F.col(column).isNotNull())
    n = rows.groupBy(*by, column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))))


def coverage(expected: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Every expected key with its count ``n`` (0 where there is none) and whether it is ``missing``; keys beyond the expected ones are left out."""
    return expected.join(there.select(key, "n"), key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("n").isNull().alias("missing"))


def stacked_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shares of several variables, one under another: one pass over unpivoted columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v")).select("v.*")
    return shares(long, "value", by=["variable"])


def quantiles(x: Column, *ps: float) -> Column:
    """Linear quantiles of a column in one aggregate, for groups of bounded size (``weighted.quantile_linear`` for any).

    Between two values they are low * (1 - d) + high * d with one rounding of the last product and sum (``fma``), to the bit what DuckDB's
    ``quantile_cont`` gives: replications lie on grids, so their quantiles are often half-way cases of a rounding that follows.
    """
    values = F.array_sort(F.collect_list(x.cast("double")))

    def at(p: float):
        place = (F.size(values) - 1) * F.lit(float(p))
        low, d = F.get(values, F.floor(place).cast("int")), place - F.floor(place)
        return F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - d, F.get(values, F.ceil(place).cast("int")) * d).cast("double")

    return F.array(*[F.when(F.size(values) > 0, at(p)) for p in ps])


def explode_band(df: DataFrame, column: str, half_width: int, low: int, high: int, out: str) -> DataFrame:
    """One row per target within ``half_width`` of a row's value: a band join as an equi-aggregation."""
    first, last = F.greatest(F.col(column) - half_width, F.lit(low)), F.least(F.col(column) + half_width, F.lit(high))
    return df.where(first <= last).withColumn(out, F.explode(F.sequence(first.cast("int"), last.cast("int"))))


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """Density on a fixed grid of values clipped to its ends."""
    step = (high - low) / bins
    clipped = F.least(F.greatest(F.col(x), F.lit(low)), F.lit(high))
    at = F.least(F.floor((clipped - low) / step), F.lit(bins - 1)).cast("int")
    n = df.where(F.col(x).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(F.lit(0))) * step))


#: Bins of a bandwidth, terms of the expansion within a bin, and bandwidths from a bin that its weight reaches. Together the
#: density is off by less than 1e-10 of its largest possible value.
BINS, TERMS, REACH = 4, 8, 9


def spread(df: DataFrame, x: str, w: str) -> dict[str, float]:
    """n, least and greatest value, effective n and weighted standard deviation (for weights that say reliability) of a column."""
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & (F.col(w) > 0)).select(F.col(x).cast("double").alias("x"), F.col(w).cast("double").alias("w"))
    one = rows.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("x")).alias("swx")).first().asDict()
    if not one["n"]:
        return {"n": 0}
    mean = one["swx"] / one["sw"]
    square = rows.agg(F.sum(F.col("w") * (F.col("x") - mean) ** 2)).first()[0] / one["sw"]
    part = one["sw2"] / one["sw"] ** 2
    return {"n": one["n"], "low": one["low"], "high": one["high"], "sum_w": one["sw"], "n_eff": 1 / part, "sd": (square / (1 - part)) ** 0.5 if part < 1 else 0.0}


def scott(found: dict[str, float]) -> float:
    """Scott's bandwidth, by the effective number of rows."""
    return found["sd"] * found["n_eff"] ** -0.2 if found["n"] else 0.0


def gaussian_density(df: DataFrame, x: str, w: str, points: int = 512, bandwidth: float | None = None, least: int = 5) -> DataFrame:
    """(x, density): weighted Gaussian density at points from the least to the greatest value; none for fewer than ``least`` rows or one value.

    A fast Gauss transform: rows are reduced, map-side, to the first moments of narrow bins (a quarter of a bandwidth), and each bin
    adds to the points within its reach by a Hermite expansion. Cost does not depend on rows x points, and nothing is
    rounded to bin centres.
    """
    found = spread(df, x, w)
    empty = df.sparkSession.createDataFrame([], "x double, density double")
    h = bandwidth or scott(found)
    if found["n"] < least or found["low"] == found["high"] or not h > 0:
        return empty
    low, step, width = found["low"], (found["high"] - found["low"]) / (points - 1), h / BINS
    value, weight = F.col(x).cast("double"), F.col(w).cast("double")
    bin_ = F.floor((value - low) / width)
    rows = df.where(value.isNotNull() & ~F.isnan(value) & (weight > 0)).select(bin_.alias("_bin"), weight.alias("_w"), ((value - low - (bin_ + 0.5) * width) / h).alias("_t"))
    bins = rows.groupBy("_bin").agg(*[F.sum(F.col("_w") * F.pow("_t", F.lit(k))).alias(f"_m{k}") for k in range(TERMS)])
    centre = (F.col("_bin") + 0.5) * width
    first = F.greatest(F.lit(0), F.ceil((centre - REACH * h) / step))
    last = F.least(F.lit(points - 1), F.floor((centre + REACH * h) / step))
    near = bins.where(first <= last).withColumn("_at", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    z = (F.col("_at") * step - centre) / h
    near = near.withColumn("_z", z)
    # the kernel at z - t is the kernel at z times the sum of Hermite polynomials of z over k!, times t to the k
    polynomials, factorial, terms = [F.lit(1.0), F.col("_z")], 1.0, F.col("_m0")
    for k in range(1, TERMS):
        factorial *= k
        terms = terms + polynomials[k] * F.col(f"_m{k}") / factorial
        polynomials.append(F.col("_z") * polynomials[k] - k * polynomials[k - 1])
    norm = found["sum_w"] * h * (2 * math.pi) ** 0.5
    sums = near.groupBy("_at").agg((F.sum(F.exp(-0.5 * F.col("_z") * F.col("_z")) * terms) / norm).alias("density"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("_at"), (low + F.col("id") * step).alias("x"))
    # far from all values an expansion may end in a tiny negative number
    return grid.join(sums, "_at", "left").select("x", F.greatest(F.coalesce("density", F.lit(0.0)), F.lit(0.0)).alias("density"))


def people(df: DataFrame, person: str, groups: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(group, *by, n_rows, n_people): exact counts of rows and of distinct people over groups that may overlap, for every
    level of ``by`` and over all of them (null), in one pass: pairs of person and level are made distinct, once, then marked."""
    flags = {f"_g{i}": F.coalesce(c, F.lit(False)).cast("int") for i, c in enumerate(groups.values())}
    each = df.withColumns(flags).groupBy(person, *by).agg(*[F.sum(f).alias(f) for f in flags])
    sets = each.groupingSets([[F.col(person), *map(F.col, by)], [F.col(person)]] if by else [[F.col(person)]], person, *by).agg(*[F.sum(f).alias(f) for f in flags], F.grouping_id().alias("_level"))
    cells = F.array(*[F.struct(F.lit(g).alias("group"), F.col(f).alias("n")) for g, f in zip(groups, flags)])
    long = sets.select(person, *by, "_level", F.explode(F.filter(cells, lambda c: c.n > 0)).alias("c"))
    out = long.groupBy("c.group", *by, "_level").agg(F.sum("c.n").alias("n_rows"), F.count(person).alias("n_people"))
    return out.select("group", *by, "n_rows", "n_people")


def sketch_error(lg_k: int) -> float:
    """Standard error, relative, of a count from a sketch of 2^lg_k registers."""
    return 1.04 / 2 ** (lg_k / 2)


def people_sketches(df: DataFrame, person: str, by: Sequence[str], lg_k: int = 12) -> DataFrame:
    """(*by, n_rows, sketch): a mergeable sketch of the people of each cell, a few kilobytes whatever their number."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.hll_sketch_agg(person, lg_k).alias("sketch"))


def people_from_sketches(cells: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """(group, n_rows, n_people): counts over groups of cells that may overlap, from the cells' sketches alone; a count is
    within three times ``sketch_error`` of the truth in about 997 of 1,000 cases."""
    tags = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(g)) for g, c in groups.items()]), lambda t: t.isNotNull())
    return cells.withColumn("group", F.explode(tags)).groupBy("group").agg(F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_people"))
