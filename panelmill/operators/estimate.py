"""Estimators on small aggregates: hazards, generators, moments, least squares."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..sources import readers


def hazards(matrix: DataFrame, origin: str, destination: str, share: str, step: float = 1.0) -> DataFrame:
    """Competing-risk rates of a probability matrix: each exit's part of -ln(1 - exits) / step; the diagonal is minus
    their sum. No exits: zero; nothing but exits: null."""
    leaves = F.col(origin) != F.col(destination)
    out = F.sum(F.when(leaves, F.col(share)).otherwise(0.0)).over(Window.partitionBy(origin))
    total = F.when(F.col("_out") <= 0, 0.0).when(F.col("_out") < 1, -F.ln(1 - F.col("_out")) / step)
    rate = F.when(leaves, F.when(F.col("_out") > 0, total * F.col(share) / F.col("_out")).otherwise(total)).otherwise(-total)
    return matrix.withColumn("_out", out).withColumn("rate", rate).drop("_out")


def generator_mle(counts: np.ndarray, step: float = 1.0) -> np.ndarray:
    """The generator Q that maximises sum counts * log expm(Q step), over log rates."""
    n = len(counts)
    off = ~np.eye(n, dtype=bool)
    p = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)

    def build(x: np.ndarray) -> np.ndarray:
        q = np.zeros((n, n))
        q[off] = np.exp(np.clip(x, -30, 10))
        np.fill_diagonal(q, -q.sum(1))
        return q

    def loss(x: np.ndarray) -> float:
        return -float((counts * np.log(np.maximum(numeric.expm(build(x) * step), 1e-300))).sum()) / counts.sum()

    return build(numeric.simplex(loss, np.log(np.maximum(p[off] / step, 1e-6)), f_tol=1e-13))


#: Columns of a regression, dummies included: its normal equations are solved on the driver.
MOST_COLUMNS = 4_000


class Equations(NamedTuple):
    """X'X, X'y, y'y and n of complete rows; columns are a constant, the numbers, and (category, level) of all but the first level."""

    columns: list
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    n: int


def _complete(y: str, xs: Sequence[str], categories: Sequence[str]) -> Column:
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (y, *xs)] + [F.col(c).isNotNull() for c in categories]
    return reduce(lambda a, b: a & b, known)


def normal_equations(df: DataFrame, y: str, xs: Sequence[str], categories: Sequence[str] = ()) -> Equations:
    """One pass over the rows, whatever the number of levels.

    No dummy column is ever made: rows are summed by cells (the combinations of levels that occur), cells by each
    category and each pair of categories. A dummy's products with numbers are its level's sums, those of two dummies the count of
    their pair. Levels are found in the data and ordered as text; the first of each category is dropped.
    """
    numbers = ["_one", *xs]
    rows = df.where(_complete(y, xs, categories)).select(F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in (*xs, y)], *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(categories)])
    cats = [f"_c{i}" for i in range(len(categories))]
    values = [*numbers, y]
    products = {(i, j): f"_s{i}_{j}" for i in range(len(values)) for j in range(i, len(values))}
    cells = rows.groupBy(*cats).agg(*[F.sum(F.col(values[i]) * F.col(values[j])).alias(name) for (i, j), name in products.items()])
    if cats:
        sets = [[], *[[c] for c in cats], *[list(pair) for pair in combinations(cats, 2)]]
        cells = readers.saved(cells, "cells")
        levels = cells.agg(*[F.count_distinct(c) for c in cats]).first()
        if 1 + len(xs) + sum(levels) > MOST_COLUMNS:
            raise ValueError(f"{sum(levels)} levels are more than a regression here takes ({MOST_COLUMNS} columns)")
        cells = cells.groupingSets([[F.col(c) for c in group] for group in sets], *cats).agg(*[F.sum(name).alias(name) for name in products.values()], F.grouping_id().alias("_set"))
    sums = {tuple((c, x[c]) for c in cats if x[c] is not None): x for x in cells.collect()}
    whole = sums[()]
    columns: list = [*numbers]
    for c in cats:
        columns += [(c, level) for level in sorted(key[0][1] for key in sums if len(key) == 1 and key[0][0] == c)[1:]]
    at = {c: i for i, c in enumerate(columns)}
    k = len(numbers)
    xx, xy = np.zeros((len(columns), len(columns))), np.zeros(len(columns))
    value = lambda row, i, j: row[products[min(i, j), max(i, j)]] or 0.0
    for i in range(k):
        xy[i] = value(whole, i, k)
        for j in range(k):
            xx[i, j] = value(whole, i, j)
    for key, row in sums.items():
        places = [at.get(level) for level in key]
        if None in places or not places:
            continue
        a, b = places[0], places[-1]
        xx[a, b] = xx[b, a] = value(row, 0, 0)
        if len(places) == 1:
            xy[a] = value(row, 0, k)
            for j in range(k):
                xx[a, j] = xx[j, a] = value(row, 0, j)
    return Equations(columns, xx, xy, float(value(whole, k, k)), int(xx[0, 0]))


def residualise(df: DataFrame, y: str, xs: Sequence[str], out: str, categories: Sequence[str] = (), keep: bool = False) -> tuple[DataFrame, float]:
    """``df``'s complete rows with y at the sample's average regressors (y net of the fit, plus the mean fit), and R squared.
    ``keep``: rows that lack a regressor stay, with y as it is. Rows without any complete one: no fit, R squared NaN."""
    rows = df if keep else df.where(_complete(y, xs, categories))
    eq = normal_equations(df, y, xs, categories)
    if not eq.n:
        return rows.withColumn(out, F.col(y).cast("double")), float("nan")
    # columns of one length: squares beside dummies would cost half the digits
    length = np.sqrt(np.maximum(np.diag(eq.xx), 1e-300))
    beta = np.linalg.lstsq(eq.xx / np.outer(length, length), eq.xy / length, rcond=1e-13)[0] / length
    mean = eq.xy[0] / eq.n
    spread = eq.yy - eq.n * mean * mean
    r2 = 1 - (eq.yy - beta @ eq.xy) / spread if spread > 0 else float("nan")
    fit: Column = F.lit(float(beta[0]))
    for x, coefficient in zip(xs, beta[1:]):
        fit = fit + F.col(x) * float(coefficient)
    for i, c in enumerate(categories):
        effects = [(level[1], float(b)) for level, b in zip(eq.columns, beta) if level[0] == f"_c{i}" and isinstance(level, tuple)]
        # at most ``MOST_COLUMNS`` rows; the first level has no effect of its own
        table = df.sparkSession.createDataFrame(effects, f"_level{i} string, _effect{i} double")
        rows = rows.join(F.broadcast(table), F.col(c).cast("string") == F.col(f"_level{i}"), "left").drop(f"_level{i}")
        fit = fit + F.coalesce(f"_effect{i}", F.lit(0.0))
    adjusted = F.col(y) - fit + float(mean)
    done = rows.withColumn(out, F.when(_complete(y, xs, categories), adjusted).otherwise(F.col(y)) if keep else adjusted)
    return done.drop(*[f"_effect{i}" for i in range(len(categories))]), float(r2)
