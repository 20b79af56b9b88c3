"""Bootstraps by multinomial splitting: multiplicities are dealt, never drawn one by one.

A resample of n rows with replacement is one draw from a multinomial over the rows. Rows with the same values are one class, and a
replication's n is dealt down the classes, in their order, by a chain of conditional binomials: of what is left, a class gets a binomial share
by its part of what is left, by the inverse distribution function of a hashed uniform. A chain needs the classes one after another, but
replications do not need each other: groups of ``CHAINS`` of them meet the classes in tasks of their own, in rounds of bounded size that hand on
what is left. Spark sees a row a class and group and a row a replication, and never n x B rows; a class is one row whatever its
size, so no hot value makes a hot task. Any engine that follows the same chain gets the same resamples.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import readers
from .panel import positions

#: Classes x replications that a task deals at once.
CELLS = 2_000_000
#: Replications that go down the classes together, and how many times so many classes as are dealt at once a round has.
CHAINS, ROUND = 50, 20

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def uniform(replication: int, bucket: object, i: int) -> float:
    """In (0, 1), from the leading 52 bits of a digest."""
    return (int(hashlib.md5(f"{replication}_{bucket}_{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def binomial_quantile(u: np.ndarray, m: np.ndarray, q: float) -> np.ndarray:
    """The least k with P(X <= k) >= u, X binomial of m and q, for each of u and m.

    Sums begin twelve standard deviations (and twelve) below the mean, what lies before is below 1e-30.
    """
    if q >= 1:
        return m.copy()
    reach = 12 * np.sqrt(m * q * (1 - q)) + 12
    k, last = np.floor(np.maximum(0, m * q - reach)), np.minimum(m, np.ceil(m * q + reach))
    p = np.exp(_lgamma(m + 1.0) - _lgamma(k + 1) - _lgamma(m - k + 1) + k * math.log(q) + (m - k) * math.log1p(-q))
    below = p.copy()
    at = np.flatnonzero((below < u) & (k < last))
    while len(at):
        p[at] *= (m[at] - k[at]) / (k[at] + 1) * (q / (1 - q))
        k[at] += 1
        below[at] += p[at]
        at = at[(below[at] < u[at]) & (k[at] < last[at])]
    return k.astype(np.int64)


def deal(totals: np.ndarray, weights: np.ndarray, replications: np.ndarray, bucket: object, first: int = 0, beyond: int = 0) -> np.ndarray:
    """A row for each weight, a column for each replication: how often its class is in the resample. The weights may be a part of the
    chain, from its class number ``first`` on, with classes of ``beyond`` rows after them; then ``totals`` is what is left for both."""
    left, out = totals.astype(np.int64), np.zeros((len(weights), len(totals)), np.int64)
    rest = np.cumsum(weights[::-1])[::-1] + beyond
    for i, w in enumerate(weights):
        if not w:
            continue
        some = np.flatnonzero(left)
        if not len(some):
            break
        u = np.array([uniform(b, bucket, first + i) for b in replications[some].tolist()])
        out[i, some] = binomial_quantile(u, left[some], float(w) / float(rest[i]))
        left = left - out[i]
    return out


def _dealt(classes: DataFrame, order: Sequence[str], replications: int, start: dict[str, float], add: Callable, kinds: dict[str, str], cells: int) -> DataFrame:
    """(b, *start): columns of the values ``start``, after ``add`` (columns so far, some classes in order, multiplicities by class and
    replication, resamples before these classes) has seen all classes. ``classes`` (_n and values) is a written table."""
    spark = classes.sparkSession
    n_classes, n = classes.agg(F.count("*"), F.sum("_n")).first()
    each, groups = max(1, cells // CHAINS), -(-replications // CHAINS)
    schema = ", ".join(["b long", "_left long", "_rest long", *[f"{c} {kinds[c]}" for c in start]])

    def round_(number: int) -> Callable:
        def run(resamples: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            rows, resamples = rows.sort_values(list(order), kind="stable"), resamples.sort_values("b")
            b, left, rest = resamples["b"].to_numpy(), resamples["_left"].to_numpy(), int(resamples["_rest"].iloc[0])
            found = {c: resamples[c].to_numpy(copy=True) for c in start}
            for at in range(0, len(rows), each):
                some = rows.iloc[at : at + each]
                weights = some["_n"].to_numpy(np.int64)
                rest -= int(weights.sum())
                times = deal(left, weights, b, 0, number * ROUND * each + at, rest)
                add(found, some, times, n - left)
                left = left - times.sum(axis=0)
            return pd.DataFrame({"b": b, "_left": left, "_rest": rest, **found})

        return run

    def grouped(df: DataFrame):
        return df.repartitionById(groups, "_group").groupBy("_group")

    parts = [classes]
    if n_classes > ROUND * each:
        placed = readers.saved(positions(classes, [F.col(c) for c in order], "_pos"), "classes")
        parts = [placed.where((F.col("_pos") > k) & (F.col("_pos") <= k + ROUND * each)).drop("_pos") for k in range(0, n_classes, ROUND * each)]
    state = spark.range(replications).select(F.col("id").alias("b"), F.lit(n).cast("long").alias("_left"), F.lit(n).cast("long").alias("_rest"), *[F.lit(x).cast(kinds[c]).alias(c) for c, x in start.items()])
    for number, part in enumerate(parts):
        state = state if not number else readers.saved(state, "resamples")
        met = part.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        state = grouped(state.withColumn("_group", F.floor(F.col("b") / CHAINS).cast("int"))).cogroup(grouped(met)).applyInPandas(round_(number), schema)
    return state.select("b", *start)


def cluster_bootstrap(stats: DataFrame, sums: Sequence[str], replications: int, cells: int = CELLS) -> DataFrame:
    """(b, *sums): the sums over as many people as there are, drawn with replacement. ``stats`` has one row a person with
    that person's sufficient statistics; a null adds nothing. Without people there are no rows."""
    known = stats.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums])
    counted = known.groupBy(*sums).agg(F.count("*").alias("_n"))
    classes = readers.saved(counted, "classes")
    kinds = {f.name: "double" if f.dataType.simpleString() in ("double", "float") or f.dataType.simpleString().startswith("decimal") else "long" for f in stats.schema.fields}
    schema = ", ".join(["b long", *[f"{c} {kinds[c]}" for c in sums]])
    if not replications or classes.isEmpty():
        return stats.sparkSession.createDataFrame([], schema)
    types = {c: np.int64 if kinds[c] == "long" else float for c in sums}

    def add(found: dict, rows: pd.DataFrame, times: np.ndarray, _) -> None:
        for c in sums:
            found[c] += rows[c].to_numpy(types[c]) @ times

    return _dealt(classes, sums, replications, dict.fromkeys(sums, 0), add, kinds, cells)


def winsorised_bootstrap(values: DataFrame, x: str, replications: int, low: float, high: float, cells: int = CELLS) -> DataFrame:
    """(b, median, mean): median, and mean of the values clipped at two linear quantiles, of each resample.

    Classes go by in the order of the values, so places within a resample are known: some classes give the values at the wanted places that
    fall among them, and the sum of what lies between the clipping places.
    """
    known = values.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.count("*").alias("_n"))
    classes = readers.saved(known, "classes")
    (n,) = classes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()
    if not n or not replications:
        return values.sparkSession.createDataFrame([], "b long, median double, mean double")
    places = [(n - 1) * p for p in (low, 0.5, high)]
    ranks = sorted({k for at in places for k in (math.floor(at), math.ceil(at))})
    first, last = math.floor(places[0]) + 1, math.floor(places[2])

    def add(found: dict, rows: pd.DataFrame, times: np.ndarray, before: np.ndarray) -> None:
        v = rows["x"].to_numpy()
        end = before + np.cumsum(times, axis=0)
        for i, k in enumerate(ranks):
            here = np.flatnonzero((before <= k) & (end[-1] > k))
            if len(here):
                found[f"r{i}"][here] = v[(end[:, here] <= k).sum(axis=0)]
        inside = np.minimum(end, last + 1) - np.maximum(end - times, first)
        found["s"] += v @ np.maximum(inside, 0)

    start = {**{f"r{i}": math.nan for i in range(len(ranks))}, "s": 0.0}
    whole = _dealt(classes, ["x"], replications, start, add, dict.fromkeys(start, "double"), cells)

    def at(place: float):
        a, part = math.floor(place), place - math.floor(place)
        below, above = F.col(f"r{ranks.index(a)}"), F.col(f"r{ranks.index(math.ceil(place))}")
        return below + (above - below) * part

    mean = (at(places[0]) * float(first) + F.col("s") + at(places[2]) * float(n - 1 - last)) / float(n)
    return whole.select("b", at(places[1]).alias("median"), mean.alias("mean"))
