"""Job-registry operators: filter chains with funnels, shares by place, layouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .clean import is_true


def apply_filters(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, map(is_true, steps.values())))


def observed_filters(df: DataFrame, steps: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows that pass all predicates, and an observation of how many were left after each: no scan beside the one for the rows."""
    seen, so_far, counts = Observation(), F.lit(True), [F.count("*").alias("read")]
    for name, condition in steps.items():
        so_far = so_far & is_true(condition)
        counts.append(F.count(F.when(so_far, 1)).alias(name))
    return apply_filters(df.observe(seen, *counts), steps), seen


def funnel(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """(step, name, n): rows left after each predicate and all before it, in one pass."""
    so_far, sums = F.lit(True), [F.count("*").alias("n0")]
    for i, condition in enumerate(steps.values(), 1):
        so_far = so_far & is_true(condition)
        sums.append(F.coalesce(F.sum(so_far.cast("int")), F.lit(0)).cast("bigint").alias(f"n{i}"))
    names = ["read", *steps]
    wide = df.agg(*sums)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(i).cast("bigint").alias("step"), F.lit(n).alias("name"), F.col(f"n{i}").alias("n")) for i, n in enumerate(names)])))


def is_public(code: Column, last: int, more: Sequence[int]) -> Column:
    """Public by legal code: up to ``last``, or one of a few more."""
    return is_true((code <= last) | code.isin(*more)).cast("int")


def shares_by(df: DataFrame, place: str, public: str, total: bool = False) -> DataFrame:
    """n, n_public, n_private and share by place; with ``total`` also over all places (a null place), in the same pass."""
    grouped = df.rollup(place) if total else df.groupBy(place)
    by = grouped.agg(F.count("*").alias("n"), F.sum(public).cast("bigint").alias("n_public"))
    return by.withColumns({"n_private": F.col("n") - F.col("n_public"), "share_public": F.col("n_public") / F.col("n")})


def two_columns(df: DataFrame, key: str, lon: str, lat: str, overrides: Mapping[int, float]) -> DataFrame:
    """``col`` 0 (west half) or 1, and ``pos`` from the north: for a legend's few dozen rows."""
    at = F.col(lon)
    for k, value in overrides.items():
        at = F.when(F.col(key) == k, value).otherwise(at)
    every = Window.partitionBy(F.lit(0))
    rows = df.withColumns({"_i": F.row_number().over(every.orderBy(at, lat, key)), "_n": F.count("*").over(every)})
    rows = rows.withColumn("col", (F.col("_i") > F.ceil(F.col("_n") / 2)).cast("int"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("col").orderBy(F.desc(lat), key))).drop("_i", "_n")
