"""Transition matrices and flows over pairs of states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import few


def grid(spark, states: Sequence[str], *names: str) -> DataFrame:
    """Every combination of the states: fixed rows so that absent cells show as 0."""
    out = spark.createDataFrame([(s,) for s in states], f"{names[0]} string")
    for name in names[1:]:
        out = out.crossJoin(spark.createDataFrame([(s,) for s in states], f"{name} string"))
    return out


def counts(pairs: DataFrame, origin: str, destination: str, states: Sequence[str], weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Long matrix (origin, destination, n) over the whole grid; a missing weight counts as 1."""
    measure = F.count("*") if weight is None else F.sum(F.coalesce(weight, F.lit(1.0)))
    have = pairs.where(F.col(origin).isNotNull() & F.col(destination).isNotNull()).groupBy(*by, origin, destination).agg(measure.alias("n"))
    frame = grid(pairs.sparkSession, states, origin, destination)
    if by:
        frame = have.select(*by).distinct().crossJoin(F.broadcast(frame))
    return frame.join(have, [*by, origin, destination], "left").fillna(0, ["n"])


def shares(matrix: DataFrame, origin: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds row_share (0 for an empty origin) and total_share."""
    row = F.sum("n").over(Window.partitionBy(*by, origin))
    # the matrix is a few dozen rows, so a window over all of it is no bottleneck
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    part = lambda whole: F.when(whole > 0, F.col("n") / whole).otherwise(0.0)
    return matrix.withColumns({"row_share": part(row), "total_share": part(total)})


def wide(matrix: DataFrame, origin: str, destination: str, states: Sequence[str], value: str = "n") -> DataFrame:
    return matrix.groupBy(origin).pivot(destination, list(states)).agg(F.first(value)).fillna(0)


def composition(df: DataFrame, period: str, state: str, states: Sequence[str]) -> DataFrame:
    """Rows by period and state over the whole grid, with shares of the period."""
    have = df.where(F.col(state).isNotNull()).groupBy(period, state).agg(F.count("*").alias("n"))
    frame = have.select(period).distinct().crossJoin(F.broadcast(grid(df.sparkSession, states, state)))
    out = frame.join(have, [period, state], "left").fillna(0, ["n"])
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(period)))


def flows(df: DataFrame, person: str, period: str, state: str) -> DataFrame:
    """Flows from each observed period to the next one in the list of periods, by state pair."""
    periods = df.select(period).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(period)))
    rows = df.join(few(periods)[0], period)
    nxt = rows.select(person, (F.col("_i") - 1).alias("_i"), F.col(period).alias("period_to"), F.col(state).alias("state_to"))
    both = rows.join(nxt, [person, "_i"])
    return both.groupBy(F.col(period).alias("period_from"), "period_to", F.col(state).alias("state_from"), "state_to").agg(F.count("*").alias("n"))
