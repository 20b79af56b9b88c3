"""Rotating panels: period ordinals, leads and lags by row or by time, pairs, first observations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import readers


def ordinal(year: str | Column, quarter: str | Column) -> Column:
    """Quarters counted on: differences are distances in quarters."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return (as_col(year) * 4 + as_col(quarter)).cast("int")


def period_label(year: Column, quarter: Column, years: int) -> Column:
    """``YYYYQn``; with a single year just ``Qn``."""
    label = F.concat(F.lit("Q"), quarter.cast("string"))
    return label if years == 1 else F.concat(year.cast("string"), label)


def _over(person: str, time: str, ties: Sequence[str] = ()):
    return Window.partitionBy(person).orderBy(F.col(time).asc_nulls_last(), *ties)


def known(person: str, value: Column) -> Column:
    """Null ids are nobody: their rows would otherwise be one person's."""
    return F.when(F.col(person).isNotNull(), value)


def consecutive_lead(df: DataFrame, person: str, time: str, columns: Iterable[str], suffix: str = "_next", gap: int = 1) -> DataFrame:
    """The next row's values where it is exactly ``gap`` periods later, else null; one shuffle for all columns."""
    w = _over(person, time)
    ok = F.lead(time).over(w) - F.col(time) == gap
    return df.withColumns({c + suffix: known(person, F.when(ok, F.lead(c).over(w))) for c in columns})


def consecutive_lag(df: DataFrame, person: str, time: str, columns: Iterable[str], suffix: str = "_prev", gap: int = 1) -> DataFrame:
    w = _over(person, time)
    ok = F.col(time) - F.lag(time).over(w) == gap
    return df.withColumns({c + suffix: known(person, F.when(ok, F.lag(c).over(w))) for c in columns})


def row_lead(df: DataFrame, person: str, time: str, columns: Iterable[str], k: int, suffix: str) -> DataFrame:
    """The value k rows on where that row is k periods later: every period between must be there."""
    w = _over(person, time)
    ok = F.lead(time, k).over(w) - F.col(time) == k
    return df.withColumns({c + suffix: known(person, F.when(ok, F.lead(c, k).over(w))) for c in columns})


def time_lead(df: DataFrame, person: str, time: str, columns: Iterable[str], k: int, suffix: str) -> DataFrame:
    """The value exactly k periods on, whatever lies between. (person, time) must be unique."""
    w = Window.partitionBy(person).orderBy(time).rangeBetween(k, k)
    return df.withColumns({c + suffix: known(person, F.when(F.col(time).isNotNull(), F.first(c).over(w))) for c in columns})


def neighbours(df: DataFrame, person: str, time: str, columns: Iterable[str]) -> DataFrame:
    """Unchecked lag 1, lag 2 and lead 1 of many columns, in one window."""
    w = _over(person, time)
    out = {}
    for c in columns:
        out |= {f"{c}_t1": F.lag(c, 1).over(w), f"{c}_t2": F.lag(c, 2).over(w), f"{c}_f1": F.lead(c, 1).over(w)}
    return df.withColumns({k: known(person, v) for k, v in out.items()})


def first_observation(df: DataFrame, person: str, *order: str | Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(person).orderBy(*order))).where("_r = 1").drop("_r")


def keep_first(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """One row a key, the first by an explicit order (``dropDuplicates`` would pick any)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def have_consecutive_pair(df: DataFrame, person: str, time: str) -> DataFrame:
    """Distinct persons with two rows one period apart."""
    return consecutive_lead(df.select(person, time), person, time, [time]).where(F.col(f"{time}_next").isNotNull()).select(person).distinct()


def hash_share(modulus: int, *keys: str) -> Column:
    """A reproducible pseudo-random bucket of a key, the same in any engine: leading md5 digits mod ``modulus``."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("bigint") % modulus


def sample_ids(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Exactly round(n * fraction) ids (1 at least), by the order of their hashes.

    Ids are counted by the first four digits of the hash (65,536 bins at most); whole bins are taken up to the one that
    holds the last place, and only that bin's ids are ordered.
    """
    code = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"_{seed}")))
    ids = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_code", code).withColumn("_bin", F.substring("_code", 1, 4))
    bins = sorted((b, n) for b, n in ids.groupBy("_bin").count().collect())
    left = max(1, int(sum(n for _, n in bins) * fraction + 0.5))
    edge = ""
    for edge, n in bins:
        if left <= n:
            break
        left -= n
    last = ids.where(F.col("_bin") == edge).orderBy("_code", key).limit(left)
    return ids.where(F.col("_bin") < edge).unionAll(last).select(key)


#: Rows of a range in ``positions``: the number of ranges grows with the data.
RANGE_ROWS = 1_000_000


def positions(df: DataFrame, keys: Sequence[Column], name: str = "pos", range_rows: int | None = None) -> DataFrame:
    """All rows with their place (1, 2, 3 ...) in the order of ``keys``, nulls last.

    Rows are dealt to ranges of the whole key, as many as the data need, and sorted within each; the written table has every
    row's range and place in it, and the counts of the ranges before (one number a range) make these places of the whole.
    Rows equal in all keys stand in one range, in any order.
    """
    ranges = max(1, -(-df.count() // (range_rows or RANGE_ROWS)))
    order = [k.asc_nulls_last() for k in keys]
    sorted_ = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the partition's number above 33 bits of the row's own
    placed = readers.saved(sorted_.withColumn("_at", F.monotonically_increasing_id()), "positions")
    placed = placed.withColumns({"_range": F.shiftright("_at", 33), "_own": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    # a row a range
    before = sizes.select("_range", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_n")).alias("_before"))
    return placed.join(before, "_range").withColumn(name, F.col("_before") + F.col("_own") + 1).drop("_range", "_at", "_own", "_before")
