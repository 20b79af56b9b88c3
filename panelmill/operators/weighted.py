"""Survey-weighted statistics."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import clip, few


def valid(x: str, w: str) -> Column:
    return F.col(x).isNotNull() & (F.col(w) > 0)


def mean_by(df: DataFrame, x: str, w: str, *by: str) -> DataFrame:
    """value (weighted mean), n and sum of weights over rows with a value and a positive weight."""
    return df.where(valid(x, w)).groupBy(*by).agg((F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("value"), F.count("*").alias("n"), F.sum(w).alias("sum_w"))


def mean_ci(df: DataFrame, x: str, w: str, *by: str, z: float = 1.96) -> DataFrame:
    """Weighted mean, population SD, effective n, standard error and normal band."""
    s = df.where(valid(x, w)).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(F.col(w) * F.col(w)).alias("sw2"), F.sum(F.col(w) * F.col(x)).alias("swx"), F.sum(F.col(w) * F.col(x) * F.col(x)).alias("swxx")
    )
    s = s.withColumn("mean", F.col("swx") / F.col("sw")).withColumn("n_eff", F.col("sw") * F.col("sw") / F.col("sw2"))
    s = s.withColumn("sd", F.sqrt(F.greatest(F.col("swxx") / F.col("sw") - F.col("mean") * F.col("mean"), F.lit(0.0)))).withColumn("se", F.col("sd") / F.sqrt("n_eff"))
    return s.select(*by, "n", "mean", "sd", "n_eff", "se", (F.col("mean") - z * F.col("se")).alias("lo"), (F.col("mean") + z * F.col("se")).alias("hi"))


#: Rows of a bracket that are sorted; a larger one is split into ``PARTS`` and looked at again.
BRACKET_ROWS, PARTS = 1_000_000, 4096


def _block(x: str) -> Column:
    """A block of values: a thousandth of their size wide, rising with the value, the same at any size of the data."""
    v = F.col(x).cast("double")
    return F.when(F.isnan(v), F.lit(800_000)).otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * 1024)).cast("long")


def _collapsed(df: DataFrame, x: str, w: Column, by: Sequence[str], aims: Callable[[Column], list[Column]]) -> DataFrame:
    """Distinct values near the wanted places, with the weight up to and with them (_cum) and in all (_all).

    Scans, and no value column is shuffled whole. The first sums the weights of blocks of values, map-side (some thousand blocks
    a group, whatever its rows); cumulated, they bracket each of ``aims`` (places in the cumulated weight, given its
    total). The next reads only rows within the brackets, through a broadcast of them, and counts and sorts their values; a
    bracket of more than ``BRACKET_ROWS`` rows is first split into narrower blocks, by a scan of its own.
    _first and _last are the least and the greatest weight of one row, _next and _next_first are of the value that follows.
    """
    weighed = df.select(*by, x, w.alias("_w1")).withColumn("_b0", _block(x))
    met = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate([*by, "_b0"])])
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rows, level = weighed.withColumns({"_p": F.lit(0).cast("long"), "_b": F.col("_b0"), "_from": F.lit(0.0), "_end": F.lit(None).cast("double"), "_all": F.lit(None).cast("double")}), 0
    while True:
        blocks = rows.groupBy(*by, "_b0", "_p", "_b").agg(
            F.sum("_w1").alias("_sum"), F.count("*").alias("_rows"), F.min(x).alias("_least"), F.max(x).alias("_greatest"),
            F.first("_from").alias("_from"), F.first("_end").alias("_end"), F.first("_all").alias("_all"),
        )
        # places within what was one block before; of a block of which only the last value is here, the end is known
        scope = own if level == 0 else Window.partitionBy(*by, "_b0", "_p")
        run = F.sum("_sum").over(scope.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        blocks = blocks.withColumns({"_before": F.coalesce(F.col("_end"), F.col("_from") + run) - F.col("_sum"), "_all": F.coalesce("_all", F.sum("_sum").over(own))})
        end, slack = F.col("_before") + F.col("_sum"), F.col("_all") * 1e-9
        blocks = blocks.withColumn("_whole", functools.reduce(Column.__or__, [(F.col("_before") <= aim + slack) & (aim <= end + slack) for aim in aims(F.col("_all"))]))
        # beside a wanted block the values next to it are needed: places lie between values, too
        near = own.orderBy("_b0", "_b")
        blocks = blocks.withColumns({"_after": F.coalesce(F.lag("_whole").over(near), F.lit(False)), "_ahead": F.coalesce(F.lead("_whole").over(near), F.lit(False))})
        all_of_it = F.col("_whole") | (F.col("_after") & F.col("_ahead"))
        low, high = F.when(~all_of_it & F.col("_ahead"), F.col("_greatest")), F.when(~all_of_it & F.col("_after"), F.col("_least"))
        # a block is found again by its bounds
        kept = blocks.where("_whole or _after or _ahead").select(
            *[F.col(k).alias(f"_key{i}") for i, k in enumerate([*by, "_b0"])], F.coalesce(low, "_least").alias("_low"), F.coalesce(high, "_greatest").alias("_high"),
            F.col("_before").alias("_from"), F.when(low.isNotNull(), end).alias("_end"), "_all", "_b", F.when(all_of_it & (F.col("_least") < F.col("_greatest")), F.col("_rows")).otherwise(0).alias("_many"),
        )
        kept, known = few(kept)
        found = weighed.join(kept, met & F.col(x).between(F.col("_low"), F.col("_high")))
        wide = kept.where(F.col("_many") > BRACKET_ROWS)
        if level == 2 or (wide.isEmpty() if known is None else all(k["_many"] <= BRACKET_ROWS for k in known)):
            break
        part = F.floor((F.col(x).cast("double") - F.col("_low")) / (F.col("_high").cast("double") - F.col("_low")) * (PARTS - 1))
        rows = found.withColumns({"_p": F.col("_b"), "_b": F.col("_b") * PARTS + F.when(F.col("_many") > BRACKET_ROWS, part).otherwise(0).cast("long")})
        level += 1
    values = found.groupBy(*by, "_b0", "_b", x).agg(F.sum("_w1").alias("_w"), F.min("_w1").alias("_first"), F.max("_w1").alias("_last"), *[F.first(c).alias(c) for c in ("_from", "_end", "_all")])
    within, on = Window.partitionBy(*by, "_b0", "_b").orderBy(x), own.orderBy(x)
    cum = F.coalesce(F.col("_end"), F.col("_from") + F.sum("_w").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return values.select(*by, x, "_w", "_first", "_last", "_all", cum.alias("_cum"), F.lead(x).over(on).alias("_next"), F.lead("_first").over(on).alias("_next_first"))


def quantile_linear(df: DataFrame, x: str, ps: Sequence[float], *by: str) -> DataFrame:
    """Linear quantiles of a column (between the two nearest ranks), nulls left out; columns q0, q1, ..."""
    rows = _collapsed(df.where(F.col(x).isNotNull()), x, F.lit(1), by, lambda n: [(n - 1) * float(p) for p in ps])
    out = []
    for i, p in enumerate(ps):
        place = (F.col("_all") - 1) * float(p)
        low = F.floor(place)
        above = F.when(F.col("_cum") > F.ceil(place), F.col(x)).otherwise(F.col("_next"))
        value = F.when(place == low, F.col(x).cast("double")).otherwise((low + 1 - place) * F.col(x) + (place - low) * above)
        out.append(F.min(F.when((F.col("_cum") > low) & (F.col("_cum") - F.col("_w") <= low), value)).alias(f"q{i}"))
    return rows.groupBy(*by).agg(*out)


def beside(stats: DataFrame, quantiles: DataFrame, *by: str) -> DataFrame:
    """A summary's rows with their group's quantiles, groups without a name included; without ``by`` one row each."""
    if not by:
        return stats.crossJoin(quantiles)
    right = quantiles.withColumnsRenamed({k: f"_{k}" for k in by})
    return stats.join(right, functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]), "left").drop(*[f"_{k}" for k in by])


def quantile_reach(df: DataFrame, x: str, w: str, ps: Sequence[float], *by: str) -> DataFrame:
    """First value at which the cumulated weight reaches p of the total; columns q0, q1, ..."""
    rows = _collapsed(df.where(valid(x, w)), x, F.col(w), by, lambda n: [n * float(p) for p in ps])
    return rows.groupBy(*by).agg(*[F.min(F.when(F.col("_cum") >= p * F.col("_all"), F.col(x))).alias(f"q{i}") for i, p in enumerate(ps)])


def quantile_exceed(df: DataFrame, x: str, w: str, ps: Sequence[float], *by: str, tolerance: float = 1e-9) -> DataFrame:
    """First value at which the cumulated weight exceeds p of the total; on an exact tie the average with the next value."""
    rows = _collapsed(df.where(valid(x, w)), x, F.col(w), by, lambda n: [n * float(p) for p in ps])
    out = []
    for i, p in enumerate(ps):
        aim = p * F.col("_all")
        tie = F.abs(F.col("_cum") - aim) <= tolerance * F.greatest(F.abs(aim), F.col("_cum"))
        at_tie = F.min(F.when(tie, (F.col(x) + F.coalesce("_next", x)) / 2))
        over = F.min(F.when((F.col("_cum") > aim) & ~tie, F.col(x)))
        out.append(F.coalesce(at_tie, over).alias(f"q{i}"))
    return rows.groupBy(*by).agg(*out)


def quantile_midpoint(df: DataFrame, x: str, w: str, ps: Sequence[float], *by: str) -> DataFrame:
    """Interpolated between the midpoints (cum - w/2) / total of rows ordered by (x, w), ends clamped.

    Rows of one value differ in their midpoints alone, so a value's first and last row say all of it.
    """
    rows = _collapsed(df.where(valid(x, w)), x, F.col(w), by, lambda n: [n * float(p) for p in ps])
    total = F.col("_all")
    rows = rows.withColumns({
        "_m0": (F.col("_cum") - F.col("_w") + 0.5 * F.col("_first")) / total, "_m1": (F.col("_cum") - 0.5 * F.col("_last")) / total,
        "_m2": (F.col("_cum") + 0.5 * F.col("_next_first")) / total,
    })
    out = []
    for i, p in enumerate(ps):
        here = F.min(F.when((F.col("_m0") <= p) & (p < F.col("_m1")), F.col(x)))
        between = F.min(F.when((F.col("_m1") <= p) & (p < F.col("_m2")), F.col(x) + (F.col("_next") - F.col(x)) * (p - F.col("_m1")) / (F.col("_m2") - F.col("_m1"))))
        end = F.when(F.min("_m0") > p, F.min(x)).otherwise(F.max(x))
        out.append(F.coalesce(here, between, end).alias(f"q{i}"))
    return rows.groupBy(*by).agg(*out)


def price_factor(df: DataFrame, nominal: str, real: str, w: str) -> DataFrame:
    """Weighted mean of nominal / real over the rows given."""
    return df.where((F.col(real) > 0) & (F.col(w) > 0)).agg((F.sum(F.col(w) * F.col(nominal) / F.col(real)) / F.sum(w)).alias("factor"))


def winsorise(df: DataFrame, x: str, low: float, high: float, *by: str, out: str | None = None) -> DataFrame:
    """Clipped at a group's linear quantiles; bounds join back by group."""
    q = quantile_linear(df, x, (low, high), *by)
    joined = df.join(q, list(by)) if by else df.crossJoin(F.broadcast(q))
    return joined.withColumn(out or x, clip(F.col(x), F.col("q0"), F.col("q1"))).drop("q0", "q1")


def winsorise_weighted(df: DataFrame, x: str, w: str, low: float, high: float, *by: str, out: str | None = None) -> DataFrame:
    q = quantile_midpoint(df, x, w, (low, high), *by)
    return df.join(q, list(by)).withColumn(out or x, clip(F.col(x), F.col("q0"), F.col("q1"))).drop("q0", "q1")


def overlapping(df: DataFrame, groups: dict[str, Column], name: str = "group") -> DataFrame:
    """One row per group that a row belongs to: one pass where groups overlap."""
    tags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(g)) for g, c in groups.items()]))
    return df.withColumn(name, F.explode(tags))
