"""Cleaning: coercion, flags, bins, labels, schema alignment."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def num(column: str | Column) -> Column:
    """Numeric coercion: text that is no number, and NaN, become null."""
    value = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(~F.isnan(value), value)


def is_true(condition: Column) -> Column:
    """Two-valued logic: a comparison with null is false."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    return is_true(condition).cast("int")


def equals(column: str, code: float) -> Column:
    """Null-safe indicator of a numeric code."""
    return is_true(num(column) == code)


def code_or_label(column: str, code: float, label: str | None) -> Column:
    """1 where the value is the code, or its text contains the label whatever the case; never null.

    A label that is part of another ("employed" in "unemployed") matches that too: pass None to go by code alone.
    """
    found = num(column) == code
    if label is not None:
        found = is_true(found) | is_true(F.contains(F.lower(F.col(column).cast("string")), F.lit(label.lower())))
    return flag(found)


def regex_flag(column: str, pattern: str) -> Column:
    """1 where the text matches the pattern, whatever the case; never null."""
    return flag(F.col(column).cast("string").rlike(f"(?i){pattern}"))


def bin_left(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Labels of [a, b) bins; with as many labels as edges the last bin has no upper end."""
    steps = list(zip(edges, [*edges[1:], None], labels))
    return _ladder((value >= a) if b is None else (value >= a) & (value < b) for a, b, _ in steps)([label for *_, label in steps])


def bin_right(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Labels of (a, b] bins; with as many labels as edges the last bin has no upper end."""
    steps = list(zip(edges, [*edges[1:], None], labels))
    return _ladder((value > a) if b is None else (value > a) & (value <= b) for a, b, _ in steps)([label for *_, label in steps])


def _ladder(conditions: Iterable[Column]):
    conditions = list(conditions)

    def label(labels: Sequence[str]) -> Column:
        out = F.when(conditions[0], labels[0])
        for condition, text in zip(conditions[1:], labels[1:]):
            out = out.when(condition, text)
        return out

    return label


def positive_log(value: Column) -> Column:
    return F.when(value > 0, F.ln(value))


def clip(value: Column, low: Column, high: Column) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def lookup(keys: Column, table: Mapping, default: Column | None = None) -> Column:
    """Value of a small literal map, else the default (null)."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    found = F.create_map(*pairs)[keys]
    return found if default is None else F.coalesce(found, default)


def few(df: DataFrame, most: int = 100_000) -> tuple[DataFrame, list | None]:
    """A small result as a broadcast table and its rows, at most ``most``; where there are more, as it is (the join is a shuffle then)."""
    rows = df.limit(most + 1).collect()
    return (F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows) if len(rows) <= most else (df, None)


# --- names and schemas ------------------------------------------------------


def canonical_name(name: str) -> str:
    """Raw codes like v4010 or vd4009 are upper-cased, other names stay."""
    return name.upper() if re.fullmatch(r"(?i)vd?\d+[a-z]?", name) else name


def canonicalise(df: DataFrame) -> DataFrame:
    names = [canonical_name(c) for c in df.columns]
    twice = [n for n, k in Counter(n.lower() for n in names).items() if k > 1]
    if twice:
        raise ValueError(f"columns collide after renaming: {twice}")
    return df.toDF(*names)


def rename_with_labels(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Bulk rename whatever the case; ``<raw>_label`` companions follow their column."""
    lower = {k.lower(): v for k, v in names.items()}
    out = {}
    for column in df.columns:
        base, tail = (column[:-6], "_label") if column.lower().endswith("_label") else (column, "")
        if base.lower() in lower:
            out[column] = lower[base.lower()] + tail
    return df.withColumnsRenamed(out)


def available(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """The wanted columns that exist, whatever the case, in the order asked for, once each."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*dict.fromkeys(have[w.lower()] for w in wanted if w.lower() in have))


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df


def promote(a: T.DataType, b: T.DataType) -> T.DataType:
    """string > timestamp (only with itself) > double > long."""
    ranks = []
    for kind in (a, b):
        if isinstance(kind, (T.TimestampType, T.DateType)):
            ranks.append("time")
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            ranks.append("double")
        elif isinstance(kind, (T.IntegralType, T.BooleanType)):
            ranks.append("long")
        else:
            ranks.append("string")
    if ranks[0] == ranks[1]:
        return {"time": T.TimestampType(), "double": T.DoubleType(), "long": T.LongType(), "string": T.StringType()}[ranks[0]]
    return T.StringType() if {"time", "string"} & set(ranks) else T.DoubleType()


def union_promoted(frames: Mapping[str, DataFrame], source_col: str = "source_file") -> DataFrame:
    """Union by name of waves: each column cast to the promoted type, missing ones null, and the wave's name added."""
    kinds: dict[str, T.DataType] = {}
    for df in frames.values():
        for field in df.schema.fields:
            kinds[field.name] = promote(kinds.get(field.name, field.dataType), field.dataType)
    cast = [df.select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in df.columns], F.lit(name).alias(source_col)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def first_usable(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate column that exists and holds any value: one aggregate over all of them."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    row = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in present]).first()
    return next((c for c in present if row[c]), None)


#: Suffixes of lagged and led columns, which share the labels of the column they come from.
LAGGED = ("_t1", "_t2", "_f1")
#: Entries of a dictionary that are sent to every task as one map; a larger one is joined column by column.
MOST_LABELS = 200_000


def base_name(column: str) -> str:
    return next((column[: -len(s)] for s in LAGGED if column.lower().endswith(s)), column).lower()


def code(value: Column) -> Column:
    """A code as text: numbers in one spelling (1, 1.0 and 01 are one code), other text trimmed."""
    text = F.trim(value.cast("string"))
    number = num(text)
    return F.coalesce(number.cast("string"), text)


def labels_of(df: DataFrame) -> DataFrame:
    """(nome_coluna, chave, valor) harvested from columns that have a ``<column>_label`` beside them: one pass for all columns."""
    names = {c.lower() for c in df.columns}
    bases = [c[:-6] for c in df.columns if c.lower().endswith("_label") and c[:-6].lower() in names]
    pairs = [F.struct(F.lit(b.lower()).alias("nome_coluna"), F.col(b).cast("string").alias("chave"), F.col(f"{b}_label").cast("string").alias("valor")) for b in bases]
    found = df.select(F.explode(F.array(*pairs) if pairs else F.array().cast("array<struct<nome_coluna:string,chave:string,valor:string>>")).alias("p")).select("p.*")
    return found.where("chave is not null and valor is not null").distinct()


def decode(df: DataFrame, dictionary: DataFrame, columns: Iterable[str], suffix: str = "_label", fallback: bool = False) -> DataFrame:
    """Adds ``<column><suffix>`` for all columns in one projection, from a dictionary (nome_coluna, chave, valor).

    Lagged and led columns (``LAGGED``) take the labels of their base column. Where a code has several labels the first in order
    counts; where it has none the result is null, or with ``fallback`` the code as it is. A dictionary of up to
    ``MOST_LABELS`` entries becomes one map (base name -> code -> label) in a broadcast row; counted, not guessed.
    """
    columns = list(columns)
    wanted = sorted({base_name(c) for c in columns})
    entries = dictionary.select(F.lower("nome_coluna").alias("_base"), code(F.col("chave")).alias("_code"), F.col("valor").alias("_label")).where(F.col("_base").isin(wanted))
    entries = entries.groupBy("_base", "_code").agg(F.min("_label").alias("_label")).where("_code is not null and _label is not null")
    if entries.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        by_base = entries.groupBy("_base").agg(F.map_from_entries(F.collect_list(F.struct("_code", "_label"))).alias("_map"))
        maps = by_base.agg(F.map_from_entries(F.collect_list(F.struct("_base", "_map"))).alias("_labels"))
        df = df.crossJoin(F.broadcast(maps))
        found = {c: F.try_element_at(F.try_element_at("_labels", F.lit(base_name(c))), code(F.col(c))) for c in columns}
    else:
        found = {}
        for i, c in enumerate(columns):
            own = entries.where(F.col("_base") == base_name(c)).select(F.col("_code").alias(f"_code{i}"), F.col("_label").alias(f"_label{i}"))
            df = df.join(own, code(F.col(c)) == F.col(f"_code{i}"), "left").drop(f"_code{i}")
            found[c] = F.col(f"_label{i}")
    shown = {f"{c}{suffix}": F.coalesce(v, F.col(c).cast("string")) if fallback else v for c, v in found.items()}
    return df.withColumns(shown).drop("_labels", *[f"_label{i}" for i in range(len(columns))])


def deflate(df: DataFrame, factor: str, prefixes: Sequence[str], suffix: str) -> DataFrame:
    """Adds ``<column><suffix>``, divided by the factor, for every numeric column that begins with a prefix."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name.startswith(tuple(prefixes))]
    return df.withColumns({c + suffix: F.col(c) / F.col(factor) for c in numeric})


# --- checks -----------------------------------------------------------------


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unmatched(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of ``df`` that ``other`` lacks."""
    return df.join(other, list(keys), "left_anti").select(*keys).distinct()


def many_to_one(df: DataFrame, dim: DataFrame, *keys: str, check: bool = True) -> DataFrame:
    """Left join on keys that must be unique in ``dim``, a dimension small enough to broadcast by its size."""
    if check and not duplicate_keys(dim, *keys).isEmpty():
        raise ValueError(f"keys repeat in the dimension: {keys}")
    return df.join(dim, list(keys), "left")


def matched(df: DataFrame, dim: DataFrame, *keys: str) -> tuple[DataFrame, Observation]:
    """Rows of ``df`` with their row of ``dim`` (unique keys), and an observation: ``n`` rows seen and ``n_unmatched`` dropped.

    The counts travel with the rows, in the scan that the next action makes anyway; ``get`` waits for that action.
    """
    seen = Observation()
    joined = df.join(dim.withColumn("_met", F.lit(True)), list(keys), "left")
    counted = joined.observe(seen, F.count("*").alias("n"), F.count(F.when(F.col("_met").isNull(), 1)).alias("n_unmatched"))
    return counted.where("_met").drop("_met"), seen


def gate(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Raises unless some row satisfies the condition."""
    if df.where(condition).isEmpty():
        raise ValueError(message)
    return df
