"""Operator 6: exact deduplication with a heavy-hitter split. DataFrame functions only.

1. One pass over the texts writes (id, digest) as a narrow table.
2. ``approx_top_k`` (a mergeable frequent-items sketch of the Misra-Gries family) names the digests that
   may be frequent; an exact, map-side combined count verifies them and finds the row of each that stays.
3. The verified winners are broadcast: at most ``most_winners`` rows, whatever the data. A copy of a
   winner is decided where it stands and never shuffled. All other digests are counted and joined by an ordinary
   shuffle, so that one of them, too, may hold any number of rows.

A digest that the sketch misses takes the ordinary shuffle, so results never depend on the sketch.

Defined cases: null text counts as empty; each run of the six ASCII white-space characters equals one
space; of equal texts the smallest id stays (null ids come last, and of rows with the same id exactly
one stays); an empty table gives no rows. Extra columns, of whatever name, pass through ``keep_first``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_name, small, stash

#: Digests that the sketch tracks, and so the most winners that are ever broadcast.
MOST_WINNERS = 1_000
#: A digest with fewer rows than this is grouped by the ordinary shuffle.
LEAST_ROWS = 500


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _first() -> Column:
    """The row that stays of a group: the smallest id, null ids last; of rows with one id the one written first."""
    return F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_u"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_winners: int = MOST_WINNERS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    own_name(id_col, "keep_id", "group_size", "kept", "text_sha256")
    digest = F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    # _u tells rows of one id apart, for good: it is in the written table
    rows = stash(df.select(F.col(id_col).alias("_id"), digest.alias("_d")).withColumn("_u", F.monotonically_increasing_id()), "digests")
    tracked = rows.agg(F.expr(f"approx_top_k(hex(_d), {most_winners}, {2 * most_winners})").alias("top"))
    likely = tracked.select(F.inline("top")).where(F.col("count") >= least_rows).select(F.unhex("item").alias("_d"))
    facts = (_first().alias("_keep"), F.count("*").alias("_n"))
    winners = stash(rows.join(F.broadcast(likely), "_d", "left_semi").groupBy("_d").agg(*facts).where(F.col("_n") >= least_rows), "winners")
    # what the sketch misses is counted map-side as well, and meets its count again in a join that splits hot keys
    other = rows.join(F.broadcast(winners.select("_d")), "_d", "left_anti")
    columns = [
        F.col("_id").alias(id_col),
        F.col("_keep._id").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        (F.col("_u") == F.col("_keep._u")).alias("kept"),
        F.lower(F.hex("_d")).alias("text_sha256"),
    ]
    removed = rows.join(F.broadcast(winners), "_d").select(*columns)
    return removed.unionByName(other.join(other.groupBy("_d").agg(*facts), "_d").select(*columns))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Ids name rows here; of rows that repeat an id with an equal text the one whose text, then whose whole row by its
    hash, comes first stays.
    """
    decided = groups(df, id_col, text_col)
    gone = stash(decided.groupBy(id_col, "text_sha256").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select(F.col(id_col).alias("_gone"), F.unhex("text_sha256").alias("_gone_d")), "gone")
    digest = F.unhex(F.sha2(normalised(df[text_col]).cast("binary"), 256))
    left = df.join(small(gone), df[id_col].eqNullSafe(gone["_gone"]) & (digest == gone["_gone_d"]), "left_anti")
    twice = decided.groupBy(id_col, "text_sha256").count().where("count > 1").select(F.col(id_col).alias("_gone")).limit(1)
    if twice.isEmpty():
        return left
    # repeated rows: rows travel as one value, folded map-side
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = left.select(F.col(id_col).alias("_id"), digest.alias("_d"), F.struct(F.col(text_col).alias("_t"), F.xxhash64(F.to_json(whole)).alias("_h")).alias("_o"), whole.alias("_row"))
    return rows.groupBy("_id", "_d").agg(F.min_by("_row", "_o").alias("_row")).select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])
