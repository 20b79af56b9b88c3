"""Text functions over document prefixes' own rows, and small parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as tx
from .base import table

S, D = SparkSession, DataFrame


@query("select doc_id, md5(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) h from documents")
def normalize_text(s: S, d: str) -> D:
    return table(s, d, "documents").select("doc_id", F.md5(tx.normalise(F.col("text"))).alias("h"))


@query("select doc_id, md5(strip_accents(text)) h from documents")
def strip_accents(s: S, d: str) -> D:
    return table(s, d, "documents").select("doc_id", F.md5(tx.strip_accents(F.col("text"))).alias("h"))


@query("select doc_id, md5(text) h from documents")
def mojibake_repair(s: S, d: str) -> D:
    """Two texts in three are broken first (UTF-8 bytes read as Latin-1); repaired, all are whole again, and the sound ones untouched."""
    broken = F.when(F.col("doc_id") % 3 != 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.md5(tx.repair_mojibake(broken)).alias("h"))


@query("""select n_nationkey, replace(replace(replace(n_name, 'NATION_1', 'First '), 'NATION_2', 'Second '), 'NATION', 'Other') shown from nation""")
def replace_longest_first(s: S, d: str) -> D:
    return table(s, d, "nation").select("n_nationkey", tx.replace_all(F.col("n_name"), {"NATION": "Other", "NATION_1": "First ", "NATION_2": "Second "}).alias("shown"))


@query("""with a as (select o_custkey k, min(year(o_orderdate))::int lo, max(year(o_orderdate))::int hi from orders group by 1) select distinct k, unnest([lo, lo + 1, hi])::int y from a""")
def year_ranges(s: S, d: str) -> D:
    """Each customer's years by a text such as ``1995-1996, 2000,``: the first two and the last one."""
    year = F.year("o_orderdate")
    spec = F.concat(F.min(year), F.lit("-"), F.min(year) + 1, F.lit(", "), F.max(year), F.lit(","))
    by = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(spec.alias("spec"))
    return by.select("k", F.explode(tx.year_list(F.col("spec"))).alias("y"))
