"""What the query modules share: tables, the person x quarter panel, and the panel's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer x quarter: state of the last order, wage (sum of prices), number of orders."""
    rows = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("bigint").alias("y"), F.quarter("o_orderdate").cast("bigint").alias("q")
    ).agg(F.max_by("o_orderstatus", "o_orderkey").alias("st"), F.round(F.sum("o_totalprice"), 2).alias("w"), F.count("*").alias("n"))
    return rows.withColumn("t", F.col("y") * 4 + F.col("q"))


#: The same as a common table expression.
PANEL = """panel as (
  select o_custkey id, year(o_orderdate)::bigint y, quarter(o_orderdate)::bigint q,
         (year(o_orderdate)*4 + quarter(o_orderdate))::bigint t,
         max_by(o_orderstatus, o_orderkey) st, round(sum(o_totalprice), 2) w, count(*) n
  from orders group by all)"""

STATES = ("F", "O", "P")


def r(value: Column, digits: int = 6) -> Column:
    return F.round(value, digits)


def r_double(value: Column, digits: int = 6) -> Column:
    """A double rounded by its binary product with a power of ten, as DuckDB does; ``r`` goes by its shortest decimal."""
    return F.round(value * F.lit(10.0**digits)) / F.lit(10.0**digits)


def big(value: str | Column) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("bigint")


def year(column: str) -> Column:
    return big(F.year(column))
