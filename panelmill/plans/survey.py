"""Weighted statistics. Analog: lineitem with weight l_quantity and value l_extendedprice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import profiles as pr, weighted as wt
from .base import big, r, table, year

S, D = SparkSession, DataFrame
KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
PS = (0.1, 0.5, 0.9)


def _items(s: S, d: str) -> D:
    return table(s, d, "lineitem").select(*KEY, year("l_shipdate").alias("y"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("w"), "l_returnflag", "l_discount", "l_tax")


@query("""select year(l_shipdate)::bigint y, round(sum(l_quantity * (l_returnflag = 'R')::int) / sum(l_quantity), 6) "value", count(*) n, sum(l_quantity) sum_w from lineitem where l_quantity > 0 and l_quantity <> 50 group by 1""")
def weighted_share_by_year(s: S, d: str) -> D:
    rows = _items(s, d).withColumns({"f": (F.col("l_returnflag") == "R").cast("double"), "w": F.nullif(F.col("w"), F.lit(50.0))})
    return wt.mean_by(rows, "f", "w", "y").select("y", r(F.col("value")).alias("value"), "n", "sum_w")


@query("""select year(l_shipdate)::bigint y, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) "value", count(*) n, sum(l_quantity) sum_w from lineitem where l_linenumber <> 7 group by 1""")
def weighted_mean_by_year(s: S, d: str) -> D:
    rows = _items(s, d).withColumn("x", F.when(F.col("l_linenumber") != 7, F.col("x")))
    return wt.mean_by(rows, "x", "w", "y").select("y", r(F.col("value"), 4).alias("value"), "n", "sum_w")


MID = """a as (select {by}, l_extendedprice x, l_quantity w, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem),
c as (select {key}, x, w, l_orderkey, l_linenumber, l_partkey, l_suppkey, (sum(w) over (v rows unbounded preceding) - 0.5 * w) / sum(w) over (partition by {key}) m from a window v as (partition by {key} order by x, w, l_orderkey, l_linenumber, l_partkey, l_suppkey)),
e as (select *, lead(x) over v x2, lead(m) over v m2 from c window v as (partition by {key} order by x, w, l_orderkey, l_linenumber, l_partkey, l_suppkey))"""


def _mid(p: float) -> str:
    return f"coalesce(min(case when m <= {p} and m2 > {p} then x + (x2 - x) * ({p} - m) / (m2 - m) end), case when min(m) > {p} then min(x) else max(x) end)"


@query("with " + MID.format(by="year(l_shipdate)::bigint y", key="y") + "select y, " + ", ".join(f"round({_mid(p)}, 4) q{i}" for i, p in enumerate(PS)) + " from e group by 1")
def wquantile_mid(s: S, d: str) -> D:
    return wt.quantile_midpoint(_items(s, d), "x", "w", PS, "y").select("y", *[r(F.col(f"q{i}"), 4).alias(f"q{i}") for i in range(3)])


CUM = """a as (select year(l_shipdate)::bigint y, l_extendedprice x, sum({w}) w from lineitem group by 1,2), c as (select *, sum(w) over (partition by y order by x rows unbounded preceding) cw, sum(w) over (partition by y) tot, lead(x) over (partition by y order by x) x2 from a)"""


@query("with " + CUM.format(w="l_quantity") + "select y, " + ", ".join(f"min(case when cw >= {p} * tot then x end) q{i}" for i, p in enumerate(PS)) + " from c group by 1")
def wquantile_cumge(s: S, d: str) -> D:
    return wt.quantile_reach(_items(s, d), "x", "w", PS, "y")


def _over(p: float) -> str:
    return f"coalesce(min(case when abs(cw - {p} * tot) <= 1e-9 * cw then (x + x2) / 2 end), min(case when cw > {p} * tot and abs(cw - {p} * tot) > 1e-9 * cw then x end))"


@query("with " + CUM.format(w="l_quantity") + "select y, " + ", ".join(f"round({_over(p)}, 4) q{i}" for i, p in enumerate(PS)) + " from c group by 1")
def wquantile_stata(s: S, d: str) -> D:
    return wt.quantile_exceed(_items(s, d), "x", "w", PS, "y").select("y", *[r(F.col(f"q{i}"), 4).alias(f"q{i}") for i in range(3)])


@query("with " + CUM.format(w="1") + f"select y, round({_over(0.01)}, 4) p1, round({_over(0.99)}, 4) p99 from c group by 1")
def quantile_stata_unweighted(s: S, d: str) -> D:
    out = wt.quantile_exceed(_items(s, d).withColumn("one", F.lit(1)), "x", "one", (0.01, 0.99), "y")
    return out.select("y", r(F.col("q0"), 4).alias("p1"), r(F.col("q1"), 4).alias("p99"))


@query("""with a as (select l_returnflag g, count(*) n, sum(l_quantity) sw, sum(l_quantity * l_quantity) sw2, sum(l_quantity * l_discount) swx, sum(l_quantity * l_discount * l_discount) swxx from lineitem group by 1),
b as (select g, n, swx / sw m, sqrt(greatest(swxx / sw - (swx / sw) * (swx / sw), 0)) sd, sw * sw / sw2 ne from a)
select g, n, round(m, 6) mean, round(sd, 6) sd, round(ne, 4) n_eff, round(m - 1.96 * sd / sqrt(ne), 6) lo, round(m + 1.96 * sd / sqrt(ne), 6) hi from b""")
def weighted_ci(s: S, d: str) -> D:
    rows = _items(s, d).withColumnRenamed("l_returnflag", "g")
    out = wt.mean_ci(rows, "l_discount", "w", "g")
    return out.select("g", "n", r(F.col("mean")).alias("mean"), r(F.col("sd")).alias("sd"), r(F.col("n_eff"), 4).alias("n_eff"), r(F.col("lo")).alias("lo"), r(F.col("hi")).alias("hi"))


@query("select round(sum(l_quantity * (1 + l_tax)) / sum(l_quantity), 6) factor from lineitem where year(l_shipdate) = 1999")
def price_factor(s: S, d: str) -> D:
    rows = _items(s, d).where("y = 1999").withColumn("real", F.col("x") / (1 + F.col("l_tax")))
    return wt.price_factor(rows, "x", "real", "w").select(r(F.col("factor")).alias("factor"))


@query("""with a as (select p_partkey, p_size::int age, p_retailprice x, l_quantity w from lineitem join part on l_partkey = p_partkey), g as (select unnest(range(5, 46)) age)
select g.age::bigint age, count(*) n, round(sum(w * x) / sum(w), 4) mean_window from g join a on abs(a.age - g.age) <= 2 group by 1""")
def age_window_profile(s: S, d: str) -> D:
    """Rows within two years of each target age: exploded to targets, so the band join is an equi-aggregation."""
    rows = table(s, d, "lineitem").select("l_partkey", F.col("l_quantity").alias("w")).join(table(s, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("x")), F.col("l_partkey") == F.col("p_partkey"))
    # sums per own age first: at most one row an age goes through the explode
    by = rows.groupBy("p_size").agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("swx"))
    out = pr.explode_band(by, "p_size", 2, 5, 45, "age").groupBy(big("age").alias("age")).agg(F.sum("n").alias("n"), (F.sum("swx") / F.sum("sw")).alias("m"))
    return out.select("age", "n", r(F.col("m"), 4).alias("mean_window"))


# --- winsorising ----------------------------------------------------------------


@query("""with q as (select year(o_orderdate) y, quantile_cont(o_totalprice, 0.01) lo, quantile_cont(o_totalprice, 0.99) hi from orders group by 1)
select o_orderkey, round(least(greatest(o_totalprice, lo), hi), 4) w from orders join q on y = year(o_orderdate)""")
def winsor_by_group(s: S, d: str) -> D:
    rows = table(s, d, "orders").select("o_orderkey", year("o_orderdate").alias("y"), F.col("o_totalprice").alias("x"))
    return wt.winsorise(rows, "x", 0.01, 0.99, "y").select("o_orderkey", r(F.col("x"), 4).alias("w"))


@query("""with q as (select year(o_orderdate) y, quantile_cont(o_totalprice, 0.01) lo, quantile_cont(o_totalprice, 0.99) hi from orders group by 1),
a as (select o_orderkey, least(greatest(o_totalprice, lo), hi) w from orders join q on y = year(o_orderdate)), p as (select quantile_cont(w, 0.01) lo, quantile_cont(w, 0.99) hi from a)
select o_orderkey, round(least(greatest(w, lo), hi), 4) w from a, p""")
def winsor_two_stage(s: S, d: str) -> D:
    rows = table(s, d, "orders").select("o_orderkey", year("o_orderdate").alias("y"), F.col("o_totalprice").alias("x"))
    return wt.winsorise(wt.winsorise(rows, "x", 0.01, 0.99, "y"), "x", 0.01, 0.99).select("o_orderkey", r(F.col("x"), 4).alias("w"))


@query("with " + MID.format(by="year(l_shipdate)::bigint y", key="y") + f", q as (select y, {_mid(0.01)} lo, {_mid(0.99)} hi from e group by 1) select a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, round(least(greatest(x, lo), hi), 4) x from a join q on a.y = q.y")
def winsor_weighted(s: S, d: str) -> D:
    return wt.winsorise_weighted(_items(s, d), "x", "w", 0.01, 0.99, "y").select(*KEY, r(F.col("x"), 4).alias("x"))


@query("""with m as (select min(l_extendedprice) low, max(l_extendedprice) high, sum(l_quantity) sw, sum(l_quantity * l_quantity) sw2, sum(l_quantity * l_extendedprice) / sum(l_quantity) mean from lineitem),
v as (select low, high, sw, sqrt(sum(l_quantity * pow(l_extendedprice - mean, 2)) / sw / (1 - sw2 / (sw * sw))) * pow(sw * sw / sw2, -0.2) h from lineitem, m group by low, high, sw, sw2),
g as (select low + k * ((high - low) / 511) x, h, sw from v, (select unnest(range(0, 512)) k))
select round(x, 4) x, round(sum(l_quantity * exp(-0.5 * pow((x - l_extendedprice) / h, 2))) / (sw * sqrt(2 * pi()) * h), 12) density from lineitem, g group by x, sw, h""")
def kde_grid(s: S, d: str) -> D:
    """Weighted density of prices at 512 points, with a bandwidth from the data."""
    return pr.gaussian_density(_items(s, d), "x", "w").select(r(F.col("x"), 4).alias("x"), r(F.col("density"), 12).alias("density"))
