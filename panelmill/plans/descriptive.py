"""Shares, summaries, percentiles, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import clean, profiles as pr, weighted as wt
from .base import big, r, table, year

S, D = SparkSession, DataFrame


@query("select c_mktsegment g, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from customer group by 1")
def category_shares(s: S, d: str) -> D:
    return pr.shares(table(s, d, "customer").select(F.col("c_mktsegment").alias("g")), "g").select("g", "n", r(F.col("share")).alias("share"))


@query("select nullif(c_mktsegment, 'BUILDING') g, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from customer group by 1")
def category_shares_null(s: S, d: str) -> D:
    return pr.shares(table(s, d, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("g")), "g", nulls=True).select("g", "n", r(F.col("share")).alias("share"))


@query("""with a as (select unnest(['l_returnflag','l_linestatus','l_linenumber']) variable, unnest([l_returnflag, l_linestatus, l_linenumber::varchar]) v from lineitem)
select variable, v "value", count(*) n, round(count(*) / sum(count(*)) over (partition by variable), 6) share from a group by 1,2""")
def profile_stack(s: S, d: str) -> D:
    return pr.stacked_shares(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]).select("variable", "value", "n", r(F.col("share")).alias("share"))


SUMMARY = "count(x) n, round(avg(x), 4) mean, round(quantile_cont(x, 0.5), 4) median, round(quantile_cont(x, 0.25), 4) p25, round(quantile_cont(x, 0.75), 4) p75"


@query(f"""with a as (select o_totalprice x, unnest(case when o_orderpriority = '1-URGENT' then ['all','urgent'] else ['all'] end) g from orders) select g, {SUMMARY} from a group by 1""")
def group_vs_all_summary(s: S, d: str) -> D:
    """A group beside everybody: one pass over overlapping groups."""
    rows = table(s, d, "orders").select(F.col("o_totalprice").alias("x"), "o_orderpriority")
    tagged = wt.overlapping(rows, {"all": F.lit(True), "urgent": F.col("o_orderpriority") == "1-URGENT"}, "g")
    out = wt.beside(tagged.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("mean")), wt.quantile_linear(tagged, "x", (0.25, 0.5, 0.75), "g"), "g")
    return out.select("g", "n", *[r(F.col(c), 4).alias(n) for c, n in (("mean", "mean"), ("q1", "median"), ("q0", "p25"), ("q2", "p75"))])


@query("select count(*) n, round(avg(l_extendedprice), 4) mean, round(median(l_extendedprice), 4) median, round(stddev_samp(l_extendedprice), 4) sd, min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem")
def describe_numeric(s: S, d: str) -> D:
    x = F.col("l_extendedprice")
    rows = table(s, d, "lineitem")
    stats = rows.agg(F.count("*").alias("n"), r(F.avg(x), 4).alias("mean"), r(F.stddev_samp(x), 4).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    return wt.beside(stats, wt.quantile_linear(rows, "l_extendedprice", [0.5])).select("n", "mean", r(F.col("q0"), 4).alias("median"), "sd", "lo", "hi")


@query("select l_returnflag g, round(avg(l_extendedprice), 4) mean_x, round(median(l_extendedprice), 4) median_x, round(avg(l_quantity), 6) mean_q, count(*) n from lineitem group by 1")
def sector_stats(s: S, d: str) -> D:
    x = F.col("l_extendedprice")
    rows = table(s, d, "lineitem").withColumnRenamed("l_returnflag", "g")
    stats = rows.groupBy("g").agg(r(F.avg(x), 4).alias("mean_x"), r(F.avg("l_quantity")).alias("mean_q"), F.count("*").alias("n"))
    return wt.beside(stats, wt.quantile_linear(rows, "l_extendedprice", [0.5], "g"), "g").select("g", "mean_x", r(F.col("q0"), 4).alias("median_x"), "mean_q", "n")


@query("""select year(o_orderdate)::bigint y, round(median(o_totalprice) filter (o_orderstatus = 'P'), 4) pub, round(median(o_totalprice) filter (o_orderstatus = 'F'), 4) priv,
round(median(o_totalprice) filter (o_orderstatus = 'P') / median(o_totalprice) filter (o_orderstatus = 'F') - 1, 6) premium from orders group by 1""")
def median_premium(s: S, d: str) -> D:
    rows = table(s, d, "orders").select(year("o_orderdate").alias("y"), "o_orderstatus", "o_totalprice")
    medians = wt.quantile_linear(rows.where("o_orderstatus in ('P', 'F')"), "o_totalprice", [0.5], "y", "o_orderstatus")
    rows = rows.select("y").distinct().join(medians, "y", "left").groupBy("y").pivot("o_orderstatus", ["P", "F"]).agg(F.first("q0"))
    return rows.select("y", r(F.col("P"), 4).alias("pub"), r(F.col("F"), 4).alias("priv"), r(F.col("P") / F.col("F") - 1).alias("premium"))


@query("""select year(o_orderdate)::bigint y, quarter(o_orderdate)::bigint q, count(*) n, round(quantile_cont(o_totalprice, 0.1), 4) p10, round(quantile_cont(o_totalprice, 0.5), 4) p50, round(quantile_cont(o_totalprice, 0.9), 4) p90, round(quantile_cont(o_totalprice, 0.999), 4) p999
from orders where o_totalprice > 0 group by 1,2""")
def percentiles_by_period(s: S, d: str) -> D:
    rows = table(s, d, "orders").where("o_totalprice > 0").select(year("o_orderdate").alias("y"), big(F.quarter("o_orderdate")).alias("q"), "o_totalprice")
    out = wt.beside(rows.groupBy("y", "q").agg(F.count("*").alias("n")), wt.quantile_linear(rows, "o_totalprice", (0.1, 0.5, 0.9, 0.999), "y", "q"), "y", "q")
    return out.select("y", "q", "n", *[r(F.col(f"q{i}"), 4).alias(n) for i, n in enumerate(("p10", "p50", "p90", "p999"))])


@query("select count(*) n_rows, count(distinct o_custkey)::bigint n_people, count(distinct (o_custkey, o_orderstatus))::bigint n_pairs, round(count(*) / count(distinct o_custkey), 6) per_person from orders")
def distinct_people(s: S, d: str) -> D:
    people = F.countDistinct("o_custkey")
    return table(s, d, "orders").agg(F.count("*").alias("n_rows"), people.alias("n_people"), F.countDistinct(F.struct("o_custkey", "o_orderstatus")).alias("n_pairs"), r(F.count("*") / people).alias("per_person"))


@query("""with a as (select year(o_orderdate)::bigint y, count(distinct quarter(o_orderdate)) k from orders group by 1) select max(y) filter (k = 4) latest, sum(k)::bigint n_quarters from a""")
def latest_complete_year(s: S, d: str) -> D:
    by = table(s, d, "orders").groupBy(year("o_orderdate").alias("y")).agg(F.countDistinct(F.quarter("o_orderdate")).alias("k"))
    return by.agg(F.max(F.when(F.col("k") == 4, F.col("y"))).alias("latest"), F.sum("k").alias("n_quarters"))


@query("""with a as (select o_totalprice x from orders), q as (select quantile_cont(x, 0.05) lo, quantile_cont(x, 0.95) hi from a)
select o_orderkey, round((least(greatest(o_totalprice, lo), hi) - lo) / (hi - lo), 6) v from orders, q""")
def percentile_clip_norm(s: S, d: str) -> D:
    rows = table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    q = wt.quantile_linear(rows, "x", (0.05, 0.95))
    low, high = F.col("q0"), F.col("q1")
    return rows.crossJoin(F.broadcast(q)).select("o_orderkey", r((clean.clip(F.col("x"), low, high) - low) / (high - low)).alias("v"))


@query("""with a as (select l_quantity q, unnest(list_filter(['all', case when l_returnflag = 'R' then 'returned' end, case when l_quantity > 25 then 'large' end], lambda x: x is not null)) g from lineitem) select g, count(*) n, round(avg(q), 6) mean from a group by 1""")
def overlapping_groups(s: S, d: str) -> D:
    rows = wt.overlapping(table(s, d, "lineitem"), {"all": F.lit(True), "returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") > 25}, "g")
    return rows.groupBy("g").agg(F.count("*").alias("n"), r(F.avg("l_quantity")).alias("mean"))


EDGES = "[" + ", ".join(f"quantile_cont(o_totalprice, {k / 20})" for k in range(21)) + "]"


@query(f"""with e as (select list_sort(list_distinct({EDGES})) q from orders), b as (select o_totalprice x, q, greatest(1, len(list_filter(q, lambda v: v < o_totalprice))) k from orders, e)
select k::bigint bin, round(q[k], 4) lo, round(q[k+1], 4) hi, round((q[k] + q[k+1]) / 2, 4) mid, round(avg(x), 4) mean, count(*) n from b group by k, q""")
def qcut_bin_stats(s: S, d: str) -> D:
    """Twenty quantile bins, equal edges dropped; a value belongs to the bin whose upper edge it does not exceed."""
    rows = table(s, d, "orders").select(F.col("o_totalprice").alias("x"))
    edges = wt.quantile_linear(rows, "x", [k / 20 for k in range(21)]).select(F.array_sort(F.array_distinct(F.array(*[f"q{k}" for k in range(21)]))).alias("q"))
    k = F.greatest(F.lit(1), F.size(F.filter("q", lambda v: v < F.col("x"))))
    lo, hi = F.element_at("q", F.col("k")), F.element_at("q", F.col("k") + 1)
    return rows.crossJoin(F.broadcast(edges)).groupBy(k.alias("k"), "q").agg(F.avg("x").alias("m"), F.count("*").alias("n")).select(big("k").alias("bin"), r(lo, 4).alias("lo"), r(hi, 4).alias("hi"), r((lo + hi) / 2, 4).alias("mid"), r(F.col("m"), 4).alias("mean"), "n")


@query("""with b as (select least(floor((least(greatest(l_extendedprice, 1000), 90000) - 1000) / 4450), 19)::int bin from lineitem) select bin, count(*) n, round(count(*) / (sum(count(*)) over () * 4450), 9) density from b group by 1""")
def hist_density(s: S, d: str) -> D:
    return pr.histogram(table(s, d, "lineitem"), "l_extendedprice", 1000.0, 90000.0, 20).select("bin", "n", r(F.col("density"), 9).alias("density"))


@query("select nullif(l_returnflag, 'N') a, l_linestatus b, count(*) n from lineitem group by 1,2")
def crosstab_with_missing(s: S, d: str) -> D:
    return table(s, d, "lineitem").groupBy(F.nullif("l_returnflag", F.lit("N")).alias("a"), F.col("l_linestatus").alias("b")).agg(F.count("*").alias("n"))


@query("""with q as (select c_mktsegment g, quantile_cont(c_acctbal, 0.25) q1, median(c_acctbal) q2, quantile_cont(c_acctbal, 0.75) q3 from customer group by 1)
select g, round(q1, 4) q1, round(q2, 4) q2, round(q3, 4) q3, min(c_acctbal) filter (c_acctbal >= q1 - 1.5 * (q3 - q1)) lo, max(c_acctbal) filter (c_acctbal <= q3 + 1.5 * (q3 - q1)) hi from customer join q on c_mktsegment = g group by 1, q1, q2, q3""")
def box_summary(s: S, d: str) -> D:
    rows = table(s, d, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("x"))
    q = wt.quantile_linear(rows, "x", (0.25, 0.5, 0.75), "g").select("g", F.array("q0", "q1", "q2").alias("q"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    out = rows.join(q, "g").groupBy("g", "q").agg(F.min(F.when(F.col("x") >= F.col("q")[0] - reach, F.col("x"))).alias("lo"), F.max(F.when(F.col("x") <= F.col("q")[2] + reach, F.col("x"))).alias("hi"))
    return out.select("g", *[r(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)], "lo", "hi")


@query("""with a as (select c_nationkey k, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'low' else 'high' end band, greatest(c_acctbal, 0) w from customer)
select band, r_name region, count(*) n, round(100 * sum(w) / sum(sum(w)) over (), 6) pct from a join nation on k = n_nationkey join region on n_regionkey = r_regionkey group by 1,2""")
def weighted_composition(s: S, d: str) -> D:
    rows = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    by = rows.groupBy(band.alias("band"), F.col("r_name").alias("region")).agg(F.count("*").alias("n"), F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("w"))
    return by.select("band", "region", "n", r(100 * F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0)))).alias("pct"))
