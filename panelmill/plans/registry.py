"""Registry filters, regional shares, layout. Analog: lineitem as job spells, supplier -> nation -> region as places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import wkt
from ..operators import clean, registry as rg
from .base import big, r, table

S, D = SparkSession, DataFrame


def _jobs(s: S, d: str) -> D:
    """Job spells: degree, hours (50 stands for unknown), legal code, activity, place."""
    part = table(s, d, "part").select("p_partkey", F.col("p_size").alias("legal"))
    rows = table(s, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_linenumber").alias("degree"), F.col("l_quantity").alias("hours"), (F.col("l_linestatus") == "F").alias("active"))
    return rows.join(part, F.col("l_partkey") == F.col("p_partkey"))


def _steps() -> dict[str, Column]:
    return {
        "degree": F.col("degree").isin(5, 6, 7),
        "full_time": (F.col("hours") >= 36) & (F.col("hours") != 50),
        "legal": F.col("legal") != 49,
        "active": F.col("active"),
        "place": F.col("l_suppkey") % 10 != 0,
    }


JOBS = "jobs as (select l_suppkey, l_linenumber in (5,6,7) c1, l_quantity >= 36 and l_quantity <> 50 c2, p_size <> 49 c3, l_linestatus = 'F' c4, l_suppkey % 10 <> 0 c5, p_size legal from lineitem join part on l_partkey = p_partkey)"
KEPT = f"{JOBS}, kept as (select * from jobs where c1 and c2 and c3 and c4 and c5)"
REGION = f"""{KEPT}, placed as (select n_regionkey k, (legal <= 20 or legal in (30, 41))::int pub from kept join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"""


@query(f"with {KEPT} select l_suppkey, legal, count(*) n from kept group by 1,2")
def registry_filters(s: S, d: str) -> D:
    return rg.apply_filters(_jobs(s, d), _steps()).groupBy("l_suppkey", "legal").agg(F.count("*").alias("n"))


@query(f"""with {JOBS}, a as (select count(*) n0, sum(c1::int) n1, sum((c1 and c2)::int) n2, sum((c1 and c2 and c3)::int) n3, sum((c1 and c2 and c3 and c4)::int) n4, sum((c1 and c2 and c3 and c4 and c5)::int) n5 from jobs)
select unnest([0,1,2,3,4,5])::bigint step, unnest(['read','degree','full_time','legal','active','place']) name, unnest([n0,n1,n2,n3,n4,n5])::bigint n from a""")
def filter_funnel(s: S, d: str) -> D:
    return rg.funnel(_jobs(s, d), _steps())


def _regions(s: S, d: str) -> D:
    jobs = rg.apply_filters(_jobs(s, d), _steps())
    place = table(s, d, "supplier").select("s_suppkey", "s_nationkey").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("k"))
    public = rg.is_public(F.col("legal"), 20, (30, 41))
    return jobs.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select("k", public.alias("pub"))


@query(f"""with {REGION} select r_name, count(*) n, sum(pub)::bigint n_public, (count(*) - sum(pub))::bigint n_private, round(avg(pub), 6) share_public from placed join region on k = r_regionkey group by 1""")
def region_shares(s: S, d: str) -> D:
    by = rg.shares_by(_regions(s, d), "k", "pub").join(table(s, d, "region"), F.col("k") == F.col("r_regionkey"))
    return by.select("r_name", "n", "n_public", "n_private", r(F.col("share_public")).alias("share_public"))


@query(f"""with {REGION} select k, count(*) n, sum(pub)::bigint n_public, round(sum(pub) / count(*), 6) share_public from placed group by grouping sets ((k), ())""")
def region_shares_total(s: S, d: str) -> D:
    """Regions and their total in one pass; the total is a ratio of sums, not a mean of shares."""
    by = rg.shares_by(_regions(s, d), "k", "pub", total=True)
    return by.select("k", "n", "n_public", r(F.col("share_public")).alias("share_public"))


@query(f"""with {KEPT} select l_suppkey, count(*) n from kept group by 1 having count(*) >= 25""")
def suppress_small(s: S, d: str) -> D:
    return rg.apply_filters(_jobs(s, d), _steps()).groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n >= 25")


@query(f"""with {REGION}, a as (select r_name, count(*) n, avg(pub) x from placed join region on k = r_regionkey group by 1) select r_name, n, round(x, 6) share_public, row_number() over (order by x desc, r_name)::bigint pos from a""")
def region_rank(s: S, d: str) -> D:
    by = rg.shares_by(_regions(s, d), "k", "pub").join(table(s, d, "region"), F.col("k") == F.col("r_regionkey"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("share_public"), "r_name")  # a row a region
    return by.select("r_name", "n", r(F.col("share_public")).alias("share_public"), big(F.row_number().over(order)).alias("pos"))


@query("""with a as (select n_nationkey k, (n_nationkey * 7) % 25 lon, (n_nationkey * 11) % 25 lat from nation), b as (select *, row_number() over (order by case when k = 3 then 99 else lon end, lat, k) i, count(*) over () c from a)
select k, case when i <= ceil(c / 2.0) then 0 else 1 end col, row_number() over (partition by i <= ceil(c / 2.0) order by lat desc, k)::bigint pos from b""")
def layout_columns(s: S, d: str) -> D:
    """Rows dealt to two balanced columns, west and east (with one override), north first in each: 25 rows."""
    rows = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), ((F.col("n_nationkey") * 7) % 25).alias("lon"), ((F.col("n_nationkey") * 11) % 25).alias("lat"))
    return rg.two_columns(rows, "k", "lon", "lat", {3: 99}).select("k", "col", big("pos").alias("pos"))


@query("select count(*) n from part where p_size < 10 having count(*) > 0")
def sanity_gate(s: S, d: str) -> D:
    rows = table(s, d, "part")
    clean.gate(rows, F.col("p_size") < 10, "no row of the kind that must be there: the extract is damaged")
    return rows.where("p_size < 10").agg(F.count("*").alias("n"))


@query("""select p_partkey, 2 n_rings, round(p_size * p_retailprice, 6) area, round(p_partkey + p_size / 2, 6) x, round(p_retailprice / 2, 6) y from part""")
def wkt_centroid(s: S, d: str) -> D:
    """Rings and centroid of polygon texts, a place a part: a rectangle by size and price, and a smaller island that does not count."""
    a, b, h = F.col("p_partkey"), F.col("p_partkey") + F.col("p_size"), F.col("p_retailprice")
    text = F.format_string("MULTIPOLYGON (((%s 0, %s 0, %s %s, %s %s, %s 0)), ((-9 -9, -8 -9, -8 -8, -9 -9)))", *[c.cast("string") for c in (a, b, b, h, a, h, a)])
    rows = table(s, d, "part").select("p_partkey", text.alias("wkt"))
    # a file of a few MB is one task, and each of its rows takes long
    rows = rows.repartition(-(-rows.count() // 50_000) or 1, "p_partkey").withColumn("c", wkt.measured(F.col("wkt")))
    return rows.select("p_partkey", "c.n_rings", r(F.col("c.area")).alias("area"), r(F.col("c.x")).alias("x"), r(F.col("c.y")).alias("y"))
