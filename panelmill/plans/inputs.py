"""Inputs and outputs: headers, yearly files, a warehouse, extracts by part, reports. All files are written here from the given tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import clean, profiles as pr, weighted as wt
from ..sources import readers, sinks
from .base import big, r, table, year

S, D = SparkSession, DataFrame


def _folder(s: S, name: str) -> str:
    return readers.scratch(s, f"{name}-{uuid.uuid4().hex}")


# --- headers --------------------------------------------------------------------


@query("""select cid::bigint pos, name from pragma_table_info('supplier')""")
def csv_header(s: S, d: str) -> D:
    path = _folder(s, "header")
    sinks.write_once(table(s, d, "supplier"), path, kind="csv")
    return s.createDataFrame(list(enumerate(readers.header(s, path, "csv"))), "pos long, name string")


@query("""select cid::bigint pos, name from pragma_table_info('lineitem')""")
def parquet_header(s: S, d: str) -> D:
    return s.createDataFrame(list(enumerate(readers.header(s, f"{d}/lineitem.parquet", "parquet"))), "pos long, name string")


@query("select c_custkey, c_name, c_acctbal, null::bigint absent from customer")
def bom_csv(s: S, d: str) -> D:
    """A CSV whose first name has a byte order mark before it, columns in another order, read by name."""
    rows, path = table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), _folder(s, "bom")
    rows.toDF("﻿C_CUSTKEY", "c_name", "c_acctbal", "c_mktsegment").write.option("header", True).csv(path)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    wanted = s.createDataFrame([], f"c_custkey {kinds['c_custkey']}, c_name string, c_acctbal {kinds['c_acctbal']}, absent long").schema
    return readers.read_csv(s, path, wanted)


@query("select c_custkey::bigint V1010, c_nationkey::bigint VD2, c_mktsegment valor from customer")
def canonical_names(s: S, d: str) -> D:
    return clean.canonicalise(table(s, d, "customer").select(big("c_custkey").alias("v1010"), big("c_nationkey").alias("Vd2"), F.col("c_mktsegment").alias("valor")))


# --- yearly inputs -----------------------------------------------------------------


def _yearly(s: S, d: str, folder: str) -> None:
    """Orders of three years: two tables, a CSV, and beside them a table and a CSV of one year and a sample."""
    orders = table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), "o_totalprice")
    for y, kind in ((1996, "parquet"), (1997, "csv"), (1998, "parquet"), (1998, "csv")):
        sinks.write_once(orders.where(F.col("y") == y).drop("y"), f"{folder}/orders_{y}.{kind}", kind=kind)
    sinks.write_once(orders.where("y = 1999").drop("y"), f"{folder}/orders_sample_1999.csv", kind="csv")


@query("""select year(o_orderdate)::bigint y, case year(o_orderdate) when 1997 then 'csv' else 'parquet' end kind, count(*) n, round(sum(o_totalprice), 2) total from orders where year(o_orderdate) between 1996 and 1998 group by 1, 2""")
def yearly_inputs(s: S, d: str) -> D:
    """Each year's preferred input, found by name; the year comes from the name of the file that a row is in."""
    folder = _folder(s, "yearly")
    _yearly(s, d, folder)
    parts = []
    for path in readers.discover(s, folder, "orders", [1996, 1997, 1998]).values():
        kind = path.rsplit(".", 1)[1]
        rows = s.read.parquet(path) if kind == "parquet" else readers.read_text_columns(s, path)
        named = rows.withColumn("y", F.regexp_extract("_metadata.file_path", r"_(20\d{2}|19\d{2})\.\w+/", 1).try_cast("long"))
        parts.append(named.select("y", F.lit(kind).alias("kind"), clean.num("o_totalprice").alias("x")))
    return _union(parts).groupBy("y", "kind").agg(F.count("*").alias("n"), r(F.sum("x"), 2).alias("total"))


def _union(parts: list[D]) -> D:
    return reduce(DataFrame.unionByName, parts)


@query("""select y::bigint y, coalesce(n, 0)::bigint n, n is null missing from (select unnest(range(1990, 2003)) y) left join (select year(o_orderdate) y, count(*) n from orders group by 1) using (y)""")
def coverage_gaps(s: S, d: str) -> D:
    """Expected years against the years there are."""
    there = table(s, d, "orders").groupBy(year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return pr.coverage(s.range(1990, 2003).select(F.col("id").alias("y")), there, "y")


@query("""select * from (values ('empty', 'empty', 0), ('good', 'usable', (select count(*)::bigint from nation)), ('lacking', 'lacks [''n_name'']', 0), ('missing', 'missing', 0)) t(part, status, n)""")
def usable_inputs(s: S, d: str) -> D:
    """Of four files of states one is good: the others are left out, each with its reason."""
    folder, rows = _folder(s, "states"), table(s, d, "nation").select("n_nationkey", "n_name")
    rows.write.option("header", True).csv(f"{folder}/good")
    rows.select("n_nationkey").write.option("header", True).csv(f"{folder}/lacking")
    rows.where("false").coalesce(1).write.option("header", False).csv(f"{folder}/empty")
    names = ["good", "lacking", "empty", "missing"]
    good, bad = readers.usable_files(s, [f"{folder}/{n}" for n in names], ["n_nationkey", "n_name"])
    counts = {p: readers.read_text_columns(s, p).count() for p in good}
    report = [(n, bad.get(p, "usable"), counts.get(p, 0)) for n in names for p in [f"{folder}/{n}"]]
    return s.createDataFrame(report, "part string, status string, n long")


# --- warehouse ---------------------------------------------------------------------


@query("select o_orderkey, o_custkey, o_totalprice from orders where year(o_orderdate) = 1997 and o_orderstatus = 'F'")
def warehouse_scan(s: S, d: str) -> D:
    """A year's rows of an SQL warehouse: a table of Spark's own, which driver and executors share, kept by year; the filters
    reach the files. ``readers.read_warehouse`` takes JDBC addresses: the database that ships with Spark lives in one process, so no
    query here can use it on a cluster."""
    name = f"warehouse_{uuid.uuid4().hex}"
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("ano"))
    sinks.warehouse_table(rows, name, "ano")
    return s.table(name).where("ano = 1997 and o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")


# --- sinks and extracts -----------------------------------------------------------------


@query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def csv_sink(s: S, d: str) -> D:
    rows, path = table(s, d, "supplier"), _folder(s, "sink")
    sinks.write_once(rows, path, kind="csv")
    return readers.read_csv(s, path, rows.schema)


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def parquet_sink(s: S, d: str) -> D:
    """Staged, counted, renamed, and then replaced by a second commit."""
    rows, path = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), _folder(s, "sink")
    sinks.commit(rows.limit(10), path)
    sinks.commit(rows, path, "o_orderstatus", overwrite=True)
    return s.read.parquet(path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("""with n as (select o_orderstatus part, count(*) n_rows, count(*) filter (o_totalprice > 300000) n_must from orders group by 1)
select 1 turn, part, case part when 'P' then 'failed' else 'written' end status, case part when 'P' then null else n_rows end n_rows, case part when 'P' then null else n_must end n_must from n where part <> 'O'
union all select 2, part, case part when 'F' then 'skipped' else 'written' end, case part when 'F' then null else n_rows end, case part when 'F' then null else n_must end from n""")
def extract_report(s: S, d: str) -> D:
    """Two runs of an extract by state of order: in the first one part cannot be read and one is not asked for; the second skips
    what is there and reads the rest."""
    orders, path = table(s, d, "orders"), _folder(s, "extract")
    broken = ["P"]

    def read(part: str) -> D:
        rows = orders.where(F.col("o_orderstatus") == part)
        return rows.withColumn("bad", F.raise_error(F.lit("the store went away"))) if part in broken else rows

    must = F.col("o_totalprice") > 300000
    first = sinks.extract_each(s, read, ["F", "P"], path, must=must)
    broken.clear()
    second = sinks.extract_each(s, read, ["F", "O", "P"], path, must=must)
    return first.withColumn("turn", F.lit(1)).unionByName(second.withColumn("turn", F.lit(2))).select("turn", "part", "status", "n_rows", "n_must")


@query("""with a as (select l_returnflag g, count(*) n, avg(l_quantity) m, max(l_discount) x from lineitem group by 1)
select g, unnest(['n', 'mean_quantity', 'max_discount']) statistic, round(unnest([n, m, x]), 6) "value" from a""")
def long_results(s: S, d: str) -> D:
    rows = table(s, d, "lineitem").withColumnRenamed("l_returnflag", "g")
    out = sinks.long_results(rows, ["g"], {"n": F.count("*"), "mean_quantity": F.avg("l_quantity"), "max_discount": F.max("l_discount")})
    return out.select("g", "statistic", r(F.col("value")).alias("value"))


# --- people, groups, labels -----------------------------------------------------------


@query("""select 'full' g, null::bigint y, count(*) n_rows, count(distinct o_custkey) n_people from orders union all select 'used', null, count(*), count(distinct o_custkey) from orders where o_orderstatus = 'F'
union all select 'full', year(o_orderdate), count(*), count(distinct o_custkey) from orders group by 2 union all select 'used', year(o_orderdate), count(*), count(distinct o_custkey) from orders where o_orderstatus = 'F' group by 2""")
def people_by_groups(s: S, d: str) -> D:
    """Rows and people of the full and of the used sample, by year and in all."""
    rows = table(s, d, "orders").select("o_custkey", "o_orderstatus", year("o_orderdate").alias("y"))
    out = pr.people(rows, "o_custkey", {"full": F.lit(True), "used": F.col("o_orderstatus") == "F"}, ["y"])
    return out.select(F.col("group").alias("g"), "y", "n_rows", "n_people")


@query("select count(*) n_rows, count(distinct (o_custkey, o_orderstatus)) n_people from orders where o_orderstatus <> 'P'")
def sample_note(s: S, d: str) -> D:
    return sinks.sample_note(table(s, d, "orders").where("o_orderstatus <> 'P'"), "o_custkey", "o_orderstatus")


@query("""select l_returnflag g, l_linestatus s, count(*) n, round(count(*) / sum(count(*)) over (partition by l_returnflag), 6) share from lineitem group by 1, 2""")
def group_shares(s: S, d: str) -> D:
    rows = table(s, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("s"))
    return pr.shares(rows, "s", by=["g"]).select("g", "s", "n", r(F.col("share")).alias("share"))


@query("""select 'winners' g, count(*) n from orders where o_orderstatus = 'F' union all select 'searching', count(*) from orders where o_orderstatus = 'O' union all select 'either', count(*) from orders where o_orderstatus in ('F', 'O')""")
def group_union(s: S, d: str) -> D:
    """Two groups and their union, for a table's note: one pass over rows marked with every group they are in."""
    won, looks = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    rows = wt.overlapping(table(s, d, "orders").select("o_orderstatus"), {"winners": won, "searching": looks, "either": won | looks}, "g")
    return rows.groupBy("g").agg(F.count("*").alias("n"))


@query("""with a as (select o_orderkey, o_custkey, o_orderdate, left(o_orderpriority, 1)::int code, o_orderpriority from orders),
b as (select *, lag(code) over w c1, lag(code, 2) over w c2, lead(code) over w f1 from a window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
m as (select distinct code k, o_orderpriority v from a where code <> 4)
select o_orderkey, coalesce(m0.v, code::varchar) now, coalesce(m1.v, c1::varchar) before, coalesce(m2.v, c2::varchar) before2, coalesce(m3.v, f1::varchar) after
from b left join m m0 on m0.k = code left join m m1 on m1.k = c1 left join m m2 on m2.k = c2 left join m m3 on m3.k = f1""")
def decode_lagged(s: S, d: str) -> D:
    """A code with its two lags and its lead, decoded by the base column's labels, which are harvested from the data; the code itself
    where it has no label."""
    from ..operators import panel as pan

    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", F.struct("o_orderdate", "o_orderkey").alias("t"), F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"), F.when(~F.col("o_orderpriority").startswith("4"), F.col("o_orderpriority")).alias("prio_label"))
    labels = clean.labels_of(rows)
    wide = pan.neighbours(rows.drop("prio_label"), "o_custkey", "t", ["prio"])
    done = clean.decode(wide, labels, ["prio", "prio_t1", "prio_t2", "prio_f1"], "_shown", fallback=True)
    return done.select("o_orderkey", F.col("prio_shown").alias("now"), F.col("prio_t1_shown").alias("before"), F.col("prio_t2_shown").alias("before2"), F.col("prio_f1_shown").alias("after"))
