"""Scans, derived columns and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import clean, panel as pan
from ..sources import readers, sinks
from .base import big, r, table, year

S, D = SparkSession, DataFrame

# --- scans --------------------------------------------------------------------


@query("select o_orderkey, o_custkey, o_totalprice from orders where year(o_orderdate) = 1997")
def scan_filter(s: S, d: str) -> D:
    # a range on the raw column reaches the Parquet reader; year(...) = 1997 would not
    date = F.col("o_orderdate")
    return table(s, d, "orders").where((date >= "1997-01-01") & (date < "1998-01-01")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("select o_orderkey, o_custkey from orders where ('0x'||substr(md5(o_custkey::varchar||'_1'),1,8))::ubigint::bigint % 10 = 3")
def hash_sample_mod(s: S, d: str) -> D:
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey").withColumn("k", F.lit(1))
    return rows.where(pan.hash_share(10, "o_custkey", "k") == 3).drop("k")


@query("select p_partkey, p_brand from part where try_cast(substr(p_brand, 7) as int) = 7")
def safe_cast_filter(s: S, d: str) -> D:
    return table(s, d, "part").where(F.substring("p_brand", 7, 10).try_cast("int") == 7).select("p_partkey", "p_brand")


@query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def csv_roundtrip(s: S, d: str) -> D:
    """Written as CSV and read by an explicit schema (no inference)."""
    rows = table(s, d, "supplier")
    path = readers.scratch(s, f"supplier-{uuid.uuid4().hex}.csv")
    rows.write.option("header", True).csv(path)
    return readers.read_csv(s, path, rows.schema)


@query("select l_orderkey, l_quantity, l_returnflag from lineitem")
def scan_project_available(s: S, d: str) -> D:
    return clean.available(table(s, d, "lineitem"), ["L_ORDERKEY", "l_quantity", "no_such_column", "l_returnflag", "l_quantity"])


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem where l_quantity >= 36 and l_quantity <> 50 and l_linenumber in (5,6,7)")
def chunked_filter_scan(s: S, d: str) -> D:
    """What a chunked reader does by hand: file splits and a filter that runs within each."""
    q = F.col("l_quantity")
    return table(s, d, "lineitem").where((q >= 36) & (q != 50) & F.col("l_linenumber").isin(5, 6, 7)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("select year(o_orderdate)::bigint y, count(*) n, round(sum(o_totalprice), 2) total from orders where year(o_orderdate) in (1996, 1999) group by 1")
def scan_year_in(s: S, d: str) -> D:
    date = F.col("o_orderdate")
    years = ((date >= "1996-01-01") & (date < "1997-01-01")) | ((date >= "1999-01-01") & (date < "2000-01-01"))
    return table(s, d, "orders").where(years).groupBy(year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey, c_name, c_nationkey, c_acctbal from customer")
def dta_source(s: S, d: str) -> D:
    """Stata files, one of a bounded number of rows each, written and read by tasks."""
    rows = table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return readers.read_dta_bytes(sinks.stata_files(rows), rows.schema)


@query("""with a as (select n_regionkey, count(*) n, round(sum(c_acctbal), 2) total from customer join nation on c_nationkey = n_nationkey group by 1)
select r_name, n, total, round(total / n, 6) mean from a join region on n_regionkey = r_regionkey""")
def reaggregate_from_saved(s: S, d: str) -> D:
    """Aggregate once, save, and build the report from the saved table."""
    by = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("n"), r(F.sum("c_acctbal"), 2).alias("total"))
    saved = readers.cached(s, readers.scratch(s, f"by-region-{uuid.uuid4().hex}"), lambda: by)
    return saved.join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n", "total", r(F.col("total") / F.col("n")).alias("mean"))


# --- derived columns ----------------------------------------------------------


@query("select o_orderkey order_id, o_orderstatus status, 's-'||o_orderstatus status_label, o_totalprice from orders")
def rename_with_labels(s: S, d: str) -> D:
    rows = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit("s-"), "o_orderstatus").alias("O_ORDERSTATUS_label"), "o_totalprice")
    return clean.rename_with_labels(rows, {"O_ORDERKEY": "order_id", "o_orderstatus": "status"})


@query("select p_partkey, try_cast(p_type as double) type_num, try_cast(substr(p_brand, 7) as double) brand_num from part")
def coerce_numeric(s: S, d: str) -> D:
    return table(s, d, "part").select("p_partkey", clean.num("p_type").alias("type_num"), clean.num(F.substring("p_brand", 7, 10)).alias("brand_num"))


@query("""select c_custkey::double k, c_nationkey::varchar nat, c_acctbal bal, 'customer' source_file from customer
union all select s_suppkey::double, s_name, null, 'supplier' from supplier""")
def union_promote_types(s: S, d: str) -> D:
    a = table(s, d, "customer").select(big("c_custkey").alias("k"), F.col("c_nationkey").alias("nat"), F.col("c_acctbal").alias("bal"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").cast("double").alias("k"), F.col("s_name").alias("nat"))
    return clean.union_promoted({"customer": a, "supplier": b})


@query("select year(o_orderdate)::bigint y, count(*) n from orders where year(o_orderdate) not between 1996 and 2000 group by 1")
def check_year_violations(s: S, d: str) -> D:
    return table(s, d, "orders").where(~F.year("o_orderdate").between(1996, 2000)).groupBy(year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))


@query("""with a as (select nullif(l_suppkey % 10, 0) x, nullif(l_partkey % 7, 0) z from lineitem)
select coalesce(x, z) place, count(*) n, sum(case when x is null and z is not null then 1 else 0 end)::bigint n_fallback from a group by 1""")
def coalesce_fallback_count(s: S, d: str) -> D:
    rows = table(s, d, "lineitem").select(F.nullif(F.col("l_suppkey") % 10, F.lit(0)).alias("x"), F.nullif(F.col("l_partkey") % 7, F.lit(0)).alias("z"))
    fallback = F.col("x").isNull() & F.col("z").isNotNull()
    return rows.groupBy(F.coalesce("x", "z").alias("place")).agg(F.count("*").alias("n"), big(F.sum(fallback.cast("int"))).alias("n_fallback"))


@query("select p_size::bigint v, count(*) n from part group by 1")
def first_usable_column(s: S, d: str) -> D:
    rows = table(s, d, "part").withColumn("empty", F.lit(None).cast("int"))
    column = clean.first_usable(rows, ["absent", "empty", "p_size", "p_retailprice"])
    return rows.groupBy(big(column).alias("v")).agg(F.count("*").alias("n"))


@query("""select o_orderpriority, count(*) n, sum((coalesce(try_cast(left(o_orderpriority, 1) as int) = 1, false) or contains(lower(o_orderpriority), 'high'))::int)::bigint n_flag,
sum((coalesce(try_cast(left(o_orderpriority, 1) as int) = 1, false))::int)::bigint n_code from orders group by 1""")
def flag_code_or_label(s: S, d: str) -> D:
    code = F.substring("o_orderpriority", 1, 1)
    rows = table(s, d, "orders").select("o_orderpriority", code.alias("code"))
    either = F.greatest(clean.code_or_label("code", 1, None), clean.code_or_label("o_orderpriority", 1, "HIGH"))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), big(F.sum(either)).alias("n_flag"), big(F.sum(clean.code_or_label("code", 1, None))).alias("n_code"))


@query("select p_type, max(regexp_matches(p_type, '(?i)promo|^small$')::int)::bigint f from part group by 1")
def flag_regex(s: S, d: str) -> D:
    return table(s, d, "part").groupBy("p_type").agg(big(F.max(clean.regex_flag("p_type", "promo|^small$"))).alias("f"))


@query("""select (p_size in (5,6,7))::int::bigint public, (p_size in (1,2,3,4))::int::bigint private, (coalesce(nullif(p_size, 9) = 8, false))::int::bigint employer, count(*) n from part group by 1,2,3""")
def flags_isin(s: S, d: str) -> D:
    code = F.nullif(F.col("p_size"), F.lit(9))
    flags = [big(clean.flag(code.isin(5, 6, 7))).alias("public"), big(clean.flag(code.isin(1, 2, 3, 4))).alias("private"), big(clean.flag(code == 8)).alias("employer")]
    return table(s, d, "part").groupBy(*flags).agg(F.count("*").alias("n"))


@query("""select case when o_orderpriority like '1%' then 'public' when o_orderpriority like '2%' then 'private' when o_orderpriority in ('3-MEDIUM','5-LOW') then 'unemployed' end three,
case when o_totalprice < 30000 then null when o_orderstatus = 'O' then 'unemployed' when o_orderstatus = 'F' then 'private' when o_orderstatus = 'P' then 'public' end masked,
case when o_orderpriority like '1%' then 'public' when o_orderpriority like '2%' then 'private' else 'unemployed' end swallowing, count(*) n from orders group by 1,2,3""")
def classify_state(s: S, d: str) -> D:
    from ..operators.states import public_private_unemployed as space

    p, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    three = space(p.startswith("1"), p.startswith("2"), p.isin("3-MEDIUM", "5-LOW"))
    masked = space(st == "P", st == "F", st == "O", first="unemployed", mask=F.col("o_totalprice") >= 30000)
    swallowing = space(p.startswith("1"), p.startswith("2"), F.lit(False), default="unemployed")
    return table(s, d, "orders").groupBy(three.column().alias("three"), masked.column().alias("masked"), swallowing.column().alias("swallowing")).agg(F.count("*").alias("n"))


@query("""select p_partkey, case when p_size between 0 and 14 and p_size < 14 then '0-14' when p_size < 24 then '15-24' when p_size < 34 then '25-34' when p_size >= 34 then '35+' end band from part""")
def bin_left_closed(s: S, d: str) -> D:
    return table(s, d, "part").select("p_partkey", clean.bin_left(F.col("p_size"), [0, 14, 24, 34], ["0-14", "15-24", "25-34", "35+"]).alias("band"))


@query("""select case when o_totalprice > 0 and o_totalprice <= 100000 then 'a' when o_totalprice > 100000 and o_totalprice <= 250000 then 'b' when o_totalprice > 250000 then 'c' end band, count(*) n from orders group by 1""")
def bin_right_closed(s: S, d: str) -> D:
    return table(s, d, "orders").groupBy(clean.bin_right(F.col("o_totalprice"), [0, 100000, 250000], ["a", "b", "c"]).alias("band")).agg(F.count("*").alias("n"))


@query("select floor(p_retailprice / 50)::bigint b, count(*) n from part group by 1")
def bin_floor(s: S, d: str) -> D:
    return table(s, d, "part").groupBy(big(F.floor(F.col("p_retailprice") / 50)).alias("b")).agg(F.count("*").alias("n"))


@query("select c_custkey, case when c_acctbal > 0 then round(ln(c_acctbal), 6) end log_bal from customer")
def positive_log(s: S, d: str) -> D:
    return table(s, d, "customer").select("c_custkey", r(clean.positive_log(F.col("c_acctbal"))).alias("log_bal"))


@query("""select year(o_orderdate)::bigint y, count(*) n from orders
where o_totalprice >= case year(o_orderdate) when 1995 then 50000 when 1996 then 60000 when 1997 then 70000 else 70000 end group by 1""")
def year_floor_filter(s: S, d: str) -> D:
    floors = {1995: 50000.0, 1996: 60000.0, 1997: 70000.0}
    floor = clean.lookup(F.year("o_orderdate"), floors, F.lit(max(floors.values())))
    return table(s, d, "orders").where(F.col("o_totalprice") >= floor).groupBy(year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))


@query("""select n_nationkey, n_regionkey, r_name n_regionkey_label from nation left join region on n_regionkey = r_regionkey and r_regionkey <> 4""")
def decode_labels(s: S, d: str) -> D:
    labels = table(s, d, "region").where("r_regionkey <> 4").select(F.lit("n_regionkey").alias("nome_coluna"), F.col("r_regionkey").cast("string").alias("chave"), F.col("r_name").alias("valor"))
    return clean.decode(table(s, d, "nation").select("n_nationkey", "n_regionkey"), labels, ["n_regionkey"])


@query("""with m as (select distinct left(o_orderpriority,1) code, substr(o_orderpriority, 3) label from orders where o_orderpriority <> '5-LOW')
select p_partkey, coalesce(label, (p_size % 6)::varchar) shown from part left join m on (p_size % 6)::varchar = code""")
def decode_from_data(s: S, d: str) -> D:
    """Labels harvested from the data; the raw code where there is none. The map has a few rows, by its DISTINCT."""
    priority = F.col("o_orderpriority")
    found = clean.labels_of(table(s, d, "orders").where("o_orderpriority <> '5-LOW'").select(F.substring(priority, 1, 1).alias("code"), F.expr("substr(o_orderpriority, 3)").alias("code_label")))
    rows = table(s, d, "part").select("p_partkey", (F.col("p_size") % 6).alias("code"))
    return clean.decode(rows, found, ["code"], "_shown", fallback=True).select("p_partkey", F.col("code_shown").alias("shown"))


@query("""select case when l_linestatus = 'F' then case when l_tax > 0.06 then 0 when coalesce(nullif(l_linenumber, 7) = 1, false) or (l_linenumber in (2,3) and l_quantity < 25) or (l_linenumber = 4 and l_returnflag = 'A') then 1 else 0 end end flag, count(*) n from lineitem group by 1""")
def refined_rule(s: S, d: str) -> D:
    """Three ways in, one way out, null outside the universe."""
    n = F.nullif(F.col("l_linenumber"), F.lit(7))
    ways = clean.is_true(n == 1) | clean.is_true(n.isin(2, 3) & (F.col("l_quantity") < 25)) | clean.is_true((n == 4) & (F.col("l_returnflag") == "A"))
    flag = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_tax") > 0.06, 0).when(ways, 1).otherwise(0))
    return table(s, d, "lineitem").groupBy(flag.alias("flag")).agg(F.count("*").alias("n"))


@query("select n_nationkey, floor(n_nationkey / 10)::bigint digit, case floor(n_nationkey / 10) when 0 then 'North' when 1 then 'South' end macro from nation")
def region_from_code(s: S, d: str) -> D:
    digit = F.floor(F.col("n_nationkey") / 10)
    return table(s, d, "nation").select("n_nationkey", big(digit).alias("digit"), clean.lookup(digit.cast("int"), {0: "North", 1: "South"}).alias("macro"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / (1 + l_tax), 6) l_extendedprice_real, round(l_discount / (1 + l_tax), 6) l_discount_real from lineitem""")
def deflate_columns(s: S, d: str) -> D:
    """Every numeric column of a prefix is deflated; a text column of that prefix is left alone."""
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", F.col("l_returnflag").alias("l_ext_text"), (1 + F.col("l_tax")).alias("f"))
    done = clean.deflate(rows, "f", ["l_ext", "l_disc"], "_real")
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(F.col("l_extendedprice_real")).alias("l_extendedprice_real"), r(F.col("l_discount_real")).alias("l_discount_real"))


@query("""with a as (select case when l_linenumber = 7 then null when l_linenumber <= 3 then 1 else 0 end f, nullif(l_quantity, 50) h from lineitem)
select case when f = 1 and h is null then null when f = 1 then (h >= 35)::int when f is not null then 0 end flag, count(*) n from a group by 1""")
def tri_state_lead(s: S, d: str) -> D:
    f = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_linenumber") <= 3, 1).otherwise(0)
    rows = table(s, d, "lineitem").select(f.alias("f"), F.nullif(F.col("l_quantity"), F.lit(50.0)).alias("h"))
    flag = F.when((F.col("f") == 1) & F.col("h").isNull(), None).when(F.col("f") == 1, (F.col("h") >= 35).cast("int")).when(F.col("f").isNotNull(), 0)
    return rows.groupBy(flag.alias("flag")).agg(F.count("*").alias("n"))


@query("""select distinct year(o_orderdate)||'Q'||quarter(o_orderdate) lab, 'Q'||quarter(o_orderdate) short, (year(o_orderdate)*4+quarter(o_orderdate))::bigint ord, (year(o_orderdate)*10+quarter(o_orderdate))::bigint ord10 from orders""")
def period_labels(s: S, d: str) -> D:
    y, q = F.year("o_orderdate"), F.quarter("o_orderdate")
    return table(s, d, "orders").select(pan.period_label(y, q, 7).alias("lab"), pan.period_label(y, q, 1).alias("short"), big(pan.ordinal(y, q)).alias("ord"), big(y * 10 + q).alias("ord10")).distinct()


@query("""select ((contains(lower(p_name), 'red') or contains(lower(nullif(p_type, 'PROMO')), 'small')) is true)::int f, count(*) n from part group by 1""")
def either_text_flag(s: S, d: str) -> D:
    has = lambda c, w: clean.is_true(F.contains(F.lower(c), F.lit(w)))
    return table(s, d, "part").groupBy(clean.flag(has(F.col("p_name"), "red") | has(F.nullif("p_type", F.lit("PROMO")), "small")).alias("f")).agg(F.count("*").alias("n"))


# --- joins --------------------------------------------------------------------

DEFLATOR = """defl as (select year(o_orderdate) y, quarter(o_orderdate) q, c_nationkey k, avg(o_totalprice) / 100000 f
  from orders join customer on o_custkey = c_custkey group by 1,2,3)"""


def _deflator(s: S, d: str) -> D:
    """Year x quarter x nation: a dimension of at most 25 rows a quarter."""
    rows = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.col("c_nationkey").alias("k")).agg((F.avg("o_totalprice") / 100000).alias("f"))


@query(f"""with {DEFLATOR} select o_orderkey, round(o_totalprice / f, 4) w_real from orders join customer on o_custkey = c_custkey
left join defl on y = year(o_orderdate) and q = quarter(o_orderdate) and k = c_nationkey""")
def deflator_join(s: S, d: str) -> D:
    rows = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.col("c_nationkey").alias("k"))
    return clean.many_to_one(rows, _deflator(s, d), "y", "q", "k").select("o_orderkey", r(F.col("o_totalprice") / F.col("f"), 4).alias("w_real"))


@query("""select distinct c_nationkey k from customer where c_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)""")
def unmatched_keys(s: S, d: str) -> D:
    have = table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return clean.unmatched(table(s, d, "customer").select(F.col("c_nationkey").alias("k")), have, "k")


@query("""select d.doc_id, d.n_chars, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id""")
def left_join_suffix(s: S, d: str) -> D:
    """Main x supplement; columns of the supplement that clash get a suffix."""
    main, extra = table(s, d, "documents").select("doc_id", "n_chars"), table(s, d, "labels").withColumn("n_chars", F.lit(0))
    extra = extra.withColumnsRenamed({c: f"{c}_sup" for c in extra.columns if c in main.columns and c != "doc_id"})
    return main.join(extra, "doc_id", "left").select("doc_id", "n_chars", "quality", "toxic")


IDS = "('0x'||substr(md5(o_custkey::varchar||'_1'),1,8))::ubigint::bigint % 10 = 0"


@query(f"""select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from orders where {IDS})""")
def sample_ids_semi(s: S, d: str) -> D:
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey")
    ids = rows.withColumn("k", F.lit(1)).where(pan.hash_share(10, "o_custkey", "k") == 0).select("o_custkey").distinct()
    return rows.join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""select s_suppkey, s_acctbal from supplier where s_suppkey in (select c_custkey from customer where c_nationkey = 3)""")
def roster_semi(s: S, d: str) -> D:
    """Membership by a normalised text key: blanks and a trailing .0 do not count."""
    norm = lambda c: F.regexp_replace(F.trim(c), r"\.0$", "")
    roster = table(s, d, "customer").where("c_nationkey = 3").select(norm(F.concat(F.lit(" "), F.col("c_custkey").cast("double").cast("string"), F.lit(" "))).alias("key"))
    rows = table(s, d, "supplier").withColumn("key", norm(F.col("s_suppkey").cast("string")))
    return rows.join(roster, "key", "left_semi").select("s_suppkey", "s_acctbal")


@query("""with m as (select s_suppkey, s_nationkey from supplier where s_nationkey <> 7), j as (select l_suppkey, s_nationkey from lineitem left join m on l_suppkey = s_suppkey)
select n_name, count(*) n, (select count(*) from j where s_nationkey is null)::bigint n_unmatched from j join nation on s_nationkey = n_nationkey group by 1""")
def region_lookup_join(s: S, d: str) -> D:
    """m:1 look-up; unmatched rows are dropped and counted in the same pass: they are the group without a place."""
    key = table(s, d, "supplier").where("s_nationkey <> 7").select("s_suppkey", "s_nationkey")
    j = table(s, d, "lineitem").select("l_suppkey").join(key, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    by = j.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    # a row a nation
    lost = F.coalesce(F.sum(F.when(F.col("s_nationkey").isNull(), F.col("n"))).over(Window.partitionBy(F.lit(0))), F.lit(0)).cast("bigint")
    by = by.withColumn("n_unmatched", lost).where("s_nationkey is not null")
    return by.join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "n", "n_unmatched")


@query("""with a as (select distinct l_discount a from lineitem), b as (select distinct l_tax b from lineitem) select a alpha, b rate, round(a * b, 6) z from a, b""")
def param_grid(s: S, d: str) -> D:
    """The one genuine cross product: two short lists of parameters, here the discounts and taxes that occur."""
    lines = table(s, d, "lineitem")
    a, b = lines.select(F.col("l_discount").alias("alpha")).distinct(), lines.select(F.col("l_tax").alias("rate")).distinct()
    return a.crossJoin(clean.few(b)[0]).withColumn("z", r(F.col("alpha") * F.col("rate")))


@query("""with a as (select n_regionkey k, avg(c_acctbal) m from customer join nation on c_nationkey = n_nationkey group by 1)
select k, round(m, 6) mean, round(m / (select avg(c_acctbal) from customer) - 1, 6) vs from a""")
def vs_reference(s: S, d: str) -> D:
    rows = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    by = rows.groupBy(F.col("n_regionkey").alias("k")).agg(F.avg("c_acctbal").alias("m"))
    reference = table(s, d, "customer").agg(F.avg("c_acctbal").alias("ref"))
    return by.crossJoin(F.broadcast(reference)).select("k", r(F.col("m")).alias("mean"), r(F.col("m") / F.col("ref") - 1).alias("vs"))


@query("select l_orderkey, l_linenumber, count(*) n from lineitem group by 1,2 having count(*) > 1")
def duplicate_keys(s: S, d: str) -> D:
    return clean.duplicate_keys(table(s, d, "lineitem"), "l_orderkey", "l_linenumber")


# --- set operations, order ----------------------------------------------------


@query("""select c_custkey k, c_acctbal bal, c_mktsegment seg, 'customer' source_file from customer union all select s_suppkey, s_acctbal, null, 'supplier' from supplier""")
def union_by_name(s: S, d: str) -> D:
    a = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"), F.lit("customer").alias("source_file"))
    b = table(s, d, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k"), F.lit("supplier").alias("source_file"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) r from lineitem) where r = 1""")
def distinct_keep_first(s: S, d: str) -> D:
    return pan.keep_first(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"], "l_partkey", "l_suppkey")


@query("""with a as (select c_mktsegment g, count(*) / sum(count(*)) over () x from customer where c_nationkey < 12 and c_mktsegment <> 'MACHINERY' group by 1),
b as (select c_mktsegment g, count(*) / sum(count(*)) over () z from customer where c_nationkey >= 12 and c_mktsegment <> 'BUILDING' group by 1)
select coalesce(a.g, b.g) g, round(coalesce(x, 0), 6) share_a, round(coalesce(z, 0), 6) share_b from a full join b on a.g = b.g""")
def share_compare_outer(s: S, d: str) -> D:
    from ..operators.profiles import shares

    rows = table(s, d, "customer").select(F.col("c_mktsegment").alias("g"), "c_nationkey")
    a = shares(rows.where("c_nationkey < 12 and g <> 'MACHINERY'"), "g").select("g", r(F.col("share")).alias("share_a"))
    b = shares(rows.where("c_nationkey >= 12 and g <> 'BUILDING'"), "g").select("g", r(F.col("share")).alias("share_b"))
    return a.join(b, "g", "full").fillna(0.0, ["share_a", "share_b"])


@query("""select id, o_orderdate, row_number() over (order by id nulls last, o_orderdate, o_orderkey)::bigint pos from (select nullif(o_custkey, 5) id, o_orderdate, o_orderkey from orders)""")
def sorted_panel(s: S, d: str) -> D:
    """Every row of the panel with its place in panel order, nulls last."""
    rows = table(s, d, "orders").select(F.nullif(F.col("o_custkey"), F.lit(5)).alias("id"), "o_orderdate", "o_orderkey")
    return pan.positions(rows, [F.col("id"), F.col("o_orderdate"), F.col("o_orderkey")]).select("id", "o_orderdate", big(F.col("pos")).alias("pos"))


@query("select p_type, count(*) n from part group by 1 order by n desc, p_type limit 3")
def topk_categories(s: S, d: str) -> D:
    return table(s, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(3)


@query("""with i as (select distinct o_custkey k from orders), n as (select greatest(1, floor(count(*) * 0.1 + 0.5)) m from i)
select k from (select k, row_number() over (order by md5(k::varchar||'_42'), k) r from i) where r <= (select m from n)""")
def sample_ids_exact(s: S, d: str) -> D:
    return pan.sample_ids(table(s, d, "orders").select(F.col("o_custkey").alias("k")), "k", 0.1)

