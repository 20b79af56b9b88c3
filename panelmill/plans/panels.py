"""Windows, transitions, trajectories over the customer x quarter panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import clean, panel as pan, transitions as tr, weighted as wt
from .base import PANEL, STATES, big, panel, r, table

S, D = SparkSession, DataFrame
NEXT = f"""with {PANEL}, pairs as (select *, case when lead(t) over v - t = 1 then lead(st) over v end st1, case when lead(t) over v - t = 1 then lead(w) over v end w1 from panel window v as (partition by id order by t))"""
GRID = "grid as (select o, d from (values ('F'),('O'),('P')) a(o) cross join (values ('F'),('O'),('P')) b(d))"


def pairs(s: S, d: str) -> D:
    return pan.consecutive_lead(panel(s, d), "id", "t", ["st", "w"], "1")


# --- windows ------------------------------------------------------------------


@query(f"{NEXT} select id, t, st, st1 from pairs")
def consecutive_lead(s: S, d: str) -> D:
    return pairs(s, d).select("id", "t", "st", "st1")


LAGS = ", ".join(f"lag({c},1) over v {c}_t1, lag({c},2) over v {c}_t2, lead({c}) over v {c}_f1" for c in ("st", "w", "n", "t"))


@query(f"with {PANEL} select id, y, q, st, w, n, t, {LAGS} from panel window v as (partition by id order by t)")
def panel_lags(s: S, d: str) -> D:
    return pan.neighbours(panel(s, d), "id", "t", ["st", "w", "n", "t"])


@query(f"with {PANEL} select id, t, case when lead(t,4) over v - t = 4 then lead(w,4) over v end w4 from panel window v as (partition by id order by t)")
def row_lead_k(s: S, d: str) -> D:
    return pan.row_lead(panel(s, d), "id", "t", ["w"], 4, "4").select("id", "t", "w4")


@query(f"with {PANEL} select id, t, first_value(w) over (partition by id order by t range between 4 following and 4 following) w4 from panel")
def time_lead_k(s: S, d: str) -> D:
    return pan.time_lead(panel(s, d), "id", "t", ["w"], 4, "4").select("id", "t", "w4")


@query(f"""with {PANEL}, a as (select *, case when t - lag(t) over v = 1 then lag(st) over v end prev from panel window v as (partition by id order by t))
select id, t, coalesce(prev = 'F' and st = 'P', false)::int f_to_p, coalesce(prev = 'O' and st = 'P', false)::int o_to_p, coalesce(prev = 'P' and st = 'P', false)::int stay_p from a""")
def prev_state_dummies(s: S, d: str) -> D:
    rows = pan.consecutive_lag(panel(s, d), "id", "t", ["st"])
    now = lambda a: clean.flag((F.col("st_prev") == a) & (F.col("st") == "P"))
    return rows.select("id", "t", now("F").alias("f_to_p"), now("O").alias("o_to_p"), now("P").alias("stay_p"))


@query(f"with {PANEL} select id, t, lag(st) over (partition by id order by t) prev from panel")
def unchecked_lag(s: S, d: str) -> D:
    return panel(s, d).select("id", "t", F.lag("st").over(Window.partitionBy("id").orderBy("t")).alias("prev"))


@query("select o_custkey, o_orderkey, o_orderdate, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) r from orders) where r = 1")
def first_obs(s: S, d: str) -> D:
    return pan.first_observation(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_custkey", "o_orderdate", "o_orderkey")


@query(f"""with {PANEL}, a as (select *, case when t - lag(t) over v = 1 then lag(w) over v end w0 from panel window v as (partition by id order by t))
select id, t, round(w - w0, 2) delta, round((w - w0) / w0, 6) rel from a where w0 is not null""")
def wage_delta(s: S, d: str) -> D:
    rows = pan.consecutive_lag(panel(s, d), "id", "t", ["w"]).where("w_prev is not null")
    return rows.select("id", "t", r(F.col("w") - F.col("w_prev"), 2).alias("delta"), r((F.col("w") - F.col("w_prev")) / F.col("w_prev")).alias("rel"))


@query(f"with {PANEL} select distinct a.id from panel a join panel b on a.id = b.id and b.t = a.t + 1")
def has_consecutive_pair(s: S, d: str) -> D:
    return pan.have_consecutive_pair(panel(s, d), "id", "t")


@query(f"""with {PANEL}, a as (select *, lead(t) over v - t gap, lead(st) over v s1, lead(n) over v n1 from panel window v as (partition by id order by t))
select id, t, (gap = 1 and s1 in ('F','P') and (st = 'O' or n1 = 1 or n1 < n))::int new_job from a where gap is not null""")
def new_job_proxy(s: S, d: str) -> D:
    """Consecutive, employed next, and entered, or tenure is one, or tenure fell (tenure: orders in the quarter)."""
    rows = pan.neighbours(panel(s, d), "id", "t", ["t", "st", "n"]).where("t_f1 is not null")
    entered = (F.col("st") == "O") | (F.col("n_f1") == 1) | (F.col("n_f1") < F.col("n"))
    return rows.select("id", "t", clean.flag((F.col("t_f1") - F.col("t") == 1) & F.col("st_f1").isin("F", "P") & entered).alias("new_job"))


@query(f"""{NEXT} select id, t, case when st1 is null then 'Not observed' when st1 = 'P' and st = 'P' then 'Stayed public' when st1 = 'P' then 'Entered public' when st1 = 'F' and w1 > w then 'Private, higher' when st1 = 'F' then 'Private' when st1 = 'O' and st = 'O' then 'Still unemployed' else 'Out of labor force' end next_status from pairs""")
def next_status(s: S, d: str) -> D:
    """A cascade of labels, the first that holds; no row-wise Python."""
    now, nxt = F.col("st"), F.col("st1")
    label = F.when(nxt.isNull(), "Not observed").when((nxt == "P") & (now == "P"), "Stayed public").when(nxt == "P", "Entered public")
    label = label.when((nxt == "F") & (F.col("w1") > F.col("w")), "Private, higher").when(nxt == "F", "Private").when((nxt == "O") & (now == "O"), "Still unemployed").otherwise("Out of labor force")
    return pairs(s, d).select("id", "t", label.alias("next_status"))


# --- matrices -----------------------------------------------------------------


def _matrix(s: S, d: str, **kw) -> D:
    return tr.counts(pairs(s, d), "st", "st1", STATES, **kw)


COUNTS = f"{NEXT}, {GRID}, c as (select o, d, count(st1) n from grid left join pairs on st = o and st1 = d group by 1,2)"


@query(f"""{COUNTS} select o st, max(n) filter (d = 'F') "F", max(n) filter (d = 'O') "O", max(n) filter (d = 'P') "P" from c group by 1""")
def transition_counts(s: S, d: str) -> D:
    return tr.wide(_matrix(s, d), "st", "st1", STATES)


@query(f"{COUNTS} select o st, d st1, n, round(case when sum(n) over (partition by o) > 0 then n / sum(n) over (partition by o) else 0 end, 6) prob from c")
def transition_probs(s: S, d: str) -> D:
    return tr.shares(_matrix(s, d), "st").select("st", "st1", "n", r(F.col("row_share")).alias("prob"))


@query(f"""{NEXT}, {GRID}, c as (select o, d, coalesce(sum(coalesce(nullif(n, 2), 1)) filter (st1 is not null), 0)::double wsum from grid left join pairs on st = o and st1 = d group by 1,2)
select o st, d st1, wsum, round(wsum / sum(wsum) over (partition by o), 6) prob from c""")
def transition_probs_weighted(s: S, d: str) -> D:
    """A missing weight (here: 2 orders) counts as 1."""
    m = _matrix(s, d, weight=F.nullif(F.col("n"), F.lit(2)).cast("double"))
    return tr.shares(m, "st").select("st", "st1", F.col("n").alias("wsum"), r(F.col("row_share")).alias("prob"))


@query(f"{COUNTS} select o st, d st1, n, round(n / sum(n) over (partition by o), 6) row_share, round(n / sum(n) over (), 6) total_share from c")
def transition_long(s: S, d: str) -> D:
    return tr.shares(_matrix(s, d), "st").select("st", "st1", "n", r(F.col("row_share")).alias("row_share"), r(F.col("total_share")).alias("total_share"))


@query(f"""{NEXT}, {GRID}, p as (select distinct t from pairs where st1 is not null), c as (select p.t, o, d, count(st1) n from p cross join grid left join pairs x on x.t = p.t and st = o and st1 = d group by 1,2,3)
select t, o st, d st1, n, round(case when sum(n) over (partition by t, o) > 0 then n / sum(n) over (partition by t, o) else 0 end, 6) prob from c""")
def transition_by_period(s: S, d: str) -> D:
    return tr.shares(_matrix(s, d, by=["t"]), "st", ["t"]).select("t", "st", "st1", "n", r(F.col("row_share")).alias("prob"))


@query(f"""with {PANEL}, p as (select distinct t from panel), g as (select t, s from p cross join (values ('F'),('O'),('P')) v(s)), c as (select g.t, g.s, count(panel.id) n from g left join panel on panel.t = g.t and st = s group by 1,2)
select t, s st, n, round(n / sum(n) over (partition by t), 6) share from c""")
def state_composition(s: S, d: str) -> D:
    return tr.composition(panel(s, d), "t", "st", STATES).select("t", "st", "n", r(F.col("share")).alias("share"))


@query(f"""with {PANEL} select id, min_by(st, t) filter (y = 1996) y1996, min_by(st, t) filter (y = 1997) y1997, min_by(st, t) filter (y = 1998) y1998 from panel where y between 1996 and 1998 group by 1""")
def trajectory_pivot(s: S, d: str) -> D:
    """First state of each year, one column a year; the list of years is given, so no extra pass finds it."""
    rows = panel(s, d).where("y between 1996 and 1998").withColumn("yy", F.concat(F.lit("y"), F.col("y").cast("string")))
    return rows.groupBy("id").pivot("yy", ["y1996", "y1997", "y1998"]).agg(F.min_by("st", "t"))


@query(f"""with {PANEL}, p as (select t, row_number() over (order by t) i from (select distinct t from panel)), r as (select panel.*, i from panel join p using (t))
select a.t period_from, b.t period_to, a.st state_from, b.st state_to, count(*) n from r a join r b on a.id = b.id and b.i = a.i + 1 group by all""")
def trajectory_flows(s: S, d: str) -> D:
    return tr.flows(panel(s, d).select("id", "t", "st"), "id", "t", "st")


@query(f"with {PANEL}, c as (select id, count(*) k from panel group by 1) select k, count(*) n from c group by 1")
def obs_count_dist(s: S, d: str) -> D:
    return panel(s, d).groupBy("id").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


# --- wages and exits ----------------------------------------------------------


@query(f"""{NEXT} select st, st1, count(*) n, round(avg((w1 > w)::int), 6) gain, round(avg((w1 < w)::int), 6) loss, round(avg((w1 = w)::int), 6) same, round(avg(w1 - w), 4) mean_delta, round(median(w1 - w), 4) median_delta
from pairs where st1 is not null group by 1,2 having count(*) >= 5""")
def wage_delta_by_transition(s: S, d: str) -> D:
    delta = F.col("w1") - F.col("w")
    share = lambda c: r(F.avg(c.cast("int")))
    rows = pairs(s, d).where("st1 is not null").withColumn("x", delta)
    out = rows.groupBy("st", "st1").agg(
        F.count("*").alias("n"), share(delta > 0).alias("gain"), share(delta < 0).alias("loss"), share(delta == 0).alias("same"), r(F.avg(delta), 4).alias("mean_delta")
    )
    return wt.beside(out.where("n >= 5"), wt.quantile_linear(rows, "x", [0.5], "st", "st1"), "st", "st1").withColumn("median_delta", r(F.col("q0"), 4)).drop("q0")


@query(f"""{NEXT} select st, st1, count(*) n, round(avg(ln(w1) - ln(w)), 6) mean_dlog, round(median(ln(w1) - ln(w)), 6) median_dlog from pairs where st1 is not null and w > 0 and w1 > 0 group by 1,2""")
def log_wage_delta(s: S, d: str) -> D:
    x = clean.positive_log(F.col("w1")) - clean.positive_log(F.col("w"))
    rows = pairs(s, d).where("st1 is not null").withColumn("x", x).where("x is not null")
    out = wt.beside(rows.groupBy("st", "st1").agg(F.count("*").alias("n"), r(F.avg("x")).alias("mean_dlog")), wt.quantile_linear(rows, "x", [0.5], "st", "st1"), "st", "st1")
    return out.select("st", "st1", "n", "mean_dlog", r(F.col("q0")).alias("median_dlog"))


@query(f"""{NEXT}, x as (select case st1 when 'P' then 'stayed' when 'F' then 'to private' when 'O' then 'to unemployment' else 'not observed' end flow from pairs where st = 'P') select flow, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from x group by 1""")
def exit_summary(s: S, d: str) -> D:
    from ..operators.profiles import shares

    flow = clean.lookup(F.col("st1"), {"P": "stayed", "F": "to private", "O": "to unemployment"}, F.lit("not observed"))
    return shares(pairs(s, d).where("st = 'P'").select(flow.alias("flow")), "flow").select("flow", "n", r(F.col("share")).alias("share"))


@query(f"""{NEXT} select case when n <= 1 then '1' when n <= 2 then '2' else '3+' end band, count(*) n, round(avg((st1 <> 'P')::int), 6) exit_rate from pairs where st = 'P' and st1 is not null group by 1""")
def exit_age_bands(s: S, d: str) -> D:
    rows = pairs(s, d).where("st = 'P' and st1 is not null").withColumn("band", clean.bin_right(F.col("n"), [0, 1, 2], ["1", "2", "3+"]))
    return rows.groupBy("band").agg(F.count("*").alias("n"), r(F.avg((F.col("st1") != "P").cast("int"))).alias("exit_rate"))


@query(f"""{NEXT}, e as (select id, t from pairs where st = 'P' and st1 is not null and st1 <> 'P'), o as (select o_custkey id, (year(o_orderdate)*4+quarter(o_orderdate))::bigint t, o_orderpriority reason from orders)
select reason, count(*) n from e join o using (id, t) group by 1 order by n desc, reason limit 8""")
def exit_top_reasons(s: S, d: str) -> D:
    exits = pairs(s, d).where("st = 'P' and st1 is not null and st1 <> 'P'").select("id", "t")
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("id"), big(pan.ordinal(F.year("o_orderdate"), F.quarter("o_orderdate"))).alias("t"), F.col("o_orderpriority").alias("reason"))
    return exits.join(orders, ["id", "t"]).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(8)


@query(f"""{NEXT} select case st1 when 'P' then 'winner' else 'still searching' end outcome, count(*) n, round(avg(w), 4) mean_w, round(avg(n), 6) mean_n from pairs where st = 'O' and st1 in ('P','O') group by 1""")
def outcome_compare(s: S, d: str) -> D:
    rows = pairs(s, d).where("st = 'O' and st1 in ('P', 'O')")
    return rows.groupBy(F.when(F.col("st1") == "P", "winner").otherwise("still searching").alias("outcome")).agg(F.count("*").alias("n"), r(F.avg("w"), 4).alias("mean_w"), r(F.avg("n")).alias("mean_n"))


@query(f"""with {PANEL}, a as (select *, lag(st) over (partition by id order by t) prev, lag(n) over (partition by id order by t) n0 from panel)
select prev, count(*) n, round(count(*) / sum(count(*)) over (), 6) share, round(avg((n0 > 1)::int), 6) from_search from a where st = 'P' and prev is not null and prev <> 'P' group by 1""")
def new_entrant_origin(s: S, d: str) -> D:
    w = Window.partitionBy("id").orderBy("t")
    rows = panel(s, d).withColumns({"prev": F.lag("st").over(w), "n0": F.lag("n").over(w)}).where("st = 'P' and prev is not null and prev <> 'P'")
    by = rows.groupBy("prev").agg(F.count("*").alias("n"), r(F.avg((F.col("n0") > 1).cast("int"))).alias("from_search"))
    return by.select("prev", "n", r(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"), "from_search")


@query(f"""{COUNTS}, x as (select *, sum(n) over () tot from c)
select o st, d st1, n, round(sum(n) over (order by o, d rows between unbounded preceding and 1 preceding) / tot, 6) y0_raw, round(n / tot, 6) height,
round((sum(n) over (partition by d order by o) - n) / tot, 6) inner0 from x""")
def sankey_layout(s: S, d: str) -> D:
    """Ribbon positions of a flow plot: where each starts on either side, and its height. The input is nine rows."""
    m = tr.shares(_matrix(s, d), "st")
    every = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(every)
    above = F.sum("n").over(every.orderBy("st", "st1").rowsBetween(Window.unboundedPreceding, -1))
    inner = F.sum("n").over(Window.partitionBy("st1").orderBy("st")) - F.col("n")
    return m.select("st", "st1", "n", r(above / total).alias("y0_raw"), r(F.col("n") / total).alias("height"), r(inner / total).alias("inner0"))
