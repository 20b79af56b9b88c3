"""Hazards, moments, regressions and bootstraps on top of panel aggregates."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import numeric
from ..operators import clean, estimate as es, profiles as pr, resample as rs, transitions as tr, weighted as wt
from .base import PANEL, STATES, panel, r, r_double, table
from .panels import COUNTS, NEXT, pairs

S, D = SparkSession, DataFrame


def _probs(s: S, d: str) -> D:
    return tr.shares(tr.counts(pairs(s, d), "st", "st1", STATES), "st")


def _matrix(s: S, d: str) -> np.ndarray:
    """The nine counts, on the driver."""
    cells = {(x["st"], x["st1"]): x["n"] for x in tr.counts(pairs(s, d), "st", "st1", STATES).collect()}
    return np.array([[cells[a, b] for b in STATES] for a in STATES], float)


def _frame(s: S, **matrices: np.ndarray) -> D:
    rows = [(a, b, *(float(m[i, j]) for m in matrices.values())) for i, a in enumerate(STATES) for j, b in enumerate(STATES)]
    return s.createDataFrame(rows, "st string, st1 string, " + ", ".join(f"{k} double" for k in matrices))


@query(f"""{COUNTS}, p as (select o, d, n / sum(n) over (partition by o) p from c), x as (select *, sum(case when o <> d then p else 0 end) over (partition by o) e from p)
select o st, d st1, round(case when o <> d then case when e > 0 then -ln(1 - e) * p / e else 0 end else ln(1 - e) end, 6) rate from x""")
def hazard_closed_form(s: S, d: str) -> D:
    return es.hazards(_probs(s, d), "st", "st1", "row_share").select("st", "st1", r(F.col("rate")).alias("rate"))


@query()
def hazard_mle(s: S, d: str) -> D:
    return _frame(s, rate=es.generator_mle(_matrix(s, d)))


@query()
def hazard_logm(s: S, d: str) -> D:
    m = _matrix(s, d)
    return _frame(s, rate=numeric.logm(m / m.sum(1, keepdims=True)))


@query()
def hazard_compare(s: S, d: str) -> D:
    """Flows as observed, by both routes to a generator, and as the likelihood's generator implies them."""
    m = _matrix(s, d)
    p = m / m.sum(1, keepdims=True)
    q = es.generator_mle(m)
    rows = _frame(s, observed=p, by_logm=numeric.logm(p), by_likelihood=q, implied=numeric.expm(q)).where("st <> st1")
    closed = es.hazards(_probs(s, d), "st", "st1", "row_share").select("st", "st1", F.col("rate").alias("closed_form"))
    return rows.join(closed, ["st", "st1"])


TENURE = f"with {PANEL}, a as (select st, t - min(t) over (partition by id) k from panel)"


def _tenure(s: S, d: str) -> D:
    from pyspark.sql import Window

    k = F.col("t") - F.min("t").over(Window.partitionBy("id"))
    bins = clean.bin_left(F.col("k"), [0, 1, 4, 8], ["0", "1-3", "4-7", "8+"])
    return panel(s, d).select("st", k.alias("k")).groupBy("st", bins.alias("band")).agg(F.count("*").alias("n"))


@query(f"{TENURE} select st, case when k < 1 then '0' when k < 4 then '1-3' when k < 8 then '4-7' else '8+' end band, count(*) n from a group by 1,2")
def tenure_bins(s: S, d: str) -> D:
    return _tenure(s, d)


@query(f"""{TENURE.replace("with ", "with recursive ", 1)}, n as (select st, count(*) filter (k < 1) n0, count(*) filter (k >= 1 and k < 4) n1, count(*) filter (k >= 4 and k < 8) n2, count(*) filter (k >= 8) n3, count(*) n from a group by 1),
step as (select st, n0, n1, n2, n3, -30.0::double lo, 5.0::double hi, 0 i from n where n >= 40 union all
  select st, n0, n1, n2, n3, case when slope > 0 then (lo + hi) / 2 else lo end, case when slope > 0 then hi else (lo + hi) / 2 end, i + 1 from (
    select *, n0 * exp(-x) / (1 - exp(-x)) + n1 * (4 * exp(-4*x) - exp(-x)) / (exp(-x) - exp(-4*x)) + n2 * (8 * exp(-8*x) - 4 * exp(-4*x)) / (exp(-4*x) - exp(-8*x)) - 8.0 * n3 slope
    from (select *, exp((lo + hi) / 2) x from step where i < 60)))
select st, round(exp((lo + hi) / 2), 5) rate from step where i = 60""")
def tenure_hazard(s: S, d: str) -> D:
    """Exponential rates from the tenure bins, for states of 40 and more."""
    found: dict[str, dict[str, int]] = {}
    for x in _tenure(s, d).collect():
        found.setdefault(x["st"], {})[x["band"]] = x["n"]
    rows = [(st, numeric.grouped_exponential([b.get(k, 0) for k in ("0", "1-3", "4-7", "8+")], [0, 1, 4, 8])) for st, b in sorted(found.items()) if sum(b.values()) >= 40]
    return s.createDataFrame(rows, "st string, rate double").withColumn("rate", r(F.col("rate"), 5))


GMM = f"""{NEXT} select round(avg((st1 = 'O')::int) filter (st = 'P' and st1 is not null), 6) delta_p, round(avg((st1 = 'O')::int) filter (st = 'F' and st1 is not null), 6) delta_f,
round(avg((st1 = 'P')::int) filter (st = 'O' and st1 is not null), 6) m_up, round(avg((st1 = 'F')::int) filter (st = 'O' and st1 is not null), 6) m_uf,
count(*) filter (st = 'O' and st1 = 'P') n_up, round(avg(ln(w1)) filter (st = 'O' and st1 = 'P'), 6) mean_log_up, round(var_pop(ln(w1)) filter (st = 'O' and st1 = 'P'), 6) var_log_up, min(w1) filter (st = 'O' and st1 = 'P') min_up,
count(*) filter (st = 'O' and st1 = 'F') n_uf, round(avg(ln(w1)) filter (st = 'O' and st1 = 'F'), 6) mean_log_uf, round(var_pop(ln(w1)) filter (st = 'O' and st1 = 'F'), 6) var_log_uf, min(w1) filter (st = 'O' and st1 = 'F') min_uf from pairs"""


def _moments(s: S, d: str) -> D:
    st, st1, w1 = F.col("st"), F.col("st1"), F.col("w1")
    rate = lambda a, b: F.avg(F.when((st == a) & st1.isNotNull(), (st1 == b).cast("int")))
    aggs = [rate("P", "O").alias("delta_p"), rate("F", "O").alias("delta_f"), rate("O", "P").alias("m_up"), rate("O", "F").alias("m_uf")]
    for to, name in (("P", "up"), ("F", "uf")):
        taken = (st == "O") & (st1 == to)
        x = F.when(taken, F.ln(w1))
        aggs += [F.count(F.when(taken, 1)).alias(f"n_{name}"), F.avg(x).alias(f"mean_log_{name}"), F.var_pop(x).alias(f"var_log_{name}"), F.min(F.when(taken, w1)).alias(f"min_{name}")]
    return pairs(s, d).agg(*aggs)


@query(GMM)
def gmm_moments(s: S, d: str) -> D:
    m = _moments(s, d)
    return m.select(*[c if c.startswith(("n_", "min_")) else r(F.col(c)).alias(c) for c in m.columns])


@query()
def gmm_grid(s: S, d: str) -> D:
    """Offer distributions for each (alpha, lambda); combinations that the moments rule out become status rows."""
    m = _moments(s, d).first().asDict()
    rows = []
    for alpha, rate in product((0.3, 0.5, 0.7), (0.8, 1.2, 2.0)):
        row: list = [alpha, rate]
        try:
            both = [numeric.offers_from_taken(m[f"mean_log_{k}"], m[f"var_log_{k}"], m[f"m_{k}"] / (rate * share)) for k, share in (("up", alpha), ("uf", 1 - alpha))]
            row += ["ok", *(v for x in both for v in (x.mu, x.sigma, x.reservation(), x.mean(), x.taken_mean())), both[1].reservation() - both[0].reservation()]
        except (ValueError, TypeError) as error:
            row += [str(error), *[None] * 11]
        rows.append(tuple(row))
    names = [f"{k}_{side}" for side in ("p", "f") for k in ("mu", "sigma", "reservation", "offer_mean", "accepted_mean")]
    return s.createDataFrame(rows, "alpha double, lambda double, status string, " + ", ".join(f"{n} double" for n in names) + ", gap double")


@query()
def threshold_by_bin(s: S, d: str) -> D:
    """Per wage bin the truncation point that gives the mean log wage of those who left for the public sector."""
    rows = pairs(s, d).where("st = 'F' and w > 0").withColumn("x", F.ln("w"))
    mu, sigma = rows.where("st1 = 'P'").agg(F.avg(F.ln("w1")), F.stddev_samp(F.ln("w1"))).first()
    q = wt.quantile_linear(rows, "x", [k / 20 for k in range(21)]).select(F.array_distinct(F.array(*[f"q{k}" for k in range(21)])).alias("edges"))
    k = F.greatest(F.lit(1), F.size(F.filter("edges", lambda v: v < F.col("x"))))
    bins = rows.crossJoin(F.broadcast(q)).where("st1 = 'P'").groupBy(k.cast("int").alias("bin")).agg(F.avg(F.ln("w1")).alias("m"), F.count("*").alias("n"))
    out = [(x["bin"], x["n"], x["m"], numeric.truncation_point(x["m"], mu, sigma) if sigma else None) for x in bins.orderBy("bin").collect()]
    return s.createDataFrame(out, "bin int, n long, mean_log double, threshold double")


@query("select l_returnflag g, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 4) intercept, round(regr_r2(l_extendedprice, l_quantity), 6) r2, count(*) n from lineitem group by 1")
def ols_slope(s: S, d: str) -> D:
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(r(F.regr_slope(y, x), 4).alias("slope"), r(F.regr_intercept(y, x), 4).alias("intercept"), r(F.regr_r2(y, x)).alias("r2"), F.count("*").alias("n"))


@query("""with a as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, ln(l_extendedprice) z, l_quantity q, l_quantity * l_quantity q2, s_nationkey k from lineitem join supplier on l_suppkey = s_suppkey where l_extendedprice > 0),
b as (select *, z - avg(z) over g dz, q - avg(q) over g d1, q2 - avg(q2) over g d2, avg(z) over () mean from a window g as (partition by k)),
s as (select sum(d1*d1) a11, sum(d1*d2) a12, sum(d2*d2) a22, sum(d1*dz) b1, sum(d2*dz) b2 from b)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(dz - d1 * (b1*a22 - b2*a12) / (a11*a22 - a12*a12) - d2 * (b2*a11 - b1*a12) / (a11*a22 - a12*a12) + mean, 4) adjusted from b, s""")
def residualize(s: S, d: str) -> D:
    """Log price net of quantity, its square and the supplier's nation, a factor whose levels the data name."""
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", clean.positive_log(F.col("l_extendedprice")).alias("y"), F.col("l_quantity").alias("q"), (F.col("l_quantity") ** 2).alias("q2"))
    rows = rows.join(table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")), "l_suppkey")
    done, _ = es.residualise(rows, "y", ["q", "q2"], "adjusted", ["nation"])
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(F.col("adjusted"), 4).alias("adjusted"))


#: Replications of the cluster bootstrap and draws of the belief bootstrap.
REPLICATIONS, DRAWS = 300, 2_000


def _chain(classes: str, replications: int) -> str:
    """SQL that deals each replication's n down the classes (i, c, w: number, size, sizes from here on): rows (b, i, x), x times class i.

    As ``operators.resample``: the least k whose binomial probability up to k reaches a hashed uniform.
    """
    return f"""cl as materialized ({classes}), size as (select sum(c)::bigint n, count(*) kk from cl),
chain as (select b, -1::bigint i, n m, 0::bigint x from (select unnest(range(0, {replications})) b), size
  union all
  select b, i, (m - x)::bigint, x from (
    select b, i, m, case when c = w then m when m = 0 then 0 else least(hi, lo + len(list_filter(range(1, len(ps) + 1), lambda z: list_sum(ps[1:z]) < u)))::bigint end x from (
      select *, list_transform(range(lo, hi + 1), lambda k: exp(lgamma(m + 1.0) - lgamma(k + 1.0) - lgamma(m - k + 1.0) + k * ln(q) + (m - k) * ln(1 - q))) ps from (
        select *, greatest(0, floor(m * q - reach))::bigint lo, least(m, ceil(m * q + reach))::bigint hi from (
          select *, 12 * sqrt(m * q * (1 - q)) + 12 reach from (
            select chain.b, cl.i, chain.m, cl.c, cl.w, case when cl.c = cl.w then 0.5 else cl.c / cl.w end q,
                   (('0x' || substr(md5(chain.b || '_0_' || cl.i), 1, 13))::ubigint::double + 0.5) / 4503599627370496 u
            from chain join cl on cl.i = chain.i + 1)))))"""


CLASSES = "select row_number() over (order by n_o, n_op) - 1 i, n_o, n_op, count(*) c, sum(count(*)) over (order by n_o desc, n_op desc) w from stats group by n_o, n_op"
BOOT = f"""{NEXT.replace("with ", "with recursive ", 1)}, stats as (select id, count(st1) filter (st = 'O') n_o, count(*) filter (st = 'O' and st1 = 'P') n_op from pairs group by 1),
{_chain(CLASSES, REPLICATIONS)}),
bs as (select b, sum(x * n_o)::bigint n_o, sum(x * n_op)::bigint n_op from chain join cl using (i) group by 1)"""


def _bootstrap(s: S, d: str) -> D:
    out, to = F.when((F.col("st") == "O") & F.col("st1").isNotNull(), 1), F.when((F.col("st") == "O") & (F.col("st1") == "P"), 1)
    stats = pairs(s, d).groupBy("id").agg(F.count(out).alias("n_o"), F.count(to).alias("n_op"))
    return rs.cluster_bootstrap(stats, ["n_o", "n_op"], REPLICATIONS)


@query(f"{BOOT} select b::bigint b, n_o, n_op, round(n_op / n_o, 6) rate from bs")
def cluster_bootstrap(s: S, d: str) -> D:
    """A flow's rate in 300 resamples of people."""
    return _bootstrap(s, d).select("b", "n_o", "n_op", r(F.col("n_op") / F.col("n_o")).alias("rate"))


@query(f"{BOOT}, x as (select n_op / n_o v from bs) select round(quantile_cont(v, 0.025), 6) lo, round(quantile_cont(v, 0.5), 6) mid, round(quantile_cont(v, 0.975), 6) hi from x")
def bootstrap_ci(s: S, d: str) -> D:
    q = _bootstrap(s, d).agg(pr.quantiles(F.col("n_op") / F.col("n_o"), 0.025, 0.5, 0.975).alias("q"))
    return q.select(*[r_double(F.col("q")[i]).alias(n) for i, n in enumerate(("lo", "mid", "hi"))])


VALUES = "select row_number() over (order by c_acctbal) - 1 i, c_acctbal v, count(*) c, sum(count(*)) over (order by c_acctbal desc) w from customer where c_nationkey = 3 group by c_acctbal"
BELIEF = f"""with recursive {_chain(VALUES, DRAWS)}),
e as (select b, v, x, sum(x) over (partition by b order by i) e from chain join cl using (i) where x > 0),
places as (select (n - 1) * 0.05 a, (n - 1) * 0.5 h, (n - 1) * 0.95 z, n from size),
q as (select b, n, floor(a) a0, floor(z) z0, min(case when e > floor(a) then v end) va, min(case when e > ceil(a) then v end) va1, min(case when e > floor(h) then v end) vh, min(case when e > ceil(h) then v end) vh1,
             min(case when e > floor(z) then v end) vz, min(case when e > ceil(z) then v end) vz1, sum(v * greatest(0, least(e, floor(z) + 1) - greatest(e - x, floor(a) + 1))) s, a, h, z from e, places group by all),
o as (select b, vh + (vh1 - vh) * (h - floor(h)) md, ((va + (va1 - va) * (a - a0)) * (a0 + 1) + s + (vz + (vz1 - vz) * (z - z0)) * (n - 1 - z0)) / n wm from (select b, any_value(n) n, any_value(a0) a0, any_value(z0) z0, any_value(a) a, any_value(h) h, any_value(z) z, min(va) va, min(va1) va1, min(vh) vh, min(vh1) vh1, min(vz) vz, min(vz1) vz1, sum(s) s from q group by b))"""


@query(f"{BELIEF} select round(quantile_cont(md, 0.05), 4) median_lo, round(quantile_cont(md, 0.95), 4) median_hi, round(quantile_cont(wm, 0.05), 4) mean_lo, round(quantile_cont(wm, 0.95), 4) mean_hi from o")
def belief_bootstrap(s: S, d: str) -> D:
    """Median and winsorised mean over 2,000 resamples of a small sample's values."""
    values = table(s, d, "customer").where("c_nationkey = 3").select("c_acctbal")
    each = rs.winsorised_bootstrap(values, "c_acctbal", DRAWS, 0.05, 0.95)
    out = each.agg(pr.quantiles(F.col("median"), 0.05, 0.95).alias("m"), pr.quantiles(F.col("mean"), 0.05, 0.95).alias("w"))
    return out.select(*[r_double(F.col(c)[i], 4).alias(n) for c, i, n in (("m", 0, "median_lo"), ("m", 1, "median_hi"), ("w", 0, "mean_lo"), ("w", 1, "mean_hi"))])
