"""Multinomial splitting: the chain against its definition and the distribution it must have."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.operators import resample


def brute_quantile(u, m, q):
    below = 0.0
    for k in range(m + 1):
        below += math.comb(m, k) * q**k * (1 - q) ** (m - k)
        if below >= u:
            return k
    return m


@pytest.mark.parametrize("m, q", [(0, 0.3), (1, 0.5), (7, 0.01), (40, 0.97), (200, 0.5)])
def test_binomial_quantile_is_the_least_k(m, q):
    u = np.random.default_rng(m).uniform(size=200)
    got = resample.binomial_quantile(u, np.full(200, m), q)
    assert got.tolist() == [brute_quantile(x, m, q) for x in u]


def test_binomials_of_large_numbers():
    u = (np.arange(2000) + 0.5) / 2000
    got = resample.binomial_quantile(u, np.full(2000, 10**7), 0.3)
    assert abs(got.mean() - 3e6) < 100 and abs(got.std() - math.sqrt(10**7 * 0.21)) < 30 and (np.diff(got) >= 0).all()
    assert resample.binomial_quantile(np.array([0.2]), np.array([9]), 1.0).tolist() == [9]


def test_dealt_multiplicities_are_multinomial():
    weights = np.array([1, 0, 5, 2, 2])
    times = resample.deal(np.full(4000, 10), weights, np.arange(4000), "t")
    assert (times.sum(axis=0) == 10).all() and not times[1].any()
    p = weights / 10
    assert np.allclose(times.mean(axis=1), 10 * p, atol=0.1)
    assert np.allclose(np.cov(times), 10 * (np.diag(p) - np.outer(p, p)), atol=0.15)


@pytest.mark.parametrize("cells", [2_000_000, 400])
def test_every_resample_has_as_many_people(spark, cells):
    stats = spark.range(300).selectExpr("1 as one", "cast(id % 40 as double) as x", "if(id % 3 = 0, null, id) as y")
    rows = resample.cluster_bootstrap(stats, ["one", "x", "y"], 60, cells).collect()
    assert sorted(r.b for r in rows) == list(range(60)) and {r.one for r in rows} == {300}
    assert abs(np.mean([r.x for r in rows]) / sum(i % 40 for i in range(300)) - 1) < 0.02 and len({r.x for r in rows}) > 40
    again = resample.cluster_bootstrap(stats, ["one", "x", "y"], 60, cells).collect()
    assert {r.b: (r.x, r.y) for r in again} == {r.b: (r.x, r.y) for r in rows}


def test_nobody_to_draw(spark):
    assert resample.cluster_bootstrap(spark.range(0).selectExpr("id as x"), ["x"], 5).collect() == []
    assert resample.winsorised_bootstrap(spark.range(0).selectExpr("id as x"), "x", 5, 0.05, 0.95).collect() == []


@pytest.mark.parametrize("n", [1, 2, 57, 400])
def test_winsorised_means_and_medians_of_the_dealt_values(spark, n):
    """One bucket, so the multiplicities can be dealt again by hand; then many buckets, whose resamples differ but not in kind."""
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(100, 20, n), 1)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    found = {r.b: (r.median, r["mean"]) for r in resample.winsorised_bootstrap(df, "x", 40, 0.05, 0.95).collect()}
    distinct, counts = np.unique(values, return_counts=True)
    times = resample.deal(np.full(40, n), counts, np.arange(40), 0)
    for b in range(40):
        drawn = np.repeat(distinct, times[:, b])
        low, mid, high = np.quantile(drawn, (0.05, 0.5, 0.95))
        assert np.allclose(found[b], (mid, np.clip(drawn, low, high).mean()))
    many = resample.winsorised_bootstrap(df, "x", 40, 0.05, 0.95, cells=400).collect()
    assert len(many) == 40 and abs(np.mean([r["mean"] for r in many]) - values.mean()) < 20 / math.sqrt(n) + 1e-9


def dealt_by_hand(values, replications):
    distinct, counts = np.unique(values, return_counts=True)
    times = resample.deal(np.full(replications, len(values)), counts, np.arange(replications), 0)
    return [np.repeat(distinct, times[:, b]) for b in range(replications)]


@pytest.mark.parametrize("cells, batch", [(resample.CELLS, 10_000), (400, 10_000), (2_500, 7)])
def test_resamples_follow_one_chain_however_the_work_is_cut(spark, cells, batch):
    """More values than are dealt at once, and more replications than a task has."""
    values = np.round(np.random.default_rng(8).normal(100, 20, 900), 1)
    drawn = dealt_by_hand(values, 120)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(batch))
    try:
        df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(5)
        found = {r.b: (r.median, r["mean"]) for r in resample.winsorised_bootstrap(df, "x", 120, 0.05, 0.95, cells).collect()}
        sums = {r.b: (r.one, r.x) for r in resample.cluster_bootstrap(df.selectExpr("1 as one", "x"), ["x", "one"], 120, cells).collect()}
    finally:
        spark.conf.set(setting, before)
    assert found.keys() == sums.keys() == set(range(120))
    for b, x in enumerate(drawn):
        low, mid, high = np.quantile(x, (0.05, 0.5, 0.95))
        assert np.allclose(found[b], (mid, np.clip(x, low, high).mean())) and np.allclose(sums[b], (900, x.sum()))


def test_many_values_are_dealt_as_the_sql_deals_them(spark):
    import duckdb

    from panelmill.plans import estimation

    values = np.round(np.random.default_rng(2).normal(100, 20, 500), 2)
    con = duckdb.connect()
    con.register("customer", pd.DataFrame({"c_nationkey": 3, "c_acctbal": values}))
    sql = f"with recursive {estimation._chain(estimation.VALUES, 60)}) select b, sum(x * v) from chain join cl using (i) group by 1"
    got = resample.cluster_bootstrap(spark.createDataFrame(pd.DataFrame({"x": values})), ["x"], 60, cells=2_000)
    got = {r.b: round(r.x, 6) for r in got.collect()}
    assert got == {b: round(x, 6) for b, x in con.execute(sql).fetchall()}


def test_quantiles_of_replications_are_those_of_the_sql_to_the_bit(spark):
    """Half cents at 0.05 and 0.95 of 2,000 are half-way cases of four digits."""
    import duckdb

    from panelmill.operators import profiles
    from panelmill.plans.base import r_double

    rng, con = np.random.default_rng(3), duckdb.connect()
    frame = pd.DataFrame({"g": np.repeat(np.arange(200), 300), "v": rng.integers(-200_000, 2_000_000, 60_000) / 200})
    got = spark.createDataFrame(frame).groupBy("g").agg(profiles.quantiles(F.col("v"), 0.05, 0.5, 0.95).alias("q"))
    got = {x.g: tuple(x)[1:] for x in got.select("g", *[F.col("q")[i] for i in range(3)], *[r_double(F.col("q")[i], 4) for i in range(3)]).collect()}
    con.register("frame", frame)
    sql = ", ".join(f"quantile_cont(v, {p})" for p in (0.05, 0.5, 0.95)) + ", " + ", ".join(f"round(quantile_cont(v, {p}), 4)" for p in (0.05, 0.5, 0.95))
    assert got == {x[0]: x[1:] for x in con.execute(f"select g, {sql} from frame group by g").fetchall()}
    none = spark.createDataFrame([(None,)], "v double").agg(profiles.quantiles(F.col("v"), 0.5).alias("q")).first().q
    assert none == [None]
