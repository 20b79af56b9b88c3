"""Small worked examples with results known by hand, and the null rules."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions import numeric, text, wkt
from panelmill.operators import clean, estimate, panel, profiles, registry, transitions, weighted
from panelmill.operators.states import StateSpace, labour_states
from panelmill.sources import readers, sinks

PANEL = [("a", 1, "U"), ("a", 2, "R"), ("a", 4, "P"), ("a", 5, "P"), ("b", 1, "R"), ("b", 2, "R"), ("b", 6, "U"), (None, 1, "U"), (None, 2, "P")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(PANEL, "id string, t int, s string").cache()


def got(df, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in df.collect()}


def test_consecutive_lead(rows):
    out = got(panel.consecutive_lead(rows, "id", "t", ["s"]).where("id is not null"), "id", "t", "s_next")
    assert out == {("a", 1): "R", ("a", 2): None, ("a", 4): "P", ("a", 5): None, ("b", 1): "R", ("b", 2): None, ("b", 6): None}
    assert not panel.consecutive_lead(rows, "id", "t", ["s"]).where("id is null and s_next is not null").count()


def test_row_lead_needs_all_rows_between_but_time_lead_does_not(rows):
    assert panel.row_lead(rows, "id", "t", ["s"], 4, "4").where("s4 is not null").count() == 0
    out = got(panel.time_lead(rows, "id", "t", ["s"], 4, "4").where("s4 is not null"), "id", "t", "s4")
    assert out == {("a", 1): "P", ("b", 2): "U"}


def test_matrix_is_complete_and_rows_sum_to_one_or_zero(rows):
    m = transitions.shares(transitions.counts(panel.consecutive_lead(rows, "id", "t", ["s"]), "s", "s_next", ["U", "P", "R"]), "s")
    cells = got(m, "s", "s_next", "n")
    assert len(cells) == 9 and {k: v for k, v in cells.items() if v} == {("U", "R"): 1, ("P", "P"): 1, ("R", "R"): 1}
    sums = got(m.groupBy("s").agg(F.sum("row_share").alias("x")), "s", "x")
    assert set(sums.values()) <= {0.0, 1.0}


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in (1, 2, 3, 4)], "x double, w double")
    mid = weighted.quantile_midpoint(df, "x", "w", (0.1, 0.5, 0.9)).first()
    assert [round(v, 6) for v in mid] == [1.333333, 3.142857, 4.0]
    assert list(weighted.quantile_reach(df, "x", "w", (0.1, 0.3, 0.5, 0.9)).first()) == [1, 2, 3, 4]
    assert list(weighted.quantile_exceed(df, "x", "w", (0.1, 0.3, 0.5, 0.9)).first()) == [1.5, 2.5, 3, 4]


def test_weights_missing_or_zero_drop_rows_but_count_one_in_matrices(spark):
    df = spark.createDataFrame([(1.0, 1.0), (5.0, None), (7.0, 0.0), (None, 2.0)], "x double, w double")
    assert tuple(weighted.mean_by(df, "x", "w").first()) == (1.0, 1, 1.0)
    pairs = spark.createDataFrame([("U", "P", None), ("U", "P", 2.0)], "a string, b string, w double")
    assert got(transitions.counts(pairs, "a", "b", ["U", "P"], F.col("w")), "a", "b", "n")["U", "P"] == 3.0


def test_bins(spark):
    df = spark.createDataFrame([(13.0,), (14.0,), (24.0,), (-1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(clean.bin_left(F.col("x"), [0, 14, 24, 34], ["0-14", "15-24", "25-34", "35+"])).collect()] == ["0-14", "15-24", "25-34", None, None]
    df = spark.createDataFrame([(1000.0,), (1000.01,), (0.0,)], "x double")
    assert [r[0] for r in df.select(clean.bin_right(F.col("x"), [0, 1000], ["first", "second"])).collect()] == ["first", "second", None]


def test_flags_are_never_null(spark):
    df = spark.createDataFrame([("1",), ("Unemployed",), (None,), ("NaN",)], "x string")
    assert [tuple(r) for r in df.select(clean.code_or_label("x", 1, "employed"), clean.code_or_label("x", 1, None), clean.regex_flag("x", "^1$")).collect()] == [(1, 1, 1), (1, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_states_take_the_first_rule(spark):
    df = spark.createDataFrame([(1, 1, 6), (1, 2, 6), (2, None, None), (None, None, 9), (1, 1, 3)], "f int, o int, c int")
    states = labour_states(F.col("f"), F.col("o"), F.col("c"))
    assert [r[0] for r in df.select(states.column()).collect()] == ["public", "unemployed", "out", "own_account", "private"]
    assert [r[0] for r in df.select(labour_states(F.col("f"), F.col("o"), F.col("c"), "v1").column()).collect()][0] == "own_account"
    assert StateSpace({"a": F.col("f") == 1}, "rest", F.col("c").isNotNull()).states == ["a", "rest"]


def test_hazards(spark):
    rows = [("U", "U", 0.533), ("U", "P", 0.028), ("U", "R", 0.439), ("P", "P", 1.0), ("P", "U", 0.0), ("R", "U", 1.0), ("R", "R", 0.0)]
    out = got(estimate.hazards(spark.createDataFrame(rows, "o string, d string, p double"), "o", "d", "p"), "o", "d", "rate")
    assert round(out["U", "P"], 6) == 0.037727 and round(out["U", "R"], 6) == 0.591507
    assert out["P", "U"] == 0 and out["R", "U"] is None


P = np.array([[0.533, 0.028, 0.439], [0.012, 0.904, 0.084], [0.034, 0.018, 0.948]])
Q = np.array([[-0.647352, 0.033655, 0.613697], [0.014870, -0.102014, 0.087144], [0.047502, 0.018823, -0.066324]])


def test_matrix_log_and_exponential():
    assert np.allclose(numeric.logm(P), Q, atol=1e-6)
    assert np.allclose(numeric.expm(numeric.logm(P)), P, atol=1e-12)


def test_likelihood_generator_agrees_with_the_logarithm():
    assert np.allclose(estimate.generator_mle(P * 1e6), Q, atol=1e-3)


def test_grouped_exponential():
    assert round(numeric.grouped_exponential([20, 300, 500, 4000], [0, 1 / 12, 1, 2]), 6) == pytest.approx(0.0920566, abs=1e-4)


def test_offers_from_taken_ones():
    a = numeric.offers_from_taken(8.0, 0.25, 0.4)
    assert [round(v, 4) for v in (a.sigma, a.mu, a.reservation(), a.mean(), a.taken_mean())] == [0.8954, 7.1352, 1575.009, 1874.3974, 3465.6762]
    assert round(numeric.offers_from_taken(7.5, 0.2, 0.7).taken_mean(), 4) == 2022.7768
    for mean, var, share, said in ((8.0, 0.25, 1.2, "offer rate"), (8.0, 0.0, 0.4, "pool more"), (8.0, 0.25, 0.0, "offer rate")):
        with pytest.raises(ValueError, match=said):
            numeric.offers_from_taken(mean, var, share)


@pytest.mark.parametrize("share", [0.02, 0.3, 0.9, 0.999])
def test_offers_have_the_moments_they_were_solved_for(share):
    """Numerically: the logs of the upper share of the offers found have the mean and variance asked for."""
    found = numeric.offers_from_taken(7.0, 0.09, share)
    z = np.linspace(found.cut, found.cut + 40, 2_000_001)
    weight = np.exp(-z * z / 2 + found.cut**2 / 2)
    x = found.mu + found.sigma * z
    mean = (x * weight).sum() / weight.sum()
    assert mean == pytest.approx(7.0, abs=1e-4) and ((x - mean) ** 2 * weight).sum() / weight.sum() == pytest.approx(0.09, rel=1e-3)


def test_truncation_point():
    assert round(numeric.truncation_point(8.5, 8, 0.6), 4) == 8.0331
    assert numeric.truncation_point(7.9, 8, 0.6) is None


def test_centroid(spark):
    text_ = "MULTIPOLYGON (((0 0, 4 0, 4 2, 0 2, 0 0)), ((9 9, 10 9, 10 10, 9 9)))"
    row = spark.createDataFrame([(text_,)], "w string").select(wkt.centroid(F.col("w")).alias("c"), F.transform(wkt.rings(F.col("w")), F.size).alias("n")).first()
    assert tuple(row.c) == (8.0, 2.0, 1.0) and row.n == [5, 4]


def test_promotion():
    kinds = {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "time": T.TimestampType()}
    cases = {("int", "int"): "int", ("int", "float"): "float", ("int", "str"): "str", ("time", "int"): "str", ("time", "time"): "time"}
    assert all(clean.promote(kinds[a], kinds[b]) == kinds[c] for (a, b), c in cases.items())


def test_canonical_names(spark):
    assert [clean.canonical_name(n) for n in ("v4010", "vd4009", "Vd3004", "valor")] == ["V4010", "VD4009", "VD3004", "valor"]
    with pytest.raises(ValueError):
        clean.canonicalise(spark.createDataFrame([(1, 2)], "v1 int, a int").withColumnsRenamed({"a": "V1 "}).toDF("v1", "V1"))


def test_funnel_is_monotone(spark):
    rows = [(9, 40, 1015, 1, 10, 11), (9, 30, 1015, 1, 10, 11), (8, 40, 1015, 1, 10, 11), (10, 44, 9999, 1, 10, 11), (11, 36, 2062, 1, None, 12), (9, 99, 1015, 1, 10, 11), (9, 40, 2194, 0, 10, 11), (9, 40, 2062, 1, None, None)]
    df = spark.createDataFrame(rows, "deg int, h int, nj int, act int, trab int, reg int")
    steps = {
        "degree": F.col("deg").isin(9, 10, 11), "full": (F.col("h") >= 36) & (F.col("h") != 99), "legal": F.col("nj") != 9999,
        "active": F.col("act") == 1, "place": F.coalesce("trab", "reg").isNotNull(),
    }
    assert [r["n"] for r in registry.funnel(df, steps).orderBy("step").collect()] == [8, 7, 5, 4, 3, 2]
    kept = registry.apply_filters(df, steps).withColumn("pub", registry.is_public(F.col("nj"), 2038, (2194, 2208, 2275)))
    assert sorted(r["pub"] for r in kept.collect()) == [0, 1]
    total = registry.shares_by(kept.withColumn("k", F.col("reg")), "k", "pub", total=True).where("k is null").first()
    assert (total["n"], total["n_public"], total["share_public"]) == (2, 1, 0.5)


def test_checks_raise(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError):
        clean.many_to_one(df, df.withColumnRenamed("v", "w"), "k")
    with pytest.raises(ValueError):
        clean.gate(df, F.col("k") > 5, "none")
    with pytest.raises(ValueError):
        clean.require(df, ["k", "z"])


def test_winsorised_values_stay_within_bounds(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").cast("double").alias("x"))
    out = weighted.winsorise(df, "x", 0.01, 0.99, "g")
    assert out.agg(F.min("x"), F.max("x")).first()[0] > 0 and out.agg(F.max("x")).first()[0] < 999


def test_residuals_have_no_slope_left(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("x"), (3 * F.col("id") + F.sin("id")).alias("y"))
    out, r2 = estimate.residualise(df, "y", ["x"], "adj")
    assert r2 > 0.99 and abs(out.select(F.regr_slope("adj", "x")).first()[0]) < 1e-6


def test_histogram_integrates_to_one(spark):
    df = spark.range(500).select((F.col("id") / 10.0).alias("x"))
    assert profiles.histogram(df, "x", 0.0, 40.0, 8).select(F.sum(F.col("density") * 5.0)).first()[0] == pytest.approx(1)


def test_sources(spark, tmp_path):
    (tmp_path / "survey_2016.csv").write_text("a,b\n1,2\n")
    (tmp_path / "survey_2017.csv").write_text("")
    (tmp_path / "survey_sample_2017.csv").write_text("a\n1\n")
    with pytest.raises(FileNotFoundError):
        readers.discover(spark, str(tmp_path), "survey", [2016, 2017])
    assert list(readers.discover(spark, str(tmp_path), "survey", [2016])) == [2016]
    good, bad = readers.usable_files(spark, [tmp_path / "survey_2016.csv", tmp_path / "survey_2017.csv", tmp_path / "no.csv"], ["b"])
    assert len(good) == 1 and sorted(bad.values()) == ["empty", "missing"]
    df = spark.read.option("header", True).csv(str(tmp_path / "survey_2016.csv")).select("a", readers.year_of().alias("y"))
    assert tuple(df.first()) == ("1", 2016)


def test_guarded_sink_and_cache(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_once(spark.range(3), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_once(spark.range(3), path)
    calls = []
    for _ in range(2):
        out = readers.cached(spark, str(tmp_path / "c"), lambda: calls.append(1) or spark.range(2))
    assert out.count() == 2 and calls == [1]
    # what a broken job left is neither read nor replaced unasked
    (tmp_path / "c" / "_SUCCESS").unlink()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        readers.cached(spark, str(tmp_path / "c"), lambda: spark.range(3))
    assert readers.cached(spark, str(tmp_path / "c"), lambda: spark.range(3), rebuild=True).count() == 3


def test_discovery_prefers_tables_and_reads_quoted_headers(spark, tmp_path):
    (tmp_path / "s_2019.csv").write_text('\ufeff"a","b, c"\n1,2\n', encoding="utf-8")
    spark.range(2).write.parquet(str(tmp_path / "s_2019.parquet"))
    (tmp_path / "s_sample_2020.csv").write_text("a\n1\n")
    (tmp_path / "s_2020.csv").write_text("a\n1\n")
    found = readers.discover(spark, str(tmp_path), "s", [2019, 2020])
    assert [p.rsplit("/", 1)[1] for p in found.values()] == ["s_2019.parquet", "s_2020.csv"]
    good, bad = readers.usable_files(spark, [tmp_path / "s_2019.csv", tmp_path / "s_2020.csv"], ["a", "b, c"])
    assert len(good) == 1 and list(bad.values()) == ["lacks ['b, c']"]
    assert readers.listing(spark, str(tmp_path / "nothing")) == []


def test_extract_by_parts_skips_what_is_there(spark, tmp_path):
    df = spark.createDataFrame([("01", 1), ("01", 2), ("02", 3), ("a b", 4), (None, 5)], "state string, x int")
    path = str(tmp_path / "parts")
    first = sinks.extract_parts(df, "state", path, ["01", "03"])
    assert sorted(map(tuple, first.collect())) == [("01", "written", 2), ("03", "empty", 0)]
    again = sinks.extract_parts(df.where("x <> 2"), "state", path, ["01", "02", "a b"])
    assert sorted(map(tuple, again.collect())) == [("01", "skipped", 2), ("02", "written", 1), ("a b", "written", 1)]
    none = sinks.extract_parts(df.where("false"), "state", str(tmp_path / "none"), ["01"])
    assert list(map(tuple, none.collect())) == [("01", "empty", 0)]


def test_report_formats(spark):
    import pandas as pd

    assert "50\\% \\& more" in sinks.latex_table(pd.DataFrame({"g": ["50% & more"], "x": [1.5]}), "t_1")
    assert list(sinks.stata_names(["a" * 40, "a" * 41]).values()) == ["a" * 32, "a" * 30 + "_1"]
    long = sinks.long_results(spark.range(4), [], {"n": F.count("*"), "mean": F.avg("id")})
    assert {r["statistic"]: r["value"] for r in long.collect()} == {"n": 4.0, "mean": 1.5}


def test_text(spark):
    row = spark.createDataFrame([("É ção",)], "x string").select(text.strip_accents(F.col("x")), text.normalise(F.col("x")), text.replace_all(F.lit("ab a"), {"a": "1", "ab": "2"})).first()
    assert tuple(row) == ("E cao", "é ção", "2 1")
    assert text.year_ranges("2016-2018, 2020") == [2016, 2017, 2018, 2020]
    with pytest.raises(ValueError):
        text.year_ranges("2019-2016")


def test_positions_of_all_rows_with_a_third_in_one_person(spark):
    from panelmill.operators import panel as pan

    data = [(None if i % 7 == 0 else 3 if i % 3 == 0 else i % 50, i * 37 % 101, i) for i in range(3000)]
    out = pan.positions(spark.createDataFrame(data, "id int, t int, k int"), [F.col("id"), F.col("t"), F.col("k")]).collect()
    want = sorted(data, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))
    assert [tuple(r)[:3] for r in sorted(out, key=lambda r: r.pos)] == want and sorted(r.pos for r in out) == list(range(1, 3001))
    assert pan.positions(spark.createDataFrame([], "id int, t int"), [F.col("id"), F.col("t")]).collect() == []


def test_a_thousand_ranges_of_bounded_size(spark):
    df = spark.range(40_000).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("k"), "id")
    out = panel.positions(df, [F.col("k"), F.col("id")], range_rows=40)
    want = [r.id for r in df.orderBy("k", "id").collect()]
    assert [r.id for r in out.orderBy("pos").collect()] == want and out.where("pos < 1 or pos > 40000").isEmpty()


@pytest.mark.parametrize("bracket, parts", [(1_000_000, 4096), (3, 4)])
def test_block_quantiles_equal_brute_force(spark, monkeypatch, bracket, parts):
    """One group with most rows, ties, negative values, an unnamed group, missing values and weights; and no rows. Small brackets are split again."""
    monkeypatch.setattr(weighted, "BRACKET_ROWS", bracket)
    monkeypatch.setattr(weighted, "PARTS", parts)
    rng = np.random.default_rng(3)
    rows = [(["a", "a", "a", "b", None][rng.integers(5)], float(round(rng.normal() * 10 ** rng.integers(0, 4), int(rng.integers(0, 3)))), float(rng.integers(1, 9))) for _ in range(900)]
    rows += [("a", None, 1.0), ("b", 4.0, None), ("b", 5.0, 0.0), ("c", 7.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    ps = (0.0, 0.013, 0.25, 0.5, 0.9, 1.0)
    linear = {v[0]: v[1:] for v in weighted.quantile_linear(df, "x", ps, "g").collect()}
    middle = {v[0]: v[1:] for v in weighted.quantile_midpoint(df, "x", "w", ps, "g").collect()}
    for g in ("a", "b", "c", None):
        x = np.array([v for k, v, _ in rows if k == g and v is not None])
        assert np.allclose(linear[g], np.quantile(x, ps))
        pairs = np.array(sorted((v, w) for k, v, w in rows if k == g and v is not None and w))
        m = (pairs[:, 1].cumsum() - pairs[:, 1] / 2) / pairs[:, 1].sum()
        assert np.allclose(middle[g], np.interp(ps, m, pairs[:, 0]))
    # reach and exceed by their definitions
    for f, first in ((weighted.quantile_reach, lambda cum, aim: cum >= aim), (weighted.quantile_exceed, lambda cum, aim: cum > aim + 1e-6)):
        found = {v[0]: v[1:] for v in f(df, "x", "w", (0.013, 0.25, 0.9), "g").collect()}
        for g in ("a", "b", "c", None):
            pairs = sorted((v, w) for k, v, w in rows if k == g and v is not None and w)
            total = sum(w for _, w in pairs)
            for p, value in zip((0.013, 0.25, 0.9), found[g]):
                cum, at = 0.0, None
                for v, w in pairs:
                    cum += w
                    if abs(cum - p * total) < 1e-9 and f is weighted.quantile_exceed:
                        at = "tie"
                        break
                    if first(cum, p * total):
                        at = v
                        break
                assert at == "tie" or at == value, (f.__name__, g, p)
    every = [v for _, v, _ in rows if v is not None]
    assert np.allclose(list(weighted.quantile_linear(df, "x", ps).first()), np.quantile(every, ps))
    assert weighted.quantile_linear(df.where("false"), "x", ps, "g").collect() == []


def test_sample_ids_by_hash_bins_is_the_first_share_of_all_ids(spark):
    import hashlib

    df = spark.range(5000).selectExpr("id % 1777 as k")
    want = sorted(range(1777), key=lambda k: hashlib.md5(f"{k}_42".encode()).hexdigest())
    for share in (0.0, 0.1, 1.0):
        assert {v.k for v in panel.sample_ids(df, "k", share).collect()} == set(want[: max(1, int(1777 * share + 0.5))])
    assert panel.sample_ids(df.where("false"), "k", 0.1).collect() == []


def test_quantiles_of_lognormal_values_with_narrow_brackets(spark, monkeypatch):
    monkeypatch.setattr(weighted, "BRACKET_ROWS", 20)
    monkeypatch.setattr(weighted, "PARTS", 8)
    values = np.random.default_rng(8).lognormal(8, 0.01, 20_000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    ps = (0.01, 0.5, 0.75, 0.99)
    assert np.allclose(list(weighted.quantile_linear(df, "x", ps).first()), np.quantile(values, ps), rtol=1e-12)
