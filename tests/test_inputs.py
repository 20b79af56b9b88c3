"""Sources and sinks: what fails stays out, what is committed is whole, counts travel with the rows."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.operators import clean, estimate, profiles, registry
from panelmill.sources import readers, sinks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_part_of_three_fails_and_the_others_are_committed(spark, tmp_path):
    df = spark.createDataFrame([("AC", 1), ("AC", 5), ("SP", 2), ("DF", 3)], "uf string, x int")
    path, asked, broken = str(tmp_path / "out"), [], {"SP"}

    def read(part):
        asked.append(part)
        rows = df.where(F.col("uf") == part)
        return rows.withColumn("y", F.raise_error(F.lit("gone"))) if part in broken else rows

    def report(**more):
        return {r.part: (r.status, r.n_rows, r.n_must) for r in sinks.extract_each(spark, read, ["AC", "SP", "DF"], path, must=F.col("x") > 1, **more).collect()}

    assert report() == {"AC": ("written", 2, 1), "SP": ("failed", None, None), "DF": ("written", 1, 1)}
    assert sorted(os.listdir(path)) == ["AC", "DF"]  # nothing half-written, no staging folder
    asked.clear()
    assert report(retries=2)["SP"][0] == "failed" and asked == ["SP"] * 3
    broken.clear()
    assert report() == {"AC": ("skipped", None, None), "SP": ("written", 1, 1), "DF": ("skipped", None, None)}
    assert sorted(os.listdir(path)) == ["AC", "DF", "SP"] and spark.read.parquet(f"{path}/SP").count() == 1
    said = sinks.extract_each(spark, lambda p: 1 / 0, ["X"], path).first()
    assert said.status == "failed" and "ZeroDivisionError" in said.error


def test_commit_replaces_only_when_the_new_table_is_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.commit(spark.range(5), path, counts={"odd": F.col("id") % 2 == 1}) == {"n": 5, "odd": 2}
    with pytest.raises(FileExistsError):
        sinks.commit(spark.range(3), path)
    with pytest.raises(Exception, match="gone"):
        sinks.commit(spark.range(3).select(F.raise_error(F.lit("gone")).alias("id")), path, overwrite=True)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["t"]
    assert sinks.commit(spark.range(3), path, overwrite=True)["n"] == 3
    assert spark.read.parquet(path).count() == 3 and os.listdir(tmp_path) == ["t"]
    assert sinks.commit(spark.range(0), str(tmp_path / "e"))["n"] == 0


def test_what_cannot_be_read_back_is_not_committed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "Observation", lambda: type("Seen", (), {"get": {"n": 99}})())
    rows = spark.range(4)
    monkeypatch.setattr(type(rows), "observe", lambda self, *_: self)
    with pytest.raises(sinks.Half):
        sinks.commit(rows, str(tmp_path / "t"))
    assert os.listdir(tmp_path) == []


def test_filters_and_columns_reach_the_warehouse(spark):
    url, driver = "jdbc:derby:memory:plans;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(1000).selectExpr("id", "id % 5 as ano", "'x' as text").write.format("jdbc").options(url=url, dbtable="t", createTableColumnTypes="text VARCHAR(9)", **driver).save()
    store = readers.read_warehouse(spark, url, "t", "id", partition_rows=100, **driver)
    year = store.where("ano = 3").select("id")
    assert store.rdd.getNumPartitions() == 10 and year.count() == 200
    text = plan(year)
    assert "EqualTo(ano,3)" in text and "text" not in text.lower().split("readschema")[1]
    empty = readers.read_warehouse(spark, url, "(select * from t where 1 = 0) e", "id", **driver)
    assert empty.count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("X", (), {"master": "spark://somewhere", "getConf": staticmethod(lambda: Cluster.conf)})

    with pytest.raises(ValueError, match="checkpoint"):
        readers.scratch(Cluster, "x")


def test_csv_by_name_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿B,a,extra\nx,1,9\ny,bad,9\n", encoding="utf-8")
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), spark.createDataFrame([], "a int, b string, none double").schema)
    assert [tuple(r) for r in rows.collect()] == [(1, "x", None), (None, "y", None)]
    (tmp_path / "l.csv").write_bytes("nome,é\nSão,1\n".encode("latin-1"))
    assert [tuple(r) for r in readers.read_text_columns(spark, str(tmp_path / "l.csv"), "ISO-8859-1").collect()] == [("São", "1")]


# --- counts beside the rows ------------------------------------------------------------


def test_unmatched_rows_are_counted_in_the_scan_of_the_matched(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("k"))
    places = spark.read.parquet(f"{sf}/supplier.parquet").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    kept, seen = clean.matched(lines, places, "k")
    assert plan(kept).count("lineitem.parquet") == 1
    n = kept.count()
    assert seen.get == {"n": lines.count(), "n_unmatched": lines.count() - n} and n == lines.join(places, "k").count()


def test_observed_filters_equal_the_funnel(spark):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 7 != 0, F.col("id") % 10))
    steps = {"small": F.col("x") < 8, "even": F.col("id") % 2 == 0}
    kept, seen = registry.observed_filters(df, steps)
    n = kept.count()
    funnel = {r.name: r.n for r in registry.funnel(df, steps).collect()}
    assert seen.get == funnel and funnel["even"] == n


def test_look_up_reads_the_lines_once(spark, sf):
    from panelmill import catalog

    assert plan(catalog.queries()["region_lookup_join"](spark, sf)).count("lineitem.parquet") == 1


# --- labels -----------------------------------------------------------------------------


@pytest.mark.parametrize("most", [200_000, 0])
def test_decode_base_and_lagged_columns(spark, monkeypatch, most):
    monkeypatch.setattr(clean, "MOST_LABELS", most)
    labels = spark.createDataFrame([("SEX", "1", "man"), ("sex", "1.0", "male"), ("sex", " 2 ", "woman"), ("kind", "a", "A kind"), ("sex", None, "no"), ("other", "1", "x")], "nome_coluna string, chave string, valor string")
    df = spark.createDataFrame([(1, 2.0, None, "a"), (3, None, 1, " b ")], "sex int, sex_t1 double, sex_f1 int, kind string")
    plain = clean.decode(df, labels, ["sex", "sex_t1", "sex_f1", "kind"])
    assert [tuple(r)[4:] for r in plain.orderBy("sex").collect()] == [("male", "woman", None, "A kind"), (None, None, "male", None)]
    back = clean.decode(df, labels, ["sex", "kind"], "_shown", fallback=True)
    assert [tuple(r)[4:] for r in back.orderBy("sex").collect()] == [("male", "A kind"), ("3", " b ")]
    if most:
        assert plan(plain).count("BroadcastNestedLoopJoin") == 1  # one map for all columns
    assert clean.decode(df, labels.where("false"), ["sex"]).select("sex_label").distinct().collect()[0][0] is None


def test_labels_are_harvested_in_one_pass(spark):
    df = spark.createDataFrame([(1, "one", "x"), (1, "one", "y"), (2, None, "z")], "a int, a_label string, b_label string")
    assert [tuple(r) for r in clean.labels_of(df).collect()] == [("a", "1", "one")]
    assert clean.labels_of(df.select("a")).collect() == []


# --- regression, density, people ---------------------------------------------------------


@pytest.mark.parametrize("levels", [(3, 2), (25, 4)])
def test_categories_as_dummies_without_dummy_columns(spark, levels):
    rng = np.random.default_rng(5)
    n = 800
    cats = [rng.integers(0, k, n) for k in levels]
    x = rng.normal(size=n)
    y = 2 + 3 * x + cats[0] * 0.5 - (cats[1] == 1) * 2 + rng.normal(size=n) * 0.1
    rows = [(float(a), float(b), f"k{c}", int(e)) for a, b, c, e in zip(y, x, *cats)] + [(1.0, None, "k1", 1), (1.0, 1.0, None, 1), (float("nan"), 1.0, "k1", 1)]
    df = spark.createDataFrame(rows, "y double, x double, c string, e int")
    out, r2 = estimate.residualise(df, "y", ["x"], "adj", ["c", "e"])
    dummies = [(cats[i] == v).astype(float) for i in (0, 1) for v in sorted(set(cats[i]), key=lambda v: f"k{v}")[1:]]
    design = np.column_stack([np.ones(n), x, *dummies])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    want = y - design @ beta + (design @ beta).mean()
    got = {(round(r.y, 9), round(r.x, 9)): r.adj for r in out.collect()}
    assert len(got) == n and np.allclose([got[round(a, 9), round(b, 9)] for a, b in zip(y, x)], want, atol=1e-8)
    assert r2 == pytest.approx(1 - ((y - design @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    kept, _ = estimate.residualise(df, "y", ["x"], "adj", ["c", "e"], keep=True)
    assert kept.count() == n + 3 and kept.where("adj = y").count() >= 2


def test_too_many_levels_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(estimate, "MOST_COLUMNS", 5)
    df = spark.range(20).selectExpr("cast(id as double) y", "cast(id as string) c")
    with pytest.raises(ValueError, match="levels"):
        estimate.residualise(df, "y", [], "adj", ["c"])
    out, r2 = estimate.residualise(df.where("false"), "y", [], "adj")
    assert out.collect() == [] and np.isnan(r2)


@pytest.mark.parametrize("bandwidth", [None, 0.003, 5.0])
def test_density_equals_direct_sums(spark, bandwidth):
    rng = np.random.default_rng(11)
    x, w = np.concatenate([rng.normal(0, 1, 700), rng.normal(9, 0.2, 300)]), rng.integers(1, 9, 1000).astype(float)
    df = spark.createDataFrame([*zip(x.tolist(), w.tolist()), (None, 1.0), (0.0, 0.0), (float("nan"), 1.0)], "x double, w double")
    got = profiles.gaussian_density(df, "x", "w", 512, bandwidth).orderBy("x").toPandas()
    part = (w**2).sum() / w.sum() ** 2
    mean = np.average(x, weights=w)
    h = bandwidth or np.sqrt(np.average((x - mean) ** 2, weights=w) / (1 - part)) * (1 / part) ** -0.2
    grid = np.linspace(x.min(), x.max(), 512)
    want = (w * np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2)).sum(axis=1) / (w.sum() * h * np.sqrt(2 * np.pi))
    assert np.allclose(got.x, grid) and np.abs(got.density - want).max() < 1e-9 * want.max()


def test_no_density_of_few_rows_or_one_value(spark):
    few = spark.createDataFrame([(float(i), 1.0) for i in range(4)], "x double, w double")
    assert profiles.gaussian_density(few, "x", "w").collect() == []
    assert profiles.gaussian_density(few.withColumn("x", F.lit(2.0)), "x", "w", least=1).collect() == []
    assert profiles.gaussian_density(few.where("false"), "x", "w").collect() == []


def test_sketches_of_people_are_within_their_bound(spark):
    df = spark.range(60_000).select((F.col("id") % 20_011).alias("p"), (F.col("id") % 7).alias("s"), (F.col("id") % 3).alias("y"))
    groups = {"all": F.lit(True), "some": F.col("s") < 2, "one": F.col("s") == 6}
    exact = {r.group: (r.n_rows, r.n_people) for r in profiles.people(df, "p", groups).collect()}
    cells = profiles.people_sketches(df, "p", ["s"])
    for r in profiles.people_from_sketches(cells, groups).collect():
        n_rows, n_people = exact[r.group]
        assert r.n_rows == n_rows and abs(r.n_people / n_people - 1) < 3 * profiles.sketch_error(12)


def test_text_that_is_no_slip_stays(spark):
    from panelmill.functions import text

    whole = ["São Paulo", "日本語 ação", "plain", "", "naïve café", "𝒳 ÿ", None]
    broken = [w if w is None else w.encode().decode("latin-1") for w in whole]
    rows = spark.createDataFrame([*zip(whole, broken)], "w string, b string").select("w", text.repair_mojibake(F.col("b")).alias("r"), text.repair_mojibake(F.col("w")).alias("same")).collect()
    assert all(r.w == r.r and r.w == r.same for r in rows)
    letters = spark.createDataFrame([("Łódź Ǎşk Ñandú ế é", )], "x string").select(text.strip_accents(F.col("x"))).first()[0]
    assert letters == "Łodz Ask Nandu e e"


def test_warehouse_is_reached_from_executors(sf, tmp_path):
    """Executors that are processes of their own see the table (a database within the driver they did not)."""
    import subprocess
    import sys
    from pathlib import Path

    import duckdb

    code = f"""
from panelmill import catalog, session
s = session.build("t", "local-cluster[2,1,1024]", spark__ui__enabled="false", spark__sql__warehouse__dir="{tmp_path}/w", spark__checkpoint__dir="{tmp_path}/c", spark__executorEnv__PYTHONPATH=".")
df = catalog.queries()["warehouse_scan"](s, "{sf}")
print("rows", df.count(), "PartitionFilters: [isnotnull(ano" in df._jdf.queryExecution().toString())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=300)
    (n,) = duckdb.connect().execute(f"select count(*) from '{sf}/orders.parquet' where year(o_orderdate) = 1997 and o_orderstatus = 'F'").fetchone()
    assert f"rows {n} True" in done.stdout, done.stderr[-2000:]


def test_polygon_texts_are_taken_apart_once(spark, sf):
    from panelmill import catalog

    df = catalog.queries()["wkt_centroid"](spark, sf)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_centroid_far_from_the_origin(spark):
    from panelmill.functions import wkt

    far = "POLYGON ((59000000 0, 59000001 0, 59000001 901.37, 59000000 901.37, 59000000 0))"
    c = spark.createDataFrame([(far,)], "w string").select(wkt.measured(F.col("w")).alias("c")).first().c
    assert tuple(c) == (1, pytest.approx(901.37, rel=1e-12), pytest.approx(59000000.5, rel=1e-14), pytest.approx(450.685, rel=1e-12))
