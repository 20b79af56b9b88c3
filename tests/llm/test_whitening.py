"""Operator 13 against numpy and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from panelmill.llm import whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("_x", T.StringType()), T.StructField("n", T.StringType()) , T.StructField("label", T.IntegerType())])


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", "clash", None) for i, v in enumerate(vectors)], SCHEMA)


def check(spark, vectors, components=4, kept=None):
    got = {}
    for r in whitening.whiten(table(spark, vectors), components).collect():
        assert (r.vec_id, r.component) not in got
        got[r.vec_id, r.component] = r
    kept = [i for i in range(len(vectors)) if i in kept] if kept is not None else list(range(len(vectors)))
    xs = {i: [math.floor(256 * float(np.float32(c))) for c in vectors[i]] for i in kept}
    fit = sorted({tuple(x) for x in xs.values()})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    mean = np.array(sums) / n
    y = np.array(fit, float) - mean
    values, vectors_ = np.linalg.eigh(y.T @ y / n)
    assert {i for i, _ in got} == set(kept) and len(got) == len(kept) * min(components, d)
    for c in range(1, min(components, d) + 1):
        e, v = values[-c], vectors_[:, -c]
        rows = [got[i, c] for i in kept]
        want = np.array([(np.array(xs[i]) - mean) @ v for i in kept]) / math.sqrt(e)
        found = np.array([r.whitened for r in rows])
        assert min(np.abs(found - want).max(), np.abs(found + want).max()) < 1e-8
        assert all(abs(r.explained - e / values.sum()) < 1e-9 and r.identity_error < 1e-9 and r.n == n for r in rows)
    for i in kept:
        assert got[i, 1].deviation == sum((n * a - s) ** 2 for a, s in zip(xs[i], sums))


def test_against_numpy_with_copies_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    scale = np.array([5.0, 3, 2, 1.2, 0.4, 0.1])
    good = [[float(c) for c in v] for v in rng.normal(size=(300, 6)) * scale + 2]
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0, 5.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1e30] * 6, [1.0, 2.0], [-0.0] * 6]
    vectors = good + bad + [good[0]] * 500  # one vector holds most rows
    check(spark, vectors, kept={*range(300), len(good) + len(bad) - 1, *range(len(good) + len(bad), len(vectors))})


def test_more_components_than_dimensions(spark):
    check(spark, [[float(i % 7), float(i % 5)] for i in range(50)])


def test_deviation_beyond_a_long_is_null_and_large_ones_are_exact(spark):
    rows = whitening.whiten(table(spark, [[0.0, 1e12], [1e12, 0.0], [3.0, 2.0]]), 1).collect()
    assert all(r.deviation is None for r in rows)
    check(spark, [[9e5, 1.0], [1.0, 5e5], [3.0, 2.0]], 2)  # beyond the vectorised bound in part


def test_no_scatter_and_no_rows(spark):
    rows = whitening.whiten(table(spark, [[1.0, 2.0]] * 3), 2).collect()
    assert len(rows) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 1 for r in rows)
    line = whitening.whiten(table(spark, [[1.0, 2.0], [2.0, 4.0], [4.0, 8.0]]), 2).collect()
    assert {r.component for r in line if r.whitened is None} == {2} and all(r.identity_error < 1e-9 for r in line)
    for vectors in ([], [None, []]):
        assert whitening.whiten(table(spark, vectors)).collect() == []


def test_the_embeddings_table(spark, sf):
    vectors = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    check(spark, vectors)
