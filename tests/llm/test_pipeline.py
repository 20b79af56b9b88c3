"""The pipeline's stages against plain Python over each stage's own input."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelmill.llm.common import stash

from .conftest import ODD, rows
from .test_texts import base, brute_components, norm


def collect(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality_rules", "exact_copies", "near_copies", "pack"]

    found = stash(stages["language_id"](spark, docs, sf), "t1")
    assert found.columns == columns and collect(found).keys() == {i for i, r in collect(docs).items() if re.search(r"[^\W\d_]", r.text)}

    good = stash(stages["quality_rules"](spark, found, sf), "t2")
    kept, before = collect(good), collect(found)
    for i, r in before.items():
        b = base(r.text)
        if b[0] < 20 or 100 * b[4] > 30 * b[0]:
            assert i not in kept
    assert all(kept[i] == before[i] for i in kept) and good.columns == columns

    unique = stash(stages["exact_copies"](spark, good, sf), "t3")
    first = {}
    for i in sorted(kept):
        first.setdefault(norm(kept[i].text), i)
    assert collect(unique).keys() == set(first.values()) and unique.columns == columns

    apart = stash(stages["near_copies"](spark, unique, sf), "t4")
    ids = sorted(collect(unique))
    texts = [collect(unique)[i].text for i in ids]
    assert collect(apart).keys() == {ids[i] for i, _, c in brute_components(texts, 5, 80) if c == i}

    packed = stages["pack"](spark, apart, sf).toPandas()
    assert set(packed.doc_id) == set(collect(apart)) and packed.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("data", [[], ODD, rows(["a b c"] * 5) + rows(["a b c"])], ids=["empty", "odd", "repeated"])
def test_stages_stand_odd_tables(spark, make, data):
    docs = make(data)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stash(stage(spark, docs, ""), name)
        kept = docs.collect()
        if name != "pack":
            # extra columns, also those named like an operator's own, come out value by value
            extra = [c for c in before.columns if c != "lang"]
            given = {tuple(r[c] for c in extra) for r in before.collect()}
            assert docs.dtypes == before.dtypes and {tuple(r[c] for c in extra) for r in kept} <= given


@pytest.mark.parametrize("name", ["language_id", "quality_rules", "exact_copies", "near_copies"])
def test_values_of_clashing_columns_pass(spark, make, name):
    text = " ".join(f"word number{i} of a plain text" for i in range(12))
    docs = make([(i, f"{text} {i} ends{i} here{i * 7}.", "en", "s", 3, "gone", "own", "mine", "long") for i in range(3)])
    docs = docs.withColumns({"lang_pred": F.lit("p"), "bits_per_byte": F.lit("b"), "_row": F.lit("r"), "a.b": F.lit("dot"), "_d": F.lit("d"), "kept": F.lit("k"), "n_shingles": F.lit("n")})
    rows_ = dict(corpus_pipeline.STAGES)[name](spark, docs, "").collect()
    assert rows_ and all((r.score, r.lang_pred, r.bits_per_byte, r._row, r["a.b"], r._d, r.kept, r.n_shingles, r._id, r._gone, r.length) == ("mine", "p", "b", "r", "dot", "d", "k", "n", "own", "gone", "long") for r in rows_)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_a_written_table_is_counted_once(spark, make):
    """Rows, bytes for a broadcast, and whether anything moved are known from the writing: each job passes the driver's memory."""
    from panelmill.llm import common, jaccard

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("written", "written")
    try:
        table, none = stash(make(["é", None, "abc"]).select("doc_id", "text"), "t"), stash(make([]).select("doc_id", "text"), "t")
        before = len(tracker.getJobIdsForGroup("written"))
        assert (common.rows(table), common.held(table, 10), common.rows(none), common.held(none)) == (3, 35, 0, 0)
        common.small(table)
        assert len(tracker.getJobIdsForGroup("written")) == before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert common.held(table.where("doc_id < 2"), 10) == 22
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21)], "_a long, _b long")
    assert dict(jaccard.components(edges, 0).collect()) == {i: 1 for i in range(1, 10)} | {20: 20, 21: 20}
    chain = spark.createDataFrame([(i, max(1, i - 1)) for i in range(1, 12)], "_id long, _parent long")
    assert dict(jaccard.roots(chain, 0).collect()) == {i: 1 for i in range(1, 12)}
