"""Operator 12 against plain counting."""

from __future__ import annotations

import random
import re
import tracemalloc
import weakref
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from panelmill.llm import collocation

from .conftest import ODD

SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("a", T.StringType())])


def brute(data, max_words, least, top, part=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = Counter(), Counter()
    for text, lang in data:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    longest = {}
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longest[lang, p[i : i + k]] = max(longest.get((lang, p[i : i + k]), 0), a)
    out = {}
    for (lang, p), a in candidates.items():
        if 100 * longest.get((lang, p), 0) >= part * a and (lang, p) in longest:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1)}


def got(spark, data, **more):
    df = spark.createDataFrame([(t, lang, "clash", "clash") for t, lang in data], SCHEMA).repartition(3)
    found = collocation.collocations(df, **more).collect()
    out = {tuple(r) for r in found}
    assert len(out) == len(found)
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "é", "日本", "cc", "d'e", "\xa0", "of", "x-y", " "]
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " ", "  ", "\t", ". ", "\n", "\x0b", ","]) for _ in range(rng.randrange(60)))
        yield text, rng.choice(["en", "en", "en", None, "", "de"])


@pytest.mark.parametrize("max_words, least, top", [(3, 10, 2000), (2, 3, 7), (5, 4, 2000), (4, 10, 15)])
def test_phrases_equal_plain_counting(spark, max_words, least, top):
    data = [*corpus(max_words, 200), *[(t, "en") for t in ODD], *[("New York City . new york", "en")] * 12]
    assert got(spark, data, max_words=max_words, least=least, top=top) == brute(data, max_words, least, top)


def test_shards_and_a_full_filter_change_nothing(spark, monkeypatch):
    data = [*corpus(9, 150)]
    expected = brute(data, 3, 5, 2000)
    monkeypatch.setattr(collocation, "SHARD_WORDS", 40)
    monkeypatch.setattr(collocation, "FILTER_BYTES", 8)  # nearly all bits are set
    assert got(spark, data, least=5) == expected


@pytest.mark.parametrize("data", [[], [(None, None)], [("", "en"), ("one two three", "en")]], ids=["empty", "null", "rare"])
def test_nothing_to_find(spark, data):
    assert got(spark, data) == set()


def test_large_products_are_exact(spark):
    """Counts of which the products pass 64 bits, scored as the plan scores them."""
    a, l, r = 9_000_000_000_019, 9_000_000_000_033, 9_000_000_000_057
    row = spark.range(1).selectExpr(f"{a}L a", f"{l}L l", f"{r}L r")
    product = collocation.F.lit(1_000_000).cast("decimal(7,0)") * collocation._exact("a") * collocation._exact("a")
    found = row.withColumns({"_p": product, "_q": collocation._exact("l") * collocation._exact("r")}).selectExpr("_p div _q s").first().s
    assert found == int(Fraction(1_000_000 * a * a, l * r))


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_suffix_order_and_common_prefixes(depth):
    rng = np.random.default_rng(depth)
    ids = rng.integers(0, 3, 400)
    room = np.concatenate([np.arange(n, 0, -1) for n in (1, 50, 49, 3, 297)])
    order = collocation.suffix_array(ids, room, depth)
    common = collocation.common_prefixes(ids, room, order, depth)
    seen = [tuple(ids[i : i + min(depth, room[i])]) for i in order]
    assert sorted(order) == list(range(400)) and seen == sorted(seen)
    for i in range(1, 400):
        same = 0
        while same < min(len(seen[i]), len(seen[i - 1])) and seen[i][same] == seen[i - 1][same]:
            same += 1
        assert common[i] == same
    for k in range(1, depth + 1):
        at, counts = collocation.intervals(room, order, common, k)
        grams = Counter(tuple(ids[i : i + k]) for i in range(400) if room[i] >= k)
        assert {tuple(ids[i : i + k]): n for i, n in zip(at, counts)} == grams


def test_no_hash_table_of_a_task_beside_its_worker(spark):
    """Rows of the workers go to the shuffle as they are; what holds a hash table comes after it."""
    counted = spark.createDataFrame([(7, 1), (7, 2), (8, 1)], "_h long, _n int")
    summed = collocation.summed(counted, "_h")
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" in plan.split("Exchange")[0] and "Aggregate" not in plan.split("Exchange")[1]
    assert {tuple(r) for r in summed.collect()} == {(7, 3), (8, 1)}


def test_both_passes_deal_rows_out_before_they_are_summed(spark, monkeypatch):
    keys = []
    monkeypatch.setattr(collocation, "summed", lambda df, *by, f=collocation.summed: (keys.append(by), f(df, *by))[1])
    data = [*corpus(4, 60)]
    assert got(spark, data, least=5) == brute(data, 3, 5, 2000)
    assert keys == [("_h",), ("lang", "phrase", "_k")]


def test_parts_of_a_shard_go_before_it_is_used(monkeypatch):
    alive, words = [], collocation._words

    def followed(batch):
        found = words(batch)
        alive.extend(weakref.ref(x) for x in found)
        return found

    monkeypatch.setattr(collocation, "_words", followed)
    batch = pa.RecordBatch.from_pydict({"text": ["one two three four. five"] * 30, "lang": ["en", None, "de"] * 10})
    n = 0
    for shard in collocation.shards([batch] * 4, 150):
        assert alive and not any(x() is not None for x in alive)
        n += len(shard.starts)
    assert n == 4 * 30 * 5


def test_filter_reaches_the_driver_as_bytes(spark):
    """Many blocks, every bit in its place, and no object a word on the driver, also without Arrow (Spark's default)."""
    hashes = np.random.default_rng(5).integers(-(2**63), 2**63, 200_000)
    keys = spark.createDataFrame(pd.DataFrame({"_h": hashes})).repartition(4)
    setting = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    tracemalloc.start()
    try:
        words = collocation._filter(keys)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set(setting, before)
    assert len(words) > 4 * collocation.BLOCK and most < 8 * words.nbytes
    at = np.concatenate([hashes.view(np.uint64) >> np.uint64(20 * i % 33) & np.uint64(len(words) * 64 - 1) for i in range(collocation.PROBES)])
    wanted = np.zeros(len(words) * 64, bool)
    wanted[at] = True
    assert np.array_equal(np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool), wanted)
    assert collocation._passes(words, hashes.view(np.uint64)).all()
