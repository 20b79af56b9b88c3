"""Operator 11 against all pairs, and its parts against their definitions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from panelmill.llm import jaccard, minhash, queries
from panelmill.llm.common import stash

from .conftest import ODD, rows
from .test_texts import brute_components


def got(df, n, percent):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, n, percent).collect()}


def want(texts, n, percent):
    return {i: (size, c, c == i) for i, size, c in brute_components(texts, n, percent)}


def family(rng, size, words, edits):
    """Texts about one centre that is not among them, so that no hub links with all."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(size):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80), (1, 50)])
def test_components_equal_all_pairs(make, n, percent):
    rng = random.Random(n)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(12))) for _ in range(60)]
    for words, edits in ((9, 1), (30, 1), (80, 2), (80, 4), (200, 6)):
        texts += family(rng, 14, words, edits)
    texts += texts[:40] + ODD
    assert got(make(texts), n, percent) == want(texts, n, percent)


def test_crowds_whose_centre_is_not_among_them(make, monkeypatch):
    rng = random.Random(5)
    texts = [x for edits in (2, 3, 4) for x in family(rng, 60, 60, edits)]
    monkeypatch.setattr(jaccard, "SMALL_GROUP", 4)
    assert got(make(texts), 3, 85) == want(texts, 3, 85)


def test_later_rounds_look_up_set_and_hub_at_once(make, monkeypatch):
    """Neither the far sets' other buckets nor the other sets of their hubs' buckets are made on the way to a later round."""
    plans = []
    real = jaccard.stash

    def noting(df, name):
        if name == "rows":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(jaccard, "stash", noting)
    monkeypatch.setattr(jaccard, "SMALL_GROUP", 4)
    rng = random.Random(8)
    common = [f"c{i}" for i in range(12)]
    texts = [" ".join(common + [f"w{g}-{i}" for i in range(30)][: rng.randrange(5, 30)]) for g in range(12) for _ in range(6)]
    assert got(make(texts), 1, 50) == want(texts, 1, 50)
    assert plans and all([("_id" in x, "_hub" in x) for x in plan.split("\n") if "Join" in x] == [(True, True)] for plan in plans)


def test_labels_of_few_sets_are_not_shuffled(make, monkeypatch):
    """Joins with a row a set are broadcasts while a count allows it: with many partitions each shuffle costs seconds."""
    joins = []
    real = jaccard.stash

    def noting(df, name):
        if name in ("best", "groups", "near", "labels"):
            joins.extend(x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
        return real(df, name)

    monkeypatch.setattr(jaccard, "stash", noting)
    texts = list(family(random.Random(9), 8, 60, 2))
    assert got(make(texts), 3, 85) == want(texts, 3, 85)
    hinted = [x for x in joins if "strategy=broadcast" in x]
    assert hinted and all("strategy=broadcast" in x or "_hub2" in x for x in joins)


def test_star_edges_are_linear(make, monkeypatch):
    """A group of near copies costs about one comparison a text, not one a pair."""
    compared = []
    real = jaccard._compare

    def counting(pairs, *more):
        pairs = stash(pairs, "pairs")
        compared.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(jaccard, "_compare", counting)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(300)]
    texts = [" ".join(base)] + [" ".join(f"e{rng.randrange(10**6)}" if i == k else w for i, w in enumerate(base)) for k in range(150)]
    assert {c for _, c, _ in got(make(texts), 3, 85).values()} == {0} and sum(compared) <= 4 * len(texts)


def test_repeated_rows_and_nothing(make, empty):
    assert got(make(rows(["a b c d", "a b c d e"]) + rows(["a b c d", "a b c d e"])), 3, 85) == {0: (2, 0, True), 1: (3, 1, True)}
    assert got(empty, 3, 85) == {} and minhash.keep_one(empty).columns == empty.columns


def test_keep_one_passes_other_columns(make):
    kept = minhash.keep_one(make(["a b c d e f", "A b c  d e f", "x"])).collect()
    assert [(r.doc_id, r.score, r._id) for r in sorted(kept)] == [(0, "s", "i"), (2, "s", "i")]


@pytest.mark.parametrize("sizes", [(6, 7), (40, 44), (400, 440)])
def test_bins_agree_as_often_as_the_sets_are_similar(sizes):
    """Small sets have mostly empty bins: densification must keep them apart from a mere shift."""
    rng = np.random.default_rng(1)
    trials, bins = 400, 216
    agree = []
    for _ in range(trials):
        y = rng.integers(0, 1 << 63, sizes[1]).astype(np.uint64)
        x = y[: sizes[0]]
        values = minhash.signatures(np.repeat([0, 1], sizes), np.concatenate([x, y]), 2, bins, 7)
        agree.append((values[0] == values[1]).mean())
    assert abs(np.mean(agree) - sizes[0] / sizes[1]) < 0.02


@pytest.mark.parametrize("percent", [30, 50, 80, 85, 95, 100])
def test_bands_miss_as_seldom_as_stated(percent):
    r, bands = minhash.bands_of(percent)
    assert (1 - (min(percent, 99) / 100) ** r) ** bands <= minhash.MISS and r * bands < 40_000


def test_densified_bins_are_filled_and_empty_sets_stay_empty():
    values = minhash.signatures(np.array([0, 0, 2]), np.array([5, 9, 11], np.uint64), 3, 50, 3)
    assert (values[1] == minhash._EMPTY).all() and len(np.unique(values[0])) == 2 and len(np.unique(values[2])) == 1


def test_query_has_its_contract(spark, sf):
    assert queries.op11_minhash(spark, sf).dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
