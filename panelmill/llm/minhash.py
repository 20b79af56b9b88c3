"""Operator 11: near-duplicates by one-permutation MinHash with optimal densification, banded buckets and star edges.

**Signatures.** One hash deals a set's shingles to bins and another ranks them; a bin's value is its least rank. An empty bin takes
the value of the first filled one in a hashed order of bins that depends on the bin alone (optimal densification), so the
bins of two sets agree with a probability near their similarity, for small sets too. Bands of r bins give a set's buckets, by the
least similarity (``bands_of``): at 0.85 there are 36 bands of 6, so two sets of similarity s share none with probability
(1 - s^6)^36, 4e-8 at s = 0.85.

**Stars.** Equal sets are one node beforehand. A bucket's sets are compared with its hub alone, the set whose buckets hold most others,
so a bucket of any size gives one edge a set, and a group of near copies costs about one comparison each. What is not connected after that is
joined as in operator 8, which has the same problem once its signatures are there: pairs of small groups, and in crowds
those that prefixes of the sets' differences from a hub, the rarest first, cannot rule out. This is exact; no bucket is capped.

Each pair is checked by a lower bound of its distance (parity bits) and then by whole texts, so no link is false; one that
shares no bucket is missed with the probability above, however many sets there are.

Defined cases: a text of fewer words than n is one shingle, a null or wordless text is the empty set and links with nothing; repeated
rows are equal sets; ids name texts (rows with one id must have one text); a text of any length is one set in one task's
memory; extra columns of any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, free_worker, mix, own_name, rows as rows_of, small, small_batches, stash, without
from .jaccard import _among, _connect, _lists, _parity, _type, shingle_sets

#: How often, about, two sets at the least similarity agree on a band; and how often they may share no bucket.
AGREE, MISS = 0.38, 4e-8
#: Bins tried for an empty one before it takes the next filled one.
TRIES = 256
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(rows: np.ndarray, found: np.ndarray, n: int, bins: int, seed: int) -> np.ndarray:
    """One-permutation signatures (n x bins) of sets given as rows and shingle hashes; a set without shingles has ``_EMPTY``."""
    h = mix(found + np.uint64(seed))
    at = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    values = np.full((n, bins), _EMPTY)
    np.minimum.at(values.reshape(-1), rows * bins + at, mix(h))
    filled = values != _EMPTY
    some = filled.any(axis=1)
    left_row, left_bin = np.nonzero(~filled & some[:, None])
    for attempt in range(TRIES):
        if not len(left_row):
            break
        donor = (mix(left_bin.astype(np.uint64) + np.uint64((attempt + 1) << 32)) % np.uint64(bins)).astype(np.int64)
        got = filled[left_row, donor]
        values[left_row[got], left_bin[got]] = values[left_row[got], donor[got]]
        left_row, left_bin = left_row[~got], left_bin[~got]
    if len(left_row):  # the next filled bin, around the end
        twice = np.concatenate([filled, filled], axis=1)
        place = np.where(twice, np.arange(2 * bins), 2 * bins)
        following = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1] % bins
        values[left_row, left_bin] = values[left_row, following[left_row, left_bin]]
    return values


def buckets(values: np.ndarray, r: int) -> np.ndarray:
    """The key of each band (n x bands)."""
    bands = values.shape[1] // r
    keys = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), (len(values), bands))
    for i in range(r):
        keys = mix(keys * np.uint64(0xC2B2AE3D27D4EB4F) + values[:, i::r])
    return keys


def bands_of(percent: int) -> tuple[int, int]:
    """Bins of a band (r) and number of bands: at a similarity of s, (1 - s^r)^bands is at most ``MISS``."""
    s = min(percent, 99) / 100
    r = max(1, round(math.log(AGREE) / math.log(s)))
    return r, math.ceil(math.log(MISS) / math.log1p(-(s**r)))


def least_size(percent: int) -> int:
    """Smaller sets link with equal ones alone (100 percent: all sets)."""
    return -(-100 // (100 - percent)) - 1 if percent < 100 else 1 << 62


def _keys(rows: np.ndarray, found: np.ndarray, sizes: np.ndarray, percent: int) -> pa.ListArray:
    r, bands = bands_of(percent)
    use = sizes >= least_size(percent)
    place = np.cumsum(use) - 1
    mine = use[rows]
    values = signatures(place[rows[mine]], found[mine], int(use.sum()), r * bands, 0x1F83D9ABFB41BD6B)
    return _lists(buckets(values, r).reshape(-1), np.where(use, bands, 0))


def _batches(batches: Iterable[pa.RecordBatch], n_words: int):
    free_worker()
    for batch in small_batches(batches, "text", 1 << 19):
        rows, found = shingle_sets(batch.column("text"), n_words)
        yield batch, rows, found, np.bincount(rows, minlength=batch.num_rows)


def _describe(df: DataFrame, n_words: int, percent: int) -> DataFrame:
    """id, n_shingles, two hashes of the set, and its buckets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, found, sizes in _batches(batches, n_words):
            columns = [batch.column("_id"), pa.array(sizes.astype(np.int64))]
            for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
                total = np.zeros(len(sizes), np.uint64)
                np.add.at(total, rows, mix(found ^ np.uint64(salt)))
                columns.append(pa.array(total.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*columns, _keys(rows, found, sizes, percent)], ["_id", "n_shingles", "_k1", "_k2", "_sigs"])

    return df.mapInArrow(run, f"_id {_type(df)}, n_shingles long, _k1 long, _k2 long, _sigs array<long>")


def _profiles(df: DataFrame, n_words: int) -> DataFrame:
    """id, text, size and parity bits of the set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, found, sizes in _batches(batches, n_words):
            columns = [batch.column("_id"), batch.column("text"), pa.array(sizes.astype(np.int32)), _parity(rows, found, sizes)]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "text", "_n", "_bits"])

    return df.mapInArrow(run, f"_id {_type(df)}, text string, _n int, _bits array<long>")


def _bucket_rows(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_sig, _id, _w) of buckets with two sets or more, from (_id, _sigs); _w: how many sets stand in a set's buckets; and the _id of
    those sets. Written tables."""
    rows = sets.select(F.explode("_sigs").alias("_sig"), "_id")
    sizes = rows.groupBy("_sig").count().where("count > 1")
    shared = stash(rows.join(sizes, "_sig"), "shared")
    weights = stash(shared.groupBy("_id").agg(F.sum("count").alias("_w")), "weights")
    out = stash(shared.join(small(weights), "_id").select("_sig", "_id", "_w"), "buckets")
    drop(shared)
    return out, weights.select("_id")


def near_duplicates(df: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id (the smallest id that links lead to), kept (that is its own)."""
    own_name(id_col, "n_shingles", "component_id", "kept")
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    described = stash(_describe(texts, n_words, percent), "described")
    keys = ["n_shingles", "_k1", "_k2"]
    # equal sets have equal buckets: those of one stand for all, and no list of buckets is shuffled
    nodes = stash(described.where("n_shingles > 0").groupBy(*keys).agg(F.min("_id").alias("_node")), "nodes")
    repeated = described.select("_id").distinct().count() < rows_of(described)
    firsts = _among(described.select("_id", "_sigs"), nodes.select(F.col("_node").alias("_id")))
    rows, ids = _bucket_rows(firsts.dropDuplicates(["_id"]) if repeated else firsts)
    wanted = _among(texts, ids)
    profiles = stash(_profiles(wanted.dropDuplicates(["_id"]) if repeated else wanted, n_words), "profiles")
    labels = _connect(rows, profiles, n_words, percent)
    for done in (rows, profiles):
        drop(done)
    least = labels.groupBy("_c").agg(F.min("_id").alias("_least"))
    found = labels.join(least, "_c").select(F.col("_id").alias("_node"), "_least")
    whole = described.select("_id", *keys).join(nodes, keys, "left").join(found, "_node", "left")
    component = F.coalesce("_least", "_node", "_id")
    return whole.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept"))


def keep_one(df: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose set stands for its group, with all their columns."""
    return without(df, near_duplicates(df, n_words, percent, id_col, text_col).where(~F.col("kept")), id_col)
