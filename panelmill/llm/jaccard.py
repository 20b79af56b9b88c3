"""Operator 8: similarity join of word n-gram sets by PartEnum signatures.

Texts become sets of 64-bit shingle hashes; equal sets (two more 64-bit hashes agree) are one node from then on.
Beside those hashes nothing is approximate: every link is found, and every pair is compared by its whole texts.

**Signatures.** A pair belongs to a size band by the sum of both sizes; sets of a band that link differ in at most
k shingles. The band deals the shingle domain to n1 groups of n2 cells with n1 * (n2 - 2) > k, so in one group at
least three cells hold the same shingles in both sets. A set's signatures are its projections on the three-cell subsets
of each group; linked sets share one. A set is in at most two bands.

**Only what can match is enumerated.** A subset that holds a cell no other set has cannot be shared. So a first
pass ships (cell, id) alone and drops cells of one set; sets left with fewer cells in common than n - k are out
too, as a linked pair agrees on n - k cells. Signatures are enumerated from the cells that remain. Cells found
in many of a bounded sample of sets (``HOT_SAMPLE``) are dealt to salted keys; this changes speed only.

**Buckets.** The sets of one signature are compared with its hub, the set with the largest share of its cells in
common, so a group of near copies takes about one comparison each. Sets meet in hub groups from then on. Where a
group's sets are not yet all connected, pairs of small groups are compared; large groups with connected hubs are
joined around one of them, pairs are found by prefixes of the sets' differences from it, the rarest first
(``_candidates``), and sets far from it meet around other hubs in the next round. Each pair is checked by a lower bound of its distance (parity bits of
the cells of a finer partition), and what is left by the texts. No group or bucket is capped.

Spark does the grouping, counting and joining; Python only turns texts into hashes. Only tables of a checked
size are broadcast, beyond it they join by a shuffle.

Defined cases: a text of fewer words than n is one shingle, a null or wordless text is the empty set and
links with nothing; repeated rows are equal sets; ids name texts (rows with one id must have one text); a text of
any length is one set in one task's memory; extra columns of any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import apart, drop, fitting, free_worker, hash_spans, held, lower_ascii, mix, rows as rows_of, small, small_batches, stash, utf8, windows, word_spans

#: Cells of a group (n2); bands of small sets have smaller groups.
WIDE = 6
#: Bits of a cell's key for its group; six more tell bands apart, the rest is the hash of its shingles.
GROUP_BITS = 14
#: Cells in at least ``HOT_LEAST`` of about ``HOT_SAMPLE`` sets are salted ``SALTS``-fold.
HOT_SAMPLE, HOT_LEAST, SALTS = 4_000, 20, 64
#: Jaccard distance from a hub, in hundredths, up to which sets are found by their differences from it.
NEAR = 70
#: Rounds of hubs; sets far from a hub meet around others in the next.
ROUNDS = 3
#: In hub groups of up to this many sets all pairs that are not connected yet are compared: at most 16 for each row.
SMALL_GROUP = 32


class Bands:
    """Bands of the sum of two sets' sizes, and for each its k, n1 and n2. ``percent``: the least similarity, in hundredths."""

    def __init__(self, percent: int, most: int):
        low, tops = 2, []
        while not tops or tops[-1] < most + most * 100 // percent:
            tops.append(max(low, low * 10_000 // percent**2))
            low = tops[-1] + 1
        self.tops, self.percent = np.array(tops), percent
        self.k = self.tops * (100 - percent) // (100 + percent)
        self.n2 = np.minimum(WIDE, self.k + 3)
        self.n1 = -(-(self.k + 1) // (self.n2 - 2))
        self.n = self.n1 * self.n2

    def views(self, sizes: np.ndarray) -> list[np.ndarray]:
        """The bands of the smallest and of the largest possible partner; -1: none, the same, or one where only equal sets link."""
        first = np.searchsorted(self.tops, sizes - (-sizes * self.percent // 100))
        last = np.searchsorted(self.tops, sizes + sizes * 100 // self.percent)
        bands = [first, np.where(last > first, last, -1)]
        return [np.where((b >= 0) & (sizes > 0) & (self.k[b] > 0), b, -1) for b in bands]


def shingle_sets(texts: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, by row."""
    raw, offsets = utf8(texts)
    buf, at = apart(lower_ascii(raw), offsets)
    starts, ends = word_spans(buf)
    words = np.searchsorted(starts, at)
    counts = np.diff(words)
    row = np.repeat(np.arange(len(texts)), counts)
    h = hash_spans(buf, starts, ends)
    grams = windows(h, n_words)
    whole = np.flatnonzero(row[: len(grams)] == row[n_words - 1 :]) if len(grams) else np.zeros(0, np.int64)
    rows, found = [row[whole]], [grams[whole]]
    for k in range(1, n_words):  # short texts: all their words
        short = np.flatnonzero(counts == k)
        if len(short):
            rows.append(short)
            found.append(windows(h, k)[words[short]])
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(found, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    rows, found = rows[order], found[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    return rows[first], found[first]


class Cells:
    """The cells of each row's set in one band per row (-1: none): keys, owners and which hold shingles."""

    def __init__(self, rows: np.ndarray, found: np.ndarray, band: np.ndarray, bands: Bands):
        self.band, self.size = band, np.where(band >= 0, bands.n[band], 0)
        base = np.concatenate([[0], np.cumsum(self.size)])
        use = band[rows] >= 0
        r, g = rows[use], found[use]
        salt = mix(band.astype(np.uint64) + np.uint64(77))
        cell = base[r] + (mix(g ^ salt[r]) % np.maximum(self.size[r], 1).astype(np.uint64)).astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, cell, mix(g + np.uint64(0x632BE59BD9B4E019)))
        count = np.bincount(cell, minlength=base[-1])
        self.owner = np.repeat(np.arange(len(band)), self.size)
        place = np.arange(base[-1]) - base[self.owner]
        own = band[self.owner]
        h = mix(total + mix(count.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(20)) + salt[self.owner]))
        group = place // np.maximum(bands.n2[own], 1)
        self.key = self._key(own, group, h)
        self.filled = count > 0
        per_row = np.bincount(self.owner[self.filled], minlength=len(band))
        # how many filled cells a linked pair has in common at least
        self.need = np.where(band >= 0, per_row - bands.k[band], 0)
        # sets so uneven that agreeing on empty cells could suffice meet in one more key a band
        self.odd = np.flatnonzero((band >= 0) & (self.need <= 0))
        self.odd_key = self._key(band[self.odd], np.zeros(len(self.odd), np.int64), mix(salt[self.odd] ^ np.uint64(0x5851F42D4C957F2D)))
        self.need[self.odd] = 1

    @staticmethod
    def _key(band: np.ndarray, group: np.ndarray, h: np.ndarray) -> np.ndarray:
        tag = (band.astype(np.uint64) & np.uint64(63)) << np.uint64(GROUP_BITS) | group.astype(np.uint64) & np.uint64((1 << GROUP_BITS) - 1)
        return tag << np.uint64(58 - GROUP_BITS) | h >> np.uint64(6 + GROUP_BITS)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _parity(rows: np.ndarray, found: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """A set's parity bits: each shingle flips one of 2 to 4 bits a shingle, a power of two in number."""
    words = np.int64(1) << np.ceil(np.log2(np.maximum(sizes, 32) / 32)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(words)])
    at = mix(found + np.uint64(0x9E3779B97F4A7C15)) & (words[rows].astype(np.uint64) * np.uint64(64) - np.uint64(1))
    bits = np.zeros(base[-1], np.uint64)
    np.bitwise_xor.at(bits, base[rows] + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return _lists(bits, words)


def _batches(batches: Iterable[pa.RecordBatch], n_words: int, percent: int):
    """(batch, rows, shingles, sizes, bands) of small batches of texts."""
    free_worker()
    for batch in small_batches(batches, "text", 1 << 19):
        rows, found = shingle_sets(batch.column("text"), n_words)
        sizes = np.bincount(rows, minlength=batch.num_rows)
        yield batch, rows, found, sizes, Bands(percent, int(sizes.max(initial=0)))


def _type(df: DataFrame) -> str:
    return df.schema["_id"].dataType.simpleString()


def _describe(df: DataFrame, n_words: int, percent: int) -> DataFrame:
    """id, n_shingles, key (two hashes of the set) and, per view, the band and how many filled cells must be shared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, found, sizes, bands in _batches(batches, n_words, percent):
            columns = [batch.column("_id"), pa.array(sizes.astype(np.int64))]
            for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
                total = np.zeros(len(sizes), np.uint64)
                np.add.at(total, rows, mix(found ^ np.uint64(salt)))
                columns.append(pa.array(total.view(np.int64)))
            for band in bands.views(sizes):
                columns += [pa.array(band.astype(np.int32)), pa.array(Cells(rows, found, band, bands).need.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n_shingles", "_k1", "_k2", "_band0", "_need0", "_band1", "_need1"])

    return df.mapInArrow(run, f"_id {_type(df)}, n_shingles long, _k1 long, _k2 long, _band0 int, _need0 int, _band1 int, _need1 int")


def _cell_rows(n_words: int, percent: int):
    """(_cell, _id) of every filled cell of every set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, found, sizes, bands in _batches(batches, n_words, percent):
            for band in bands.views(sizes):
                cells = Cells(rows, found, band, bands)
                owner = np.concatenate([cells.owner[cells.filled], cells.odd])
                keys = np.concatenate([cells.key[cells.filled], cells.odd_key])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("_id").take(pa.array(owner))], ["_cell", "_id"])

    return run


def _profiles(df: DataFrame, n_words: int, percent: int) -> DataFrame:
    """id, text, size, number of filled cells, keys of empty cells, most cells of one tag, parity bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, found, sizes, bands in _batches(batches, n_words, percent):
            filled, wide = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
            keys, owners = [], []
            for band in bands.views(sizes):
                cells = Cells(rows, found, band, bands)
                filled += np.bincount(cells.owner[cells.filled], minlength=len(sizes))
                wide = np.maximum(wide, np.where(band >= 0, bands.n2[band] * -(-bands.n1[band] >> GROUP_BITS), 1))
                keys.append(cells.key[~cells.filled])
                owners.append(cells.owner[~cells.filled])
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            empty = _lists(keys[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(sizes)))
            columns = [batch.column("_id"), batch.column("text"), pa.array(sizes.astype(np.int32)), pa.array(filled.astype(np.int32)), empty, pa.array(wide.astype(np.int32)), _parity(rows, found, sizes)]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "text", "_n", "_filled", "_empty", "_wide", "_bits"])

    return df.mapInArrow(run, f"_id {_type(df)}, text string, _n int, _filled int, _empty array<long>, _wide int, _bits array<long>")


def _sets(df: DataFrame, n_words: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in small_batches(batches, "text", 1 << 19):
            rows, found = shingle_sets(batch.column("text"), n_words)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), _lists(found, np.bincount(rows, minlength=batch.num_rows))], ["_id", "_set"])

    return df.mapInArrow(run, f"_id {_type(df)}, _set array<long>")


def _among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose _id is in ``ids`` (a written table): broadcast where the ids are few, else a shuffle."""
    return df.join(small(ids), "_id", "left_semi")


# --- components --------------------------------------------------------------


def components(edges: DataFrame, size: int) -> DataFrame:
    """(_id, _c): the smallest id that each endpoint of ``edges`` (_a, _b) reaches. Labels spread and jump in rounds; each round is a
    written table. ``size``: bytes of three tables of labels, at most."""
    both = stash(edges.select(F.col("_a").alias("_id"), F.col("_b").alias("_to")).unionByName(edges.select(F.col("_b").alias("_id"), F.col("_a").alias("_to"))).distinct(), "edges")
    labels = stash(both.groupBy("_id").agg(F.least(F.col("_id"), F.min("_to")).alias("_c")), "labels")
    while True:
        # the least label among the neighbours, then the label of that label
        near = both.join(fitting(labels.withColumnRenamed("_id", "_to"), size), "_to").groupBy("_id").agg(F.min("_c").alias("_near"))
        step = near.join(fitting(labels, size), "_id").select("_id", F.col("_c").alias("_old"), F.least("_c", "_near").alias("_c"))
        jump = labels.select(F.col("_id").alias("_c"), F.col("_c").alias("_far"))
        moved = Observation()
        after = step.join(fitting(jump, size), "_c", "left").select("_id", "_old", F.least("_c", "_far").alias("_c"))
        after = stash(after.observe(moved, F.count_if(F.col("_c") != F.col("_old")).alias("n")), "labels")
        drop(labels)
        labels = after
        if not moved.get["n"]:
            drop(both)
            return labels.select("_id", "_c")


def roots(parents: DataFrame, size: int) -> DataFrame:
    """(_id, _c): the root above each id of a forest (_id, _parent; a root is its own parent), in rounds that double the reach.
    ``size``: see ``components``."""
    labels = stash(parents.select("_id", F.col("_parent").alias("_c")), "labels")
    while True:
        above = labels.select(F.col("_id").alias("_c"), F.col("_c").alias("_up"))
        moved = Observation()
        after = labels.join(fitting(above, size), "_c").select("_id", F.col("_c").alias("_old"), F.col("_up").alias("_c"))
        after = stash(after.observe(moved, F.count_if(F.col("_c") != F.col("_old")).alias("n")), "labels")
        drop(labels)
        labels = after
        if not moved.get["n"]:
            return labels.select("_id", "_c")


def _merged(labels: DataFrame, links: DataFrame, size: int) -> DataFrame:
    """``labels`` (_id, _c) after joining what ``links`` (_a, _b) connect: only edges between labels are spread. ``size``: see ``components``."""
    ends = links
    for side in ("_a", "_b"):
        ends = ends.join(fitting(labels.select(F.col("_id").alias(side), F.col("_c").alias(f"_c{side}")), size), side)
    ends = stash(ends.where("_c_a != _c_b").select(F.least("_c_a", "_c_b").alias("_a"), F.greatest("_c_a", "_c_b").alias("_b")).distinct(), "ends")
    if not rows_of(ends):
        return labels
    new = components(ends, size).select(F.col("_id").alias("_c"), F.col("_c").alias("_new"))
    return stash(labels.join(fitting(new, size), "_c", "left").select("_id", F.coalesce("_new", "_c").alias("_c")), "labels")


# --- candidates --------------------------------------------------------------


def _band_of(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 58).cast("int")


def _shared_cells(cells: DataFrame, sampled: DataFrame, keys: DataFrame) -> DataFrame:
    """(_id, _cells): for each set the cells that other sets have too, in bands where it has enough of them.

    ``cells`` (_cell, _id) of all sets, and of the sample from which hot cells are told."""
    hot = stash(sampled.groupBy("_cell").count().where(F.col("count") >= HOT_LEAST).select("_cell", F.lit(True).alias("_hot")), "hot")
    # at most the sample's cells / HOT_LEAST rows, whatever the input
    salted = cells.join(F.broadcast(hot), "_cell", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("byte"))
    # hot cells are in others for certain
    shared = salted.withColumn("_rows", F.count("*").over(Window.partitionBy("_cell", "_salt"))).where((F.col("_rows") > 1) | F.col("_hot"))
    by_set = shared.groupBy("_id").agg(F.collect_list("_cell").alias("_cells")).join(keys, "_id")

    def enough(view: int) -> Column:
        band, need = F.col(f"_band{view}"), F.col(f"_need{view}")
        own = F.filter("_cells", lambda c: _band_of(c) == band % 64)
        return F.when((band >= 0) & (F.size(own) >= need), own).otherwise(F.array().cast("array<long>"))

    return by_set.select("_id", F.concat(enough(0), enough(1)).alias("_cells")).where(F.size("_cells") > 0)


def _signatures(shared: DataFrame, profiles: DataFrame) -> DataFrame:
    """(_sig, _id, _w): the three-cell subsets of each group, from shared and empty cells; _w: a set's share of shared cells, in thousandths."""
    rows = shared.join(profiles.select("_id", "_filled", "_empty", "_wide"), "_id")
    bands = F.array_distinct(F.transform("_cells", _band_of))
    empty = F.filter("_empty", lambda e: F.array_contains(F.col("_bands"), _band_of(e)))
    rows = rows.withColumn("_bands", bands).withColumn("_all", F.sort_array(F.concat("_cells", empty)))
    tag = lambda c: F.shiftrightunsigned(c, 58 - GROUP_BITS)
    # sorted cells of one group stand together
    after = lambda cells, i, x, most: F.filter(F.slice(cells, i + 2, most), lambda y: tag(x) == tag(y))

    def subsets(x: Column, i: Column) -> Column:
        rest = after(F.col("_all"), i, x, F.col("_wide"))
        return F.flatten(F.transform(rest, lambda y, j: F.transform(after(rest, j, y, F.col("_wide")), lambda z: F.xxhash64(x, y, z))))

    weight = F.floor(1000 * F.size("_cells") / F.greatest("_filled", F.lit(1))).cast("short")
    return rows.select(F.explode(F.flatten(F.transform("_all", subsets))).alias("_sig"), "_id", weight.alias("_w"))


def _bounded(pairs: DataFrame, profiles: DataFrame, a: str, b: str, size: int) -> DataFrame:
    """``pairs`` of ids with both sizes (``_n`` and the id's name) and ``_differ``: a lower bound of how many shingles they differ in.
    ``size``: bytes of two tables of parity bits."""
    for side in (a, b):
        pairs = pairs.join(fitting(profiles.select(F.col("_id").alias(side), F.col("_n").alias(f"_n{side}"), F.col("_bits").alias(f"_bits{side}")), size), side)
    half = lambda bits: F.shiftright(F.size(bits), 1)
    fold = lambda bits: F.zip_with(F.slice(bits, 1, half(bits)), F.slice(bits, half(bits) + 1, half(bits)), lambda x, y: x.bitwiseXOR(y))
    x, y = F.col(f"_bits{a}"), F.col(f"_bits{b}")
    narrow = lambda x, y: F.when(F.size(x) == 2 * F.size(y), fold(x)).otherwise(x)
    # a shingle in one of the two sets flips one bit, so they differ in as many shingles at least as in bits; sets of very
    # unequal sizes (one more fold would be needed) differ in as many as their sizes do
    bits = F.aggregate(F.zip_with(narrow(x, y), narrow(y, x), lambda u, v: F.coalesce(F.bit_count(u.bitwiseXOR(v)), F.lit(0))), F.lit(0), lambda so_far, n: so_far + n)
    alike = (F.size(x) <= 2 * F.size(y)) & (F.size(y) <= 2 * F.size(x))
    by_size = F.abs(F.col(f"_n{a}") - F.col(f"_n{b}"))
    return pairs.withColumn("_differ", F.when(alike, F.greatest(bits, by_size)).otherwise(by_size)).drop(f"_bits{a}", f"_bits{b}")


def _compare(pairs: DataFrame, profiles: DataFrame, n_words: int, percent: int, bits: int) -> DataFrame:
    """The pairs (_a, _b) that link, as a written table: first by a lower bound of the distance, then by whole texts. ``bits``: see ``_bounded``."""
    pairs = _bounded(pairs, profiles, "_a", "_b", bits)
    pairs = pairs.where(100 * F.least("_n_a", "_n_b") >= percent * F.greatest("_n_a", "_n_b"))
    near = stash(pairs.where((100 + percent) * F.col("_differ") <= (100 - percent) * (F.col("_n_a") + F.col("_n_b"))).select("_a", "_b"), "near")
    size = 2 * held(near)
    if not size:
        return near
    # where the pairs are few they go to the texts, which are dealt by one of their ends alone
    text_a, text_b = (profiles.select(F.col("_id").alias(side), F.col("text").alias(f"_text{side}")) for side in ("_a", "_b"))
    text_b = text_b.join(fitting(near.select("_b"), size), "_b", "left_semi")
    near = text_a.join(fitting(near, size), "_a").join(text_b, "_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for large in small_batches(batches, "_text_a", 1 << 19):
            for batch in small_batches([large], "_text_b", 1 << 20):
                sides = [shingle_sets(batch.column(c), n_words) for c in ("_text_a", "_text_b")]
                size = np.bincount(np.concatenate([rows for rows, _ in sides]), minlength=batch.num_rows)
                rows, found = (np.concatenate(x) for x in zip(*sides))
                order = np.lexsort((found, rows))
                rows, found = rows[order], found[order]
                twice = (rows[1:] == rows[:-1]) & (found[1:] == found[:-1])
                common = np.bincount(rows[1:][twice], minlength=batch.num_rows)
                yield batch.select(["_a", "_b"]).filter(pa.array(100 * common >= percent * (size - common)))

    kind = _type(profiles)
    return stash(near.select("_a", "_b", "_text_a", "_text_b").mapInArrow(run, f"_a {kind}, _b {kind}"), "links")


def _spaces(around: DataFrame, percent: int, last: bool) -> DataFrame:
    """What ``_candidates`` works on, from _id, _hub, _set, _cset (the hub's), _linked: a row for each space (1: differences from
    the hub, 0: own elements) in which a set is looked for, with its elements and prefixes; and far: sets far from the hub."""
    p, q0, q1 = percent, 100 - percent, 100 + percent
    rows = around.withColumns({"_n": F.size("_set"), "_cn": F.size("_cset"), "_i": F.size(F.array_intersect("_set", "_cset"))})
    rows = rows.withColumns({"_d": F.col("_n") + F.col("_cn") - 2 * F.col("_i"), "_union": F.col("_n") + F.col("_cn") - F.col("_i")})
    half = F.greatest(F.lit(1), F.floor((q1 * F.col("_d") + q0 * (F.col("_cn") - F.col("_n"))) / (2 * q1)) + 1)
    long = F.greatest(F.lit(1), F.ceil((p * F.col("_d") - q0 * F.col("_n")) / p))
    own = F.col("_n") - F.ceil(p * F.col("_n") / 100) + 1
    differences = F.concat(F.array_except("_set", "_cset"), F.array_except("_cset", "_set"))
    nothing = F.array().cast("array<long>")
    far = 100 * F.col("_d") >= (NEAR - 100 + p) * F.col("_union")

    def space(number: int, size: Column, found: Column, search: Column, elements: Column) -> Column:
        names = ("space", "all", "found", "search", "elements")
        return F.struct(*[c.cast("array<long>" if n == "elements" else "long").alias(n) for n, c in zip(names, (F.lit(number), size, found, search, elements))])

    # (space, elements in all, prefix to be found by, prefix to search by)
    spaces = F.array_compact(F.array(
        F.when(far, space(0, F.col("_n"), own, own, F.col("_set")) if last else space(-1, F.lit(0), F.lit(0), F.lit(0), nothing)),
        F.when(100 * F.col("_d") <= NEAR * F.col("_union"), space(1, F.col("_d"), F.col("_d") - half + 1, F.col("_d") - long + 1, differences)),
    ))
    return rows.select("_id", "_hub", "_linked", F.col("_n").cast("int").alias("_n"), F.explode(spaces).alias("_s")).select("_id", "_hub", "_linked", "_n", "_s.*")


def _candidates(met: DataFrame, percent: int) -> DataFrame:
    """Pairs of a hub group, at least one of them not connected with the hub, that prefixes cannot rule out.

    ``met``: see ``_spaces``; _linked: connected with the hub; if not, the set is known not to link with it.
    With x, y, c sets, a = |x|, Dx = x without c and c without x: links need |x meet y| >= p a / 100 and, as x and
    y differ in just what Dx and Dy differ in, |Dx meet Dy| >= (|Dx| + |Dy| - q (|x| + |y|)) / 2, where
    q = (100 - p) / (100 + p). If one of the pair does not link with c, |D| > q (own size + |c|) for it; so the other
    one's D has more than (|D| + q (|c| - own size)) / 2 in common, and its own at least |D| - a (100 - p) / p, and at
    least 1. Elements go by rarity within the group, so all but the last (common - 1) of them suffice.

    Jaccard distance is a metric, so of a linked pair either both are within ``NEAR`` of c, and are found by their
    D, or both are farther than NEAR less the distance of links. Those meet around other hubs in the next round;
    in the last one they are found by their own elements.
    """
    p = percent
    own_key = ["_id", "_hub", "space"]
    facts = met.select("_id", "_hub", "_linked", "_n", "space", "all", "found", "search")
    # an element's key is its own within group and space
    keys = met.select("_id", "_hub", "space", F.xxhash64("_hub", "space").alias("_salt"), F.explode("elements").alias("_e")).select(*own_key, F.col("_e").bitwiseXOR(F.col("_salt")).alias("_k"))
    shared = keys.withColumn("_f", F.count("*").over(Window.partitionBy("_k"))).where("_f > 1")
    # elements of one set alone come first in its order and are only counted
    mine = Window.partitionBy(*own_key)
    shared = shared.withColumns({"_r": F.row_number().over(mine.orderBy("_f", "_k")), "_shared": F.count("*").over(mine)}).join(facts, own_key)
    place = F.col("all") - F.col("_shared") + F.col("_r")
    shared = stash(shared.select("_k", "_id", "_n", "_linked", (place <= F.col("found")).alias("_found"), (~F.col("_linked") & (place <= F.col("search"))).alias("_searches")).where("_found or _searches"), "elements")
    search = shared.where("_searches").select("_k", F.col("_id").alias("_a"), F.col("_n").alias("_na"), F.col("_found").alias("_half"))
    found = shared.where("_found").select(F.col("_k").alias("_kb"), F.col("_id").alias("_b"), F.col("_n").alias("_nb"), F.col("_linked").alias("_lb"))
    ok = (F.col("_a") != F.col("_b")) & (F.col("_half") | F.col("_lb")) & (100 * F.least("_na", "_nb") >= p * F.greatest("_na", "_nb"))
    return search.join(found, (F.col("_k") == F.col("_kb")) & ok).select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()


def _connect(rows: DataFrame, profiles: DataFrame, n_words: int, percent: int) -> DataFrame:
    """(_id, _c): sets with one _c are those that links connect. ``rows``: _sig, _id, _w."""
    # a plan has three tables of a row a set at most, or two of parity bits
    size = 3 * held(profiles.select("_id"))
    bits = size + 2 * 8 * (profiles.agg(F.sum(F.size("_bits"))).first()[0] or 0)
    compare = lambda pairs: _compare(pairs, profiles, n_words, percent, bits)
    with_label = lambda df, side, name: df.join(fitting(labels.select(F.col("_id").alias(side), F.col("_c").alias(name)), size), side)
    pair = (F.least("_id", "_hub").alias("_a"), F.greatest("_id", "_hub").alias("_b"))
    labels = stash(profiles.select("_id", F.col("_id").alias("_c")), "labels")
    for turn in range(1, ROUNDS + 1):
        hub = F.max(F.struct("_w", (-F.hash("_id")).alias("_o"), "_id"))
        hubs = rows.groupBy("_sig").agg(hub.getField("_id").alias("_hub"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")
        around = stash(rows.join(hubs, "_sig"), "around")
        met = stash(around.where("_id != _hub").groupBy("_id", "_hub").agg(F.count("*").alias("_sigs")), "met")
        if not rows_of(met):
            break
        # each set with the hub it shares most signatures with; a hub outranks its sets, so these links make a forest
        best = met.groupBy("_id").agg(F.max(F.struct("_sigs", "_hub")).getField("_hub").alias("_hub"))
        if turn > 1:  # at first each set is on its own
            best = with_label(with_label(best, "_id", "_ci"), "_hub", "_ch").where("_ci != _ch")
        best = stash(best.select("_id", "_hub", *pair), "best")
        linked = compare(best.select("_a", "_b"))
        # at most a link a set
        up = best.join(fitting(linked, size), ["_a", "_b"]).select("_id", F.col("_hub").alias("_parent"))
        if turn == 1:
            labels = roots(labels.join(fitting(up, size), "_id", "left").select("_id", F.coalesce("_parent", "_id").alias("_parent")), size)
        else:
            labels = _merged(labels, linked, size)
        # then the other hubs, as far as sets are not connected with them
        rest = with_label(with_label(met, "_id", "_ci"), "_hub", "_ch").where("_ci != _ch").join(fitting(best.select("_id", "_hub"), size), ["_id", "_hub"], "left_anti")
        labels = _merged(labels, compare(rest.select(*pair).distinct()), size)
        # groups with a set that is not connected with the hub, and another that it could link with
        groups = stash(with_label(with_label(met, "_id", "_ci"), "_hub", "_ch").select("_id", "_hub", "_ci", (F.col("_ci") == F.col("_ch")).alias("_linked")), "groups")
        counts = groups.groupBy("_hub").agg(F.count("*").alias("_all"), F.count(F.when(~F.col("_linked"), 1)).alias("_loose")).where("_all > 1 and _loose > 0")
        counts = stash(counts, "counts")
        if not rows_of(counts):
            break
        few = groups.join(fitting(counts.where(F.col("_all") <= SMALL_GROUP).select("_hub"), size), "_hub", "left_semi")
        one, other = few.where("not _linked").select("_hub", F.col("_id").alias("_x"), F.col("_ci").alias("_cx")), few.select(F.col("_hub").alias("_hub2"), F.col("_id").alias("_y"), F.col("_ci").alias("_cy"))
        pairs = one.join(other, (F.col("_hub") == F.col("_hub2")) & (F.col("_cx") != F.col("_cy"))).select(F.least("_x", "_y").alias("_a"), F.greatest("_x", "_y").alias("_b")).distinct()
        labels = _merged(labels, compare(pairs), size)
        # large groups whose hubs are connected are one group around one of these hubs
        crowds = groups.join(fitting(counts.where(F.col("_all") > SMALL_GROUP).select("_hub"), size), "_hub", "left_semi").select("_id", "_hub")
        crowds = stash(with_label(crowds, "_hub", "_ch"), "crowds")
        if not rows_of(crowds):
            break
        centres = crowds.groupBy("_ch", "_hub").count().groupBy("_ch").agg(F.max(F.struct("count", "_hub")).getField("_hub").alias("_centre"))
        places = stash(crowds.select("_hub", "_ch").distinct().join(fitting(centres, size), "_ch").select("_hub", "_centre"), "places")
        inside = stash(crowds.join(fitting(places, size), "_hub").select("_id", "_hub", "_centre"), "inside")
        members = stash(inside.select("_id", "_centre").where("_id != _centre").distinct(), "members")
        loose = with_label(with_label(members, "_id", "_ci"), "_centre", "_cc").where("_ci != _cc")
        labels = _merged(labels, compare(loose.select(F.least("_id", "_centre").alias("_a"), F.greatest("_id", "_centre").alias("_b")).distinct()), size)
        members = with_label(with_label(members, "_id", "_ci"), "_centre", "_cc").select("_id", F.col("_centre").alias("_hub"), (F.col("_ci") == F.col("_cc")).alias("_linked"))
        left = members.groupBy("_hub").agg(F.count("*").alias("_all"), F.count(F.when(~F.col("_linked"), 1)).alias("_loose")).where("_all > 1 and _loose > 0")
        many = stash(members.join(left.select("_hub"), "_hub", "left_semi"), "many")
        if not rows_of(many):
            break
        # what is too far from the hub for its differences to tell goes on to the next round, without its set
        bound = stash(_bounded(many, profiles, "_id", "_hub", bits).withColumn("_is_far", (200 - NEAR) * F.col("_differ") > NEAR * (F.col("_n_id") + F.col("_n_hub"))).select("_id", "_hub", "_linked", "_is_far"), "bound")
        close = bound if turn == ROUNDS else bound.where("not _is_far")
        wanted = stash(close.select("_id").unionByName(close.select(F.col("_hub").alias("_id"))).distinct(), "wanted")
        sets = stash(_sets(_among(profiles.select("_id", "text"), wanted), n_words), "sets")
        beside = close.drop("_is_far").join(sets, "_id").join(sets.select(F.col("_id").alias("_hub"), F.col("_set").alias("_cset")), "_hub")
        spaces = stash(_spaces(beside, percent, turn == ROUNDS), "spaces")
        drop(sets)
        labels = _merged(labels, compare(_candidates(spaces.where("space >= 0"), percent)), size)
        if turn == ROUNDS:
            break
        far = stash(spaces.where("space = -1").select("_id", "_hub").unionByName(bound.where("_is_far").select("_id", "_hub")).withColumnRenamed("_hub", "_centre"), "far")
        drop(spaces)
        if not rows_of(far):
            break
        # only rows of a far set whose hub stands for its group go on; set and hub are looked up together, as far sets stand in
        # many other buckets and these hubs' buckets hold many other sets
        own = inside.unionByName(places.select(F.col("_hub").alias("_id"), "_hub", "_centre"))
        onward = stash(own.join(small(far), ["_id", "_centre"], "left_semi").select("_id", "_hub"), "onward")
        rows = stash(around.join(small(onward), ["_id", "_hub"], "left_semi").drop("_hub"), "rows")
        drop(around)
    drop(around)
    return labels


def join(df: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id (the smallest id that links lead to)."""
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    described = stash(_describe(texts, n_words, percent), "described")
    keys = ["n_shingles", "_k1", "_k2"]
    nodes = stash(described.where("n_shingles > 0").groupBy(*keys).agg(F.min("_id").alias("_node")), "nodes")
    firsts = stash(nodes.select(F.col("_node").alias("_id")), "firsts")
    sampled = F.pmod(F.xxhash64("_id"), F.lit(max(1, rows_of(firsts) // HOT_SAMPLE))) == 0
    repeated = described.select("_id").distinct().count() < rows_of(described)
    once = lambda rows: rows.dropDuplicates(["_id"]) if repeated else rows
    narrow = once(described.select("_id", "_band0", "_need0", "_band1", "_need1"))
    cells = lambda rows: once(_among(rows, firsts)).mapInArrow(_cell_rows(n_words, percent), f"_cell long, _id {_type(texts)}")
    shared = stash(_shared_cells(cells(texts), cells(texts.where(sampled)), narrow), "shared")
    profiles = stash(once(_profiles(_among(texts, stash(shared.select("_id"), "ids")), n_words, percent)), "profiles")
    signatures = stash(_signatures(shared, profiles), "signatures")
    labels = _connect(signatures, profiles, n_words, percent)
    for done in (shared, signatures, profiles):
        drop(done)
    least = labels.groupBy("_c").agg(F.min("_id").alias("_least"))
    found = labels.join(least, "_c").select(F.col("_id").alias("_node"), "_least")
    whole = described.select("_id", *keys).join(nodes, keys, "left").join(found, "_node", "left")
    return whole.select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("_least", "_node", "_id").alias("component_id"))
