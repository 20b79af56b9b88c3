"""Operator 12: collocations, from n-gram counts by suffix arrays.

Texts are cut into shards of about ``SHARD_WORDS`` words, as they stream through a task. In a shard words become ids, and a
suffix array of the id sequence is built by prefix doubling in numpy: ranks by one word, two, four, until the longest phrase
is covered. Neighbours in that order give the common prefix lengths, and a run of neighbours with k words or more in common
is an LCP interval: one n-gram of k words and its count. Spark then sums the counts of all shards by language and phrase.

Two passes keep the shuffle small and lose nothing: the first ships a 64-bit hash and a count of each pair of words; sums
below ``least`` are hashes of no candidate (a collision can only raise a sum). The rest fill a Bloom filter of at most
``FILTER_BYTES``, whatever the corpus. The second pass counts phrases, as strings, all of whose pairs pass the filter; a
filter with too many keys passes more and changes no result. All words are counted.

Scores are exact: products are decimals of 38 digits (an overflow raises). Words of a shard are told apart by 64-bit hashes.

Defined cases: null text counts as empty; a null language is ``und``; an empty table, or no phrase often enough, gives no
rows; a text of any length lies whole in one shard of one task; repeated rows count as often as they stand there; equal
scores go by frequency, then by the phrase's UTF-8 bytes; extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, drop, free_worker, give_back, hash_spans, lower_ascii, mix, small_batches, stash, utf8

#: Words of a shard: the larger, the fewer rows for a phrase; a word takes about 100 bytes of a worker's memory.
SHARD_WORDS = 500_000
#: Bytes of text that are taken apart at once; hashing takes about 50 bytes of memory for each.
BATCH_BYTES = 1 << 18
#: The most bytes of the filter that is sent to the workers, and its bits and probes for a key.
FILTER_BYTES, BITS, PROBES = 32 << 20, 16, 3
#: Words of 64 bits of the filter that come to the driver as one row of bytes.
BLOCK = 1 << 13
#: Parts of a language of which the first ``top`` phrases are found apart.
SALTS = 512
#: Bytes between words of a piece, and bytes that end a piece.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


class Shard(NamedTuple):
    buf: np.ndarray  # lower-cased bytes
    starts: np.ndarray  # of words
    ends: np.ndarray
    room: np.ndarray  # words from here to the end of the piece, this one included
    hashes: np.ndarray  # of a word and its language
    lang: np.ndarray  # place of the word's language in langs
    langs: list[str]


def _words(batch: pa.RecordBatch):
    """Bytes, spans, room, hashes and rows of the words of a batch."""
    raw, offsets = utf8(batch.column("text"))
    buf, at = apart(lower_ascii(raw), offsets)
    kind = _CLASS[buf]
    edge = np.diff((kind == 0).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    last = np.flatnonzero(np.diff(piece, append=-1))  # the last word of each piece
    room = (last[np.searchsorted(last, np.arange(len(starts)))] - np.arange(len(starts)) + 1).astype(np.int32)
    row = np.searchsorted(at, starts, "right") - 1
    return buf, starts, ends, room, hash_spans(buf, starts, ends), row


def shards(batches: Iterable[pa.RecordBatch], most: int | None = None) -> Iterator[Shard]:
    """Shards of about ``most`` words from batches with columns text and lang."""
    parts, langs, held, size = [[] for _ in Shard._fields[:-1]], {}, 0, 0
    most = most or SHARD_WORDS

    def joined() -> Shard:
        """The shard; its parts go column by column, so that they are not there beside it while it is used."""
        nonlocal langs, held, size
        columns = []
        for part in parts:
            columns.append(np.concatenate(part))
            part.clear()
        names, langs, held, size = list(langs), {}, 0, 0
        return Shard(*columns, names)

    for batch in small_batches(batches, "text", BATCH_BYTES):
        buf, starts, ends, room, hashes, row = _words(batch)
        names = batch.column("lang").fill_null("und").dictionary_encode()
        code = np.array([langs.setdefault(x, len(langs)) for x in names.dictionary.to_pylist()], np.int32)
        seed = hash_spans(*(lambda b, o: (b, o[:-1], o[1:]))(*utf8(names.dictionary)))
        own = np.asarray(names.indices)[row]
        for part, x in zip(parts, (buf, starts + size, ends + size, room, mix(hashes + mix(seed + np.uint64(0x2545F4914F6CDD1D))[own]), code[own])):
            part.append(x)
        held, size = held + len(starts), size + len(buf)
        del batch, buf, starts, ends, room, hashes, row, own, part, x
        if held >= most:
            yield joined()
            give_back()
    if held:
        yield joined()


def suffix_array(ids: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` words, within pieces, by prefix doubling."""
    rank, reach = ids.astype(np.int64) + 1, 1
    order = np.argsort(rank)
    while reach < depth:
        further = np.zeros(len(rank), np.int64)  # 0: the piece ends before
        further[:-reach] = np.where(room[:-reach] > reach, rank[reach:], 0)
        key = rank * (int(rank.max(initial=0)) + 1) + further
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(key)])
        reach *= 2
    return order


def common_prefixes(ids: np.ndarray, room: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Words, up to ``depth``, that each position of the order has in common with the one before it."""
    found = np.zeros(len(order), np.int8)
    a, b = order[:-1], order[1:]
    for k in range(depth):
        use = np.flatnonzero((found[1:] == k) & (room[a] > k) & (room[b] > k))
        use = use[ids[a[use] + k] == ids[b[use] + k]]
        found[1 + use] += 1
    return found


def intervals(room: np.ndarray, order: np.ndarray, common: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """One position and the number of occurrences of every n-gram of ``k`` words."""
    first = np.flatnonzero(common < k)
    counts = np.diff(np.concatenate([first, [len(order)]]))
    at = order[first]
    whole = room[at] >= k
    return at[whole], counts[whole]


def _pairs(shard: Shard, at: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of words that begin at these positions."""
    return mix(mix(shard.hashes[at]) * np.uint64(0xC2B2AE3D27D4EB4F) + shard.hashes[at + 1])


def _counted(shard: Shard, depth: int):
    _, ids = np.unique(shard.hashes, return_inverse=True)
    order = suffix_array(ids, shard.room, depth)
    return ids, order, common_prefixes(ids, shard.room, order, depth)


def _pair_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    free_worker()
    for shard in shards(batches):
        _, order, common = _counted(shard, 2)
        at, counts = intervals(shard.room, order, common, 2)
        yield from _sliced([pa.array(_pairs(shard, at).view(np.int64)), pa.array(counts.astype(np.int32))], ["_h", "_n"])


def _sliced(columns: list[pa.Array], names: list[str], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, whole.num_rows, size):
        yield whole.slice(at, size)


def _probes(h: Column, bits: int) -> Column:
    """Bit positions of a 64-bit hash in a filter of ``bits`` (a power of two)."""
    return F.array(*[F.shiftrightunsigned(h, 20 * i % 33).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)])


def _passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes are in the filter ``words``; as ``_probes``."""
    found, last = np.ones(len(h), bool), np.uint64(len(words) * 64 - 1)
    for i in range(PROBES):
        at = h >> np.uint64(20 * i % 33) & last
        found &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _packed(masks: pd.DataFrame) -> pd.DataFrame:
    """The bytes of one block of the filter from its words that are not 0."""
    words = np.zeros(BLOCK, np.uint64)
    words[masks["_word"].to_numpy() % BLOCK] = masks["_mask"].to_numpy(np.int64).view(np.uint64)
    return pd.DataFrame({"_block": [masks["_block"].iloc[0]], "_bits": [words.tobytes()]})


def _filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column _h: at most ``FILTER_BYTES`` come to the driver, packed by tasks into a row of bytes a block. As rows
    of one word they would take many times that there."""
    wanted = max(64, keys.count() * BITS)
    bits = min(8 * FILTER_BYTES, 1 << (wanted - 1).bit_length())  # both powers of two
    at = keys.select(F.explode(_probes(F.col("_h"), bits)).alias("_at"))
    mask = F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))"))
    masks = at.groupBy(F.shiftright("_at", 6).cast("int").alias("_word")).agg(mask.alias("_mask"))
    blocks = masks.withColumn("_block", F.floor(F.col("_word") / BLOCK).cast("int")).groupBy("_block").applyInPandas(_packed, "_block int, _bits binary")
    words = np.zeros(bits // 64, np.uint64)
    for row in blocks.collect():
        part = words[row["_block"] * BLOCK :][:BLOCK]
        part[:] = np.frombuffer(row["_bits"], np.uint64)[: len(part)]
    return words


def _strings(shard: Shard, at: np.ndarray) -> pa.Array:
    """The words at these positions."""
    sizes = (shard.ends - shard.starts)[at]
    ends = np.cumsum(sizes)
    places = np.repeat(shard.starts[at] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(shard.buf[places]))


def _phrase_counts(words, max_words: int):
    """Counts of all words, and of phrases whose pairs of words all pass the filter in the broadcast ``words``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for shard in shards(batches):
            ids, order, common = _counted(shard, max_words)
            langs = pa.array(shard.langs, pa.string())
            one = np.zeros(int(ids.max()) + 1, np.int64)
            one[ids] = np.arange(len(ids))  # a position of each word
            spelled = _strings(shard, one)
            alive = np.zeros(len(ids), bool)
            pairs = np.flatnonzero(shard.room >= 2)
            alive[pairs] = _passes(words.value, _pairs(shard, pairs))
            for k in range(1, max_words + 1):
                at, counts = intervals(shard.room, order, common, k)
                for i in range(k - 1):
                    use = alive[at + i]
                    at, counts = at[use], counts[use]
                for some in range(0, len(at), 20_000):
                    where, n = at[some : some + 20_000], counts[some : some + 20_000]
                    parts = [spelled.take(pa.array(ids[where + i])) for i in range(k)]
                    phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(shard.lang[where])), phrase, pa.array(np.full(len(where), k, np.int8)), pa.array(n.astype(np.int64))], ["lang", "phrase", "_k", "_n"])

    return run


def summed(counted: DataFrame, *keys: str) -> DataFrame:
    """Sums ``a`` of the counts _n by key. Rows are dealt out first: a shard has a key once, so a hash table of a task's keys, beside its
    Python worker, would merge only what a task's few shards have in common (a fifth of pairs, two fifths of words and phrases)."""
    return counted.repartition(*keys).groupBy(*keys).agg(F.sum("_n").alias("a"))


def phrase_counts(texts: DataFrame, max_words: int, least: int) -> DataFrame:
    """(lang, phrase, _k, a): all words, and all phrases of 2 to ``max_words`` words that stand there ``least`` times; a written table."""
    pairs = summed(texts.mapInArrow(_pair_counts, "_h long, _n int"), "_h")
    keys = stash(pairs.where(F.col("a") >= least).select("_h"), "pairs")
    words = texts.sparkSession.sparkContext.broadcast(_filter(keys))
    counted = texts.mapInArrow(_phrase_counts(words, max_words), "lang string, phrase string, _k byte, _n long")
    found = stash(summed(counted, "lang", "phrase", "_k").where((F.col("_k") == 1) | (F.col("a") >= least)), "phrases")
    words.destroy()
    drop(keys)
    return found


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(15,0)")


def _cut(part: str, by: int) -> Column:
    """Words of the phrase before or after the cut."""
    words = F.split("phrase", " ")
    kept = F.slice(words, 1, by) if part == "l" else F.slice(words, by + 1, F.size(words))
    return F.array_join(kept, " ")


def collocations(df: DataFrame, max_words: int = 3, least: int = 10, top: int = 2000, part: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``part``: a phrase goes if a longer candidate that holds it has at least this many hundredths of its occurrences.
    """
    texts = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = phrase_counts(texts, max_words, least)
    totals = counts.where("_k = 1").groupBy("lang").agg(F.sum("a").alias("n"))
    candidates = counts.where("_k > 1")
    # what longer candidates make of the shorter ones within them
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("_k") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("_k") - k + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, k), " "))))
    longer = candidates.where("_k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < part * F.col("a"))).select("lang", "phrase", "_k", "a")
    # every cut with the counts of its parts; the lowest score counts, then the first cut
    cuts = kept.withColumn("_cut", F.explode(F.sequence(F.lit(1), F.col("_k") - 1)))
    for side in ("l", "r"):
        parts = counts.select("lang", F.col("phrase").alias(f"_{side}"), F.col("a").alias(side))
        cuts = cuts.withColumn(f"_{side}", _cut(side, F.col("_cut"))).join(parts, ["lang", f"_{side}"])
    product = F.lit(1_000_000).cast("decimal(7,0)") * _exact("a") * _exact("a")
    scored = cuts.withColumns({"_product": product, "_parts": _exact("l") * _exact("r")}).withColumn("score", F.expr("_product div _parts"))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "_cut")).alias("_b")).select("lang", "phrase", "_b.*")
    order = (F.desc("score"), F.desc("a"), "phrase")
    # the first of each of SALTS parts of a language, then of these: no task orders all of its phrases
    place = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order))
    some = best.withColumn("rank", place(F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", place()).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
