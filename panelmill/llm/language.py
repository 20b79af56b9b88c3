"""Operator 10: language identification by prediction by partial matching (PPM).

For each language a byte context tree of orders 0 to ``ORDER`` holds how often each byte followed each
context. A text's exact code length in a language is the sum, over its letters' bytes, of the PPM cost
with escapes (method C: a context with n occurrences of t distinct bytes escapes with t / (n + t)),
from the longest seen context down to the uniform order -1. Statistics are frozen after training, so
the costs of all observed contexts are laid out once, by sorted keys, and a text is scored by look-ups with
escapes to the shorter context. The order is the same for any number of languages and any alphabet.
The language of the shortest code wins.

Texts are seen as lower-case bytes in which each run of non-letter bytes is one space.

Training is a classifier fitted on a bounded sample of rows: per language the ``TRAIN_ROWS`` distinct texts with
the smallest hashes, each of them whole and once however many copies it has. Contexts are counted in tasks; only
counts reach the driver. Scoring reads whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to the language
that sorts first; repeated rows are scored each; no training rows at all: everything is ``und``; an empty table gives no rows; a
text of any length is scored whole, in one task's memory; other columns pass, but those named ``lang_pred``, ``score`` or
``bits_per_byte`` are replaced by the results (the pipeline hands rows over as one value, so there they pass).
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, utf8, worker_cache

ORDER = 3
TRAIN_ROWS = 300

_HAS_LETTER = regex.compile(r"\p{L}").search
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _fold(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes, each document led by one space; and the documents' offsets in them."""
    out = np.empty(len(buf) + len(offsets) - 1, np.uint8)
    at = offsets[:-1] - offsets[0] + np.arange(len(offsets) - 1)
    lead = np.zeros(len(out), bool)
    lead[at] = True
    out[lead] = 32
    out[~lead] = _FOLD[buf]
    space = out == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep |= lead
    sums = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], sums[np.concatenate([at, [len(out)]])]


def count_contexts(texts: pa.Array, order: int = ORDER) -> dict[int, int]:
    """How often each byte string of 1 to ``order`` + 1 folded bytes occurs, packed as length and bytes."""
    buf, offsets = utf8(texts)
    s, at = _fold(buf[offsets[0] : offsets[-1]], offsets)
    begin = np.repeat(at[:-1], np.diff(at))
    place = np.arange(len(s)) - begin
    out: dict[int, int] = {}
    for k in range(order + 1):
        code = np.zeros(len(s), np.uint64)
        for j in range(k, -1, -1):
            code = code * np.uint64(256) + np.roll(s, j).astype(np.uint64)
        keys, n = np.unique(code[place >= k], return_counts=True)
        out.update({(k + 1 << 40) + int(a): int(b) for a, b in zip(keys, n)})
    return out


Counts = dict[int, int] | tuple[np.ndarray, np.ndarray]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class _Costs:
    """Bits of each observed (context, byte) of one language, and of the escape from each observed context, by sorted keys."""

    def __init__(self, counts: Counts, order: int):
        keys, n = (np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))) if isinstance(counts, dict) else counts
        size, code = keys >> 40, (keys & (1 << 40) - 1).astype(np.uint64)
        self.levels: list[tuple[np.ndarray, ...]] = []
        for k in range(order + 1):
            own = np.flatnonzero(size == k + 1)
            own = own[np.argsort(code[own])]
            codes, times = code[own], n[own].astype(np.float64)
            contexts, begin, back = np.unique(codes >> np.uint64(8), return_index=True, return_inverse=True)
            total = np.add.reduceat(times, begin) if len(codes) else np.zeros(0)
            kinds = np.diff(np.append(begin, len(codes)))
            self.levels.append((codes, -np.log2(times / (total + kinds)[back]), contexts, -np.log2(kinds / (total + kinds))))

    def bits(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Bits of the last byte of each code of ``k`` + 1 bytes after the others."""
        if k < 0:
            return np.full(len(codes), 8.0)  # order -1: any byte
        seen, own, contexts, escape = self.levels[k]
        at, there = _find(seen, codes)
        out = own[at] if len(own) else np.zeros(len(codes))
        rest = codes[~there]
        if len(rest):
            at, known = _find(contexts, rest >> np.uint64(8))
            leave = np.where(known, escape[at], 0.0) if len(escape) else 0.0
            out[~there] = leave + self.bits(rest & np.uint64((1 << 8 * k) - 1), k - 1)
        return out


class CostTable:
    """Bits for each (context of ``order`` bytes, byte) in each language."""

    def __init__(self, counts: dict[str, Counts], order: int = ORDER):
        self.languages = sorted(counts)
        self.order = order
        self.costs = [_Costs(counts[language], order) for language in self.languages]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths in bits, (rows, languages), and the number of coded bytes of each row."""
        buf, offsets = utf8(texts)
        s, at = _fold(buf[offsets[0] : offsets[-1]], offsets)
        place = np.arange(len(s)) - np.repeat(at[:-1], np.diff(at))
        code = np.zeros(len(s), np.uint64)
        for j in range(self.order, -1, -1):
            back = np.roll(s, j)
            if j:
                back[place < j] = 32
            code = code * np.uint64(256) + back.astype(np.uint64)
        codes, which = np.unique(code, return_inverse=True)
        out = np.zeros((len(at) - 1, len(self.languages)))
        # every row holds its leading space at least, so no segment is empty
        for column, costs in enumerate(self.costs if len(out) else []):
            out[:, column] = np.add.reduceat(costs.bits(codes, self.order)[which], at[:-1])
        return out, np.diff(at)


#: Counts that a task holds at most before it hands them on.
COUNTS_HELD = 1_000_000


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n), summed within the task."""
    held: dict[str, Counter] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["lang", "key", "n"])
        held.clear()

    for batch in small_batches(batches, "text", 1 << 20):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            held[lang].update(count_contexts(batch.column("text").filter(pa.array(langs == lang))))
        if sum(map(len, held.values())) > COUNTS_HELD:
            yield from rows()
    yield from rows()


def train(df: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, Counts]:
    """Context counts per language of the rows for which ``trains`` holds (lang not null); rows bounded as documented above."""
    rows = df.where(trains & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_h"), F.xxhash64(F.col(id_col).cast("string")).alias("_i"))
    # Which texts is settled on narrow rows, copies folded map-side; one row of each is fetched.
    first = Window.partitionBy("lang").orderBy("_h")
    chosen = rows.groupBy("lang", "_h").agg(F.min("_i").alias("_i")).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= TRAIN_ROWS).drop("_r")
    texts = rows.join(F.broadcast(chosen), ["lang", "_h", "_i"], "left_semi").groupBy("lang", "_h").agg(F.min("text").alias("text"))  # ids may repeat
    # a bounded sample: few tasks, so that each sums up many texts
    counts = texts.select("lang", "text").coalesce(8).mapInArrow(_count_batches, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return {str(lang): (part["key"].to_numpy(), part["n"].to_numpy()) for lang, part in counts.toPandas().groupby("lang")}


def identify(df: DataFrame, counts: dict[str, Counts], text_col: str = "text", *more: str) -> DataFrame:
    """``df``'s columns plus lang_pred, score (probability of that language) and bits_per_byte."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(counts)
    key = uuid.uuid4().hex
    new = ("lang_pred", "score", "bits_per_byte")
    schema = T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_cache("costs", key, make=lambda: CostTable(sent.value) if sent.value else None)
        for batch in small_batches(batches, text_col, 1 << 19):
            texts = batch.column(text_col)
            letters = np.array([bool(t) and _HAS_LETTER(t) is not None for t in texts.to_pylist()], bool)
            if table is None:
                pred, score, rate = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
            else:
                bits, n = table.score(texts)
                best = bits.argmin(1)
                low = bits[np.arange(len(best)), best]
                score = np.where(letters, 1 / np.exp2(np.clip(low[:, None] - bits, -1000, 0)).sum(1), 0.0)
                pred = np.where(letters, np.array(table.languages, object)[best], "und")
                rate = low / np.maximum(n, 1)
            columns = {c: batch.column(c) for c in batch.schema.names if c not in new}
            columns |= {"lang_pred": pa.array(pred.tolist(), pa.string()), "score": pa.array(score), "bits_per_byte": pa.array(rate)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return df.mapInArrow(run, schema)
