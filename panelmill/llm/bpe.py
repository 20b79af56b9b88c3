"""Operator 1: byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash resolves whole pre-tokens that are vocabulary entries, many at a
time; a pre-token that it misses is merged with a heap over a linked list of its bytes. Spark only
moves Arrow batches; the vocabulary (bounded by its file) is broadcast once.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no bytes; repeated
rows and extra columns pass through unchanged, but for one named like a new column, which it replaces; an
empty table gives no rows; a text of any length is encoded whole, in one task's memory; an id outside the
vocabulary or null in ``decode`` raises ``IndexError`` in the task. ``round_trip`` needs an id column that is
not named like one of its results, else it raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import AgedMemo, own_name, hash_spans, mix, small_batches, utf8, worker_cache

#: Bytes that a worker's memory of words, and that of pieces between spaces, may take.
MEMO_BYTES = 80 << 20


def load_ranks(path: str) -> list[bytes]:
    """The vocabulary of a ``.tiktoken`` rank file, by id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    by_id = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [by_id[i] for i in range(len(by_id))]


class PerfectHash:
    """A minimal perfect hash over byte strings: hash, then displace bucket by bucket, largest first."""

    def __init__(self, keys: list[bytes]):
        buf, offsets = utf8(pa.array(keys, pa.binary()))
        h = hash_spans(buf, offsets[:-1], offsets[1:])
        n, self.n_buckets = len(keys), max(1, len(keys) // 4)
        self.n = n
        bucket = (h % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.n_buckets)
        ends = np.cumsum(sizes)
        self.shift = np.zeros(self.n_buckets, np.int64)
        self.key_at = np.zeros(n, np.int32)
        free = np.ones(n, bool)
        trial = np.arange(256, dtype=np.uint64)
        spare = None
        for b in np.argsort(-sizes, kind="stable"):
            size = int(sizes[b])
            if not size:
                break
            own = order[ends[b] - size : ends[b]]
            if size == 1:  # the rest go straight to what is left
                spare = iter(np.flatnonzero(free)) if spare is None else spare
                at = int(next(spare))
                self.shift[b] = -1 - at
                self.key_at[at] = own[0]
                continue
            first = np.uint64(0)
            while True:
                slots = self._slots(h[own][None, :], (first + trial)[:, None])
                ok = free[slots].all(1)
                if size > 1:
                    ranked = np.sort(slots, 1)
                    ok &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
                good = np.flatnonzero(ok)
                if len(good):
                    break
                first += np.uint64(len(trial))
            self.shift[b] = int(first) + int(good[0])
            free[slots[good[0]]] = False
            self.key_at[slots[good[0]]] = own
        self.keys = pa.array(keys, pa.binary())

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(h + (shift + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The key number of each word, or -1; each hit is verified byte by byte."""
        column = pa.array(words, pa.binary())
        buf, offsets = utf8(column)
        h = hash_spans(buf, offsets[:-1], offsets[1:])
        shift = self.shift[(h % np.uint64(self.n_buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, self._slots(h, np.maximum(shift, 0).astype(np.uint64)))
        key = self.key_at[slot]
        same = pc.equal(self.keys.take(pa.array(key)), column).to_numpy(zero_copy_only=False)
        return np.where(same, key, -1)


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: a heap of mergeable neighbours over linked bytes; lowest rank first, then leftmost."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = after[i]
        if j < 0 or j >= n or after[j] != end:
            continue  # one of the two has been merged meanwhile
        after[i], after[j] = end, -1
        if end < n:
            before[end] = i
            far = after[end]
            if (r := rank.get(word[i:far])) is not None:
                heappush(heap, (r, i, far))
        left = before[i]
        if left >= 0 and (r := rank.get(word[left:end])) is not None:
            heappush(heap, (r, left, end))
    out, i = [], 0
    while i < n:
        out.append(rank[word[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes and decodes Arrow columns in a worker."""

    def __init__(self, table: PerfectHash, pattern: str):
        self.table = table
        self.rank = {k: i for i, k in enumerate(table.keys.to_pylist())}
        self.digits = pa.array([b"%d " % i for i in range(table.n)], pa.binary())
        space = r"\p{White_Space}"
        self.find = regex.compile(pattern.replace(r"\s", space).replace(r"\S", space.replace("p", "P", 1))).findall
        self.cut = regex.compile(rf"(?= \P{{White_Space}})", regex.V1).split
        # of two ages, so rare words do not push out frequent ones
        self.words, self.memo = AgedMemo(MEMO_BYTES), AgedMemo(MEMO_BYTES)

    def _resolve(self, words: set[str]) -> None:
        words = self.words.missing(words)
        if not words:
            return
        raw = [w.encode() for w in words]
        found = zip(words, raw, self.table.find(raw).tolist())
        self.words.learn((w, key.to_bytes(4, "little") if key >= 0 else np.array(merge(r, self.rank), "<i4").tobytes()) for w, r, key in found)

    def _learn(self, pieces: set[str], lead: str) -> dict[str, bytes | None]:
        """Ids of ``lead + piece``; None for a piece at which the text may not be cut."""
        found = {p: self.find(lead + p) for p in pieces if not lead or (p and not p[0].isspace())}
        self._resolve({w for ws in found.values() for w in ws})
        get = self.words.known.__getitem__
        return {p: b"".join(map(get, found[p])) if p in found else None for p in pieces}

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        self.memo.trim()
        self.words.trim()
        cut = [(t or "").split(" ") for t in texts]
        memo = self.memo.known
        missing: set[str] = set()
        for pieces in cut:
            missing.update(set(pieces[1:]).difference(memo))
        self.memo.learn(self._learn(set(self.memo.missing(missing)), " ").items())
        heads = self._learn({pieces[0] for pieces in cut}, "")
        out = []
        for t, pieces in zip(texts, cut):
            try:
                out.append(b"".join([heads[pieces[0]], *map(memo.__getitem__, pieces[1:])]))
            except TypeError:  # spaces next to other white space: cut only before a space that a word follows
                parts = self.cut(t)
                learnt = self._learn(set(parts), "")
                out.append(b"".join(learnt[p] for p in parts))
        return out

    def encode(self, texts: pa.Array) -> pa.ListArray:
        coded = self.encode_texts(texts.to_pylist())
        offsets = np.zeros(len(coded) + 1, np.int32)
        np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))

    @staticmethod
    def _slices(table: pa.Array, ids: pa.ListArray) -> tuple[pa.Buffer | bytes, np.ndarray]:
        flat = table.take(ids.flatten())
        buf, at = utf8(flat)
        bounds = ids.offsets.to_numpy().astype(np.int64)
        return buf, at[bounds - bounds[0]]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each row's ids; null: none."""
        ids = pa.array(ids.to_pylist(), ids.type) if ids.null_count else ids
        ids = ids.fill_null([]) if ids.null_count else ids
        buf, at = self._slices(self.table.keys, ids)
        return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(buf)])

    def ids_digest(self, ids: pa.ListArray) -> pa.Array:
        """SHA-256, in hex, of the decimal ids joined by one space."""
        buf, at = self._slices(self.digits, ids)
        view = memoryview(buf)
        return pa.array([hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())


def shared_codec(sent) -> Codec:
    """This worker's codec for a broadcast (perfect hash, pattern)."""
    table, pattern, key = sent.value
    return worker_cache("codec", key, make=lambda: Codec(table, pattern))


_SENT: dict[tuple, object] = {}


def send_vocabulary(spark: SparkSession, path: str, pattern: str):
    """Broadcast the perfect hash of a rank file: as large as its vocabulary, whatever the data."""
    key = (spark.sparkContext.applicationId, path, pattern)
    if key not in _SENT:
        _SENT[key] = spark.sparkContext.broadcast((PerfectHash(load_ranks(path)), pattern, hash((path, pattern))))
    return _SENT[key]


def _with(df: DataFrame, *new: T.StructField) -> T.StructType:
    names = {f.name for f in new}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + list(new))


def _extend(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n not in new} | new
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``df`` with an ``array<int>`` column of token ids (replacing a column of that name)."""
    sent = send_vocabulary(df.sparkSession, path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(sent)
        for batch in small_batches(batches, text_col):
            yield _extend(batch, {ids_col: codec.encode(batch.column(text_col))})

    return df.mapInArrow(run, _with(df, T.StructField(ids_col, T.ArrayType(T.IntegerType()))))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with a binary column: the bytes that the ids stand for."""
    sent = send_vocabulary(df.sparkSession, path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(sent)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield _extend(part, {bytes_col: codec.decode(part.column(ids_col))})

    return df.mapInArrow(run, _with(df, T.StructField(bytes_col, T.BinaryType())))


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode again in one pass over the texts: id, n_tokens, digests of the ids and of the decoded bytes.

    Neither ids nor bytes leave the task, so nothing wider than a digest is written.
    """
    own_name(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
    sent = send_vocabulary(df.sparkSession, path, pattern)
    kept = df.select(id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(sent)
        for batch in small_batches(batches, text_col):
            ids = codec.encode(batch.column(text_col))
            back = codec.decode(ids)
            buf, at = utf8(back)
            view = memoryview(buf)
            digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pc.list_value_length(ids).cast(pa.int64()), codec.ids_digest(ids), pa.array(digests, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    id_type = kept.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
