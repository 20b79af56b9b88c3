"""Helpers shared by the operators: shared-folder tables and vectorised text hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space that separates words in every operator here.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where it is unset, a local master takes one below the
    warehouse; a cluster has no folder to guess, so that raises ``ValueError``."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read and no earlier stage runs twice. Rows and bytes of strings are counted while
    it is written, so ``rows`` and ``held`` start no job for it: a job's plan, task and broadcasts all pass the driver's memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    counts = Observation()
    df.observe(counts, F.count("*").alias("rows"), *[x.alias(f"bytes{i}") for i, x in enumerate(_bytes(df))]).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path, out._stash_counts = path, counts
    return out


def _bytes(df: DataFrame) -> list[Column]:
    """Sums of the bytes of each column of strings."""
    return [F.sum(F.octet_length(F.col(f"`{f.name}`"))) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]


def rows(table: DataFrame) -> int:
    """The number of rows of a table that ``stash`` returned."""
    return table._stash_counts.get["rows"]


def drop(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that ``stash`` returned; no lazy plan may still need it."""
    path = getattr(df, "_stash_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Tables of more bytes than this are never broadcast; they join by a shuffle then. A query has one such broadcast at a time.
MOST_BYTES = 32 << 20
#: Bytes of a row of ids in a broadcast's hash table, besides the bytes of strings.
ROW_BYTES = 64


def held(ids: DataFrame, row_bytes: int = ROW_BYTES) -> int:
    """Bytes that a written table of rows of about ``row_bytes`` takes in a broadcast: counted, not guessed."""
    if hasattr(ids, "_stash_counts"):
        counts = ids._stash_counts.get
        n, strings = counts["rows"], [x for name, x in counts.items() if name != "rows"]
    else:
        n, *strings = ids.agg(F.count("*"), *_bytes(ids)).first()
    return n * row_bytes + sum(x or 0 for x in strings)


def fitting(df: DataFrame, n_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if ``n_bytes``, counted before for all broadcasts of its plan, are at most ``MOST_BYTES``."""
    return F.broadcast(df) if n_bytes <= MOST_BYTES else df


def small(ids: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """A written table of rows of about ``row_bytes``, marked for broadcast if it has at most ``MOST_BYTES``."""
    return fitting(ids, held(ids, row_bytes))


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``gone`` (a null key matches a null key)."""
    gone = stash(gone.select(F.col(key).alias("_gone")).distinct(), "gone")
    return df.join(small(gone), df[key].eqNullSafe(gone["_gone"]), "left_anti")


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def own_name(id_col: str, *results: str) -> None:
    """Raises ``ValueError`` where an id column is named like a result."""
    if id_col.lower() in results:
        raise ValueError(f"rename the id column {id_col!r}: a result has that name")


def crc_bucket(key: str, n: int) -> Column:
    """``crc32(key as text) mod n``: the fixed fold of a row."""
    return F.crc32(F.col(key).cast("string")) % n


_KEPT: dict[tuple, object] = {}
_FROZEN: list[int] = []


def give_back() -> None:
    """Returns freed memory to the system, as far as the allocators can."""
    gc.collect()
    if os.getpid() not in _FROZEN:
        # what is there at a worker's first task, modules for the most part, stays: later collections need not look at it
        _FROZEN[:] = [os.getpid()]
        gc.freeze()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def free_worker() -> None:
    """Lets go what an earlier stage left in this worker."""
    _KEPT.clear()
    give_back()


def worker_cache(*key, make):
    """What a worker keeps between tasks: one thing at a time, so that stages do not add up in its memory."""
    if key not in _KEPT:
        free_worker()
        _KEPT[key] = make()
    return _KEPT[key]


class Memo:
    """What a worker remembers of words (``known``), for speed alone. ``trim``, between batches, empties it beyond ``most``
    bytes (keys, values and about ``EACH`` for an entry), so long words do not add up either."""

    EACH = 200

    def __init__(self, most: int = 40 << 20):
        self.known: dict = {}  # a plain one: sets are compared with it by look-up
        self.most, self.held = most, 0

    def learn(self, items) -> None:
        for key, value in items:
            self.known[key] = value
            self.held += len(key) + len(value or ()) + self.EACH

    def trim(self) -> None:
        if self.held > self.most:
            self.known.clear()
            self.held = 0


class AgedMemo(Memo):
    """A memo of two ages of half of ``most`` bytes each: where the young words are too many they become the old ones, and the former old
    ones are forgotten; an old word that is met again is young. So frequent words stay and only rare ones go."""

    def __init__(self, most: int = 40 << 20):
        super().__init__(most // 2)
        self.old: dict = {}

    def missing(self, words: set) -> list:
        """Those of ``words`` that are not remembered; the others are young from now on."""
        words = words.difference(self.known)
        again = {w: self.old[w] for w in words if w in self.old}
        self.learn(again.items())
        return list(words.difference(again))

    def trim(self) -> None:
        if self.held > self.most:
            self.old, self.known, self.held = self.known, {}, 0


# --- vectorised hashing ----------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else _BASE_INV
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _POWERS[kind] = np.cumprod(steps, dtype=np.uint64)
    return have


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]`` for many spans at once, by prefix sums of a polynomial mod 2^64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo, hi = int(starts.min()), int(ends.max())
    buf, starts, ends = buf[lo:hi], starts - lo, ends - lo
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers("up", len(buf))[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers("down", len(buf) + 1)[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a byte buffer."""
    word = np.zeros(len(buf) + 2, np.int8)
    word[1:-1] = ~_SPACE[buf]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def apart(buf: np.ndarray, offsets: np.ndarray, separator: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """The documents' bytes with one separator byte before each (so no word spans two), and their new offsets."""
    n = len(offsets) - 1
    at = offsets[:-1] - offsets[0] + np.arange(n)
    out = np.empty(int(offsets[-1] - offsets[0]) + n, np.uint8)
    lead = np.zeros(len(out), bool)
    lead[at] = True
    out[lead] = separator
    out[~lead] = buf[offsets[0] : offsets[-1]]
    return out, np.concatenate([at, [len(out)]]).astype(np.int64)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : i + n])
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of a string or binary column; null counts as empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if column.offset:
        column = pa.concat_arrays([column, column[:0]])
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets.astype(np.int64)


def small_batches(batches, column: str = "text", most_bytes: int = 4 << 20):
    """Cut Arrow batches so that one holds about ``most_bytes`` of text (or one row): bounded memory for any text length."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        sizes = offsets[1:] - offsets[0]
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch
        pa.default_memory_pool().release_unused()
    give_back()
