"""Operator 2: best-fit packing by length patterns and non-negative least squares.

Planning works on the histogram of piece lengths alone, which has at most ``size`` bins whatever the data:

1. Patterns of one to three lengths that fill a sequence exactly, or as nearly as the lengths allow, are
   enumerated; the triples draw on the most frequent lengths.
2. Repeat counts are fitted to the histogram by non-negative least squares and rounded down.
3. The residual pieces are packed best-fit, longest first, over counts: into the open patterns' leftover
   room as well as into new sequences.

The plan is a list of runs: pieces of one length, ranked ``first`` .. ``first + n - 1`` among their length,
lie at one offset in n consecutive sequences. Its size depends on ``size`` only, so it is broadcast; each
piece finds its place from its length and rank. Ranks come from counted blocks, never from one task per length.

Defined cases: a null text is empty; an empty text is the end mark alone; an empty table gives no rows;
repeated rows are packed each; extra columns of ``pack`` pass through, but for ``sequence_id`` and ``offset``; a text
of any length is encoded whole, in one task's memory, and cut into pieces. A special string of the vocabulary in a
text (``<|endoftext|>``) stands for its id, the library's default.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import AgedMemo, small_batches, stash, utf8, worker_cache

#: The most frequent lengths that triples are built from.
TRIPLE_LENGTHS = 72
#: The most frequent lengths that near-full pairs are built from.
NEAR_LENGTHS = 16
#: Weight of left-over room against misfit of the histogram.
ROOM_WEIGHT = 6.0
#: Pieces of one length in one ranking block, about.
BLOCK_ROWS = 20_000


# --- planning over the histogram ------------------------------------------


def patterns(counts: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """Few-length patterns: exact singles and pairs, exact triples over the most frequent lengths, and for each
    length the fill that leaves least room, one piece and then another."""
    have = counts > 0
    lengths = np.flatnonzero(have)
    out = [(int(a),) for a in lengths if a == size]
    out += [(int(a), size - int(a)) for a in lengths if 2 * a <= size and a < size and have[size - a]]
    often = sorted((int(a) for a in sorted(lengths, key=lambda a: (-counts[a], a))[:TRIPLE_LENGTHS]))
    for i, a in enumerate(often):
        for b in often[i:]:
            c = size - a - b
            if c >= b and have[c]:
                out.append((a, b, c))
    below = np.maximum.accumulate(np.where(have, np.arange(size + 1), 0))  # the longest length up to each
    frequent = sorted(map(int, lengths), key=lambda a: (-counts[a], a))[:NEAR_LENGTHS]
    for a in map(int, lengths):
        b = int(below[size - a])
        c = int(below[size - a - b]) if b else 0
        for parts in ((a, b), (a, b, c)):
            if size - sum(parts) < lengths[0]:  # else the residuals' stage goes on filling
                out.append(tuple(x for x in parts if x))
        if 2 * a > size:
            out.append((a,))
        out += [(a, b) for b in frequent if 0 <= size - a - b <= size // 8]
    return list(dict.fromkeys(tuple(sorted(x)) for x in out))


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares over sparse columns (how often a pattern uses each length), by accelerated
    projected gradients. Each row is scaled by its target, so that rare lengths count as much as frequent ones;
    one more row (0, which no length has) asks for no room left over, which settles ties between fits."""
    if not columns:
        return np.zeros(0)
    size = len(target) - 1
    width = max(map(len, columns))
    index = np.array([c + (0,) * (width - len(c)) for c in columns])
    scale = 1 / np.maximum(target, 1.0)
    weight = np.where(index > 0, np.sqrt(scale)[index], 0.0)
    room = (size - index.sum(1)) / size * ROOM_WEIGHT / np.sqrt(max(1.0, target @ np.arange(size + 1) / size))
    aim = np.sqrt(scale) * target
    aim[0] = 0

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.bincount(index.ravel(), (weight * x[:, None]).ravel(), len(target))
        out[0] = room @ x
        return out

    def backward(r: np.ndarray) -> np.ndarray:
        return (weight * r[index]).sum(1) + room * r[0]

    v = np.ones(len(columns))
    for _ in range(20):  # the largest singular value bounds the step
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        after = np.maximum(0.0, y - backward(forward(y) - aim) / (1.05 * norm))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = after + (old - 1) / t * (after - x)
        x = after
    return x


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, n, first sequence, offset) that place every piece of a length histogram."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    left = counts.copy()
    runs: list[tuple[int, int, int, int, int]] = []
    taken = np.zeros(size + 1, np.int64)
    sequences = 0
    open_rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, n)

    def place(length: int, n: int, first_sequence: int, offset: int) -> None:
        runs.append((length, int(taken[length]), n, first_sequence, offset))
        taken[length] += n

    columns = patterns(counts, size)
    repeats = np.floor(nnls(columns, counts.astype(float)) + 1e-6).astype(np.int64)
    for i in np.argsort(-repeats, kind="stable"):
        uses = {a: columns[i].count(a) for a in columns[i]}
        n = min(int(repeats[i]), *(int(left[a]) // k for a, k in uses.items()))
        if n <= 0:
            continue
        offset = 0
        for a in columns[i]:
            place(a, n, sequences, offset)
            offset += a
        for a, k in uses.items():
            left[a] -= n * k
        if offset < size:
            open_rooms[size - offset].append((sequences, n))
        sequences += n
    # residuals: best fit, longest first; open sequences of one room are handled together
    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            room = min((r for r in open_rooms if r >= length), default=None)
            if room is None:
                each = size // length  # equal pieces that fill a new sequence
                full = n // each
                if full:
                    for k in range(each):
                        place(length, full, sequences, k * length)
                    if size - each * length:
                        open_rooms[size - each * length].append((sequences, full))
                    sequences, n = sequences + full, n - full * each
                if n:
                    for k in range(n):
                        place(length, 1, sequences, k * length)
                    open_rooms[size - n * length].append((sequences, 1))
                    sequences, n = sequences + 1, 0
                continue
            first, many = open_rooms[room].pop()
            if not open_rooms[room]:
                del open_rooms[room]
            used = min(n, many)
            place(length, used, first, size - room)
            if many > used:
                open_rooms[room].append((first + used, many - used))
            if room > length:
                open_rooms[room - length].append((first, used))
            n -= used
    return runs


# --- Spark ------------------------------------------------------------------


def pack(pieces: DataFrame, size: int, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (lengths 1 to ``size``) with sequence_id and offset. Reads its input three times: pass a written table."""
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(F.col(length_col).alias("_length"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)], F.struct(*columns).alias("_row"))
    length_col, order_cols = "_length", tuple(f"_o{i}" for i in range(len(order_cols)))
    histogram = pieces.groupBy(length_col).count().collect()  # at most `size` rows
    runs = plan({r[0]: r["count"] for r in histogram}, size)
    most = max((r["count"] for r in histogram), default=0)
    # ranks: blocks of a length by hash, their sizes summed up in block order, then a rank within each block
    blocks = max(1, -(-most // BLOCK_ROWS))
    keyed = pieces.withColumn("_block", F.pmod(F.xxhash64(*order_cols), F.lit(blocks)).cast("int"))
    sizes = keyed.groupBy(length_col, "_block").agg(F.count("*").alias("_n"))
    before = sizes.select(length_col, "_block", (F.sum("_n").over(Window.partitionBy(length_col).orderBy("_block")) - F.col("_n")).alias("_before"))
    ranked = keyed.withColumn("_own", F.row_number().over(Window.partitionBy(length_col, "_block").orderBy(*order_cols)))
    ranked = ranked.join(before, [length_col, "_block"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for length, *rest in runs:
        by_length[length].append(tuple(rest))
    rows = [(length, [dict(zip(("first", "n", "sequence", "at"), r)) for r in sorted(rs)]) for length, rs in by_length.items()]
    places = spark.createDataFrame(rows, "_l int, _runs array<struct<first: long, n: long, sequence: long, at: int>>")
    found = ranked.join(F.broadcast(places), F.col(length_col) == F.col("_l"))
    run = F.filter("_runs", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") < r["first"] + r["n"]))[0]
    return found.withColumn("_run", run).select(
        "_row.*", (F.col("_run.sequence") + F.col("_rank") - F.col("_run.first")).alias("sequence_id"), F.col("_run.at").cast("long").alias("offset")
    )


#: ASCII marks that neither join the letter before them in a pre-token nor compose with what follows.
MARKS = ".,;:!?|*#$%&"
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(MARKS.encode())] = True


#: Words of these letters are one pre-token, which no normal form changes but for the case.
_PLAIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: The normalisers and pre-tokenisers for which that holds.
_PLAIN_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PLAIN_SPLIT = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character that stands for each byte in a byte-level vocabulary.
_BYTE_LEVEL = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


class WordIds:
    """Ids by a lower-casing ``tokenizers`` file whose pre-tokens never span white space nor join letters to
    marks: texts fall apart at both, and each distinct part is encoded once, plain words by the library's model alone where the
    file's normaliser and pre-tokeniser leave them whole. The file's special strings
    stand for their ids, as the library has it by default; texts fall apart at them first."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.special = {t.content: int(i).to_bytes(4, "little") for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.memo = AgedMemo()
        parts = json.loads(spec)
        steps = (parts.get("normalizer") or {}).get("normalizers"), (parts.get("pre_tokenizer") or {}).get("pretokenizers"), parts.get("post_processor")
        self.model = self.tokenizer.model if steps == (_PLAIN_NORMAL, _PLAIN_SPLIT, None) else None

    @staticmethod
    def words(texts: pa.Array) -> list[list[bytes]]:
        buf, offsets = utf8(texts)
        buf = buf[: offsets[-1]]
        letter = _LETTER[buf]
        letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)  # Latin-1 letters
        at = np.flatnonzero(letter[:-1] & _MARK[buf[1:]]) + 1
        spaced = np.insert(buf, at, 32).tobytes().lower()
        ends = (offsets + np.searchsorted(at, offsets)).tolist()
        return [spaced[a:b].split() for a, b in zip(ends, ends[1:])]

    def texts(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        self.memo.trim()
        if self.special:
            buf, offsets = utf8(texts)
            raw = buf[offsets[0] : offsets[-1]].tobytes()
            if any(s.encode() in raw for s in self.special):
                cut = [self.cut.split(t or "") for t in texts.to_pylist()]  # ordinary, special, ordinary ...
                coded = iter(self._ordinary(pa.array([p for parts in cut for p in parts[::2]], pa.string())))
                return [b"".join(self.special[p] if i % 2 else next(coded) for i, p in enumerate(parts)) for parts in cut]
        return self._ordinary(texts)

    def _by_model(self, words: list[bytes], others: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words with their ids; those that are not plain go to ``others``."""
        tokenize, plain = self.model.tokenize, _PLAIN
        for word in words:
            text = word.decode()
            if not plain(text) or len(word) >= len(_PACK):
                others.append(word)
                continue
            if not text.isascii():
                text = text.lower().encode().decode("latin-1").translate(_BYTE_LEVEL)
            ids = [x.id for x in tokenize(text)]
            yield word, _PACK[len(ids)](*ids)

    def _ordinary(self, texts: pa.Array) -> list[bytes]:
        split, memo = self.words(texts), self.memo.known
        met: set[bytes] = set()
        for words in split:
            met.update(set(words).difference(memo))
        new = self.memo.missing(met)
        if self.model is not None:
            rare = []
            self.memo.learn(self._by_model(new, rare))
            new = rare
        for at in range(0, len(new), 4096):  # the library's results are large
            part = new[at : at + 4096]
            coded = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.memo.learn((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, coded))
        get = memo.__getitem__
        return [b"".join(map(get, words)) for words in split]



def token_pieces(df: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of at most ``size``: id, piece, start, length, ids_crc32 (and the ids)."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    sent = df.sparkSession.sparkContext.broadcast(spec)
    key = zlib.crc32(spec.encode())
    end = int(end_id).to_bytes(4, "little")
    kept = df.select(id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = worker_cache("words", key, make=lambda: WordIds(sent.value))
        for batch in small_batches(batches, text_col, 2 << 20):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, coded in enumerate(ids_of.texts(batch.column(text_col))):
                coded += end
                for k, at in enumerate(range(0, len(coded), 4 * size)):
                    part = coded[at : at + 4 * size]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [batch.column(id_col).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    id_type = kept.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack_documents(df: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack documents: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stash(token_pieces(df, path, size, id_col=id_col, text_col=text_col), "pieces")
    return pack(pieces, size, order_cols=(id_col, "piece"))
