"""Operator 4: token counts by offset-mapped attribution.

Whole documents are encoded once; the tokens' character spans are interval-joined to the document's
sections by a linear merge of two sorted lists (``searchsorted``), all rows of a batch at once. Rule
for a token that crosses a boundary: it belongs to the section that holds most of its characters, and
on a tie to the earlier one. A token of no whole character (part of a multi-byte one) belongs to the
section of the character that it ends within. So the sections' counts add up to the document's count.

Sections are the document's lines, each with its line feed; other spans come through ``attribute``.
Defined cases: a null or empty text is one empty section with no tokens; repeated rows are counted each;
extra columns pass by, and an id column named like a result raises; an empty table gives no rows; a text of any length is
encoded whole, in one task's memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import Codec, send_vocabulary, shared_codec
from .common import own_name, small_batches, utf8


def attribute(token_ends: np.ndarray, section_ends: np.ndarray) -> np.ndarray:
    """The section of each token. Both arrays hold ascending end positions in characters (the spans are gapless)."""
    starts = np.concatenate([[0], token_ends[:-1]])
    inside = np.where(token_ends > starts, starts, np.maximum(starts - 1, 0))  # the rest of a character begun before
    first = np.searchsorted(section_ends, inside, "right")
    last = np.searchsorted(section_ends, np.maximum(token_ends - 1, inside), "right")
    out = np.minimum(first, len(section_ends) - 1)
    for i in np.flatnonzero(last > first):  # the few that cross a boundary
        bounds = np.concatenate([[starts[i]], section_ends[first[i] : last[i]], [token_ends[i]]])
        out[i] = first[i] + int(np.argmax(np.diff(bounds)))
    return np.minimum(out, len(section_ends) - 1)


def _count(codec: Codec, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per line of each text: row, number of the line, characters, tokens."""
    ids = codec.encode(texts)
    buf, doc_ends = utf8(texts)
    lo = doc_ends[0]
    starts_char = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=starts_char[1:])  # characters begun before each byte
    lengths = pc.binary_length(codec.table.keys.take(ids.flatten())).to_numpy(zero_copy_only=False).astype(np.int64)
    token_ends = starts_char[lo + np.cumsum(lengths)]
    # a line ends after its line feed, a document ends its last line
    feeds = np.flatnonzero(buf[: doc_ends[-1]] == 10) + 1
    feeds = feeds[feeds > lo]
    n = len(texts)
    ends = np.concatenate([feeds, doc_ends[1:]])
    rows = np.concatenate([np.searchsorted(doc_ends, feeds - 1, "right") - 1, np.arange(n)])
    order = np.lexsort((np.concatenate([np.zeros(len(feeds)), np.ones(n)]), ends, rows))
    ends, rows = ends[order], rows[order]
    # a document that ends with a line feed has no further, empty line
    extra = np.zeros(len(ends), bool)
    extra[1:] = (rows[1:] == rows[:-1]) & (ends[1:] == ends[:-1])
    ends, rows = ends[~extra], rows[~extra]
    section_ends = starts_char[ends]
    chars = np.diff(np.concatenate([[starts_char[lo]], section_ends]))
    tokens = np.zeros(len(ends), np.int64)
    if len(token_ends):
        # empty sections never hold a token: join to the others alone
        real = np.flatnonzero(chars > 0)
        base = starts_char[lo]
        np.add.at(tokens, real[attribute(token_ends - base, section_ends[real] - base)], 1)
    line = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    return rows, line, chars, tokens


def count_tokens(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of each text: id, section int, n_chars long, n_tokens long."""
    own_name(id_col, "section", "n_chars", "n_tokens")
    sent = send_vocabulary(df.sparkSession, path, pattern)
    kept = df.select(id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(sent)
        for batch in small_batches(batches, text_col):
            texts = batch.column(text_col).fill_null("")
            rows, line, chars, tokens = _count(codec, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(rows)), pa.array(line.astype(np.int32)), pa.array(chars), pa.array(tokens)],
                [id_col, "section", "n_chars", "n_tokens"],
            )

    id_type = kept.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_col}` {id_type}, section int, n_chars long, n_tokens long")
