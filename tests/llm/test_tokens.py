"""Operators 1, 2 and 4: codec, packing, attribution."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelmill.llm import bpe, packing, queries, token_counts

from .conftest import ODD

RANKS = bpe.load_ranks(queries.BYTE_BPE)
CODEC = bpe.Codec(bpe.PerfectHash(RANKS), P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={k: i for i, k in enumerate(RANKS)}, special_tokens={})
WORDS = packing.WordIds(open(queries.WORD_BPE, encoding="utf-8").read())
TOKENIZER = Tokenizer.from_file(queries.WORD_BPE)


def ids(coded: bytes) -> list[int]:
    return np.frombuffer(coded, "<i4").tolist()


def test_perfect_hash_is_minimal_and_verifies():
    keys = [b"k%d" % i for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert table.find(keys).tolist() == list(range(5000)) and sorted(table.key_at.tolist()) == list(range(5000))
    assert (table.find([b"", b"k5000", b"other"]) == -1).all()


texts = st.text(st.sampled_from(list(" \n\t\r\x0b\x1c\x85\xa0 aBé́日1'slm.!?_<|>ß½")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_same_ids_as_tiktoken(text):
    assert ids(CODEC.encode_texts([text])[0]) == TIKTOKEN.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_same_word_ids_as_tokenizers(text):
    assert ids(WORDS.texts(pa.array([text]))[0]) == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|><|startoftext|>s", "a<|ENDOFTEXT|>b", "x <|end<|endoftext|> it's", "<|endoftext|>", "|<|endoftext|>|>é"])
def test_special_strings_are_as_the_library_has_them(text):
    both = WORDS.texts(pa.array(["plain words", text, None]))
    assert ids(both[1]) == TOKENIZER.encode(text, add_special_tokens=False).ids and ids(both[0]) and not ids(both[2])


def test_memo_is_bounded_in_bytes():
    from panelmill.llm.common import Memo

    memo = Memo(10_000)
    memo.learn([("x" * 9_900, b"1")])
    memo.trim()
    assert not memo.known and memo.held == 0


def test_real_and_odd_texts_round_trip(real):
    given_ = [t or "" for t in ODD] + real.text.tolist()
    coded = CODEC.encode(pa.array(given_))
    assert coded.to_pylist() == TIKTOKEN.encode_ordinary_batch(given_)
    assert [b.decode() for b in CODEC.decode(coded).to_pylist()] == given_


def test_a_small_memo_changes_nothing(real):
    codec, words = bpe.Codec(CODEC.table, P.PATTERN), packing.WordIds(open(queries.WORD_BPE, encoding="utf-8").read())
    codec.words.most = codec.memo.most = words.memo.most = 1_000
    for text in real.text.head(20):
        assert codec.encode_texts([text]) == CODEC.encode_texts([text])
        assert words.texts(pa.array([text])) == WORDS.texts(pa.array([text]))


def test_encode_and_decode_operators(odd, empty):
    coded = bpe.encode(odd, queries.BYTE_BPE, P.PATTERN)
    back = bpe.decode(coded, queries.BYTE_BPE, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.decode(bpe.encode(empty, queries.BYTE_BPE, P.PATTERN), queries.BYTE_BPE, P.PATTERN).collect() == []


def test_query_digests(spark, sf, real):
    import hashlib

    out = {r.doc_id: r for r in queries.op1_byte_bpe(spark, sf).collect()}
    for doc_id, text in zip(real.doc_id, real.text):
        want = TIKTOKEN.encode_ordinary(text)
        assert out[doc_id].n_tokens == len(want)
        assert out[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert out[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


# --- packing ------------------------------------------------------------------


def best_fit(histogram, size):
    import bisect

    rooms, used = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            i = bisect.bisect_left(rooms, length)
            room = rooms.pop(i) if i < len(rooms) else size
            used += room == size
            if room > length:
                bisect.insort(rooms, room - length)
    return used


def check_plan(histogram, size):
    placed, counts = {}, {}
    for length, first, n, sequence, at in packing.plan(histogram, size):
        assert first == counts.get(length, 0)
        counts[length] = first + n
        for k in range(n):
            placed.setdefault(sequence + k, []).append((at, length))
    assert counts == {k: v for k, v in histogram.items() if v}
    for parts in placed.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= size
    assert sorted(placed) == list(range(len(placed)))
    return len(placed)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 30), max_size=30))
def test_plans_are_valid_and_no_worse_than_best_fit_by_much(histogram):
    used = check_plan(histogram, 64)
    assert used <= best_fit(histogram, 64) * 1.08 + 1


def test_plan_near_the_bound():
    rng = random.Random(5)
    histogram = {}
    for _ in range(20_000):
        length = min(2048, max(1, int(rng.lognormvariate(6.3, 1.0))))
        histogram[length] = histogram.get(length, 0) + 1
    bound = -(-sum(k * v for k, v in histogram.items()) // 2048)
    assert check_plan(histogram, 2048) <= bound * 1.005 + 1


def test_nnls_fits_and_stays_positive():
    target = np.array([0, 4.0, 6.0, 4.0, 0])
    x = packing.nnls([(1, 3), (2, 2), (1, 1, 2)], target)
    assert (x >= 0).all() and np.abs(x - [4, 3, 0]).max() < 0.05


def test_packed_documents(odd, empty):
    out = packing.pack_documents(odd, queries.WORD_BPE, 64).toPandas()
    for i, text in enumerate(ODD):
        want = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]
        own = out[out.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(-(-len(want) // 64))) and own.start.tolist() == [64 * k for k in own.piece]
        assert own.length.tolist() == [len(want[64 * k : 64 * k + 64]) for k in own.piece]
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(want[64 * k : 64 * k + 64], "<u4").tobytes()) for k in own.piece]
    for _, parts in out.groupby("sequence_id"):
        parts = parts.sort_values("offset")
        assert parts.offset.tolist() == [0, *parts.length.cumsum()[:-1]] and parts.length.sum() <= 64
    assert packing.pack_documents(empty, queries.WORD_BPE).collect() == []


def test_repeated_rows_and_blocks(make, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 7)
    out = packing.pack_documents(make([(1, "a b c", "en", "s", 1, "", "", "", "")] * 100), queries.WORD_BPE, 8).toPandas()
    assert len(out) == 100 and len(out.drop_duplicates(["sequence_id", "offset"])) == 100 and out.sequence_id.nunique() == 50


# --- attribution ----------------------------------------------------------------


def brute(text):
    """Characters of each token by repeated decoding, then the rule as written."""
    tokens = TIKTOKEN.encode_ordinary(text)
    so_far, ends = 0, []
    for t in tokens:
        so_far += sum((b & 0xC0) != 0x80 for b in RANKS[t])
        ends.append(so_far)
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    bounds, at = [], 0
    for line in lines:
        bounds.append((at, at + len(line)))
        at += len(line)
    counts, start = [0] * len(lines), 0
    for end in ends:
        overlap = [min(end, b) - max(start, a) for a, b in bounds]
        if end > start:
            counts[int(np.argmax(overlap))] += 1
        else:
            counts[max(i for i, (a, b) in enumerate(bounds) if a < max(end, 1) <= b or (a <= end < b))] += 1
        start = end
    return [len(x) for x in lines], counts


def test_counts_by_line(make, empty, real):
    data = [t for t in ODD if t is None or "日" not in t] + real.text.head(60).tolist() + ["a\n\n\nb\n", "\n\n\n   x\n\n", "x\n"]
    out = token_counts.count_tokens(make(data), queries.BYTE_BPE, P.PATTERN).toPandas().sort_values(["doc_id", "section"])
    for i, text in enumerate(data):
        own = out[out.doc_id == i]
        chars, tokens = brute(text or "")
        assert own.section.tolist() == list(range(len(chars))) and own.n_chars.tolist() == chars
        assert own.n_tokens.sum() == len(TIKTOKEN.encode_ordinary(text or ""))
        assert own.n_tokens.tolist() == tokens, text
    assert token_counts.count_tokens(empty, queries.BYTE_BPE, P.PATTERN).collect() == []


def test_boundary_rule():
    assert token_counts.attribute(np.array([2, 5, 6]), np.array([3, 6])).tolist() == [0, 1, 1]
    assert token_counts.attribute(np.array([2, 4]), np.array([3, 4])).tolist() == [0, 0]  # a tie: the earlier one


@pytest.mark.parametrize("text", ["日本語\nテキスト", "é\n½"])
def test_multi_byte_tokens_add_up(make, text):
    out = token_counts.count_tokens(make([text]), queries.BYTE_BPE, P.PATTERN).toPandas()
    assert out.n_tokens.sum() == len(TIKTOKEN.encode_ordinary(text)) and out.n_chars.tolist() == [len(x) for x in text.splitlines(True)]


def test_frequent_words_outlast_rare_ones():
    from panelmill.llm.common import AgedMemo

    memo, asked = AgedMemo(8_000), []
    for i in range(200):
        new = memo.missing({b"often", b"rare%d" % i, b"seldom%d" % i})
        asked += new
        memo.learn((w, b"1234") for w in new)
        memo.trim()
    assert asked.count(b"often") == 1 and len(asked) == 401 and len(memo.known) + len(memo.old) < 40


@pytest.mark.parametrize("most", (4_000, 1 << 20))
def test_frequent_words_are_merged_once(monkeypatch, most):
    """Rare words that fill the codec's memory do not push out frequent ones; ids stay those of tiktoken."""
    codec, asked, merge = bpe.Codec(CODEC.table, P.PATTERN), [], bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda word, rank: asked.append(word) or merge(word, rank))
    codec.words.most = codec.memo.most = most
    texts = [f"xqzoftenq xqzoftenq, xqz{i}vw  zqx{i}" for i in range(200)]
    coded = [codec.encode_texts([t])[0] for t in texts]
    assert [ids(c) for c in coded] == [TIKTOKEN.encode_ordinary(t) for t in texts]
    assert asked.count(b" xqzoftenq") == 1


def test_plain_words_by_the_model_alone():
    """Every letter of Latin-1 in every place, repeated letters, and long words, as the whole library has them."""
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    words = [p % c for c in letters for p in ("%s", "a%sb", "%sund", "tion%s", "%s" * 2 % ("%s", "e"))] + ["ab" * n for n in range(1, 40)]
    rare: list[bytes] = []
    got = dict(WORDS._by_model([w.encode() for w in words], rare))
    assert WORDS.model is not None and len(got) > 400 and "×".encode() in rare
    for word, ids in got.items():
        assert list(np.frombuffer(ids, "<u4")) == WORDS.tokenizer.encode(word.decode(), add_special_tokens=False).ids
