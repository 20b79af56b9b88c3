"""Operators 3, 5, 6, 7, 8, 9, 10 on odd rows, against plain Python, or by held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelmill.llm import chat, exact_dedup, html_text, jaccard, language, quality, queries, toxicity
from panelmill.llm.common import hash_spans, windows

from .conftest import ODD, rows

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


# --- 3: main text ---------------------------------------------------------------


@pytest.mark.parametrize("page", html_text.LABELLED)
def test_labelled_pages_give_back_their_content(page):
    inside = page.split("<!--[-->")[1].split("<!--]-->")[0]
    words = re.sub(r"<[^>]*>", " ", inside).split()
    assert " ".join(html_text.main_text(page).split()) == " ".join(words)


PAGES = {
    None: "", "": "", "<p>": "", "plain words": "plain words", "<nav><a>a</a></nav>": "",
    "<body><nav>menu here</nav><article><h1>T &amp; U</h1><p>a\n b<br>c &lt;d&gt; &eacute;</p><p>e</article><footer>f</footer>": "T & U\na b c <d> é\ne",
    "<article><p>a text of some words</p><div class='comments'><p>I say no</p></div><p>and more of them</p></article>": "a text of some words\nand more of them",
    "<main><script>var x='</p><p>no';</script><p>yes</p><style>p{}</style><form>name</form><aside>side</aside></main>": "yes",
    "<article><p>cut in a tag</p><p>and &am": "cut in a tag\nand &am", "<article><p>cut</p><p cla": "cut", "<article><p>one</p><!-- <p>two": "one",
    "<div id=cookie-notice>we use cookies</div><div class=\"article-body\"><p>body text of the page</p></div><p hidden>not seen</p>": "body text of the page",
    "<article><p>in<b>si</b>de</p><ul><li>x</li><li>y</li></ul></article>": "inside\nx\ny",
}


PAGES |= {
    "<nav><a>x</a> <a>y</a></nav><article><header><h1>The title of it</h1></header><p>a text of some more words</p></article><footer>foot</footer>": "The title of it\na text of some more words",
    '<div class="social-science"><h1>Title</h1><p>a long enough paragraph to be read</p></div>': "Title\na long enough paragraph to be read",
    '<article><p>first part with some words in it</p></article><div class="ad">buy now</div><article><p>second part with more words</p></article>': "first part with some words in it\nsecond part with more words",
    "<main><h1>Heading</h1><p>lead of the story</p><article><p>the nested article has more words</p></article></main>": "Heading\nlead of the story\nthe nested article has more words",
    '<article><h2 id="legal-history">Legal history</h2><section id="search-and-rescue"><p title="a hidden gem">more text</p></section></article>': "Legal history\nmore text",
}


def marked(page):
    return "".join(re.sub(r"<[^>]*>", " ", "".join(re.findall(r"<!--\[-->(.*?)<!--\]-->", page, re.S))).split())


def test_held_out_pages():
    """Pages of the same parts put together by another rule: figures are in the README."""
    same = lost = extra = words = 0
    for page in html_text.labelled_pages(99):
        want, got = marked(page), "".join(html_text.main_text(page).split())
        same, words = same + (want == got), words + len(want)
        lost, extra = lost + max(0, len(want) - len(got)), extra + max(0, len(got) - len(want))
    assert same >= 0.7 * (5 + html_text.PAGES * 6 // 5 - 1) and lost < 0.03 * words and extra < 0.02 * words


def brute_region(page):
    """The best contiguous pieces by trying all."""
    values = [s * p.words if isinstance(p, html_text.Run) else s for p, s in page]
    sums = np.concatenate([[0], np.cumsum(values)])
    return max(((sums[j] - sums[i]), i, j) for i in range(len(sums)) for j in range(i, len(sums)))[0]


def test_region_is_the_best_of_all():
    for page in list(html_text.labelled_pages(99))[:60]:
        pieces = html_text.scored(page)
        begin, end = html_text.best_region(pieces)
        total = sum(s * p.words if isinstance(p, html_text.Run) else s for p, s in pieces[begin:end])
        assert total == pytest.approx(brute_region(pieces))


def test_without_the_scan_more_than_the_article_comes_back(monkeypatch):
    menu = "<nav>" + "<a href=x>some link</a> " * 60 + "</nav>"
    page = f"<body><p>a blurb in passing words</p>{menu}<article><p>{'the story itself goes on ' * 8}</p></article></body>"
    story = ("the story itself goes on " * 8).strip()
    assert html_text.main_text(page) == story
    monkeypatch.setattr(html_text, "best_region", lambda pieces: (0, len(pieces)))
    assert html_text.main_text(page) == "a blurb in passing words\n" + story


@pytest.mark.parametrize("piece", ["<" + "a" * 4_000 + ' "', "<div>" * 4_000 + "</p>" * 4_000, "<span>" * 4_000 + "</b>" * 4_000, '<a "', "<", "<!--", "<p ", "<div class='", "<x a=b", "<script>", "</p>", "<div class=a{i}>", "<div id='n{i} x'>w", "<p>x"])
def test_malformed_megabyte_takes_a_moment(piece):
    import time

    page = "".join(piece.replace("{i}", str(i)) for i in range(1_000_000 // len(piece)))
    html_text.fitted()
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 5  # 0.1 to 2 s where the core is idle: linear in the number of elements


@pytest.mark.parametrize("page", list(PAGES))
def test_main_text(page):
    assert html_text.main_text(page) == PAGES[page]


def test_extract_passes_other_columns(spark, sf):
    df = spark.createDataFrame([(1, p, "was here", 5) for p in PAGES], "page_id long, html string, text string, n_chars int")
    out = html_text.extract(df).collect()
    assert [(r.text, r.n_chars) for r in out] == [(t, len(t)) for t in PAGES.values()]
    assert html_text.extract(df.limit(0)).collect() == []
    for r in queries.op3_main_text(spark, sf).collect():
        assert r.n_chars == len(r.text) > 0


# --- 5: toxicity ------------------------------------------------------------------


def test_label_model_finds_accuracies_and_the_correlated_pair():
    rng = np.random.default_rng(0)
    y = rng.random(60_000) < 0.3
    first = np.where(y, rng.random(len(y)) < 0.9, rng.random(len(y)) < 0.05)
    echo = np.where(rng.random(len(y)) < 0.95, first, rng.random(len(y)) < 0.5)
    other = np.where(y, rng.random(len(y)) < 0.8, rng.random(len(y)) < 0.1)
    code = first * 1 + echo * 2 + other * 4
    patterns = np.arange(8)
    votes = toxicity._bits(patterns, 3)
    labelled = np.array([[((code == p) & (y == k))[:3000].sum() for k in (0, 1)] for p in patterns], float)
    model = toxicity.LabelModel(3)
    model.fit(votes, np.bincount(code, minlength=8).astype(float), labelled)
    assert {frozenset((i, p)) for i, p in enumerate(model.parent) if p >= 0} >= {frozenset((0, 1))}
    truth = np.array([y[code == p].mean() for p in patterns])
    weight = np.bincount(code, minlength=8)
    assert (np.abs(model.posterior(votes) - truth) * weight).sum() / weight.sum() < 0.02


def test_held_out_toxicity(spark):
    out = queries.op5_toxicity(spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert len(out) == len(docs) and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    both = out.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9 and not held[(held.toxic == 0)].predicted.any()


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    assert len(toxicity.score(odd, labels, F.lit(True)).collect()) == len(ODD)
    one_kind = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r.score < 0.5 for r in toxicity.score(odd, one_kind, F.lit(True)).collect()} == {True}
    assert toxicity.score(empty, labels, F.lit(True)).collect() == []
    assert len(toxicity.score(odd, labels.limit(0), F.lit(True)).collect()) == len(ODD)


# --- 6: exact copies ------------------------------------------------------------------


def norm(t):
    return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")


@pytest.mark.parametrize("least", [1, 3, 500])
def test_groups_of_copies(make, empty, least):
    data = ODD + ["hot  text"] * 40 + ["hot\ntext"] * 5 + ["pair", "pair"]
    out = {r.doc_id: r for r in exact_dedup.groups(make(data), least_rows=least, most_winners=5).collect()}
    by = collections.defaultdict(list)
    for i, t in enumerate(data):
        by[norm(t)].append(i)
    for i, t in enumerate(data):
        own = by[norm(t)]
        want = (own[0], len(own), i == own[0], hashlib.sha256(norm(t).encode()).hexdigest())
        assert (out[i].keep_id, out[i].group_size, out[i].kept, out[i].text_sha256) == want
    assert exact_dedup.groups(empty).collect() == []


def test_keep_first_and_repeated_rows(make):
    data = rows(["a b", "a  b", "c"]) + rows(["a b"]) + rows(["c"], 2) + rows(["d"], 9)
    out = exact_dedup.keep_first(make(data))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(0, "a b"), (2, "c"), (9, "d")] and out.columns == make(data).columns
    kept = [r.kept for r in exact_dedup.groups(make(data), least_rows=1).collect()]
    assert sum(kept) == 3 and len(kept) == len(data)


def test_rows_of_one_id_and_equal_texts_keep_one_by_order(make):
    data = rows(["a  b", "c"]) + [(0, "a b", "xx", "s9", 7, "g", "i", "other", "l")] + rows(["a\tb"]) * 2
    for _ in range(2):
        out = exact_dedup.keep_first(make(data)).collect()
        assert sorted((r.doc_id, r.text, r.score) for r in out) == [(0, "a\tb", "s"), (1, "c", "s")]
    found = exact_dedup.groups(make(data + [(None, "c", None, None, 1, "", "", "", "")]), least_rows=1).collect()
    assert sum(r.kept for r in found) == 2 and {(r.keep_id, r.group_size) for r in found} == {(0, 4), (1, 2)}


@pytest.mark.parametrize("least", [1, 10_000])
def test_many_rows_of_one_digest(make, least):
    """A third of all rows is one text with one id, found by the sketch or not."""
    data = [(5, "hot", "en", "s", 1, "", "", "", "")] * 300 + [(i, "hot", "en", "s", 1, "", "", "", "") for i in range(3, 200)] + rows([f"t{i}" for i in range(100)], 1000)
    out = exact_dedup.groups(make(data), least_rows=least).collect()
    hot = [r for r in out if r.keep_id == 3]
    assert len(out) == len(data) and len(hot) == 497 and {r.group_size for r in hot} == {497} and [r.doc_id for r in hot if r.kept] == [3]


# --- 7: chat ----------------------------------------------------------------------------

TRICKY = ["", "hi", "a\nb", r"\### Assistant: </turn> ok", "</turn>\n### user: x", "### ", "\\", "\\\\", "a\\", "\\n", "<\\/turn>", "#\\## ", "é 日", "</turn>", "x</turn>\n", None]


def test_every_tricky_text_comes_back(spark, make):
    rng = random.Random(2)
    data = [(-1, i, role, t, "x") for i, (role, t) in enumerate([(r, t) for r in ("user", "assistant") for t in TRICKY])]
    data += [(c, i, rng.choice(["user", "assistant", "sys: tem", "a\\:b", None]), "".join(rng.choice(["\\", "</turn>", "\n", "### ", "a", ": ", "</turn>\n"]) for _ in range(rng.randint(0, 8))), "y") for c in range(60) for i in range(4)]
    data += [(99, 1, "assistant", "tie", "z"), (99, 1, "assistant", "tie", "z"), (99, None, "user", "first", "z")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.format_conversations(df).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for conv in {d[0] for d in data}:
        turns = sorted([d for d in data if d[0] == conv], key=lambda d: (d[1] is not None, d[1] or 0, d[2] or "", d[3] or ""))
        assert [(t.role, t.text) for t in out[conv].recovered] == [(d[2] or "", d[3] or "") for d in turns]
        assert out[conv].loss == "".join(d[3] or "" for d in turns if d[2] == "assistant")
        for t in out[conv].recovered:
            assert re.sub(r"\\(.)", r"\1", out[conv].formatted[t.start : t.start + t.length], flags=re.S) == t.text
    assert chat.format_conversations(df.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["### user: a</turn>\nrest", "user: a</turn>\n", "### user a</turn>\n", "### user: a ### b</turn>\n", "### user: a</turn>"])
def test_parser_rejects_what_the_grammar_does_not_produce(spark, text):
    from pyspark.sql import functions as F

    assert spark.range(1).select(chat.parse(F.lit(text))).first()[0] is None


def test_plain_turns_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b # c"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == "### user: a < b # c</turn>\n### assistant: yes</turn>\n"


# --- 8: similarity join -------------------------------------------------------------------


def shingles(text, n):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed, groups=14, copies=12):
    """Templates, copies with few and with many edits, passages in common, permutations and copies of copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(45)]
    texts = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 9, 15, 40, 120, 300]))] + (passage if g % 3 == 0 else [])
        for _ in range(copies):
            edit = list(rng.choice([base, base, texts[-1].split() if texts else base]))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                at = rng.randrange(len(edit) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    edit.insert(at, rng.choice(words))
                elif kind == 1 and at < len(edit) and len(edit) > 1:
                    del edit[at]
                elif at < len(edit):
                    edit[at] = rng.choice(words)
            texts.append(rng.choice([" ", "  "]).join(edit))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 60), (4, 2, 95)])
def test_components_equal_all_pairs(make, seed, n, percent):
    texts = ODD[:-1] + near_copies(seed)
    out = jaccard.join(make(texts), n, percent).toPandas().sort_values("doc_id")
    assert list(out.itertuples(index=False, name=None)) == brute_components(texts, n, percent)


def test_a_hot_group_whose_centre_does_not_link_all(make):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(300):
        edit = list(base)
        for _ in range(rng.choice([1, 4, 6, 8])):
            edit[rng.randrange(150)] = f"e{i}-{rng.randrange(10**6)}"
        texts.append(" ".join(edit))
    out = jaccard.join(make(texts), 4, 85).toPandas().sort_values("doc_id")
    assert list(out.itertuples(index=False, name=None)) == brute_components(texts, 4, 85)


def test_join_of_repeated_rows_and_of_nothing(make, empty):
    texts = near_copies(9, 4, 6)
    data = rows(texts)
    out = jaccard.join(make(data + data[:20]), 4, 85).toPandas().sort_values("doc_id").drop_duplicates()
    assert list(out.itertuples(index=False, name=None)) == brute_components(texts, 4, 85)
    assert jaccard.join(empty, 4, 85).collect() == []


def test_ids_beyond_the_broadcast_bound_join_by_shuffle(make, monkeypatch):
    from panelmill.llm import common

    monkeypatch.setattr(common, "MOST_BYTES", -1)
    texts = near_copies(5, 4, 6)
    out = jaccard.join(make(texts), 4, 85).toPandas().sort_values("doc_id")
    assert list(out.itertuples(index=False, name=None)) == brute_components(texts, 4, 85)


def test_span_hashes_tell_words_apart():
    words = [b"", b"a", b"b", b"ab", b"ba", b"aa", b"aaa", b"\x00", b"\x00\x00"] + [b"k%d" % i for i in range(20_000)]
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    h = hash_spans(buf, ends - [len(w) for w in words], ends)
    assert len(set(h.tolist())) == len(words)
    assert len(set(windows(h, 4).tolist())) == len(words) - 3


# --- 9: quality ---------------------------------------------------------------------------


def base(text):
    w = WORD.findall(text or "")
    grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = [False] * len(w)
    for k in range(len(w) - 7):
        if grams[tuple(w[k : k + 8])] > 1:
            hit[k : k + 8] = [True] * 8
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, sum(hit)


def test_base_counts_and_verdicts(spark, make, empty):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    data = ODD + ["a b c d e f g h\n" * 4, "x y\nx y\n x y\n\n", "a a a a a a a a a"] + docs.text.head(150).tolist()
    out = quality.judge(make(data)).toPandas().sort_values("doc_id")
    for text, r in zip(data, out.itertuples()):
        want = base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.judge(empty).collect() == []


def test_nulls_and_marks_are_groups_of_their_own(make):
    text = " ".join(f"word{i}" for i in range(40))
    data = [(i, f"{text} {i}", lang, source, 1, "", "", "", "") for i, (lang, source) in enumerate([("en", "*"), ("en", None), ("en", ""), (None, "s"), ("", "s"), ("*", "*")] * 3)]
    out = quality.judge(make(data)).collect()
    assert len(out) == len(data) and all(r.kept and r.distance is None for r in out)


@pytest.mark.parametrize("n", [59, 60])
def test_least_rows_of_a_group(spark, n):
    """A source of 59 rows is judged by its language's estimate, one of 60 by its own."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(500, 7)), rng.normal(size=(n, 7)) + 9])
    frame = pd.DataFrame(x, columns=quality.STATS).assign(g_lang="=en", g_source=["=big"] * 500 + ["=few"] * n, base_failed=False)
    assert {r.g_source for r in quality.estimates(spark.createDataFrame(frame)).collect()} == ({"*", "=big", "=few"} if n == 60 else {"*", "=big"})


def test_outliers_go_and_clean_documents_stay(spark):
    out = queries.op9_quality(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    passed = out[~out.base_failed]
    assert passed[passed.quality == 1].kept.mean() > 0.99 and passed[passed.quality == 0].kept.mean() < 0.1


def test_estimate_ignores_a_fifth_of_outliers(spark):
    rng = np.random.default_rng(1)
    d = len(quality.STATS)
    clean = rng.normal(5, 1, (4000, d))
    clean[:, 1] += clean[:, 0]
    bad = rng.normal(30, 0.5, (1000, d))
    frame = pd.DataFrame(np.vstack([clean, bad]), columns=quality.STATS).assign(g_lang="en", g_source="s", base_failed=False)
    found = quality.estimates(spark.createDataFrame(frame)).where("g_source = 's'").first()
    assert np.abs(np.array(found["mean"]) - clean.mean(0)).max() < 0.3
    lower = np.zeros((d, d))
    lower[np.tril_indices(d)] = found["factor"]
    distance = (((frame[list(quality.STATS)].to_numpy() - found["mean"]) @ lower.T) ** 2).sum(1) / found["scale"]
    assert (distance[:4000] < quality.CUTOFF).mean() > 0.999 and (distance[4000:] > quality.CUTOFF).all()


@pytest.mark.parametrize("copied", [True, False])
def test_estimate_ignores_a_third_of_junk(spark, copied):
    rng = np.random.default_rng(4)
    d = len(quality.STATS)
    clean = rng.normal(0, 1, (660, d)) * quality.FLOOR + 5
    bad = np.repeat(clean[:1], 340, 0) + 12 * np.eye(d)[2] * quality.FLOOR[2]
    if not copied:
        bad = bad + rng.normal(0, 1, bad.shape) * quality.FLOOR
    frame = pd.DataFrame(np.vstack([clean, bad]), columns=quality.STATS).assign(g_lang="en", g_source="s", base_failed=False)
    found = quality.estimates(spark.createDataFrame(frame)).where("g_source = 's'").first()
    assert np.abs((np.array(found["mean"]) - clean.mean(0)) / quality.FLOOR).max() < 0.5
    lower = np.zeros((d, d))
    lower[np.tril_indices(d)] = found["factor"]
    distance = (((frame[list(quality.STATS)].to_numpy() - found["mean"]) @ lower.T) ** 2).sum(1)
    assert distance[660:].min() > np.quantile(distance[:660], 0.99)


def brute_mcd(x):
    """The same estimate in plain numpy: whole sorts instead of bins, each start to its end."""
    d, best = x.shape[1], (math.inf,)
    deviation = 1.4826 * np.median(np.abs(x - np.median(x, 0)), 0)
    for mean, cov in ((np.median(x, 0), np.diag(deviation**2)), (x.mean(0), np.cov(x.T, bias=True))):
        cov, last = quality._floored(cov), math.inf
        while True:
            distance = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            half = np.argsort(distance)[: (len(x) + d + 1) // 2]
            step = x[half].mean(0), quality._floored(quality.CONSISTENT * np.cov(x[half].T, bias=True))
            logdet = np.linalg.slogdet(step[1])[1]
            if logdet >= last - quality.SETTLED:
                break
            (mean, cov), last = step, logdet
        best = min(best, (last, mean.tolist(), cov.tolist()))
    mean, cov = np.array(best[1]), np.array(best[2])
    distance = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    inner = x[distance <= quality.NATURAL * max(1, np.median(distance) / quality.MEDIAN)]
    return inner.mean(0), quality._floored(quality.NATURAL_CONSISTENT * np.cov(inner.T, bias=True))


def test_estimate_equals_brute_force_and_finds_a_correlated_outlier(spark):
    rng = np.random.default_rng(8)
    d = len(quality.STATS)
    mixed = rng.normal(0, 1, (200, d)) @ (np.eye(d) + 0.6 * np.triu(np.ones((d, d)), 1)) + 5
    mixed[:, 0] = mixed[:, 1] + rng.normal(0, 0.15, 200)
    odd = mixed.mean(0)
    odd[0], odd[1] = odd[0] + 1.5 * mixed[:, 0].std(), odd[1] - 1.5 * mixed[:, 1].std()  # within the margins, against the correlation
    x = np.vstack([mixed, odd])
    frame = pd.DataFrame(x, columns=quality.STATS).assign(g_lang="en", g_source="s", base_failed=False)
    found = quality.estimates(spark.createDataFrame(frame)).where("g_source = 's'").first()
    mean, cov = brute_mcd(x)
    lower = np.zeros((d, d))
    lower[np.tril_indices(d)] = found["factor"]
    distance = (((x - found["mean"]) @ lower.T) ** 2).sum(1)
    want = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    assert np.corrcoef(distance, want)[0, 1] > 0.99 and abs(np.log(np.median(distance / want))) < 0.1
    assert distance[-1] / found["scale"] > quality.CUTOFF and (distance[:-1] / found["scale"] < quality.CUTOFF).mean() > 0.97
    assert (np.abs(odd - mixed.mean(0)) < 2 * mixed.std(0)).all()


def test_duplicate_lines_alone_can_reject_and_floors_are_no_addition(spark, make):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    unique = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 400))).replace(" w1", "\nw1") for _ in range(80)]
    notice = "\n".join(f"read all\n{' '.join(rng.choice(words) for _ in range(9))}" for _ in range(60))
    data = [(i, t, "en", "s0", 7, "g", "i", "s", "l") for i, t in enumerate([*unique, notice])]
    out = {r.doc_id: r for r in quality.judge(make(data)).collect()}
    assert not out[80].base_failed and not out[80].kept and sum(out[i].kept for i in range(80)) >= 79
    wide = np.diag(np.square(quality.FLOOR)) * 4
    assert np.allclose(quality._floored(wide), wide)


# --- 10: language ---------------------------------------------------------------------------


def brute_bits(texts, text, order):
    """PPM with escape method C, context by context, over the folded bytes."""
    fold = lambda t: b" " + re.sub(rb"[^a-z\x80-\xff]+", b" ", t.encode().lower())
    squeeze = lambda b: re.sub(rb" +", b" ", b)
    counts = collections.defaultdict(collections.Counter)
    for t in map(squeeze, map(fold, texts)):
        for i in range(len(t)):
            for k in range(min(i, order) + 1):
                counts[t[i - k : i]][t[i]] += 1
    s, total = squeeze(fold(text)), 0.0
    for i in range(len(s)):
        context = (b" " * order + s[:i])[-order:] if order else b""
        bits = 0.0
        for k in range(order, -1, -1):
            c = counts.get(context[len(context) - k :], {})
            n, kinds = sum(c.values()), len(c)
            if s[i] in c:
                bits -= math.log2(c[s[i]] / (n + kinds))
                break
            if n:
                bits -= math.log2(kinds / (n + kinds))
        else:
            bits += 8.0
        total += bits
    return total


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_code_lengths_equal_the_definition(order):
    train = {"en": ["the cat sat on the mat", "The end."], "fr": ["le chat était là", "été"]}
    table = language.CostTable({k: language.count_contexts(pa.array(v), order) for k, v in train.items()}, order)
    for text in ["the mat", "le été", "zzz ΩQ", "a", "9 9"]:
        bits, _ = table.score(pa.array([text, text]))
        for j, lang in enumerate(table.languages):
            assert bits[1, j] == pytest.approx(brute_bits(train[lang], text, order), rel=1e-4)


def test_held_out_languages(spark):
    out = queries.op10_language(spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    both = out.merge(docs, on="doc_id")
    assert len(out) == len(docs) and (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.98


def test_language_of_odd_rows(odd, empty):
    counts = language.train(odd, F.lit(True))
    out = {r.doc_id: r for r in language.identify(odd, counts).collect()}
    for i, text in enumerate(ODD):
        has = bool(text) and any(c.isalpha() for c in text)
        assert (out[i].lang_pred != "und") == has and 0 <= out[i].score <= 1 and (has or out[i].score == 0)
    assert language.identify(empty, counts).collect() == []
    assert {r.lang_pred for r in language.identify(odd, language.train(empty, F.lit(True))).collect()} == {"und"}


def test_training_takes_whole_and_distinct_texts(make, monkeypatch):
    monkeypatch.setattr(language, "TRAIN_ROWS", 3)
    texts = ["abc " * 2000 + "zq", "the copy", "one more text"]
    data = [(i, t, "en", "s", 7, "g", "i", "s", "l") for i, t in enumerate([*texts, *["the copy"] * 20])]
    found = language.train(make(data + data[-2:]), F.lit(True))["en"]
    assert dict(zip(*(x.tolist() for x in found))) == language.count_contexts(pa.array(texts))


def test_order_holds_for_many_languages_and_wide_alphabets():
    rng = random.Random(5)
    alphabet = [chr(c) for c in (*range(97, 123), *range(0x3B1, 0x3CA), *range(0x430, 0x450), *range(0x4E00, 0x4F00))]
    train = {f"l{i}": ["".join(rng.choice([*alphabet, " "]) for _ in range(400)) for _ in range(3)] for i in range(7)}
    table = language.CostTable({k: language.count_contexts(pa.array(v)) for k, v in train.items()})
    assert table.order == language.ORDER == 3
    for text in (train["l2"][0][:150], "a ω я 一"):
        bits, _ = table.score(pa.array([text]))
        for j, lang in enumerate(table.languages):
            assert bits[0, j] == pytest.approx(brute_bits(train[lang], text, 3), rel=1e-4)
