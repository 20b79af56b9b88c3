"""Operator 3: main text of web pages by the maximum-scoring subsequence.

A page is a sequence of tags and runs of words. A word's score is a log-odds of standing in content, given where it
stands: the names, class words and flags of the elements around it, whether these are within an article, whether
it is in a link, and length and link share of its block. A tag's score is negative, or 0. All weights are fitted to
labelled pages: a few written out, and many put together from the parts below, where comments mark the content; no
name decides alone. One linear scan finds the contiguous region of the highest total score; what stands elsewhere is
dropped even where its own words score positive. Of the region, runs whose words score negative are left out (an
advert or comments within an article).

Time is linear in the page: tags are read by a pattern that never backtracks, and an end tag costs as much as the
elements it closes.

Defined cases: a null or empty page, or one without a region of positive score, has the empty text; a
page that breaks off inside a tag, comment or script loses that remainder; ``<br>`` is white space;
repeated rows and extra columns pass through, but for one named like a new column, which it replaces; an empty
table gives no rows; a page of any length is read whole, in one task's memory.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no markup.
RAW = {
    name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I)
    for name in "script style title textarea noscript template iframe svg xmp noembed noframes".split()
}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(>|\Z)|<[a-zA-Z/!?][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_PART = re.compile(r"[a-z0-9]+")


def element_features(name: str, attrs: str, within: bool) -> frozenset[str]:
    """What an element says of the words in it: its name (``@``: within an article), whole class words (``.``), their parts (``~``), flags (``!``)."""
    at = "@" if within else ""
    out = {name + at}
    for key, *values in _ATTR.findall(attrs) if attrs and not attrs.isspace() else ():
        key, value = key.lower(), next(filter(None, values), "").lower()
        if key in ("class", "id", "role"):
            for word in value.split():
                out.add(f".{word}")
                parts = _PART.findall(word)
                out.update(f"~{p}" for p in parts if len(parts) > 1)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            out.add("!hidden")
    return frozenset(out)


class Run:
    """A run of text: its block, the features around it, its words."""

    __slots__ = ("block", "around", "link", "words", "text")

    def __init__(self, block: int, around: frozenset[str], link: bool, text: str):
        self.block, self.around, self.link, self.text, self.words = block, around, link, text, len(text.split())


def pieces(page: str, weighed: frozenset[str] | None = None) -> Iterator[Run | str]:
    """Runs of text, tags (by name, with / for an end tag) and comments (whole) in page order. A run's features are those of
    the elements open around it, counted once each; only the ``weighed`` ones where given, so their number is bounded."""
    at, end, block = 0, len(page), 0
    nothing: frozenset[str] = frozenset()
    stack: list[tuple[str, frozenset[str]]] = []  # open elements, each with all features so far
    named = Counter()
    joined: dict[tuple[frozenset[str], frozenset[str]], frozenset[str]] = {}
    known: dict[tuple[str, str, bool], frozenset[str]] = {}

    def close(to: int) -> None:
        for name, _ in stack[to:]:
            named[name] -= 1
        del stack[to:]

    while at < end:
        found = _TAG.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            yield Run(block, stack[-1][1] if stack else nothing, named["a"] > 0, page[at:stop])
        if not found:
            return
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            yield found[0]
            continue
        if name in BLOCK:
            block += 1
        if found[1]:
            if named[name] > 0:
                to = len(stack) - 1
                while stack[to][0] != name:
                    to -= 1
                close(to)
            yield "/" + name
            continue
        if name in RAW:
            shut = RAW[name].search(page, at)
            at = shut.end() if shut else end
            yield name
            continue
        if name in BLOCK and named["p"] > 0:  # a paragraph ends where a block begins
            for i in range(len(stack) - 1, max(-1, len(stack) - 5), -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if name not in VOID and not found[3].rstrip().endswith("/"):
            key = name, found[3], named["article"] + named["main"] > 0
            if key not in known:
                found_here = element_features(*key)
                known[key] = found_here if weighed is None else found_here & weighed
            both = stack[-1][1] if stack else nothing, known[key]
            if both not in joined:
                joined[both] = both[0] | both[1]
            stack.append((name, joined[both]))
            named[name] += 1
        yield name


def block_features(runs: list[Run]) -> dict[int, tuple[str, ...]]:
    """Of each block: a bin of its length in words, and whether most of its words are links."""
    words, links = Counter(), Counter()
    for r in runs:
        words[r.block] += r.words
        links[r.block] += r.words * r.link
    return {b: (f"#{min(4, n.bit_length() // 2)}",) + (("#links",) if 2 * links[b] > n else ()) for b, n in words.items()}


# --- labelled pages ---------------------------------------------------------
# The parts that labelled pages are put together from. They only train weights.

#: Elements that are no content, by what they hold: links, prose or a form.
JUNK_LINKS = (
    '<nav>', '<nav class="main-menu">', '<nav role="navigation">', '<div class="menu">', '<ul id="navigation">', '<div class="navbar">', '<div class="breadcrumb">',
    '<div class="breadcrumbs">', '<header>', '<header class="site-header">', '<div class="header" id="top">', '<div class="topbar">', '<div class="toolbar">', '<div role="banner" class="masthead">',
    '<aside>', '<aside class="sidebar">', '<div class="sidebar">', '<div id="side" class="widget">', '<div class="widget-area">', '<div class="related">', '<div class="related-posts">',
    '<section class="recommended">', '<div class="share">', '<div class="share-buttons">', '<div class="sharing">', '<div class="social">', '<div class="social-links">', '<div class="pagination">', '<div class="pager">',
    '<div class="tags">', '<ul class="links">', '<footer>', '<footer class="site-footer">', '<div class="footer">', '<div id="footer" role="contentinfo">', '<menu>',
)
JUNK_PROSE = (
    '<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="adverts banner">', '<div class="ad-slot">', '<div class="advertisement">', '<section class="advertising">', '<div class="sponsor">', '<div class="sponsored">',
    '<div class="promo">', '<div class="promotion">', '<div class="banner">', '<div class="cookie-notice">', '<div id="cookie-notice">', '<div class="cookies">', '<div class="cookie-banner">', '<div id="consent">', '<div class="gdpr">', '<div class="notice">',
    '<div class="notices">', '<div class="alert">', '<div class="comments">', '<section id="comments">', '<ol class="comment-list">', '<div class="comment">', '<div id="respond" class="replies">', '<div id="disqus">', '<div class="newsletter">', '<div class="subscribe">',
    '<div class="popup">', '<div class="modal">', '<div class="overlay">', '<footer>', '<div class="footer">', '<div class="copyright">', '<div class="legal">', '<aside>', '<aside class="box">', '<dialog>', '<div class="sidebar">',
    '<div hidden>', '<p hidden>', '<div aria-hidden="true">', '<div style="display: none">',
)
JUNK_FORMS = ('<form>', '<form class="search">', '<form id="login">', '<div class="signup"><form>', '<fieldset>', '<button>', '<select>', '<label>', '<div role="search">')
#: Elements that hold content; some have words in their classes that others use for junk.
CONTENT = (
    '', '', '<article>', '<article class="post">', '<main>', '<main id="content">', '<main><article>', '<article><section>', '<div class="content">', '<div id="content">', '<div class="article">', '<div class="article-body">', '<div class="entry-content">',
    '<div class="post-content">', '<div class="story">', '<div class="text">', '<section class="body">', '<div>', '<div class="main">', '<div id="page"><div class="inner">', '<div class="social-science">', '<section id="search-and-rescue">', '<div id="side-effects">',
    '<article class="legal-history">', '<section class="ad-hoc-committee">', '<div class="banner-headline-story">', '<article id="menu-of-the-day">', '<div class="related-work">', '<div class="comment-on-law">', '<article title="a hidden notice">',
)
PAGES = 400
#: How often a block of a labelled page's content is followed by an element that is none.
INNER = 0.3
#: Penalty of the weights.
RIDGE = 0.3
#: Labelled pages: <!--[--> and <!--]--> enclose the content.
LABELLED = (
    """<html><head><title>t t</title></head><body><header><a href="/">Home</a> <a href="/b">News</a></header><nav><ul><li><a>one</a></li><li><a>two</a></li>
    <li><a>three</a></li></ul></nav><div class="ad">Buy now and save money today</div><article><!--[--><h1>The harbour opens again</h1><p>After two long winters of repair the
    harbour opened its gates to small boats on Monday.</p><p>Fishermen said that they had <b>waited</b> for this day, and that the <a href="/x">new wall</a> would hold for many
    years.</p><p>The town paid for half of the work.</p><!--]--></article><footer>&copy; town paper <a>imprint</a></footer></body></html>""",
    """<html><body><div id="menu"><a>start</a> | <a>archive</a> | <a>about</a></div><div id="content"><!--[--><h2>A note on bread</h2><p>Flour, water and salt are all
    that one needs, and some patience while the dough rests overnight.</p><ul><li>Mix everything in a large bowl.</li><li>Wait until the morning and bake it hot.</li></ul>
    <p>It keeps for a week.<br>Cut it when cold.</p><!--]--></div><div class="sidebar"><p>Popular: <a>cake</a> <a>soup</a></p></div><div class="comments"><p>I tried it and
    it was fine.</p><p>Mine burnt.</p></div><form><label>Your name</label><input><button>Send</button></form><div class="footer">All rights reserved</div></body></html>""",
    """<body><div class="cookie-notice">We use cookies to make this site better. <button>Accept</button></div><nav><a>a</a><a>b</a><a>c</a><a>d</a></nav><main><!--[-->
    <p>The committee met for the third time this spring and agreed on nothing but the date of its next meeting.</p><blockquote>We will need more time, the chair
    said.</blockquote><p>Observers were <em>not</em> surprised at all by that.</p><!--]--></main><aside><ul><li><a>Related story</a></li><li><a>Another story</a></li></ul>
    </aside><table class="widget"><tr><td><a>x</a></td><td><a>y</a></td></tr></table><footer><p>Contact, legal notice</p></footer></body>""",
    """<body><ul><li><a>Sports</a></li><li><a>Weather</a></li><li><a>Travel</a></li><li><a>Money</a></li></ul><article><!--[--><h1>Rain</h1><p>It rained for nine days.</p>
    <h3>Then the sun</h3><p>On the tenth the sun came out, <i>and the river</i> fell by a hand within hours, leaving mud on every street of the lower town.</p><!--]-->
    </article><div><a>Previous</a> <a>Next</a></div></body>""",
)


def _closing(opening: str) -> str:
    return "".join(f"</{name}>" for name in reversed(re.findall(r"<([a-z0-9]+)", opening)))


def labelled_pages(seed: int = 3) -> Iterator[str]:
    """The pages above, and ``PAGES`` put together from the parts by a fixed rule."""
    yield from LABELLED
    rng = random.Random(seed)
    said = lambda n: " ".join("w" * rng.randint(1, 9) for _ in range(n))  # noqa: E731  words: only their number tells
    begin, end = "<!--[-->", "<!--]-->"

    def link(n: int) -> str:
        return f"<a href='/{said(1)}'>{said(n)}</a>"

    def junk() -> str:
        kind = rng.choices("lpf", (5, 5, 1))[0]
        opening = rng.choice({"l": JUNK_LINKS, "p": JUNK_PROSE, "f": JUNK_FORMS}[kind])
        if kind == "l":
            many = [link(rng.randint(1, 6)) for _ in range(rng.randint(2, 9))]
            inner = rng.choice(["<ul><li>" + "</li><li>".join(many) + "</li></ul>", " ".join(many), " | ".join(many), said(rng.randint(1, 9)) + " ".join(many)])
        elif kind == "p":
            inner = rng.choice(["", "<p>", "<p>", "<li>", "<h3>"]).join(said(rng.randint(3, 30)) + rng.choice(["", "", link(1)]) for _ in range(rng.randint(1, 4)))
        else:
            inner = f"<label>{said(2)}</label><input><button>{said(1)}</button><option>{said(1)}</option>" + rng.choice(["", f"<p>{said(6)}</p>"])
        return opening + inner + _closing(opening)

    def sentence(n: int) -> str:
        return said(n) + rng.choice(["", "", "", " " + link(rng.randint(1, 4)) + " " + said(3), f" <b>{said(2)}</b>", f" <em>{said(1)}</em> " + said(2), "<br>" + said(4), f"<code>{said(1)}</code>"])

    def block() -> str:
        kind = rng.choices(("p", "h", "ul", "quote", "table", "pre", "figure", "dl", "links", "bare"), (12, 3, 2, 1, 1, 1, 1, 1, 1, 2))[0]
        lines = [sentence(rng.randint(1, 25)) for _ in range(rng.randint(1, 4))]
        if kind == "p":
            return f"<p>{sentence(rng.randint(4, 90))}" + rng.choice(["</p>", "</p>", ""])
        if kind == "h":
            name = f"h{rng.randint(1, 4)}"
            attrs = rng.choice(["", "", ' id="notice-of-change"', ' class="menu-title"', ' class="legal-side"'])
            return f"<{name}{attrs}>{said(rng.randint(1, 9))}</{name}>"
        if kind == "ul":
            name = rng.choice(["ul", "ol"])
            return f"<{name}><li>" + "</li><li>".join(lines) + f"</li></{name}>"
        if kind == "bare":
            return lines[0] + "<br>"
        if kind == "quote":
            return f"<blockquote>{rng.choice(['', '<p>'])}{lines[0]}</blockquote>"
        if kind == "table":
            return "<table><tr><td>" + "</td><td>".join(lines) + "</td></tr></table>"
        if kind == "pre":
            return f"<pre>{said(12)}</pre>"
        if kind == "figure":
            return f"<figure><img src=x><figcaption>{said(6)}</figcaption></figure>"
        if kind == "dl":
            return f"<dl><dt>{said(2)}</dt><dd>{lines[0]}</dd></dl>"
        return rng.choice([f"<ul><li>{link(3)}</li><li>{link(4)}</li></ul>", f"<p>{link(5)}</p>", f"<p>{said(1)} {link(3)}, {link(2)}</p>"])

    for _ in range(PAGES):
        out = ["<html><head><title>t</title><style>p{}</style></head><body>"] + [junk() for _ in range(rng.randint(0, 5))]
        for _ in range(rng.choice((1, 1, 1, 2))):
            opening = rng.choice(CONTENT)
            out.append(opening + begin)
            if rng.random() < 0.3 and ("article" in opening or "main" in opening):
                out.append(f"<header><h1>{said(5)}</h1>{rng.choice(['', f'<p>{said(4)}</p>'])}</header>")
            for _ in range(rng.randint(2, 12)):
                wrap = rng.choice([""] * 6 + ["<div>", '<div class="paragraph">', "<section>", '<div class="row"><div class="col">'])
                out.append(wrap + block() + _closing(wrap))
                if rng.random() < INNER:
                    out.append(end + junk() + begin)
            out.append(end + _closing(opening))
        yield "".join(out + [junk() for _ in range(rng.randint(1, 5))]) + "</body></html>"
    for _ in range(PAGES // 5):  # fragments: content and hardly anything else
        yield rng.choice(["", "", "<body>", "<nav>" + link(1) + "</nav>"]) + begin + rng.choice([said(rng.randint(1, 60)), block(), f"<div>{said(rng.randint(1, 30))}</div>"]) + end


# --- weights ------------------------------------------------------------------

#: A word's score and a tag's are held within these: a long advert within an article must not outweigh what follows it.
MOST, LEAST, TAG_LEAST = 4.0, -0.5, -2.0


@cache
def fitted() -> tuple[dict[str, float], float, dict[str, float]]:
    """Weights of features, bias, and scores of tags. Features: ridge-penalised logistic regression over the labelled pages'
    runs, each as much as the root of its words; tags: smoothed log-odds of standing within content, at most 0."""
    rows: list[tuple[tuple[str, ...], float, bool]] = []
    inside, outside = Counter(), Counter()
    for page in labelled_pages():
        content, runs, labels = False, [], []
        for piece in pieces(page):
            if isinstance(piece, Run):
                if piece.words:
                    runs.append(piece)
                    labels.append(content)
            elif piece.startswith("<"):
                content = piece == "<!--[-->" or content and piece != "<!--]-->"
            else:
                (inside if content else outside)[piece] += 1
        of = block_features(runs)
        rows += [((*r.around, *(("#link",) if r.link else ()), *of[r.block]), math.sqrt(r.words), y) for r, y in zip(runs, labels)]
    seen = Counter(f for features, _, _ in rows for f in features)
    names = sorted(f for f, n in seen.items() if n >= 3)
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    for i, (features, _, _) in enumerate(rows):
        x[i, [at[f] for f in features if f in at]] = 1
    x[:, -1] = 1
    weight, y = np.array([w for _, w, _ in rows]), np.array([y for _, _, y in rows], float)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-3
    for _ in range(12):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    n_in, n_out = sum(inside.values()), sum(outside.values())
    tags = {t: min(0.0, max(TAG_LEAST, math.log((inside[t] + 0.5) / (n_in + 1)) - math.log((outside[t] + 0.5) / (n_out + 1)))) for t in {*inside, *outside}}
    return dict(zip(names, w[:-1].tolist())), float(w[-1]), tags


Model = tuple[dict[str, float], float, dict[str, float]]


def scored(page: str, model: Model | None = None) -> list[tuple[Run | str, float]]:
    """The pieces of a page with the score of each tag and of each word of a run."""
    weights, bias, tags = model or fitted()
    found = list(pieces(page, frozenset(weights)))
    of = block_features([p for p in found if isinstance(p, Run)])
    known: dict[frozenset[str], float] = {}
    out: list[tuple[Run | str, float]] = []
    for piece in found:
        if isinstance(piece, Run):
            base = known.get(piece.around)
            if base is None:
                base = known[piece.around] = bias + math.fsum(weights.get(f, 0.0) for f in piece.around)
            score = base + sum(weights.get(f, 0.0) for f in of[piece.block]) + (weights.get("#link", 0.0) if piece.link else 0.0)
            out.append((piece, max(LEAST, min(MOST, score))))
        elif not piece.startswith("<"):
            out.append((piece, tags.get(piece, 0.0)))
    return out


def best_region(page: list[tuple[Run | str, float]]) -> tuple[int, int]:
    """The maximum-scoring subsequence: the contiguous pieces of the highest total, in one scan; empty where none is positive."""
    best = total = 0.0
    region, begin = (0, 0), 0
    for i, (piece, score) in enumerate(page):
        total += score * piece.words if isinstance(piece, Run) else score
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, region = total, (begin, i + 1)
    return region


def main_text(page: str | None, model: Model | None = None) -> str:
    """The text of the best region of a page."""
    if not page:
        return ""
    all_pieces = scored(page, model)
    begin, end = best_region(all_pieces)
    blocks, block = [], []
    for piece, score in all_pieces[begin:end]:
        if isinstance(piece, Run):
            if score >= 0:
                block.append(piece.text)
        elif piece.lstrip("/") in BLOCK:
            blocks.append(block)
            block = []
        elif piece == "br":
            block.append(" ")
    blocks.append(block)
    texts = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``df`` without its html column, with ``text`` and ``n_chars`` (code points)."""
    new = (text_col, "n_chars")
    passed = [f for f in df.schema.fields if f.name not in (html_col, *new)]
    schema = T.StructType(passed + [T.StructField(text_col, T.StringType()), T.StructField("n_chars", T.LongType())])

    sent = df.sparkSession.sparkContext.broadcast(fitted())  # fitted once, some hundred weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, html_col):
            texts = [main_text(p, sent.value) for p in batch.column(html_col).to_pylist()]
            columns = [batch.column(f.name) for f in passed] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
