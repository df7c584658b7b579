"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the hierarchy.

A page becomes a tree of elements. Trees score each element from its subtree's densities, tag and
attribute tokens, depth and siblings. Decoding finds the labelling of highest likelihood in which an
element is outside, inside the article, or cut out of it; inside may follow outside or inside, and
all below a cut element is cut, so no choice contradicts an ancestor's. The text is that of inside elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import renamed_aside

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)|</\Z|<\Z""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe noembed noframes svg select button".split())
LITERAL = frozenset("xmp listing plaintext".split())  # their content is text, tags and references included
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ())}
TAG_KINDS = ("article main", "section div body", "p pre blockquote", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form fieldset", "table tbody tr td th", "figure figcaption")
KIND_OF = {t: k for k, ts in enumerate(TAG_KINDS) for t in ts.split()}
# Attribute tokens that mark the article, and those of the parts around it, by kind.
ARTICLE_TOKENS = frozenset("article articlebody content body entry main post story text blog hentry page prose read reader chapter".split())
AROUND_TOKENS = (
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination skip links tabs".split()),
    frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo promoted banner teaser outbrain taboola".split()),
    frozenset("header masthead topbar branding logo".split()),
    frozenset("footer copyright legal colophon bottom".split()),
    frozenset("sidebar side aside rail widget related recommended more popular tags share social follow".split()),
    frozenset("comment comments discussion reply replies respond disqus reader thread".split()),
    frozenset("cookie cookies consent notice alert warning gdpr popup modal overlay paywall disclaimer message".split()),
    frozenset("form search login signup subscribe newsletter register contact input".split()),
)
ABOVE = [KIND_OF[t] for t in ("article", "nav", "header", "footer", "aside", "form")]  # kinds of elements looked for among those above, too
FEATURES = 11 + len(TAG_KINDS) + 2 * (1 + len(AROUND_TOKENS)) + len(ABOVE)


class Node:
    __slots__ = ("tag", "tokens", "parent", "depth", "index", "parts", "own", "children", "hidden")

    def __init__(self, tag: str, tokens: tuple[str, ...], parent: int, depth: int, index: int, hidden: bool):
        self.tag, self.tokens, self.parent, self.depth, self.index, self.hidden = tag, tokens, parent, depth, index, hidden
        self.parts: list[tuple[int, str]] = []  # (place in the page, text); a link's text counts for link density
        self.own = [0, 0]
        self.children = 0


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Structural nodes in page order, and (node, text) pieces in page order; inline tags leave no trace, breaks a space."""
    nodes = [Node("#page", (), -1, 0, 0, False)]
    pieces: list[tuple[int, str]] = []
    stack, inline, at, n = [0], 0, 0, len(html)

    def say(text: str) -> None:
        if text:
            pieces.append((stack[-1], text))
            size = len(text) - text.count(" ")
            own = nodes[stack[-1]].own
            own[0] += size
            own[1] += size * (inline > 0)

    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        if m[5] and not m[7]:  # the page ends within this tag
            break
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if tag == "br" or tag == "hr":
            say(" ")
        if tag == "a":
            inline = max(0, inline + (-1 if closing else 1))
        if tag in VOID or tag in INLINE:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    inline = 0
                    break
            continue
        if tag in LITERAL and not closing:
            end = None if tag == "plaintext" else re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            say(" " + html[at : end.start() if end else n].replace("&", "&amp;") + " ")
            at = end.end() if end else n
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag == "head" or tag == "html":
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                t = nodes[stack[k]].tag
                if t == "p":
                    del stack[k:]
                    inline = 0
                    break
                if t in CLOSES_P or t in ("li", "td", "th", "body"):
                    break
        if tag in IMPLIED:
            ends, until = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                t = nodes[stack[k]].tag
                if t in until:
                    break
                if t in ends.split():
                    del stack[k:]
                    inline = 0
                    break
        tokens, hidden = (), False
        if attributes := m[3] or m[6]:
            for name, *values in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                    hidden = True
                elif name not in ("style", "aria-hidden"):
                    tokens += tuple(x.lower() for x in SPLIT.split(value) if x)
        up = nodes[stack[-1]]
        nodes.append(Node(tag, tokens, stack[-1], up.depth + 1, up.children, hidden))
        up.children += 1
        stack.append(len(nodes) - 1)
    return nodes, pieces


def features(nodes: list[Node], pieces: list[tuple[int, str]]) -> np.ndarray:
    """(nodes, FEATURES): subtree density, links, lists, punctuation, depth, siblings, tags and attribute tokens (own and nearest above)."""
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    own = np.array([x.own for x in nodes], np.float64)
    marks = np.zeros(n)
    for k, t in pieces:
        marks[k] += t.count(".") + t.count(",")
    p = np.array([x.tag == "p" for x in nodes], np.float64)
    li = np.array([x.tag == "li" for x in nodes], np.float64)
    below = np.column_stack([own, np.ones(n), p, li, marks])
    for k in range(n - 1, 0, -1):  # children come after their parents
        below[parent[k]] += below[k]
    up = np.maximum(parent, 0)
    chars = below[:, 0]
    x = np.zeros((n, FEATURES), np.float32)
    x[:, 0] = np.log1p(chars)
    x[:, 1] = below[:, 1] / np.maximum(chars, 1)
    x[:, 2] = chars / below[:, 2]
    x[:, 3] = np.log1p(below[:, 3])
    x[:, 4] = below[:, 4] / below[:, 2]
    x[:, 5] = below[:, 5] / np.maximum(chars, 1) * 100
    x[:, 6] = [a.depth for a in nodes]
    kids = np.array([a.children for a in nodes], np.float64)
    x[:, 7] = np.array([a.index for a in nodes]) / np.maximum(kids[up], 1)
    x[:, 8] = np.log1p(kids[up])
    x[:, 9] = chars / np.maximum(chars[up], 1)
    x[:, 10] = chars / max(chars[0], 1)
    wide = 1 + len(AROUND_TOKENS)
    base, kinds = 11 + len(TAG_KINDS), [11 + k for k in ABOVE]
    for k, a in enumerate(nodes):
        if (kind := KIND_OF.get(a.tag)) is not None:
            x[k, 11 + kind] = 1
        if a.tokens:
            s = set(a.tokens)
            x[k, base] = not s.isdisjoint(ARTICLE_TOKENS)
            for i, around in enumerate(AROUND_TOKENS):
                x[k, base + 1 + i] = not s.isdisjoint(around)
        if k:  # the nearest ancestor's
            x[k, base + wide : base + 2 * wide] = np.maximum(x[a.parent, base : base + wide], x[a.parent, base + wide : base + 2 * wide])
            x[k, base + 2 * wide :] = np.maximum(x[a.parent, kinds], x[a.parent, base + 2 * wide :])
    return x


class Boosted:
    """Gradient-boosted regression trees of depth 4 on binned features, logistic loss."""

    def __init__(self, trees: int = 60, rate: float = 0.3, bins: int = 32, depth: int = 4):
        self.trees, self.rate, self.bins, self.depth, self.grown, self.bias = trees, rate, bins, depth, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        code = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.bias)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-6)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = (at - first) * (len(e) + 1) + code[:, f]
                    gs = np.bincount(key, g, width * (len(e) + 1)).reshape(width, -1)
                    hs = np.bincount(key, h, width * (len(e) + 1)).reshape(width, -1)
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + width][better] = f
                    cut[first : first + width][better] = e[k[better]]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - ((1 << self.depth) - 1)
            value = self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + 1)
            z += value[leaf]
            self.grown.append((feature, cut, value))
        return self

    def decide(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        z, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, value in self.grown:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            z += value[at - ((1 << self.depth) - 1)]
        return z


def decode(nodes: list[Node], odds: np.ndarray, opening: float = 0.5, page: bool = False) -> np.ndarray:
    """Whether each node is inside: the most likely labelling of outside, inside and cut without contradictions. page: the page itself may be the article."""
    n = len(nodes)
    z = np.clip(odds, -8, 8)
    yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
    weight = 1 + np.log1p([x.own[0] for x in nodes])
    yes, no = (yes * weight).tolist(), (no * weight).tolist()
    out, into, cut = no[:], yes[:], no[:]  # best of the subtree if the node is outside, inside, cut
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent
        if nodes[k].hidden:
            into[k] = -1e18
        out[p] += max(out[k], into[k] - opening)
        into[p] += max(into[k], cut[k])
        cut[p] += cut[k]
    inside, state = np.zeros(n, bool), [0] * n  # 0 outside, 1 inside, 2 cut
    for k in range(n):
        above = state[nodes[k].parent] if k else 0
        if above == 0:
            state[k] = 1 if (k or page) and into[k] - opening > out[k] else 0
        else:
            state[k] = 1 if above == 1 and into[k] >= cut[k] else 2
        inside[k] = state[k] == 1
    return inside


def unmarked(nodes: list[Node], x: np.ndarray) -> np.ndarray:
    """Whether a node is neither a part around an article (by tag or attribute tokens), nor hidden, nor within such a one."""
    base, wide = 11 + len(TAG_KINDS), 1 + len(AROUND_TOKENS)
    around = x[:, base + 1 : base + wide].any(axis=1) | x[:, [11 + KIND_OF[t] for t in ("nav", "header", "footer", "aside", "form")]].any(axis=1)
    out = np.ones(len(nodes), bool)
    for k, a in enumerate(nodes):
        out[k] = not (around[k] or a.hidden) and (k == 0 or out[a.parent])
    return out


def chosen(nodes: list[Node], x: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """decode(), and where that leaves no text though the page has some outside marked parts, those nodes: a bare page is its own article."""
    inside = decode(nodes, odds)
    own = np.array([a.own[0] for a in nodes])
    if not own[inside].any():
        free = unmarked(nodes, x)
        if own[free].any():
            return decode(nodes, np.where(free, 4.0, -4.0), page=True)
    return inside


def gather(nodes: list[Node], pieces: list[tuple[int, str]], inside: np.ndarray) -> str:
    """Text of inside nodes: references decoded, white space made one space, blocks parted by one space."""
    parts, last = [], -1
    for k, t in pieces:
        if inside[k]:
            if last != k:
                parts.append(" ")
            parts.append(unescape(t))
        last = k
    return " ".join("".join(parts).split())


# Text-free outlines of common page layouts for training; {t} takes a paragraph, {s} a few words, {a} links.
PARTS = {
    "menu": ['<nav><ul>{a}</ul></nav>', '<div class="menu"><ul>{a}</ul></div>', '<div id="navbar">{a}</div>', '<ul class="breadcrumb">{a}</ul>'],
    "top": ['<header><div class="logo">{s}</div></header>', '<div class="masthead"><h1>{s}</h1><p>{s}</p></div>', '<div id="header">{s}</div>'],
    "advert": ['<div class="ad">{s}</div>', '<div class="sponsored"><p>{t}</p></div>', '<section class="promo-banner"><h3>{s}</h3>{s}</section>'],
    "notice": ['<div class="cookie-notice"><p>{t}</p></div>', '<div role="alert" class="alert">{s}</div>', '<section id="consent"><p>{t}</p></section>'],
    "form": ['<form action="/s"><label>{s}</label><input><p>{s}</p></form>', '<div class="newsletter-signup"><p>{s}</p></div>', '<form class="search"><fieldset>{s}</fieldset></form>'],
    "side": ['<aside><h3>{s}</h3><ul>{a}</ul></aside>', '<div class="sidebar"><p>{t}</p></div>', '<div class="related"><h4>{s}</h4><ul>{a}</ul></div>'],
    "comments": ['<section class="comments"><h3>{s}</h3><div class="comment"><p>{t}</p></div><div class="comment"><p>{t}</p></div></section>', '<div id="comments"><ol><li><p>{t}</p></li><li><p>{t}</p></li></ol></div>', '<div class="discussion"><article class="comment"><p>{t}</p></article></div>'],
    "bottom": ['<footer>{s}</footer>', '<div class="footer"><p>{s}</p><ul>{a}</ul></div>', '<div id="copyright">{s}</div>'],
}
BODIES = ['<article>{x}</article>', '<main>{x}</main>', '<div class="content">{x}</div>', '<div id="story-body">{x}</div>', '<div class="post-entry">{x}</div>', '<main><article>{x}</article></main>', '<div class="text">{x}</div>', '<article>{x}</article>', '<div>{x}</div>', '{x}']
BLOCKS = ['<p>{t}', '<p>{t}</p>', '<p>{t}</p>', '<p>{t}</p>', '<h2>{s}</h2>', '<p><b>{s}<br>', '<ul><li>{t}</li><li>{t}</li></ul>', '<blockquote><p>{t}</p></blockquote>', '<div><p>{t}</p></div>', '<p>{s}</p>', '<table><tr><td>{s}</td><td>{s}</td></tr></table>', '<p>{t} <a href="/x">{s}</a> {t}</p>']


def practice_page(rng: np.random.Generator, words: list[str]) -> str:
    """A made-up page from the outlines with the given words; the article's elements bear data-in."""

    def some(lo: int, hi: int) -> str:
        return " ".join(words[i] for i in rng.integers(0, len(words), int(rng.integers(lo, hi)))) + "."

    def fill(outline: str) -> str:
        links = "".join(f'<li><a href="/{k}">{some(1, 3)}</a></li>' for k in range(int(rng.integers(2, 9))))
        outline = outline.replace("{a}", links)
        while "{t}" in outline:
            outline = outline.replace("{t}", some(5, 120), 1)
        while "{s}" in outline:
            outline = outline.replace("{s}", some(1, 12), 1)
        return outline

    around = float(rng.choice([0.0, 0.3, 0.6, 0.9]))  # from bare articles to full pages

    def part(name: str) -> str:
        own = PARTS[name]
        return fill(own[int(rng.integers(len(own)))]) if rng.random() < around else ""

    inner = "<h1>{s}</h1>" * (rng.random() < 0.6)
    kind = rng.random()  # an article of line breaks, of one to three short paragraphs, or any
    if kind < 0.2:
        inner += "<p><b>{s}<br>" * int(rng.integers(0, 2))
    elif kind < 0.45:
        inner += "".join(("<p>{s}</p>", "<p>{s}", "<p>{t}</p>", "<div>{s}</div>", "{s}")[int(rng.integers(5))] for _ in range(int(rng.integers(1, 4))))
    else:
        inner += "".join(BLOCKS[int(rng.integers(len(BLOCKS)))] for _ in range(int(rng.integers(1, 12))))
    inner = re.sub(r"<(?!/|br|b>|a )([a-z0-9]+)", r"<\1 data-in", fill(inner))
    if rng.random() < 0.5:
        inner += part(("advert", "side", "comments", "form", "notice")[int(rng.integers(5))])
    body = re.sub(r"<(?!/)([a-z]+)", r"<\1 data-in", BODIES[int(rng.integers(len(BODIES)))]).replace("{x}", inner)
    before = "".join(part(x) for x in ("notice", "top", "menu", "advert", "form"))
    after = "".join(part(x) for x in ("side", "comments", "advert", "form", "bottom"))
    page = f"{before}{body}{after}"
    page = f"{'<div class=page>' * (wrap := int(rng.random() < 0.3))}{page}{'</div>' * wrap}"
    return page if rng.random() < 0.3 else f"<html><body>{page}</body></html>"


def practice_nodes(html: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a practice page's elements."""
    inside = [m[2] is not None and "data-in" in (m[3] or "") for m in TOKEN.finditer(html) if (m[2] or m[5]) and not (m[1] or m[4]) and (m[2] or m[5]).lower() not in INLINE | VOID | RAW | {"html", "head"}]
    nodes, pieces = parse(html.replace(" data-in", ""))
    assert len(inside) == len(nodes) - 1
    return features(nodes, pieces)[1:], np.array(inside, np.float64)


def train(pages: DataFrame, practice: int = 1200, sample: int = 300, seed: int = 3) -> Boosted:
    """Fit on made-up layouts and on a bounded sample of pages.

    practice: number of made-up pages (their words come from the sample). sample: the first so many
    pages by a hash of the id; of those, pages with one article or main element add their nodes, as inside where
    they are within it and neither they nor what holds them there are nav, header, footer, aside, form or so called. Without pages the made-up ones have stand-in words.
    """
    rng = np.random.default_rng(seed)
    rows = [r[0] or "" for r in pages.select("page_id", "html").orderBy(F.xxhash64(F.lit(seed), "page_id"), "html").limit(sample).select("html").toLocalIterator()]
    parsed = [parse(h) for h in rows]
    words = [w for _, pieces in parsed for _, t in pieces for w in t.split()][:50_000] or [f"word{k}" for k in range(500)]
    xs, ys = zip(*(practice_nodes(practice_page(rng, words)) for _ in range(practice)), strict=True)
    xs, ys = list(xs), list(ys)
    for nodes, pieces in parsed:
        tops = [k for k, a in enumerate(nodes) if a.tag in ("article", "main")]
        if len(tops) != 1:
            continue
        y = np.zeros(len(nodes))
        for k, a in enumerate(nodes):
            if k:
                around = a.tag in ("nav", "header", "footer", "aside", "form") or any(not t.isdisjoint(a.tokens) for t in AROUND_TOKENS)
                y[k] = k == tops[0] or y[a.parent] and not around
        xs.append(features(nodes, pieces)[1:])
        ys.append(y[1:])
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def extract_texts(model: Boosted, htmls: list[str]) -> list[str]:
    parsed = [parse(h) for h in htmls]
    x = [features(*p) for p in parsed]
    odds = model.decide(np.concatenate(x)) if x else np.zeros(0)
    out, at = [], 0
    for (nodes, pieces), own in zip(parsed, x, strict=True):
        out.append(gather(nodes, pieces, chosen(nodes, own, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract_pages(pages: DataFrame, model: Boosted) -> DataFrame:
    """Add text and n_chars (code points) to pages(page_id, url, html), from each whole html; html itself is left out.

    A null html is an empty one; a page without an article has the empty text; broken or cut markup is
    read as far as it goes; repeated rows are repeated. Clashing columns get the suffix _in.
    """
    pages = renamed_aside(pages, ("page_id", "html"), ("text", "n_chars"))
    kept = [c for c in pages.columns if c != "html"]
    held = pages.sparkSession.sparkContext.broadcast(model)  # a fixed number of trees

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 100):
                part = b.slice(i, 100)
                texts = extract_texts(held.value, [h or "" for h in part.column("html").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.mapInArrow(extract, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html"] + ["text string", "n_chars long"]))
