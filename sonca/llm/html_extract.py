"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded so that no decision contradicts another.

A page is read once into block nodes (inline tags belong to their block's text; scripts, styles, controls and comments of
markup are no text). Trees score each node from its subtree's text and link density, attribute tokens, depth, place among
its siblings and what stands above it. Decoding takes the set of nodes that is closed upwards (a node is kept only with
all its ancestors) and has the largest sum of scores, by one pass from the leaves: a kept menu inside a dropped header,
or a dropped wrapper around a kept article, cannot come out.

The trees are trained on first use on pages that this module invents, with the parts real pages have under varied names
and nesting; no page of the table is used. Null html, and pages without text, give an empty string. Repeated rows give
repeated results. Broken markup is read as far as it goes: unclosed and stray tags are let be.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math canvas select button object audio video head".split())
#: Of these, what holds no tags: without its end it runs to the end of the page.
TO_END = frozenset("script style title textarea iframe noembed noframes xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
PEERS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|[!?/][^>]*+>)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall
TAGS = ("p", "div", "li", "ul", "ol", "nav", "header", "footer", "aside", "form", "article", "main", "section", "table", "td", "h1", "h2", "h3", "blockquote", "pre", "figure", "body")
GOOD = frozenset("article content main story post entry body text prose copy reading chapter".split())
BAD = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toc links topbar pagination pager sitemap skip",
    "edge": "header footer masthead banner colophon copyright legal foot bottom top brand logo",
    "side": "sidebar aside rail widget related recommended popular trending tags author bio share social secondary complementary more",
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promoted adsense dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall toast disclaimer warning",
    "form": "form search login register contact input field feedback",
    "comment": "comment comments reply replies discussion disqus respond reader readers thread reviews",
}
BAD_OF = {w: i for i, ws in enumerate(BAD.values()) for w in ws.split()}
HASHED = 16


class Page:
    """Block nodes in document order (parents before children) and the text blocks that lie directly in them."""

    __slots__ = ("tags", "parents", "attrs", "blocks", "hidden")

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.attrs, self.hidden = ["html"], [-1], [()], [False]
        self.blocks: list[tuple[int, str, int]] = []
        stack, held, linked, in_link, at = [0], [], 0, False, 0

        def flush() -> None:
            nonlocal held, linked
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self.blocks.append((stack[-1], text, linked))
                held, linked = [], 0

        endless, body = set(), False
        for m in _TAG.finditer(html):
            if m.start() < at:
                continue
            if m.start() > at:
                raw = html[at : m.start()]
                raw = unescape(raw) if "&" in raw else raw
                held.append(raw)
                if in_link:
                    linked += len(raw)
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, end = name.lower(), m[1] or m[4]
            if name in INLINE:
                if name == "a":
                    in_link = not end
                elif name == "br":
                    held.append(" ")
                continue
            if name in RAW:
                if not end and not (m[3] or m[6] or "").rstrip().endswith("/"):
                    close = None if name in endless else re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                    if close:
                        at = close.end()
                    elif name in TO_END:
                        at = len(html)
                    else:
                        endless.add(name)  # nor will a later one find its end
                continue
            flush()
            if end:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[i]] == name:
                        del stack[i:]
                        break
                in_link = False
                continue
            if name == "html":
                continue
            if name == "body":
                if body:
                    continue
                body = True
            if name in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[i]] == "p":
                        del stack[i:]
                        break
                    if self.tags[stack[i]] in ("td", "th", "table", "object"):
                        break
            if name in PEERS:
                peers, scope = PEERS[name]
                for i in range(len(stack) - 1, 0, -1):
                    tag = self.tags[stack[i]]
                    if tag in scope:
                        break
                    if tag in peers:
                        del stack[i:]
                        if name != "tbody":
                            break
            if name in VOID:
                continue
            in_link = False
            self.tags.append(name)
            self.parents.append(stack[-1])
            tokens, hidden = [], False
            if m[3] or m[6]:
                for a in _ATTR.finditer(m[3] or m[6]):
                    value = a[2] or a[3] or a[4] or ""
                    key = a[1].lower()
                    if key in ("hidden", "aria-hidden", "style"):
                        hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
                    else:
                        tokens += [t.lower() for t in _TOKEN(value)]
            self.attrs.append(tuple(tokens))
            self.hidden.append(hidden)
            stack.append(len(self.tags) - 1)
            if len(stack) > 200:  # deeper nodes stay where they are: their text lies in this one
                stack.pop()
        rest = html[at:]
        if rest.strip():
            held.append(unescape(rest))
        flush()


_CUES = re.compile(r"©|\(c\)|copyright|cookie|subscribe|newsletter|advert|sponsor|sign (?:up|in)|log in|all rights|privacy|reply|comments?\b|share|related|read more", re.I)
WIDTH = 18 + len(BAD) * 2 + 2 + HASHED + len(TAGS)


def features(page: Page) -> np.ndarray:
    """A row of WIDTH numbers for each node."""
    n = len(page.tags)
    own, links, marks, cues, count = ([0.0] * n for _ in range(5))
    sub, sub_links, sub_marks, sub_cues, sub_blocks, below = ([0.0] * n for _ in range(6))
    longest = [0.0] * n
    for i, text, linked in page.blocks:
        own[i] += len(text)
        links[i] += min(linked, len(text))
        marks[i] += text.count(".") + text.count(",") + text.count("。")
        count[i] += 1
        longest[i] = max(longest[i], len(text))
        if len(text) < 400 and _CUES.search(text):
            cues[i] += 1
    kids: list[int] = [0] * n
    order, depth = [0] * n, [0] * n
    twins: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = page.parents[i]
        order[i] = kids[p]
        kids[p] += 1
        depth[i] = depth[p] + 1
        twins[p, page.tags[i]] = twins.get((p, page.tags[i]), 0) + 1
    for i in range(n - 1, -1, -1):
        sub[i] += own[i]
        sub_links[i] += links[i]
        sub_marks[i] += marks[i]
        sub_cues[i] += cues[i]
        sub_blocks[i] += count[i]
        below[i] += 1
        if i:
            p = page.parents[i]
            sub[p] += sub[i]
            sub_links[p] += sub_links[i]
            sub_marks[p] += sub_marks[i]
            sub_cues[p] += sub_cues[i]
            sub_blocks[p] += sub_blocks[i]
            below[p] += below[i]
            longest[p] = max(longest[p], longest[i])
    out = np.zeros((n, WIDTH), np.float32)
    total, before = max(1.0, sub[0]), 0.0
    k = len(BAD)
    for i in range(n):
        p, row = page.parents[i], out[i]
        row[:18] = (
            min(depth[i], 40), kids[i], order[i], kids[p] if i else 1, twins.get((p, page.tags[i]), 1), np.log1p(sub[i]), np.log1p(own[i]), sub[i] / total, sub_links[i] / max(1.0, sub[i]), links[i] / max(1.0, own[i]),
            sub_marks[i] / max(1.0, sub[i]) * 100, np.log1p(sub[i] / max(1.0, sub_blocks[i])), np.log1p(longest[i]), sub[i] / max(1.0, below[i]), sub_cues[i] / max(1.0, sub_blocks[i]), before / total, sub[i] / max(1.0, sub[p] if i else total), page.hidden[i],
        )
        if i and page.hidden[p]:
            page.hidden[i] = True
            row[17] = 1
        before += own[i]
        at = 18
        for t in page.attrs[i]:
            if t in BAD_OF:
                row[at + BAD_OF[t]] += 1
            elif t in GOOD:
                row[at + 2 * k] += 1
            row[at + 2 * k + 2 + zlib.crc32(t.encode()) % HASHED] += 1
        own_tag = {"nav": 0, "header": 1, "footer": 1, "aside": 2, "form": 5}.get(page.tags[i])
        if own_tag is not None:
            row[at + own_tag] += 1
        if i:  # what stands above: the parent's own tokens and what stood above it
            row[at + k : at + 2 * k] = out[p, at : at + k] + out[p, at + k : at + 2 * k]
            row[at + 2 * k + 1] = out[p, at + 2 * k] + out[p, at + 2 * k + 1] + (page.tags[p] in ("article", "main"))
        if page.tags[i] in TAG_AT:
            row[at + 2 * k + 2 + HASHED + TAG_AT[page.tags[i]]] = 1
    return out


TAG_AT = {t: i for i, t in enumerate(TAGS)}


class Trees:
    """Gradient-boosted trees for a yes/no label: second-order steps on histograms of quantile bins.

    Each tree is grown on half the rows, drawn anew, and gives all of them their next score.
    """

    def __init__(self, trees: int = 90, depth: int = 4, rate: float = 0.2, bins: int = 32, share: float = 0.5) -> None:
        self.n, self.depth, self.rate, self.bins, self.share = trees, depth, rate, bins, share

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        score, self.trees, size, rng = np.full(len(y), self.base), [], 1 << self.depth, np.random.default_rng(len(y))
        for _ in range(self.n):
            drawn = np.flatnonzero(rng.random(len(y)) < self.share)
            part, p = binned[:, drawn], 1 / (1 + np.exp(-score[drawn]))
            g, h, node = y[drawn] - p, p * (1 - p), np.zeros(len(drawn), np.int64)
            feature, cut = np.zeros(size, np.int64), np.full(size, self.bins, np.int64)
            for level in range(self.depth):
                width = 1 << level
                best = np.full(width, 1e-6)
                for f, edges in enumerate(self.edges):
                    bins = len(edges) + 1
                    key = node * bins + part[f]
                    gs, hs = (np.bincount(key, v, width * bins).reshape(width, bins) for v in (g, h))
                    gl, hl = gs.cumsum(1), hs.cumsum(1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < 1) | (ht - hl < 1)] = 0
                    top = gain.argmax(1)
                    at = np.flatnonzero(gain[np.arange(width), top] > best)
                    best[at] = gain[at, top[at]]
                    feature[width + at] = f
                    cut[width + at] = top[at]
                node = 2 * node + (part[feature[width + node], np.arange(len(drawn))] > cut[width + node])
            gs, hs = np.bincount(node, g, size), np.bincount(node, h, size)
            limit = np.array([self.edges[f][c] if c < len(self.edges[f]) else np.inf for f, c in zip(feature, cut, strict=True)])
            self.trees.append((feature, limit, self.rate * gs / (hs + 1)))
            score += self._steps(x, *self.trees[-1])
        return self

    def _steps(self, x: np.ndarray, feature: np.ndarray, limit: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """What one tree adds to the score of each row."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for level in range(self.depth):
            at = (1 << level) + node
            node = 2 * node + (x[rows, feature[at]] > limit[at])
        return leaf[node]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self._steps(x, *tree)
        return out


def _invent(rng: np.random.Generator) -> tuple[str, str]:
    """A page whose attribute `data-y` on content nodes and their wrappers is the label; and its main text."""
    vocabulary = ["".join(rng.choice(list("abcdefghilmnoprstuvéäñ"), rng.integers(2, 9))) for _ in range(60)]
    pick = lambda *x: x[rng.integers(len(x))]
    words = lambda n: " ".join(rng.choice(vocabulary, max(1, n)))
    noise = lambda: pick("", "", "", f"c{rng.integers(1000)}", f"col-{rng.integers(12)}", "wrap", "inner", "box row", "css-1x", "block", "item")

    def sentence() -> str:
        return words(int(rng.integers(1, 18))).capitalize() + pick(".", ".", ".", ",", "!", "")

    def attr(tokens: str, sure: float = 0.85) -> str:
        value = f"{tokens if rng.random() < sure else ''} {noise()}".strip()
        value = value if rng.random() < 0.8 else value.replace("-", "_")
        return f' {pick("class", "class", "id")}="{value}"' if value else ""

    def links(n: int) -> str:
        return "".join(pick(f'<li><a href="/{words(1)}">{words(int(rng.integers(1, 4)))}</a></li>', f'<a href="#">{words(1)}</a> ') for _ in range(n))

    def bad(kind: int) -> str:
        n = int(rng.integers(2, 9))
        if kind == 0:
            return pick(f"<nav{attr('nav', 0.4)}><ul>{links(n)}</ul></nav>", f"<div{attr(pick('menu', 'main-menu', 'navbar', 'breadcrumb', 'site-nav', 'navigation'))}><ul>{links(n)}</ul></div>", f'<div role="navigation">{links(n)}</div>', f"<ul{attr(pick('menu', 'nav-list', 'breadcrumbs', 'pagination'))}>{links(n)}</ul>")
        if kind == 1:
            inner = pick(f"<h1>{words(3)}</h1>", f"<p>{words(4)}</p>", f"<a href=/>{words(2)}</a>", f"<div{attr('logo')}>{words(2)}</div><p>{sentence()}</p>") + pick("", links(3))
            return pick(f"<header{attr('site-header', 0.5)}>{inner}</header>", f"<div{attr(pick('header', 'masthead', 'page-header', 'top-bar'))}>{inner}</div>")
        if kind == 2:
            inner = pick(f"&copy; {words(2)} {pick('', sentence())}", f"<p>{pick('© 2023', 'Copyright', '')} {sentence()}</p>", f"<div>{links(n)}</div><p>{sentence()}</p>", f"&copy; example.org &middot; {sentence()} {sentence()}")
            return pick(f"<footer{attr('footer', 0.4)}>{inner}</footer>", f"<div{attr(pick('footer', 'site-footer', 'colophon', 'copyright', 'page-foot'))}>{inner}</div>")
        if kind == 3:
            inner = pick(f"<h3>{words(2)}</h3><ul>{links(n)}</ul>", f"<p>{sentence()} {sentence()}</p>", f"<div><h4>{words(2)}</h4><p>{sentence()}</p></div>" * 2)
            return pick(f"<aside{attr('sidebar', 0.5)}>{inner}</aside>", f"<div{attr(pick('sidebar', 'side-bar', 'related', 'right-rail', 'widget', 'recommended', 'popular-posts', 'share-buttons'))}>{inner}</div>")
        if kind == 4:
            inner = pick(sentence() + " " + sentence(), f"<p>{sentence()} {sentence()}</p>", f"<a href=#>{words(3)}</a>", f"<p>{pick('Advertisement', 'Sponsored', '')} {sentence()}</p>")
            return f"<{(t := pick('div', 'div', 'section', 'aside', 'p'))}{attr(pick('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo', 'advertisement', 'banner-ad'), 1 if t in ('div', 'p', 'section') else 0.6)}>{inner if t != 'p' else sentence()}</{t}>"
        if kind == 5:
            inner = pick(f"<p>{pick('This site uses cookies.', 'We use cookies', '')} {sentence()}</p><button>OK</button>", f"{pick('Subscribe to our newsletter', '')} {sentence()}", f"<p>{sentence()}</p>")
            return f"<{(t := pick('div', 'div', 'section', 'dialog'))}{attr(pick('cookie-banner', 'cookie', 'consent', 'gdpr-notice', 'notice', 'newsletter', 'popup', 'alert', 'modal', 'subscribe-box'), 1)}>{inner}</{t}>"
        if kind == 6:
            return f"<form{attr(pick('search', 'login', 'contact-form', ''), 0.6)}>{pick('<label>' + words(2) + '</label>', '<p>' + sentence() + '</p>', words(3))}<input name=q><button>{words(1)}</button></form>"
        one = lambda: pick(f"<li><b>{words(1)}</b> <p>{sentence()} {sentence()}</p></li>", f"<div{attr(pick('comment', 'reply', 'comment-body'))}><p>{sentence()} {words(12)}.</p></div>", f"<article{attr('comment', 1)}><p>{sentence()} {sentence()} {sentence()}</p></article>")
        return f"<{(t := pick('div', 'section', 'ol'))}{attr(pick('comments', 'comment-list', 'discussion', 'responses comments', 'disqus_thread', 'reader-comments', 'replies'), 1)}>{pick('<h3>Comments</h3>', f'<h3>{words(2)}</h3>', '')}{''.join(one() for _ in range(rng.integers(1, 5)))}</{t}>"

    y, main = ' data-y="1"', []

    def good() -> str:
        t = " ".join(sentence() for _ in range(max(1, int(rng.exponential(3)))))
        if rng.random() < 0.03:  # an article may say what notices say
            t = pick("", t + " ") + pick("All rights reserved.", "Copyright 2023.", "© " + words(2), "Read more.", "Share this.", "Subscribe.", "Privacy.", "Reply to " + words(1) + ".", "Log in.", "Cookies.", "Comments.", "Sponsored.")
        main.append(t)
        shape = rng.random()
        if shape < 0.7:
            return f"<p{y}>{pick('', '', '<b>', '<i>')}{t}" + pick("</p>", "</p>", "<br>")
        if shape < 0.8:
            return f"<{(h := pick('h2', 'h3'))}{y}>{t}</{h}>"
        if shape < 0.87:
            return f"<ul{y}><li{y}>{t}</li></ul>"
        if shape < 0.92:
            return f"<blockquote{y}><p{y}>{t}</p></blockquote>"
        if shape < 0.96:
            return f"<div{y}{attr(pick('text', 'paragraph', ''), 0.5)}>{t}</div>"
        return f"<table{y}><tr{y}><td{y}>{t}</td></tr></table>"

    title = sentence()
    main.append(title)
    body = [f"<h1{y}>{title}</h1>"] if rng.random() < 0.8 else [f"<header{y}{attr(pick('entry-header', 'article-header'), 0.6)}><h1{y}>{title}</h1></header>"]
    for _ in range(max(1, int(rng.exponential(7)))):
        body.append(good())
        if rng.random() < 0.1:
            body.append(bad(int(pick(3, 4, 4, 5, 6))))
    if rng.random() < 0.25:
        body.append(bad(7))
    inner = "".join(body)
    where = pick("article", "article", "main", "div", "section")
    inner = f"<{where}{y}{attr(pick('article', 'content', 'post', 'entry-content', 'story', 'main-content'), 0.7 if where == 'div' else 0.3)}>{inner}</{where}>"
    for _ in range(rng.integers(0, 3)):
        inner = f"<{(t := pick('div', 'main', 'section'))}{y}{attr(pick('container', 'page', 'wrapper', 'content', 'layout'), 0.6)}>{bad(int(rng.integers(8))) if rng.random() < 0.3 else ''}{inner}{bad(int(pick(3, 4, 5, 7))) if rng.random() < 0.4 else ''}</{t}>"
    before = "".join(bad(int(pick(0, 0, 1, 4, 5, 6))) for _ in range(rng.integers(0, 4)))
    after = "".join(bad(int(pick(2, 2, 3, 4, 5, 7, 7))) for _ in range(rng.integers(0, 4)))
    return f"<html><head><title>{title}</title></head><body{y}>{before}{inner}{after}</body></html>", "\n\n".join(main)


@lru_cache(maxsize=1)
def model(pages: int = 1200, seed: int = 7) -> Trees:
    """The trees, trained once a process on invented pages."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    for _ in range(pages):
        html, _ = _invent(rng)
        page = Page(html)
        xs.append(features(page))
        # Labels are read in document order; the reader keeps the order of start tags.
        ys.append(_labels(html, page))
    return Trees().fit(np.concatenate(xs), np.concatenate(ys))


def _labels(html: str, page: Page) -> np.ndarray:
    found, block = [1.0], Page(html.replace(' data-y="1"', ' role="yyy"'))
    for a in block.attrs[1:]:
        found.append(1.0 if "yyy" in a else 0.0)
    assert len(found) == len(page.tags)
    return np.array(found)


def decode(page: Page, logits: np.ndarray) -> np.ndarray:
    """By node, whether it is kept: the upward-closed set with the root that has the largest sum."""
    n = len(page.tags)
    mass = np.ones(n)
    for i, text, _ in page.blocks:
        mass[i] += len(text) ** 0.5
    best = (np.asarray(logits) * mass).tolist()
    for i in range(n - 1, 0, -1):
        if best[i] > 0:
            best[page.parents[i]] += best[i]
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.parents[i]] and best[i] > 0
    return kept


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page; nodes of all pages are scored together."""
    read = [Page(h) if h else None for h in pages]
    rows = [features(p) for p in read if p]
    logits = trees.logit(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for p in read:
        if p is None:
            out.append("")
            continue
        kept = decode(p, logits[at : at + len(p.tags)])
        at += len(p.tags)
        out.append("\n\n".join(t for i, t, _ in p.blocks if kept[i]))
    return out


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row; no shuffle. The trees are a broadcast of fixed size."""
    shared = pages.sparkSession.sparkContext.broadcast(model())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        htmls = batch.column(2).to_pylist()
        for a in range(0, len(htmls), 64):
            for k, u, t in zip(batch.column(0)[a : a + 64].to_pylist(), batch.column(1)[a : a + 64].to_pylist(), extract(htmls[a : a + 64], shared.value), strict=True):
                yield k, u, t, len(t)

    return pages.select(pages[key].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages[html].cast("string").alias("html")).mapInArrow(common.by_rows(schema, each), "page_id long, url string, text string, n_chars long")
