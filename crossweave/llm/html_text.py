"""Main text of web pages: gradient-boosted trees over features of DOM nodes.

A page becomes a tree of blocks with its runs of text as leaves.  Every node gets features of its
subtree's density, its own and its ancestors' tags and attribute tokens, its depth and its siblings;
boosted trees give the chance that it holds main text.  Decoding takes the likeliest choice
in which a chosen node's ancestors are chosen too, so that ancestors and descendants can't contradict.

The trees are trained on a bounded sample of the pages: on those that mark their article, and on pages
laid out anew from the sample's own paragraphs, in many layouts with all kinds of boilerplate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm.worker import by_value, columns_named

by_value(__name__)

#: The bound of the training sample: about so many pages, of so many characters at most.
TRAINED_PAGES = 250
TRAINED_CHARACTERS = 60_000
LAID_OUT = 450
ROUNDS, DEPTH, BINS, RATE = 50, 4, 32, 0.25
# Nodes whose features are worked out together.
AT_ONCE = 30_000

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noframes noembed".split())
# Left out with what is in them, if they are closed: otherwise what follows is read.
LEFT_OUT = set("noscript template svg object select annotation annotation-xml".split())
# What can be in a head; anything else ends it.
IN_HEAD = RAW | set("html head meta link base noscript template".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol "
    "p pre search section summary table tbody td tfoot th thead tr ul head caption label button".split()
)
# An opening tag of the key ends an open element of the first set, up to one of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(
    r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Words of attributes, by what they say about a block.
TOKENS = (
    "article content main post entry story body text prose",
    "nav menu breadcrumb breadcrumbs navigation navbar toc pagination pager",
    "header masthead banner logo top topbar brand",
    "footer foot copyright legal bottom colophon",
    "sidebar side aside widget related recommended rail more popular trending tags teaser",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense",
    "cookie cookies consent notice alert gdpr popup modal newsletter subscribe signup share social overlay",
    "comment comments reply replies respond discussion disqus reader responses feedback",
    "form search login register",
)
TOKEN_BITS = {word: 1 << i for i, words in enumerate(TOKENS) for word in words.split()}
TAGS = "article main nav aside header footer form section list heading p text".split()
TAG_OF = (
    {t: i for i, t in enumerate(TAGS)}
    | {t: TAGS.index("list") for t in ("ul", "ol", "li", "menu", "dl", "dt", "dd")}
    | {f"h{i}": TAGS.index("heading") for i in range(1, 7)}
    | {t: TAGS.index("form") for t in ("fieldset", "label", "button", "legend", "search")}
)
OTHER = len(TAGS)


@dataclass
class Page:
    """Nodes in page order, parents first; ``texts`` has the leaves' texts by node."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[int] = field(default_factory=lambda: [OTHER])
    tokens: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    texts: dict[int, str] = field(default_factory=dict)

    def add(self, parent: int, tag: int, tokens: int, linked: int = 0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.linked.append(linked)
        return len(self.parent) - 1


def tokens_of(attributes: str) -> int:
    bits = 0
    for found in ATTRIBUTE.findall(attributes):
        for word in WORD.findall("".join(found)):
            bits |= TOKEN_BITS.get(word.lower(), 0)
    return bits


def end_of(html: str, at: int, name: str) -> int:
    """Where an element that is left out ends, the ones of its name within it counted; ``at`` if nowhere."""
    depth, place = 1, at
    for found in re.compile(rf"<(/?){name}\b[^>]*?(/?)>", re.I).finditer(html, at):
        if found[1]:
            depth -= 1
            place = found.end()
        elif not found[2]:
            depth += 1
        if not depth:
            return place
    # Not all are closed: the last end tag ends it.
    return place


def parse(html: str) -> Page:
    """The blocks and runs of text of a page; scripts, styles, the head and markup are left out.

    As in browsers, an element or text that can't be in a head ends it; a self-closed svg is empty.
    """
    page = Page()
    stack = [("", 0)]
    run: list[str] = []
    linked, links, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                close({"head"}, set())
                node = page.add(stack[-1][1], TAGS.index("text"), 0, min(linked, len(text)))
                page.texts[node] = text
            run.clear()
        linked = 0

    def close(names: set[str], fence: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in fence:
                return

    while True:
        found = TOKEN.search(html, at)
        text = html[at : found.start() if found else len(html)]
        if text:
            run.append(text)
            if links:
                linked += len(text)
        if not found:
            break
        at = found.end()
        ended = found[1]
        if ended:
            name = ended.lower()
            if name == "a":
                links = max(links - 1, 0)
            elif name in BLOCKS:
                flush()
                close({name}, set())
            continue
        name = (found[2] or found[4] or "").lower()
        if not name:
            continue
        if name not in IN_HEAD and any(open_name == "head" for open_name, _ in stack):
            flush()
            close({"head"}, set())
        if name == "a":
            links += 1
        elif name in RAW:
            # Their text is no markup, and goes on to the end of the page where nothing closes them.
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            run.append(" ")
        elif name in LEFT_OUT:
            if not (found[3] or found[5] or "").rstrip().endswith("/"):
                at = end_of(html, at, name)
            run.append(" ")
        elif name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                run.append(" ")
        elif name in BLOCKS:
            flush()
            links = 0
            if stack[-1][0] == "p":
                stack.pop()
            if name in ENDS:
                close(*ENDS[name])
            attributes = found[3] or found[5] or ""
            node = page.add(
                stack[-1][1], TAG_OF.get(name, OTHER), tokens_of(attributes) if attributes else 0
            )
            stack.append((name, node))
    flush()
    return page


# Features.

ANCESTRY = [TAGS.index(t) for t in ("article", "main", "nav", "aside", "header", "footer", "form", "list")]


def features(pages: list[Page]) -> np.ndarray:
    """One row per node of all pages, in order."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    base = np.repeat(first, sizes)
    parent = np.concatenate([np.array(p.parent) for p in pages])
    parent = np.where(parent < 0, -1, parent + base)
    depth = np.concatenate([np.array(p.depth) for p in pages])
    tag = np.concatenate([np.array(p.tag) for p in pages])
    own = np.concatenate([np.array(p.tokens) for p in pages])
    count = len(parent)
    text, commas, leaves = np.zeros(count), np.zeros(count), np.zeros(count)
    for start, page in zip(first, pages, strict=True):
        for node, run in page.texts.items():
            text[start + node] = len(run)
            commas[start + node] = run.count(",") + run.count(".")
            leaves[start + node] = 1
    link = np.concatenate([np.array(p.linked, dtype=float) for p in pages])
    nodes, paragraphs = np.ones(count), (tag == TAGS.index("p")).astype(float)
    longest = text.copy()
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
    for level in reversed(levels[1:]):
        for sums in (text, commas, leaves, link, nodes, paragraphs):
            np.add.at(sums, parent[level], sums[level])
        np.maximum.at(longest, parent[level], longest[level])
    tag_bit = 1 << tag
    above_tags, above_tokens = np.zeros(count, dtype=int), np.zeros(count, dtype=int)
    for level in levels[1:]:
        up = parent[level]
        above_tags[level] = above_tags[up] | tag_bit[up]
        above_tokens[level] = above_tokens[up] | own[up]
    up = np.maximum(parent, 0)
    # Siblings in page order.
    order = np.lexsort((np.arange(count), parent))
    sorted_parent = parent[order]
    begins = np.concatenate([[True], sorted_parent[1:] != sorted_parent[:-1]])
    group = np.cumsum(begins) - 1
    siblings = np.bincount(group)[group]
    index = np.arange(count) - np.flatnonzero(begins)[group]
    same = np.unique(group * (OTHER + 1) + tag[order], return_inverse=True, return_counts=True)
    before = np.where(begins, 0, np.concatenate([[0], text[order][:-1]]))
    ends = np.concatenate([begins[1:], [True]])
    after = np.where(ends, 0, np.concatenate([text[order][1:], [0]]))
    place = np.empty(count, dtype=int)
    place[order] = np.arange(count)
    page_text = text[base]
    numbers = [
        depth,
        np.log1p(text),
        np.log1p(longest),
        link / np.maximum(text, 1),
        text / nodes,
        np.log1p(leaves),
        np.log1p(paragraphs),
        text / np.maximum(leaves, 1),
        commas / np.maximum(text, 1),
        text / np.maximum(page_text, 1),
        text / np.maximum(text[up], 1),
        link[up] / np.maximum(text[up], 1),
        np.log1p(text[up]),
        paragraphs[up],
        siblings[place],
        index[place] / siblings[place],
        same[2][same[1]][place] / siblings[place],
        np.log1p(before[place]),
        np.log1p(after[place]),
        (np.arange(count) - base) / np.repeat(sizes, sizes),
    ]
    flags = [tag == t for t in range(OTHER)]
    flags += [(tag[up] == t) for t in (TAGS.index("p"), TAGS.index("list"), TAGS.index("heading"))]
    flags += [(above_tags >> t) & 1 for t in ANCESTRY]
    for i in range(len(TOKENS)):
        flags += [(own >> i) & 1, (above_tokens >> i) & 1]
    return np.column_stack([*numbers, *flags]).astype(np.float32)


# Boosted trees.


@dataclass
class Trees:
    """Complete trees: a node at i has its children at 2i + 1 and 2i + 2; leaves are the last level."""

    start: float
    which: np.ndarray  # (trees, inner nodes)
    bound: np.ndarray
    value: np.ndarray  # (trees, leaves)

    def odds(self, given: np.ndarray) -> np.ndarray:
        total = np.full(len(given), self.start)
        rows = np.arange(len(given))
        for which, bound, value in zip(self.which, self.bound, self.value, strict=True):
            node = np.zeros(len(given), dtype=int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (given[rows, which[node]] > bound[node])
            total += value[node - (2**DEPTH - 1)]
        return total


def boost(given: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> Trees:
    """Fit trees to the logistic loss, level by level on binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in given.T]
    bins = np.column_stack(
        [np.searchsorted(e, c, side="left") for e, c in zip(edges, given.T, strict=True)]
    )
    width, inner = given.shape[1], 2**DEPTH - 1
    mean = np.average(truth, weights=weight).clip(1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    odds = np.full(len(truth), start)
    which, bound, value = [], [], []
    for _ in range(ROUNDS):
        chance = 1 / (1 + np.exp(-odds))
        slope, bend = weight * (truth - chance), weight * chance * (1 - chance)
        node = np.zeros(len(truth), dtype=int)
        splits, bounds = np.zeros(inner, dtype=int), np.full(inner, np.inf)
        for level in range(DEPTH):
            low, many = 2**level - 1, 2**level
            here = node - low
            best = np.full(many, 1e-6)
            for f in range(width):
                at = here * BINS + bins[:, f]
                g = np.bincount(at, slope, many * BINS).reshape(many, BINS).cumsum(axis=1)
                h = np.bincount(at, bend, many * BINS).reshape(many, BINS).cumsum(axis=1)
                gain = (
                    g**2 / (h + 1)
                    + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1)
                    - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                )[:, : len(edges[f])]
                if not gain.shape[1]:
                    continue
                cut = gain.argmax(axis=1)
                better = gain[np.arange(many), cut] > best
                best = np.where(better, gain[np.arange(many), cut], best)
                for n in np.flatnonzero(better):
                    splits[low + n], bounds[low + n] = f, edges[f][cut[n]]
            node = 2 * node + 1 + (given[np.arange(len(node)), splits[node]] > bounds[node])
        leaf = node - inner
        leaves = np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, bend, inner + 1) + 1)
        odds += RATE * leaves[leaf]
        which.append(splits)
        bound.append(bounds)
        value.append(RATE * leaves)
    return Trees(start, np.array(which), np.array(bound), np.array(value))


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """The likeliest choice of nodes in which each chosen one's parent is chosen."""
    gain = odds.tolist()
    # A node's best with it chosen, over not choosing anything of its subtree.
    for node in range(len(gain) - 1, 0, -1):
        if gain[node] > 0:
            gain[page.parent[node]] += gain[node]
    chosen = [gain[0] > 0] + [False] * (len(gain) - 1)
    for node in range(1, len(gain)):
        chosen[node] = gain[node] > 0 and chosen[page.parent[node]]
    return chosen


def main_texts(htmls: list[str], trees: Trees) -> list[str]:
    """The main text of each page: its chosen runs of text, one a line."""
    out: list[str] = []
    pages: list[Page] = []
    size = 0
    for i, html in enumerate(htmls):
        pages.append(parse(html))
        size += len(pages[-1].parent)
        if size < AT_ONCE and i + 1 < len(htmls):
            continue
        odds, at = trees.odds(features(pages)), 0
        for page in pages:
            chosen = decode(page, odds[at : at + len(page.parent)])
            at += len(page.parent)
            out.append("\n".join(text for node, text in page.texts.items() if chosen[node]))
        pages, size = [], 0
    return out


# Training pages.


class Layouts:
    """Lays out pages from paragraphs and phrases; content is marked by a character of private use."""

    MARK = "\ue000"

    def __init__(self, paragraphs: list[str], phrases: list[str], seed: int):
        self.random = np.random.default_rng(seed)
        self.paragraphs, self.phrases = paragraphs, phrases

    def one(self, *of: str) -> str:
        return of[self.random.integers(len(of))]

    def some(self, low: int, high: int) -> range:
        return range(self.random.integers(low, high + 1))

    def phrase(self) -> str:
        return self.one(*self.phrases)

    def paragraph(self) -> str:
        text = self.one(*self.paragraphs)
        if self.random.random() < 0.35:
            words = text.split()
            text = " ".join(words[: self.random.integers(1, 30)])
        return text

    def links(self, low: int = 3, high: int = 9) -> str:
        items = [f'<li><a href="#">{self.phrase()}</a></li>' for _ in self.some(low, high)]
        if self.random.random() < 0.2:
            return " | ".join(i[4:-5] for i in items)
        return "<ul>" + "".join(items) + "</ul>"

    def box(self, tags: str, names: str, inside: str) -> str:
        tag = self.one(*tags.split())
        name = self.one(*names.split(), "", "")
        how = self.one("class", "class", "id")
        extra = self.one("", "", " x1", " wide", " block-2")
        return f'<{tag} {how}="{name}{extra}">{inside}</{tag}>' if name else f"<{tag}>{inside}</{tag}>"

    def boilerplate(self) -> str:
        kind = self.random.integers(10)
        p = lambda: f"<p>{self.paragraph()}</p>"
        head = f"<{(h := self.one('h2', 'h3', 'h4'))}>{self.phrase()}</{h}>"
        if kind == 0:
            return self.box("nav", "nav main-nav menu breadcrumbs", self.links())
        if kind == 1:
            return f'<div class="{self.one("ad", "ads", "advert", "sponsored", "promo-box", "ad-slot")}">' + (
                self.one(self.phrase(), p(), self.paragraph())
            ) + "</div>"
        if kind == 2:
            return self.box("aside", "sidebar widget related", head + self.one(self.links(), p(), p() + p()))
        if kind == 3:
            name = self.one("sidebar", "widget", "related-posts", "more-stories", "right-rail")
            return f'<div class="{name}">{head}{self.one(self.links(), p() + self.links())}</div>'
        if kind == 4:
            name = self.one("cookie-notice", "cookie-banner", "alert", "consent", "notice", "gdpr-popup")
            tag = self.one("div", "section", "div role='alert'")
            button = self.one("", "<button>OK</button>", '<a href="#">OK</a>')
            return f'<{tag} class="{name}">{self.one(p(), self.paragraph())}{button}</{tag.split()[0]}>'
        if kind == 5:
            name = self.one("", ' class="search"', ' class="newsletter-signup"', ' id="login"')
            label = self.one("", f"<p>{self.phrase()}</p>", p(), head)
            return f'<form{name}>{label}<label>{self.phrase()}</label><input name="q"><button>{self.phrase()}</button></form>'
        if kind in (6, 7):
            one = lambda: self.one(
                f'<div class="{self.one("comment", "reply", "comment-body")}">'
                f'{self.one("", f"<b>{self.phrase()}</b>", f"<h4>{self.phrase()}</h4>")}{p()}</div>',
                f"<li>{p()}</li>",
                f'<article class="comment">{p()}</article>',
            )
            name = self.one('id="comments"', 'class="comments"', 'class="reader-comments"', 'class="discussion"')
            tag = self.one("section", "div", "ol" if self.random.random() < 0.3 else "div")
            return f"<{tag} {name}>{head}{''.join(one() for _ in self.some(1, 5))}</{tag}>"
        if kind == 8:
            name = self.one("share", "social-links", "tags", "newsletter", "subscribe-box")
            return f'<div class="{name}">{self.one(self.links(2, 5), self.phrase(), p())}</div>'
        return self.box("div section", "popular trending recommended teaser-list", head + self.links())

    def content(self) -> str:
        mark = lambda text: self.MARK + text
        out = [f"<h1>{mark(self.phrase())}</h1>"] if self.random.random() < 0.85 else []
        for _ in self.some(1, 14):
            kind = self.random.random()
            if kind < 0.72:
                text = self.paragraph()
                if self.random.random() < 0.15:
                    words = text.split()
                    cut = len(words) // 3
                    linked = " ".join(words[cut : cut + 3])
                    text = f"{' '.join(words[:cut])} <a href='#'>{linked}</a> {' '.join(words[cut + 3 :])}"
                out.append(f"<p>{mark(text)}</p>")
            elif kind < 0.8:
                out.append(f"<{(h := self.one('h2', 'h3'))}>{mark(self.phrase())}</{h}>")
            elif kind < 0.87:
                items = [f"<li>{mark(self.one(self.phrase(), self.paragraph()))}</li>" for _ in self.some(2, 5)]
                out.append(f"<{(t := self.one('ul', 'ol'))}>{''.join(items)}</{t}>")
            elif kind < 0.92:
                out.append(f"<blockquote>{mark(self.paragraph())}</blockquote>")
            elif kind < 0.95:
                cells = [f"<td>{mark(self.phrase())}</td>" for _ in self.some(2, 6)]
                out.append(f"<table><tr>{''.join(cells)}</tr></table>")
            else:
                out.append(f"<div><p>{mark(self.paragraph())}</p></div>")
            if self.random.random() < 0.07:
                out.append(self.boilerplate())
        if self.random.random() < 0.2:
            out.append(self.boilerplate())
        return "".join(out)

    def page(self) -> str:
        inside = self.content()
        kind = self.random.random()
        if kind < 0.45:
            inside = f"<article>{inside}</article>"
        elif kind < 0.6:
            inside = f"<main>{inside}</main>"
        elif kind < 0.9:
            name = self.one("content", "post", "entry-content", "article-body", "story", "main-text", "post-body")
            tag = self.one("div", "section")
            inside = f'<{tag} {self.one("class", "id")}="{name}">{inside}</{tag}>'
        else:
            inside = f"<div>{inside}</div>"
        for tag in ("main", "div", "div class='wrapper'", "div class='container'"):
            if self.random.random() < 0.2:
                inside = f"<{tag}>{inside}</{tag.split()[0]}>"
        top = self.one(
            f"<header><div class='logo'>{self.phrase()}</div><nav>{self.links()}</nav></header>",
            f"<nav>{self.links()}</nav>",
            f'<div id="header"><h2>{self.phrase()}</h2>{self.links()}</div>',
            f'<header><p>{self.paragraph()}</p></header>',
            f'<div class="masthead">{self.phrase()}</div>',
            "",
        )
        bottom = self.one(
            f"<footer>{self.phrase()}</footer>",
            f"<footer><p>{self.paragraph()}</p>{self.links()}</footer>",
            f'<div class="footer">{self.phrase()}</div>',
            f'<div id="footer"><p>{self.paragraph()}</p></div>',
            "",
        )
        before = "".join(self.boilerplate() for _ in self.some(0, 2))
        after = "".join(self.boilerplate() for _ in self.some(0, 3))
        return f"<html><body>{top}{before}{inside}{after}{bottom}</body></html>"


def _truth(page: Page, content: set[int]) -> np.ndarray:
    """1 for nodes that hold a content leaf."""
    holds = np.zeros(len(page.parent))
    for node in content:
        while node >= 0 and not holds[node]:
            holds[node] = 1
            node = page.parent[node]
    return holds


def train(htmls: list[str], seed: int = 0) -> Trees | None:
    """Fit the trees to sample pages and pages laid out from their texts; None without texts."""
    pages, truths = [], []
    paragraphs, phrases = [], []
    for html in htmls:
        page = parse(html)
        for text in page.texts.values():
            paragraphs.append(text.replace("<", "&lt;"))
            phrases.append(" ".join(text.replace("<", "&lt;").split()[:6]))
        marked = {TAGS.index("article"), TAGS.index("main")}
        inside = set()
        for node in range(1, len(page.parent)):
            if page.tag[node] in marked or page.parent[node] in inside:
                inside.add(node)
        if any(node in inside for node in page.texts):
            pages.append(page)
            truths.append(_truth(page, inside & set(page.texts)))
    if not paragraphs:
        return None
    layouts = Layouts(paragraphs, phrases, seed)
    for _ in range(LAID_OUT):
        page = parse(layouts.page())
        content = {node for node, text in page.texts.items() if text.startswith(Layouts.MARK)}
        for node in content:
            page.texts[node] = page.texts[node][1:]
        pages.append(page)
        truths.append(_truth(page, content))
    weights = [np.full(len(t), 1.0) for t in truths]
    return boost(features(pages), np.concatenate(truths), np.concatenate(weights))


def sample_pages(pages: DataFrame) -> list[str]:
    """A bounded sample of ``pages(page_id, html)`` for training."""
    fit = pages.where(F.length("html").between(1, TRAINED_CHARACTERS)).select("page_id", "html")
    rows = fit.count()
    if not rows:
        return []
    fine = 1_000_000
    chance = F.pmod(F.xxhash64(F.lit(6), "page_id"), F.lit(fine))
    found = fit.where(chance < fine * TRAINED_PAGES // rows + 1).limit(2 * TRAINED_PAGES).collect()
    return [r["html"] for r in sorted(found, key=lambda r: (r["page_id"] is None, r["page_id"], r["html"]))]


def main_text(html: Column, trees: Trees | None) -> Column:
    """The main text of each page; empty if there is none, or nothing to learn from."""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            if trees is None:
                yield pd.Series([""] * len(htmls), dtype=object)
            else:
                yield pd.Series(main_texts([h or "" for h in htmls], trees), dtype=object)

    return read(html)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row of ``pages(page_id, url, html)``.

    Blocks are in page order, one a line, with character references decoded and white space
    made single.  A null page counts as empty and has an empty text; broken markup is read as far as
    it goes.  Repeated rows give repeated results, other columns are ignored, an empty table gives an
    empty result.
    """
    columns_named(pages, "page_id", "url", "html")
    trees = train(sample_pages(pages))
    return pages.select(
        "page_id", "url", main_text(F.col("html"), trees).alias("text")
    ).withColumn("n_chars", F.length("text").cast("long"))
