"""Main text of web pages by minimum-cut labelling (operator 4).

A page is read into text blocks with the elements above them. A classifier gives each block a log-odds value for content; its size
is the capacity of the block's edge from the source (content) or to the sink (boilerplate), which is the cost of deciding against
it. Blocks that follow each other, and consecutive blocks of one parent, are joined by smoothness edges whose capacity grows with
the share of the DOM path that both have in common. The minimum cut, found as a maximum flow, separates content from boilerplate
at the least total cost, so a doubtful block goes with its neighbours.

The classifier is a logistic regression on what a block is like: words, links, sentence end, heading, list item, paragraph,
siblings, neighbours, share of the page. It is fitted to a bounded sample of pages whose element names, classes and roles tell
content from boilerplate; those names are no features, so it also serves pages without them. Where a page has them, they add
fixed evidence, of the order of what a block's edges can carry.

Defined cases: a null, empty or text-free page gives the empty text; a page of which the cut leaves nothing keeps the blocks that
no boilerplate element holds and that aren't mostly links; without pages to fit to, fixed weights serve; character references are
decoded once, white space inside a block becomes one space, blocks are joined by one space; script, style, comments and the head
are never text; unclosed and misnested tags close where HTML closes them, an unclosed comment or script reaches to the end; pages
are handled whole, in time that doesn't grow with the depth of their elements; repeated rows are repeated results; null page_ids
are kept; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|title|textarea|iframe|noembed|noframes|noscript|template|svg|math|select|object"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button label fieldset head".split())
CONTENT_TAGS = frozenset("article main".split())
# Words of class, id and role that speak for boilerplate or for content.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay toast newsletter subscribe subscription signup sidebar side rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager footer foot header masthead topbar toolbar comment comments commentlist disqus discussion replies reply respond feedback social share sharing "
    "related recommended recommendations trending popular login search contentinfo complementary dialog form paywall teaser skip legal copyright disclaimer tags".split()
)
NEVER_WRAPPERS = frozenset("comment comments commentlist disqus discussion replies reply respond feedback related recommended recommendations trending popular".split())
HEADER_WORDS = frozenset("header banner".split())
CONTENT_WORDS = frozenset("article content post entry story main body articlebody".split())
# Evidence of names for content, against it, outside the content of a page that has some, and for link lists; smoothness.
INSIDE, BOILERPLATE, OUTSIDE, LINK_LIST = 5.0, -6.0, -5.0, -6.0
NEXT, SIBLING = 1.2, 0.6
#: The classifier's value is within this.
MOST = 4.0
#: Features of a block, and their weights where there is nothing to fit them to.
FEATURES = {
    "one": -1.0, "words": 0.41, "linked": -4.0, "sentence": 0.6, "heading": 0.6, "listed": 0.0, "paragraph": 0.0, "siblings": 0.0, "copyright": -3.0,
    "words_before": 0.0, "words_after": 0.0, "share": 0.0,
}
DEFAULT = tuple(FEATURES.values())

_SPECIAL = re.compile("[>\"']")
_NAME = re.compile(r"[a-zA-Z][^\s/>]{0,99}")
_RAW = re.compile(rf"(?:{RAW})(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    """Flags that hold for all below are taken from the parent, so nothing walks to the top."""

    __slots__ = ("tag", "parent", "depth", "sign", "chars", "holds", "words", "block", "heading", "inside", "texts", "standing")

    def __init__(self, tag: str, parent: Element | None, attributes: str = ""):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.chars, self.holds, self.texts, self.standing = 0, False, 0, 0
        self.block = parent.block if parent and tag in INLINE else self
        self.heading = tag in HEADINGS or bool(parent and parent.heading)
        self.words = words = self.read(attributes) if attributes and not attributes.isspace() else frozenset()
        bad = tag in BOILERPLATE_TAGS or bool(words & BOILERPLATE_WORDS)
        if tag == "header" or bad and words & BOILERPLATE_WORDS <= HEADER_WORDS and tag not in BOILERPLATE_TAGS:
            bad = not words & CONTENT_WORDS and not (parent and parent.inside)  # an article's own header is part of it
        good = tag in CONTENT_TAGS or bool(words & CONTENT_WORDS)
        self.sign = -1 if bad else 1 if good else 0
        self.inside = good or bool(parent and parent.inside)

    @staticmethod
    def read(attributes: str) -> frozenset[str]:
        out = set()
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                out.add("popup")
            elif name not in ("style", "aria-hidden"):
                out.update(w.lower() for w in _WORD.findall(value))
        return frozenset(out)


class Block:
    __slots__ = ("parent", "text", "linked", "heading")

    def __init__(self, parent: Element, text: str, linked: int, heading: bool):
        self.parent, self.text, self.linked, self.heading = parent, text, linked, heading


class Ends:
    """Where tags end: the first > outside of quotes. The answer for every place is found in one pass from the end, so a page of tags or
    quotes that never end takes no longer than another one."""

    def __init__(self, html: str):
        self.at = [m.start() for m in _SPECIAL.finditer(html)]
        self.end = [-1] * (len(self.at) + 1)  # for a place outside of quotes before the i-th of them; -1: none
        seen = {'"': -1, "'": -1}
        for i in range(len(self.at) - 1, -1, -1):
            c = html[self.at[i]]
            if c == ">":
                self.end[i] = self.at[i]
            else:
                self.end[i] = self.end[seen[c] + 1] if seen[c] >= 0 else -1
                seen[c] = i
        self.plain = [x for x in self.at if html[x] == ">"]

    def of_tag(self, start: int) -> int:
        return self.end[bisect_left(self.at, start)]

    def of_declaration(self, start: int) -> int:
        i = bisect_left(self.plain, start)
        return self.plain[i] if i < len(self.plain) else -1


def tokens(html: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, whether it closes, tag, attributes) of all markup; the tag is None for what is dropped as a whole: comments,
    declarations, and elements of RAW with what they hold. A < that begins no markup is text."""
    ends, at = Ends(html), html.find("<")
    while at >= 0:
        to, closes, tag, attributes = -1, False, None, ""
        if ends.of_declaration(at) < 0:  # nothing ends any more but the text
            if (at := html.find("<!--", at)) >= 0:
                yield at, len(html), False, None, ""
            return
        if html.startswith("<!--", at):
            to = html.find("-->", at + 4) + 3
            to = to if to > 2 else len(html)
        elif raw := _RAW.match(html, at + 1):
            if (inner := ends.of_tag(raw.end())) >= 0:
                last = re.compile(rf"</{raw[0]}\s*>", re.I).search(html, inner + 1)
                to = last.end() if last else len(html)
        elif html.startswith(("<!", "<?"), at):
            to = ends.of_declaration(at) + 1 or -1
        else:
            closes = html.startswith("/", at + 1)
            if name := _NAME.match(html, at + 1 + closes):
                tag, begin = name[0], name.end()
                to = ends.of_tag(begin) + 1 or -1
                if to < 0 and (quote := re.search("[\"']", tag)):  # then the quote may begin an attribute
                    tag, begin = tag[: quote.start()], name.start() + quote.start()
                    to = ends.of_tag(begin) + 1 or -1
                attributes = html[begin : to - 1] if to >= 0 else ""
        if to >= 0:
            yield at, to, closes, tag, attributes
        at = html.find("<", to if to >= 0 else at + 1)


def blocks(html: str) -> list[Block]:
    """Text blocks in page order; their elements know whether they stand in content (1), in boilerplate (-1) or in neither."""
    top = at = Element("#top", None)
    every = [top]
    out: list[Block] = []
    parts: list[str] = []
    linked = links = 0
    open_: Counter[str] = Counter()

    def close() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(unescape("".join(parts)).split()):
                out.append(Block(at.block, text, linked, at.heading))
                at.block.chars += len(text)
            parts.clear()
        linked = 0

    last = 0
    for start, end, closes, name, attributes in tokens(html):
        if start > last:
            parts.append(html[last:start])
            if links:
                linked += start - last
        last = end
        if name is None:
            continue
        tag = name.lower()
        if tag == "br":
            parts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            close()
        if closes:
            found = at if open_[tag] else None
            while found and found.tag != tag and not (inline and found.tag not in INLINE):
                found = found.parent
            if found and found.tag == tag and found.parent:
                while at is not found.parent:
                    links -= at.tag == "a"
                    open_[at.tag] -= 1
                    at = at.parent
            continue
        drop = {"p"} if tag in CLOSES_P else SAME.get(tag, ())
        if drop:
            found, least = at, 12
            while found and found.tag not in drop and least and (found.tag in INLINE or found.tag in drop):
                found, least = found.parent, least - 1
            if found and found.tag in drop:
                while at is not found.parent:
                    links -= at.tag == "a"
                    open_[at.tag] -= 1
                    at = at.parent
        if tag in VOID or attributes.endswith("/") and not inline and tag not in CLOSES_P:
            continue
        at = Element(tag, at, attributes)
        every.append(at)
        open_[tag] += 1
        links += tag == "a"
        if at.sign > 0:
            above = at.parent
            while above and not above.holds:
                above.holds = True
                above = above.parent
    if last < len(html):
        parts.append(html[last:])
    close()
    for x in reversed(every[1:]):  # parents come before their children
        x.parent.chars += x.chars
    for x in every[1:]:
        # boilerplate elements count wherever they are, but for wrappers with most of the page's text around its article
        wrapper = x.holds and 2 * x.chars >= top.chars and not x.words & NEVER_WRAPPERS
        x.standing = -1 if x.parent.standing < 0 or x.sign < 0 and not wrapper else max(x.parent.standing, x.sign)
    for b in out:
        if b.parent.parent:
            b.parent.parent.texts += 1
    return out


def features(page: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    total = sum(len(b.text) for b in page)
    words = [log1p(b.text.count(" ") + 1) for b in page]
    before, after = [0.0, *words[:-1]], [*words[1:], 0.0]
    rows = [
        (
            1.0, w, min(1.0, b.linked / len(b.text)), b.text[-1] in ".!?\"'", b.heading, b.parent.tag == "li", b.parent.tag == "p", log1p(b.parent.parent.texts if b.parent.parent else 1), "\u00a9" in b.text,
            x, y, len(b.text) / total,
        )
        for b, w, x, y in zip(page, words, before, after, strict=True)
    ]
    return np.array(rows, float).reshape(len(page), len(FEATURES))


def evidence(page: list[Block], weights: tuple[float, ...] = DEFAULT) -> list[float]:
    """Log-odds of content of each block: the classifier's value, and what names add."""
    value = (features(page) @ np.array(weights)).clip(-MOST, MOST)
    standing = np.array([b.parent.standing for b in page])
    menu = np.array([b.parent.tag == "li" and not b.heading and b.linked > 0.9 * len(b.text) and b.text.count(" ") < 11 for b in page])
    names = np.where(standing < 0, BOILERPLATE, np.where(standing > 0, INSIDE + LINK_LIST * menu, OUTSIDE if (standing > 0).any() else 0.0))
    return (value + names).tolist()


def fit(x: np.ndarray, content: np.ndarray, penalty: float = 1.0, steps: int = 30) -> tuple[float, ...]:
    """Weights of a logistic regression by Newton's method, both kinds weighing the same."""
    if not 0 < content.mean() < 1:
        return DEFAULT
    w = np.zeros(x.shape[1])
    weight = np.where(content, 0.5 / content.mean(), 0.5 / (~content).mean())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        slope = x.T @ (weight * (content - p)) - penalty * w
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), slope)
    return tuple(w.tolist())


def proximity(a: Element, b: Element) -> float:
    """The share of the longer path to the top that both have in common."""
    deep = max(a.depth, b.depth)
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return (a.depth + 1) / (deep + 1)


def minimum_cut(value: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut; value: capacity from the source (> 0) or to the sink (< 0)."""
    n = len(value)
    to: list[list[int]] = [[] for _ in range(n + 2)]
    head, room = [], []

    def add(u: int, v: int, there: float, back: float) -> None:
        to[u].append(len(head))
        to[v].append(len(head) + 1)
        head.extend((v, u))
        room.extend((there, back))

    for i, x in enumerate(value):
        add(n, i, x, 0.0) if x > 0 else add(i, n + 1, -x, 0.0)
    for u, v, c in edges:
        add(u, v, c, c)
    while True:  # Dinic: levels, then blocking flow
        level = [-1] * (n + 2)
        level[n] = 0
        queue = deque([n])
        while queue:
            u = queue.popleft()
            for e in to[u]:
                if room[e] > 1e-9 and level[head[e]] < 0:
                    level[head[e]] = level[u] + 1
                    queue.append(head[e])
        if level[n + 1] < 0:
            return [x >= 0 for x in level[:n]]
        place = [0] * (n + 2)
        path: list[int] = []
        u = n
        while True:
            if u == n + 1:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path.clear()
                u = n
                continue
            while place[u] < len(to[u]):
                e = to[u][place[u]]
                if room[e] > 1e-9 and level[head[e]] == level[u] + 1:
                    path.append(e)
                    u = head[e]
                    break
                place[u] += 1
            else:
                if u == n:
                    break
                e = path.pop()
                u = head[e ^ 1]
                place[u] += 1


def label(page: list[Block], weights: tuple[float, ...] = DEFAULT) -> list[bool]:
    """Which blocks are content."""
    edges, last = [], {}
    for i, b in enumerate(page):
        if i:
            edges.append((i - 1, i, NEXT * proximity(page[i - 1].parent, b.parent)))
        above = id(b.parent.parent)
        if (j := last.get(above, i)) < i - 1:
            edges.append((j, i, SIBLING * proximity(page[j].parent, b.parent)))
        last[above] = i
    content = minimum_cut(evidence(page, weights), edges)
    return content if any(content) else [b.parent.standing >= 0 and 2 * b.linked < len(b.text) for b in page]


def main_text(html: str | None, weights: tuple[float, ...] = DEFAULT) -> str:
    page = blocks(html or "")
    return " ".join(b.text for b, keep in zip(page, label(page, weights), strict=True) if keep) if page else ""


def _telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(features, content) of the blocks of pages whose names tell content."""
    for whole in batches:
        for batch in slices(whole, "html"):
            for html in batch.column(0):
                page = blocks(html.as_py() or "")
                content = [b.parent.standing > 0 for b in page]
                if any(content):
                    yield pa.record_batch([pa.array(features(page).tolist(), pa.list_(pa.float64())), pa.array(content)], names=["features", "content"])


def fitted(pages: DataFrame, most_pages: int = 400, most_blocks: int = 20_000) -> tuple[float, ...]:
    """Weights from the pages with the smallest hashes of page_id, at most ``most_pages``, and at most ``most_blocks`` of their blocks."""
    sample = pages.select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id").limit(most_pages).select("html")
    rows = sample.mapInArrow(_telling, "features array<double>, content boolean").limit(most_blocks).toArrow()
    if not rows.num_rows:
        return DEFAULT
    x = rows["features"].combine_chunks()
    x = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy().reshape(-1, len(FEATURES))
    return fit(x, rows["content"].to_numpy().astype(bool))


def _extract(weights: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
                yield pa.record_batch(
                    [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return run


def extract(pages: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages (page_id, url, html); weights: the classifier's, by default fitted to them."""
    weights = weights or fitted(pages)
    return pages.select("page_id", "url", "html").mapInArrow(_extract(weights), "page_id long, url string, text string, n_chars long")
