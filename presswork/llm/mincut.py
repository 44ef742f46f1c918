"""Main text of a page by a minimum cut over its text blocks.

1. A page is cut into blocks at block-level tags; each remembers its path of elements,
   how much of it is link text, and what its surroundings are called.
2. A classifier gives each block the cost of calling it content and of calling it
   boilerplate; these are the capacities towards the two terminals.
3. Smoothness edges join neighbours in page order and neighbours under one parent,
   the stronger the closer they are in the element tree.
4. The minimum cut is the labelling of least total cost. Blocks whose own costs
   outweigh all their edges are settled first, which leaves the cut as it is; maximum
   flow decides the rest.

Pages are independent: one pass, no shuffle, a page at a time in memory.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|!\[CDATA\[|[!?])")
_MARKS = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Elements whose content is never text of the page.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video",
       "textarea", "title", "select", "datalist", "button", "map", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var"}
#: An opening tag of the first kind closes an open element of the second.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
CONTENT_TAGS = {"article", "main"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
BOILER_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "header", "login",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup",
    "promo", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip",
    "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget"}
CONTENT_NAMES = {"article", "articlebody", "body", "content", "entry", "main", "post", "prose", "story", "text"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SCALE = 1000


#: A name that starts with one of these says what an element comes with, not what it is.
ASIDES = {"has", "have", "with", "without", "no", "not", "non", "is", "hide", "show", "hidden"}


class Block:
    __slots__ = ("text", "element", "link_share")

    def __init__(self, text, element, link_share):
        self.text, self.element, self.link_share = text, element, link_share


class _Element:
    __slots__ = ("tag", "number", "parent", "depth", "boiler", "content")

    def __init__(self, tag, number, parent, boiler, content):
        self.tag, self.number, self.parent, self.boiler, self.content = tag, number, parent, boiler, content
        self.depth = parent.depth + 1 if parent else 0


def apart(a: _Element, b: _Element, most: int) -> int:
    """Steps from one element to the other in the tree, or a number over ``most``."""
    steps = 0
    while a is not b and steps <= most:
        if a.depth >= b.depth:
            a, steps = a.parent, steps + 1
        else:
            b, steps = b.parent, steps + 1
    return steps


def _marked(value: str) -> tuple[bool, bool]:
    """Whether names of ``value`` stand for boilerplate, and for content."""
    boiler = content = False
    for word in value.split():
        names = _NAME.findall(_CAMEL.sub(" ", word).lower())
        if names and names[0] not in ASIDES:
            if not BOILER_NAMES.isdisjoint(names):
                boiler = True
            elif not CONTENT_NAMES.isdisjoint(names):
                content = True
    return boiler, content


def _surroundings(tag: str, attributes: str, parent: _Element) -> tuple[int, int]:
    """How often the path has met boilerplate and content so far, this element included.

    An element whose names say both is taken for neither.
    """
    boiler, content = parent.boiler, parent.content
    named = set()
    if attributes and tag not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind == "role":
                boiler += value.lower() in BOILER_ROLES
                content += value.lower() in ("main", "article")
            elif kind == "hidden" or kind == "style" and "display:none" in value.replace(" ", "").lower():
                boiler += 1
            elif kind in ("class", "id", "itemprop"):
                own = _marked(value)
                if own[0] and parent.content and set(_NAME.findall(_CAMEL.sub(" ", value).lower())) & BOILER_NAMES == {"header"}:
                    own = (False, own[1])
                named.update(n for n, there in zip("bc", own) if there)
    if named == {"b"}:
        boiler += 1
    elif named == {"c"}:
        content += 1
    if tag in BOILER_TAGS or tag == "header" and not parent.content:
        boiler += 1
    elif tag in CONTENT_TAGS:
        content += 1
    return boiler, content


class _Scanner:
    """Tags of a page; every search that can fail is not repeated, so the time is linear."""

    def __init__(self, html: str):
        self.html, self.ends, self.quotes, self.missing = html, True, True, set()

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose name or mark was read up to ``at``, quoted ``>`` left out; -1 for nowhere."""
        end = self.html.find(">", at) if self.ends else -1
        if end < 0:
            self.ends = False
            return -1
        if not self.quotes or '"' not in self.html[at:end] and "'" not in self.html[at:end]:
            return end
        i = at
        while m := _MARKS.search(self.html, i):
            if m[0] == ">":
                return m.start()
            close = -1 if m[0] in self.missing else self.html.find(m[0], m.end())
            if close < 0:
                self.missing.add(m[0])
            i = max(m.end(), close + 1)
        self.quotes = False
        return end

    def after(self, what: str, at: int) -> int | None:
        """Where the text behind the next ``what`` starts."""
        if what in self.missing:
            return None
        end = self.html.find(what, at)
        if end < 0:
            self.missing.add(what)
            return None
        return end + len(what)

    def after_element(self, tag: str, at: int) -> int | None:
        if f"/{tag}" in self.missing:
            return None
        m = re.compile(rf"</{re.escape(tag)}\s*>" + (r"|(?=<body\b)" if tag == "head" else ""), re.I).search(self.html, at)
        if m is None:
            self.missing.add(f"/{tag}")
        return m and m.end()


def blocks_of(html: str) -> list[Block]:
    """The page's text blocks in order; character references decoded, white space runs one space."""
    stack = [_Element("", 0, None, 0, 0)]
    blocks: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    opened: Counter[str] = Counter()
    holders: list[int] = []
    in_link, number, at, scanner = False, 0, 0, _Scanner(html)

    def flush():
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                link = len(" ".join(unescape("".join(linked)).split())) if linked else 0
                blocks.append(Block(text, stack[-1], link / len(text)))
            parts.clear()
        linked.clear()

    def close(tags: set[str], within: int = 1):
        if not any(opened[t] for t in tags):
            return
        for depth in range(len(stack) - 1, within - 1, -1):
            if stack[depth].tag in tags:
                opened.subtract(e.tag for e in stack[depth:])
                del stack[depth:]
                while holders and holders[-1] >= depth:
                    holders.pop()
                return

    def text(low: int, high: int):
        if high > low:
            parts.append(html[low:high])
            if in_link:
                linked.append(html[low:high])

    n = len(html)
    while at < n:
        m = _OPEN.search(html, at) if scanner.ends else None
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        if m[2] is None:
            end = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0])
            after = (scanner.after(end, m.end()) or n) if end else scanner.tag_end(m.end()) + 1
            if not after:
                text(m.start(), m.end())
                after = m.end()
            at = after
            continue
        end = scanner.tag_end(m.end())
        if end < 0:
            text(m.start(), m.end())
            at = m.end()
            continue
        closing, tag, attributes, at = m[1], m[2].lower(), html[m.end():end], end + 1
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input"):
                parts.append(" " * (tag != "wbr"))
            elif tag == "hr":
                flush()
            continue
        if tag in RAW and not closing:
            if attributes.endswith("/") and tag in ("svg", "math", "iframe"):
                continue
            # what is never closed hides nothing, but for scripts and styles
            at = scanner.after_element(tag, at) or (n if tag in ("script", "style") else at)
            parts.append(" ")
            continue
        flush()
        in_link = False
        if closing:
            close({tag})
            continue
        if tag != "p" and tag in CLOSES:
            close(CLOSES[tag], (holders[-1] if holders else 0) + 1)
        elif stack[-1].tag == "p":
            opened["p"] -= 1
            stack.pop()
        number += 1
        if tag in ("ul", "ol", "dl", "table"):
            holders.append(len(stack))
        opened[tag] += 1
        stack.append(_Element(tag, number, stack[-1], *_surroundings(tag, attributes, stack[-1])))
    flush()
    return blocks


def leaning(block: Block) -> float:
    """The classifier's log odds of content."""
    n, element = len(block.text), block.element
    # an item of an article's list may well be a link; its neighbours tell a list of links from one that holds a few
    item = element.tag == "li" and element.content and not element.boiler
    z = -0.8 + 1.6 * min(n, 240) / 120 - (2.4 if item else 4.0) * block.link_share
    z += 2.4 * min(element.content, 1) - 4.5 * min(element.boiler, 2)
    z += 0.8 * (element.tag in HEADINGS or element.tag in ("p", "blockquote", "pre")) + 0.4 * block.text.endswith((".", "!", "?", "…"))
    return z


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], int]:
    """Smoothness between neighbours in page order and neighbours under one parent."""
    edges: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for j, block in enumerate(blocks):
        parent = block.element.parent.number if block.element.parent else 0
        pairs = {j - 1, last.get(parent, -1)} - {-1}
        last[parent] = j
        for i in pairs:
            steps = apart(blocks[i].element, block.element, 2 * SCALE * 2)
            edges[i, j] = edges.get((i, j), 0) + round(SCALE * 1.6 / (1 + steps))
    return edges


def minimum_cut(to_content: list[int], to_boiler: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """True for content: the labelling of least cost, with as few content blocks as possible among equals.

    ``to_content[i]`` is paid if i is content, ``to_boiler[i]`` if it is not, an edge
    if its ends differ.
    """
    n = len(to_content)
    lean = [b - c for c, b in zip(to_content, to_boiler)]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (i, j), weight in edges.items():
        if weight > 0 and i != j:
            near[i][j] = near[i].get(j, 0) + weight
            near[j][i] = near[j].get(i, 0) + weight
    label: list[bool | None] = [None] * n
    ahead = deque(range(n))
    while ahead:  # blocks that outweigh what pulls at them
        i = ahead.popleft()
        if label[i] is None and abs(lean[i]) > sum(near[i].values()):
            label[i] = lean[i] > 0
            for j, weight in near[i].items():
                lean[j] += weight if label[i] else -weight
                del near[j][i]
                ahead.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if not left:
        return [bool(x) for x in label]
    source = {i: lean[i] for i in left if lean[i] > 0}
    sink = {i: -lean[i] for i in left if lean[i] < 0}
    rest = [dict(x) for x in near]
    while True:
        parent: dict[int, int | None] = {i: None for i, c in source.items() if c > 0}
        queue, end = deque(parent), None
        while queue:
            i = queue.popleft()
            if sink.get(i, 0) > 0:
                end = i
                break
            for j, c in rest[i].items():
                if c > 0 and j not in parent:
                    parent[j] = i
                    queue.append(j)
        if end is None:
            return [parent_has if x is None else bool(x) for x, parent_has in ((label[i], i in parent) for i in range(n))]
        path, i = [], end
        while parent[i] is not None:
            path.append((parent[i], i))
            i = parent[i]
        amount = min([source[i], sink[end], *(rest[a][b] for a, b in path)])
        source[i] -= amount
        sink[end] -= amount
        for a, b in path:
            rest[a][b] -= amount
            rest[b][a] += amount


def label_blocks(blocks: list[Block]) -> list[bool]:
    costs = [leaning(b) for b in blocks]
    return minimum_cut([round(SCALE * math.log1p(math.exp(-z))) for z in costs],
                       [round(SCALE * math.log1p(math.exp(z))) for z in costs], edges_of(blocks))


def main_text(html: str | None) -> str:
    blocks = blocks_of(html or "")
    if all(not b.element.depth for b in blocks):  # no elements to tell content by
        return "\n".join(b.text for b in blocks)
    return "\n".join(b.text for b, content in zip(blocks, label_blocks(blocks)) if content)


def main_text_column(html: str) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(page) for page in pages], dtype=object)

    return run(F.col(html))


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``text`` (empty if a page has none) and ``n_chars`` (long).

    A null page has an empty text. Existing columns of these names are replaced; repeated rows stay.
    """
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    return pages.withColumn("text", main_text_column(html)).select(*kept, "text", F.length("text").cast("long").alias("n_chars"))
