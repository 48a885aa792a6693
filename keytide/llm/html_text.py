"""Main text of web pages by composite text density.

A page becomes a tree of elements. What is page furniture by its element or role (menus, headers, footers, forms,
scripts, styles) is no part of it. A class or id made of furniture words is only evidence, by itself (``sidebar``) or
with words of layout (``comment-list``, ``ad-slot``, ``sidebar-left``); one with any other word (``share-price``) is
none. Such an element goes unless it holds most of the page's text; inside the article, words that can also name
parts of it (search, notice, related) take away only what is less dense than the page. For every element, with C characters, T tags, LC link characters and LT link tags below it, the density is

    C / T * log((C / LC) * (T / LT)) / log(log(C / (C - LC) * LC + LC_body / C_body * C + e))

with 1 in place of every divisor that is 0, so links lower it. An element's density sum is that of its children.
The element with the largest sum holds the text; from there the path to the body is climbed while the element
above is at least as dense as the body, the threshold for the page. An article may stand in several elements:
those beside the chosen one that reach the threshold belong to it. Where the page names no article, parts at
either end of what is chosen that fall below the threshold and are mostly links are left out; everything else
is text, lists of links between or below paragraphs of an article included.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import byte_texts, raw, slices

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article blockquote body center dd details dialog div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 "
    "hgroup hr html li main ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
_SPACED = frozenset(["br", "td", "th", "img", "wbr"])
_DROPPED = frozenset(
    "script style noscript template head title nav aside footer form button select textarea input iframe object "
    "embed svg canvas audio video menu dialog map".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter "
    "subscribe subscription popup modal overlay toolbar pagination pager login signup search widget skip".split()
)
#: Of these, words that hardly name a part of an article.
_SURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr "
    "sidebar navbar breadcrumb breadcrumbs masthead comment comments commentlist disqus reply replies respond newsletter "
    "subscribe subscription popup modal overlay toolbar pagination pager login signup".split()
)
#: Words of layout, which say nothing beside a furniture word.
_LAYOUT = frozenset(
    "area list item items slot left right top bottom wrapper wrap container box block section inner outer unit panel "
    "module row col column zone holder group body main content primary secondary bar buttons links title form".split()
)
_KEPT = frozenset(["html", "body", "main", "article"])
_CONTAINERS = frozenset("html body main article section div center address fieldset details".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Start tags that end an open paragraph, and elements that end an open one of their own kind.
_ENDS_P = _BLOCKS - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr"} | {"nav", "aside", "footer", "header", "form"}
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "hint", "inside", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool, hint: str = "", inside: bool = False):
        self.tag, self.parent, self.noise, self.hint, self.inside = tag, parent, noise, hint, inside
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def is_noise(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element is page furniture by what it says of itself."""
    if tag in _DROPPED or tag == "header" and not in_article:
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if not value or tag in _KEPT:
            continue
        if name == "role" and value.strip().lower() in _ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
    return False


def hint_of(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> str:
    """``sure`` or ``likely`` furniture by a class or an id, or nothing; headings and paragraphs of an article are none."""
    if tag in _KEPT or in_article and (tag == "p" or tag in _HEADINGS):
        return ""
    found = ""
    for name, value in attrs:
        for token in (value or "").split() if name in ("class", "id") else ():
            words = {w for w in _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if w}
            named = words & (_WORDS | ({"header"} if not in_article else set()))
            if named and words <= named | _LAYOUT:
                found = "sure" if named & _SURE else found or "likely"
    return found


class Tree(HTMLParser):
    """Builds the tree as browsers do for what pages commonly leave open; furniture is not entered."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("html", None, False)
        self.body: Node | None = None
        self.articles = 0
        self.hints: list[Node] = []

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not asked for

    def _close_to(self, node: Node) -> None:
        """Make ``node``'s parent the open element."""
        at = self.open
        while at is not node:
            self.articles -= at.tag in ("article", "main")
            at = at.parent
        self.articles -= node.tag in ("article", "main")
        self.open = node.parent or self.root

    def _nearest(self, tags: set[str], stop: set[str]) -> Node | None:
        at = self.open
        while at is not self.root:
            if at.tag in tags:
                return at
            if at.tag in stop:
                return None
            at = at.parent
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html" or tag == "body" and self.body:
            return
        if tag in _ENDS_P and (p := self._nearest({"p"}, {"table", "td", "th", "button", "object"})):
            self._close_to(p)
        if tag in _SIBLINGS and (same := self._nearest(*_SIBLINGS[tag])):
            self._close_to(same)
        if tag == "body" and self.open is not self.root:
            self.open, self.articles = self.root, 0  # an unclosed head
        inside, noise = self.articles > 0, self.open.noise
        noise = noise or is_noise(tag, attrs, inside)
        node = Node(tag, self.open, noise, "" if noise else hint_of(tag, attrs, inside), inside)
        if node.hint:
            self.hints.append(node)
        self.open.children.append(node)
        if tag == "body":
            self.body = node
        if tag not in _VOID:
            self.open = node
            self.articles += tag in ("article", "main")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the closing slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in _VOID:
            return
        if found := self._nearest({tag}, {"td", "th"} if tag not in ("table", "tr", "td", "th", "tbody") else set()):
            self._close_to(found)

    def handle_data(self, data: str) -> None:
        if not self.open.noise:
            self.open.children.append(data)


def measure(root: Node) -> list[Node]:
    """Count characters, tags and links below every element that is not furniture; in page order."""
    order, work = [], [root]
    while work:
        node = work.pop()
        order.append(node)
        work += [c for c in reversed(node.children) if isinstance(c, Node) and not c.noise]
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            elif not c.noise:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    return order


def score(order: list[Node], body: Node) -> None:
    """Density of every element, and the sum over its children."""
    share = body.link_chars / max(1, body.chars)
    for node in reversed(order):
        c, lc = node.chars, node.link_chars
        node.density = 0.0
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            spread = math.log(max(1.0, c / max(1, lc) * max(1, node.tags) / max(1, node.link_tags)))
            # A base of e at least: log(base) is then 1 for pages without links.
            node.density = c / max(1, node.tags) * spread / max(1.0, math.log(max(math.e, base)))
        node.total = sum(x.density for x in node.children if isinstance(x, Node))


def as_dense(node: Node, body: Node) -> bool:
    """Whether an element is as dense as the page; one without links is held against it by its text per tag alone.

    Without links the density grows with the length of the text, so a part would always be thinner than its whole.
    """
    text = node.chars * max(1, body.tags) >= body.chars * max(1, node.tags)
    return node.density >= body.density or not node.link_tags and text


def drop_hinted(hints: list[Node], order: list[Node], body: Node) -> None:
    """Drop hinted elements, but not most of the page, and inside the article nothing likely that is dense enough.

    Inside is what is below an article or main element, or stands among paragraphs. On a page that has such an
    element, only what holds one can be most of it: a long advert beside a short article is still one.
    """
    named, holders = False, set()
    for node in order:
        if node.tag in ("article", "main") and node.chars:
            named = True
            while node is not None and node not in holders:
                holders.add(node)
                node = node.parent
    for node in hints:
        if 2 * node.chars > body.chars and (node in holders or not named):
            continue
        among = node.inside or any(isinstance(c, Node) and c.tag == "p" and c.chars and not c.hint for c in node.parent.children)
        node.noise = node.hint == "sure" or not (among and as_dense(node, body))


def choose(order: list[Node], body: Node) -> Node:
    """The element with the largest density sum, or the outermost one above it that is dense enough."""
    best = max(order, key=lambda n: n.total)  # the first of equals
    if not best.total:
        return body
    while best is not body and best.parent is not None and best.parent is not body and best.parent.density >= body.density:
        best = best.parent
    return best


def article(best: Node, threshold: float) -> list[Node | str]:
    """The chosen element with those beside it that are article too.

    These are the dense enough ones (of a chosen article or main element only others of that kind), the headings
    right before one, and what stands between two of them but containers that are not dense enough.
    """
    if best.parent is None:
        return [best]
    beside = best.parent.children
    named = best.tag in ("article", "main")

    def is_part(c: Node | str) -> bool:
        if c is best:
            return True
        alike = isinstance(c, Node) and not c.noise and c.chars > 0 and (c.tag in ("article", "main") or not named)
        return alike and c.tag not in _HEADINGS and c.density >= threshold and 2 * c.link_chars <= c.chars

    parts = [i for i, c in enumerate(beside) if is_part(c)]
    first, chosen = parts[0], set(parts)
    while first and (isinstance(c := beside[first - 1], str) and not c.strip() or isinstance(c, Node) and c.tag in _HEADINGS):
        first -= 1
    titled = any(n.tag == "h1" for i in parts for n in measure(beside[i])) if first < parts[0] else False
    found = []
    for i in range(first, parts[-1] + 1):
        c = beside[i]
        if i < parts[0] and isinstance(c, Node) and titled and c.tag == "h1":
            continue  # the site's name
        if isinstance(c, str) or i in chosen or c.tag not in _CONTAINERS:
            found.append(c)
    return found


def link_ends(tops: list[Node | str], threshold: float) -> set[int]:
    """Elements at either end of what is chosen that are mostly links and not dense, up to the first other text.

    Inside an article or main element there are none: its links are its own.
    """
    out: set[int] = set()
    whole = {id(top) for top in tops if isinstance(top, Node) and top.tag in _CONTAINERS}
    for forward in (True, False):
        work: list[Node | str] = list(tops[::-1] if forward else tops)
        while work:
            item = work.pop()
            if isinstance(item, str):
                if item.strip():
                    break
            elif not item.noise and item.chars:
                if item.inside or item.tag in ("article", "main"):
                    break
                sparse = item.density < threshold and 2 * item.link_chars > item.chars
                if sparse and item.tag in _BLOCKS and id(item) not in whole:
                    out.add(id(item))
                    continue
                work += reversed(item.children) if forward else item.children
    return out


def blocks(tops: list[Node | str], threshold: float) -> list[str]:
    """The text blocks in and below some elements, white space within each turned into one space."""
    found, parts = [], []

    def end() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            found.append(text)

    work: list[Node | str | None] = tops[::-1]
    left_out = link_ends(tops, threshold)
    while work:
        item = work.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            parts.append(item)
        elif not item.noise and id(item) not in left_out:
            if item.tag in _SPACED:
                parts.append(" ")
            if item.tag in _BLOCKS:
                end()
                work.append(None)
            work += reversed(item.children)
    end()
    return found


def main_text(html: str) -> str:
    """The main text of a page, its blocks joined by two line ends; empty if there is none."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    body = tree.body or tree.root
    order = measure(body)
    score(order, body)
    if tree.hints:
        drop_hinted(tree.hints, order, body)
        order = measure(body)
        score(order, body)
    best = choose(order, body)
    return "\n\n".join(blocks(article(best, body.density), body.density))


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per input row.

    ``pages`` has ``page_id``, ``url`` and ``html``. A null or empty html, or one without text, gives an empty
    text. Pages are read whole however long; repeated rows come back as they go in, null ids and urls stay null,
    an empty table gives an empty result, other columns are not looked at.
    """
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b, "html")):
            texts = [main_text(h.decode("utf-8", "replace")) for h in byte_texts(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw("html").alias("html")
    )
    return rows.mapInArrow(run, schema)
