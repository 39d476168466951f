"""Main text of HTML pages by composite text density.

Every element gets a density: its characters per tag, raised where few of them are link text and
lowered where many are. An element's sum adds the densities of its children, its own text counting as
one; a lone block, which holds no other block, has its own density for a sum, so that it never
outweighs the element around it. Of the elements at least as dense as the sparsest on the path from
the body to the one with the largest sum, the one with the largest sum is the article, with a heading
that stands directly before it. No tag makes an element the article. Elements that say by tag, role or
a whole class or id that they are no article (menus, page headers and footers, sidebars, notices,
adverts, forms, comments) count nowhere, unless they hold an article, a main or most of the text
outside links: then density decides.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the key ends open elements of the values, up to a boundary.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
BOUNDARY = frozenset("html body article main section div td th table ul ol dl blockquote nav aside header footer form figure details fieldset select".split())
#: What is no article: by tag or role, and by whole classes and ids.
NO_ARTICLE_TAGS = frozenset("nav footer aside form button select dialog menu svg canvas audio video object map datalist".split())
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NO_ARTICLE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer header masthead topbar "
    "comment comments disqus replies respond discussion share sharing social related recommended newsletter subscribe subscription signup login search pagination pager skip "
    "site-header site-footer page-footer main-nav site-nav nav-menu navbar-nav skip-link cookie-banner cookie-notice cookie-consent ad-banner ad-container ad-slot "
    "share-buttons social-share social-links related-posts related-articles newsletter-signup comments-area comment-list comment-respond post-comments".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: Read from left to right, so that no value is taken for a name.
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class _Node:
    __slots__ = ("children", "chars", "density", "link", "link_chars", "link_tags", "marked", "name", "own", "parent", "skip", "sum", "tags")

    def __init__(self, name: str, parent: _Node | None, marked: bool):
        self.name, self.parent, self.marked, self.skip = name, parent, marked, False
        self.children: list[_Node | str] = []
        self.link = name == "a" or (parent is not None and parent.link)
        self.own = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _no_article(name: str, attributes: str, node: _Node) -> bool:
    if name in NO_ARTICLE_TAGS or name in RAW:
        return True
    if name == "header":
        while node is not None:  # a header inside the article holds its headline
            if node.name in ("article", "main"):
                return False
            node = node.parent
        return True
    if not attributes or name in ("html", "body", "article", "main") or name in HEADINGS:
        return False
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    named = f"{found.get('class', '')} {found.get('id', '')}".split()
    return (
        not NO_ARTICLE_WORDS.isdisjoint(named) or found.get("role", "").strip() in NO_ARTICLE_ROLES
        or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in "".join(found.get("style", "").split())
    )


def parse(page: str) -> _Node:
    """The tree of a page; its root stands for the body where there is none."""
    root = node = _Node("html", None, False)
    at, end, last_tag = 0, len(page), page.rfind(">") + 1
    opened: Counter[str] = Counter()  # names of the open elements, so that no end tag of another walks up the tree

    def close_to(x: _Node) -> None:
        nonlocal node
        while node is not x:
            opened[node.name] -= 1
            node = node.parent

    def text(s: str) -> None:
        if s:
            node.children.append(html.unescape(s) if "&" in s else s)

    while at < end:
        m = _TOKEN.search(page, at, last_tag)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if not opened[name]:
                continue
            x = node
            while x.name != name and (name not in INLINE or x.name not in BOUNDARY):  # an inline end tag ends no block around it
                x = x.parent
            if x.name == name:
                close_to(x.parent)
            continue
        if name in ("html", "body") and (name == "html" or any(getattr(c, "name", "") == "body" for c in root.children)):
            continue
        if name not in INLINE and name not in VOID or name in ENDS:
            ends = ENDS.get(name, frozenset()) | ({"p"} if name not in INLINE else frozenset())
            x, last = node, None
            while any(opened[e] for e in ends) and x is not root and (x.name not in BOUNDARY or x.name in ends):
                if x.name in ends:
                    last = x
                x = x.parent
            if last is not None:
                close_to(last.parent)
        child = _Node(name, node, _no_article(name, attributes, node))
        node.children.append(child)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
        elif name not in VOID and not attributes.endswith("/"):
            node = child
            opened[name] += 1
    return root


def _order(root: _Node) -> list[_Node]:
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(c for c in reversed(x.children) if not isinstance(c, str) and not c.skip)
    return out


def _skip_marked(body: _Node) -> None:
    """Skips the marked elements but those that hold an article, a main or most of the text outside links.

    That text is the enclosing article's or main's; outside of them, the body's, on a page that has
    none with text. An article inside another is a comment on it or the like and saves nothing.
    """
    nodes = _order(body)
    plain: dict[_Node, int] = {}
    around: dict[_Node | None, _Node | None] = {body.parent: None}
    holds = set()
    for x in nodes:
        x.own = sum(len("".join(c.split())) for c in x.children if isinstance(c, str))
        around[x] = x if x.name in ("article", "main") else around[x.parent]
    for x in reversed(nodes):
        plain[x] = (0 if x.link else x.own) + sum(plain[c] for c in x.children if not isinstance(c, str))
        outer = around[x.parent]
        if x in holds or around[x] is x and (x.name == "main" or outer is None or outer.name == "main"):
            holds.add(x.parent)
    of_page = None if any(around[x] is x and plain[x] for x in nodes) else body
    for x in nodes:
        whole = around[x] or of_page
        x.skip = x.marked and x not in holds and (whole is None or 2 * plain[x] <= plain[whole])


def _density(chars: int, tags: int, link_chars: int, link_tags: int, body_links: float) -> float:
    if not chars:
        return 0.0
    tags, links, link_tags = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + body_links * chars + math.e)
    # 1 is added to the base, which would be 1 on a page without links.
    return chars / tags * max(0.0, math.log(chars * tags / (links * link_tags))) / math.log(1 + base)


def main_element(root: _Node) -> _Node:
    body = next((c for c in root.children if getattr(c, "name", "") == "body"), root)
    _skip_marked(body)
    nodes = _order(body)
    for x in reversed(nodes):
        x.chars, x.link_chars = x.own, x.own if x.link else 0
        x.tags = x.link_tags = 0
        for c in x.children:
            if not isinstance(c, str) and not c.skip:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags + (c.name == "a")
    body_links = body.link_chars / max(1, body.chars)
    for x in nodes:
        x.density = _density(x.chars, x.tags, x.link_chars, x.link_tags, body_links)
    for x in nodes:
        inside = [c for c in x.children if not isinstance(c, str) and not c.skip]
        if all(c.name in INLINE or c.name in VOID for c in inside):
            x.sum = x.density
        else:
            x.sum = _density(x.own, 1, x.own if x.link else 0, 0, body_links) + sum(c.density for c in inside)
    blocks = [x for x in nodes if x is body or x.name not in INLINE]
    best = max(blocks, key=lambda x: x.sum)
    least, x = best.density, best
    while x is not body:
        x = x.parent
        least = min(least, x.density)
    return max((x for x in blocks if x.density >= least), key=lambda x: x.sum)


def _heading_before(x: _Node) -> list[_Node]:
    """The heading that nothing but white space stands between and x."""
    around = x.parent.children if x.parent is not None else []
    at = next((i for i, c in enumerate(around) if c is x), 0)
    before = [c for c in around[:at] if not isinstance(c, str) or c.strip()]
    return before[-1:] if before and getattr(before[-1], "name", "") in HEADINGS and not before[-1].skip else []


def main_text(page: str) -> str:
    """The text of the main element: references decoded, white space collapsed, blocks joined by one space."""
    best = main_element(parse(page))
    out, stack = [], [best, *_heading_before(best)]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.skip:
            edge = "" if x.name in INLINE else " "
            out.append(edge)
            stack.append(edge)
            stack.extend(reversed(x.children))
    return " ".join("".join(out).split())


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield batch({"page_id": part.column(0), "url": part.column(1), "text": texts, "n_chars": [len(t) for t in texts]}, _TEXT)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row.

    A null page is empty and has an empty text; repeated rows and null ids are kept; an empty table
    gives no rows; other columns are ignored. Whole pages are read, however long.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
