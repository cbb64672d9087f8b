"""Main text of web pages by composite text density.

A page is parsed into a tree; every block and every link gets the link-adjusted characters per tag

    (C / T) * log_b((C / LC) * (T / LT)),   b = ln((C / NLC) * LC + (LCb / Cb) * C + e)

with C characters, T tags, LC and NLC characters inside and outside links, LT link tags, b the body.
Elements inside a line of text (bold, spans, line breaks) are no tags of their own. A node's density
sum is the sum over its children, its own loose text being one. On every page the subtree of the
largest density sum is the content, and the smallest density on the path from the body to it is the
threshold that a sibling of the path needs to be part of the article too.

Marks only weigh in: inside an enclosing `article` or `main` a sibling needs no density (but must not
be mostly links), outside of one it needs the largest density on the path. Elements that hold no
article text by the HTML standard (scripts, menus, footers, forms, ...) take no part, nor do elements
whose class, id or role is wholly made of words for adverts, notices, comments and the like; a page
that has nothing else has no main text, but for boxes of a generic name (widgets, dialogs). Of two articles side by side, outside of a common one, the
denser is the content, and the other one needs the largest density on the path.

Defined results: a null or empty page, and one without text, gives the empty text; unclosed and
truncated markup is closed at the end; an attribute whose quote is never closed ends at the next `>`;
repeated rows stay repeated; other columns are carried only if asked for; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

from pyspark.sql import DataFrame

from .batches import with_columns

# Names from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul search caption".split()
)
LINKS = frozenset("a button select".split())
HEADINGS = frozenset("h1 h2 h3".split())
#: Elements that hold no article text.
EXCLUDED = frozenset(
    "head script style noscript template nav footer aside form button select option textarea iframe object embed svg canvas "
    "audio video menu dialog title input noembed noframes search map".split()
)
#: An open element of the first kind ends where one of the second begins.
IMPLIED_END = {
    "p": BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "option", "optgroup"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "tr": {"tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
    "head": {"body"},
}
#: What hides an element of the first kind that is still open.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "p": {"td", "th", "table", "button", "object", "body"}}
_ENDED_BY = {tag: [kind for kind, enders in IMPLIED_END.items() if tag in enders] for tag in set().union(*IMPLIED_END.values())}

#: Words for what an article is to be told from: menus, sidebars, notices, adverts, reader comments.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices alert popup "
    "modal newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments disqus "
    "discussion replies responses related recommended share sharing social pagination widget widgets search complementary contentinfo dialog".split()
)
#: Those among them that name a kind of box only: what is in one may be the page's article, where there is no other text.
GENERIC = frozenset("widget widgets popup modal dialog related recommended promo search complementary contentinfo".split())
#: Words that may stand beside them in a name.
BESIDE = frozenset("article post page site blog entry user reader list section box block area wrap wrapper container slot unit thread bar left right top bottom inner outer main links form".split())

_MARK = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(?![\"'])([^\s>]*)|[\"']([^>]*)))?)")
_NAME_PARTS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("article", "chars", "content", "density", "drop", "holder", "link_chars", "link_tags", "marked", "own", "parts", "stands", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.content = tag, []
        #: whether this is a tag of its own, and not part of a line; the nearest such node around it, and those within it
        self.stands = parent is None or tag in BLOCK or tag in LINKS
        self.holder = parent if parent is None or parent.stands else parent.holder
        self.parts: list[Node] = []
        self.drop = tag in EXCLUDED
        #: 1 for a box of a generic name, 2 for what is named as no part of an article
        self.marked = 0
        self.article = tag in ("article", "main")
        self.chars = self.own = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def boilerplate_grade(tag: str, name: str) -> int:
    """Over 0 if a class, id or role is wholly made of words for boilerplate and what stands beside them; 1 if these are generic."""
    parts = {p for p in _NAME_PARTS.split(_CAMEL.sub(" ", name).lower()) if p}
    if tag in ("html", "body", "main") or not parts & BOILERPLATE or not parts <= BOILERPLATE | BESIDE:
        return 0
    return 2 if parts & (BOILERPLATE - GENERIC) else 1


def _weigh(node: Node, name: str, value: str) -> None:
    name, low = name.lower(), value.lower()
    if name in ("class", "id", "role"):
        node.marked = max(node.marked, *(boilerplate_grade(node.tag, v) for v in value.split()), 0)
        node.article |= name == "role" and low in ("main", "article")
    elif name == "itemprop":
        node.article |= low == "articlebody"
        node.marked = max(node.marked, 2 * (low == "comment"))
    elif name == "hidden" or (name == "style" and _HIDDEN.search(low)) or (name == "aria-hidden" and low == "true"):
        node.drop = True


def attributes(html: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """(name, value) pairs of a tag from its name's end, and where the tag ends."""
    found = []
    while m := _ATTRIBUTE.match(html, at):
        at = m.end()
        if m[1]:
            return found, at
        found.append((m[2], unescape(m[3] or m[4] or m[5] or m[6] or "")))
    return found, len(html)


def parse(html: str) -> Node:
    """The tree of a page, in one pass. Text is decoded; `content` holds strings and nodes in page order."""
    root = Node("#root", None)
    opened, places = [root], defaultdict(list)
    at, size, lower = 0, len(html), None

    def close_to(depth: int) -> None:
        while len(opened) > depth:
            places[opened.pop().tag].pop()

    while at < size:
        m = _MARK.search(html, at)
        begin = m.start() if m else size
        if begin > at:
            opened[-1].content.append(unescape(html[at:begin]))
        if not m:
            break
        if not m[3]:
            end = html.find("-->" if m[1] else ">", m.end())
            at = size if end < 0 else end + (3 if m[1] else 1)
            continue
        tag = m[3].lower()
        found, at = attributes(html, m.end())
        if m[2]:
            if places[tag]:
                close_to(places[tag][-1])
            elif tag in ("p", "br"):
                opened[-1].content.append("\n")
            continue
        for kind in _ENDED_BY.get(tag, ()):
            if places[kind] and places[kind][-1] > max((places[b][-1] for b in SCOPE.get(kind, ()) if places[b]), default=0):
                close_to(places[kind][-1])
        node = Node(tag, opened[-1])
        for name, value in found:
            _weigh(node, name, value)
        opened[-1].content.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            lower = html.lower() if lower is None else lower
            same = len(lower) == size
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", 0 if same else re.I).search(lower if same else html, at)
            stop = end.start() if end else size
            node.content.append(html[at:stop])
            close = html.find(">", stop)
            at = close + 1 if end and close >= 0 else size
            continue
        places[tag].append(len(opened))
        opened.append(node)
    return root


def live(root: Node, boxes: bool = False) -> list[Node]:
    """Nodes that take part, in page order, with `boxes` those of a generic name too. A header does so only inside an article or main element."""
    found, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node.drop or node.marked > boxes or (node.tag == "header" and not inside):
            continue
        found.append(node)
        inside |= node.article
        stack.extend((part, inside) for part in reversed(node.content) if isinstance(part, Node))
    return found


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Link-adjusted characters per tag; share: the body's share of characters inside links."""
    if not chars:
        return 0.0
    tags = max(tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    return chars / tags * max(math.log(chars / max(link_chars, 1) * (tags / max(link_tags, 1))), 0.0) / math.log(base + 1.0)


def measure(nodes: list[Node]) -> Node:
    """Fill counts, densities and density sums of nodes in page order; returns the body (or the root)."""
    standing = [n for n in nodes if n.stands]
    for node in standing:
        node.parts, node.own, node.chars, node.tags, node.link_chars, node.link_tags, node.total = [], 0, 0, 0, 0, 0, 0.0
    for node in nodes:
        (node if node.stands else node.holder).own += sum(len("".join(part.split())) for part in node.content if isinstance(part, str))
    for node in reversed(standing):
        node.chars += node.own
        if node.tag in LINKS:
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        up = node.holder
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body = next((n for n in standing if n.tag == "body"), nodes[0])
    share = body.link_chars / max(body.chars, 1)
    for node in standing:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        node.total += density(node.own, 1, 0, 0, share)
        if node.holder is not None:
            node.holder.total += node.density
            node.holder.parts.append(node)
    return body


def choose(body: Node) -> tuple[list[Node], set[int]]:
    """The path from the densest subtree up to the body, and its siblings that are no part of the article.

    Sums inside an `article` or `main` count double.
    """
    best, most, stack = body, -1.0, [(body, False)]
    while stack:
        node, inside = stack.pop()
        inside |= node.article
        weighed = node.total * (2 if inside else 1)
        if weighed > most:
            best, most = node, weighed
        stack.extend((part, inside) for part in reversed(node.parts))
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].holder)
    marked = max((k for k, n in enumerate(path) if n.article), default=-1)
    least, largest = min(n.density for n in path), max(n.density for n in path)
    on_path, out = {id(n) for n in path}, set()
    for k, node in enumerate(path[1:], 1):
        for part in node.parts:
            plain = 2 * part.link_chars < part.chars
            needed = 0.0 if k <= marked or (marked < 0 and part.tag in HEADINGS) else least if marked < 0 else largest
            if id(part) not in on_path and not (plain and part.density >= needed):
                out.add(id(part))
        if k > marked and density(node.own, 1, 0, 0, 0.0) < (least if marked < 0 else largest):
            # loose text of the path that is too thin
            out.add(-id(node))
    return path, out


def blocks(top: Node, taken: set[int], out: set[int]) -> list[str]:
    """Texts of the blocks below `top`: of nodes in `taken` and not in `out`; -id there mutes a node's loose text."""
    found: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            found.append(text)

    stack: list = [(top, False)]
    while stack:
        item, mute = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            if not mute:
                line.append(item)
        elif id(item) not in taken or id(item) in out:
            continue
        elif item.tag in VOID:
            line.append(" ")
            if item.tag == "hr":
                close()
        else:
            if item.tag in BLOCK:
                close()
                stack.append((None, False))
            mute = -id(item) in out if item.stands else mute
            stack.extend((part, mute) for part in reversed(item.content))
    close()
    return found


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    for boxes in (False, True):
        nodes = live(root, boxes)
        body = measure(nodes)
        if body.chars:
            path, out = choose(body)
            return "\n\n".join(blocks(path[-1], {id(n) for n in nodes}, out))
    return ""


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns and the main text of every page; no shuffle."""
    return with_columns(pages, html, lambda values: {"text": [main_text(v) for v in values]}, "text string", keep or ["page_id", "url"], as_bytes=False)
