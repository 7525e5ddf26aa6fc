"""HTML extraction by tree scoring: paragraphs give their ancestors points, link density discounts them, the best container and its siblings stay, link-dense ones aside."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions

# Element names of the HTML standard, and the words by which page furniture is named.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math object".split())
FURNITURE = set("head nav footer aside form button select option label fieldset dialog menu canvas audio video".split())
BLOCK = set("address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = ("article", "main", "body", "td", "table")
SCOPES = ("ul", "ol", "table", "dl", "article", "main", "body", "div", "section", "blockquote")
PARAGRAPH = set("p pre td blockquote li dd".split())
NAMED = set("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget".split())

# Words that a name of page furniture may hold beside those of NAMED.
AROUND = set("site page post entry article blog main global primary secondary top bottom left right upper lower inner outer wrapper wrap container box bar list item items block area section column col row panel module link links button buttons icon icons text title form content c js id div ul desktop mobile".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: For what follows a quote that never ends.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "items", "drop", "inside", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, drop: bool):
        self.tag, self.parent, self.items, self.drop = tag, parent, [], drop
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.score, self.chars, self.linked = 0.0, 0, 0


def _furniture_name(value: str, inside: bool) -> bool:
    """One of the names in a class or id is that of page furniture, whole: 'nav-bar' is, 'share-of-market' is not."""
    for name in value.split():
        words = {w.lower() for w in _NAME.findall(name)} - ({"header"} if inside else set())
        if words & NAMED and words <= NAMED | AROUND:
            return True
    return False


def _unwanted(tag: str, attributes: str, parent: Node) -> bool:
    if tag in FURNITURE:
        return True
    inside = parent.inside or parent.tag in ("article", "main")
    if tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and {w.lower() for w in _NAME.findall(value)} & {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}:
            return True
        if name in ("class", "id") and _furniture_name(value, inside):
            return True
    return False


class _Open:
    """The open elements, outermost first, and where each tag stands among them."""

    def __init__(self):
        self.nodes: list[Node] = [Node("#root", None, False)]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Closes the element at a place and all within it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags; 0 without."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def first_after(self, tags, place: int) -> int:
        """The place of the outermost open element with one of the tags within the one at ``place``; 0 without."""
        return min((p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, place)) < len(p)), default=0)


def parse(page: str) -> Node:
    """A forgiving tree: unclosed paragraphs, items and inline elements end where the next block begins or an ancestor ends.

    Every character is looked at a bounded number of times: end tags and unclosed elements are found by the places of open
    tags, not by walking up, and once a quote turns out never to end, quotes count for nothing.
    """
    open_ = _Open()
    at, n, token = 0, len(page), _TOKEN
    ends: dict[str, re.Pattern] = {}
    while at < n:
        start = _START.search(page, at)
        m = start and token.match(page, start.start())
        if start and not m and token is _TOKEN:
            token = _PLAIN
            m = token.match(page, start.start())
        text = page[at : m.start() if m else n]
        here = open_.nodes[-1]
        if text:
            here.items.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                here.items.append(m[0][9:-3])
            continue
        if m[1]:
            place = open_.last((tag,))
            if place and (tag in BLOCK or place >= open_.last(BOUNDS)):
                open_.cut(place)
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}\s*[^>]*>?", re.I)).search(page, at)
                at = end.end() if end else n
            continue
        if tag in CLOSES_P or tag in SAME:
            close = SAME.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            if place := open_.first_after(close, open_.last(SCOPES)):
                open_.cut(place)
        here = open_.nodes[-1]
        node = Node(tag, here, tag not in VOID and _unwanted(tag, m[3], here))
        here.items.append(node)
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            open_.push(node)
    return open_.nodes[0]


def _score(root: Node) -> list[Node]:
    """Sizes, link densities and points, bottom up; returns the nodes that stay, in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node) and not x.drop)
    commas = {}
    for node in reversed(order):
        chars = linked = n = 0
        for x in node.items:
            if isinstance(x, str):
                chars += len(" ".join(x.split()))
                n += x.count(",")
            elif not x.drop:
                chars, linked, n = chars + x.chars, linked + x.linked, n + commas[id(x)]
        node.chars, node.linked, commas[id(node)] = chars, chars if node.tag == "a" else linked, n
    for node in order:
        if node.tag == "article" or node.tag == "main":
            node.score += 25
        if node.tag in PARAGRAPH and node.chars >= 25:
            points = 1 + commas[id(node)] + min(node.chars / 100, 3)
            up, share = node.parent, 1.0
            while up is not None and share > 0.1:
                up.score += points * share
                up, share = up.parent, share / (2 if share == 1 else 1.5)
    return order


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _blocks(node: Node, out: list[str]) -> None:
    """Texts of the blocks under ``node``, in page order; ``out``'s last entry is the block under way."""
    out.append("")
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append("")
        elif isinstance(x, str):
            out[-1] += x
        elif not x.drop:
            if x.tag in BLOCK:
                out.append("")
                stack.append(None)
            elif x.tag in ("br", "img", "wbr"):
                out[-1] += " " if x.tag == "br" else ""
            stack.extend(reversed(x.items))
    out.append("")


def main_text(page: str | None) -> str:
    """The blocks of the best container (the whole article or main element that it lies in) and of its siblings, but link-dense ones without a good score, one a line; empty without any text."""
    if not page:
        return ""
    order = _score(parse(page))
    best = max((x for x in order if x.chars and x.tag not in ("a", "li", "p", "span", "b", "i", "em", "strong")), key=lambda x: x.score * (1 - _density(x)), default=None)
    if best is None:
        return ""
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    top = best.score * (1 - _density(best))
    if best.parent is not None:
        for x in best.parent.items:
            if isinstance(x, Node) and x is not best and x.chars and _density(x) >= 0.25 and x.score * (1 - _density(x)) < max(10, 0.2 * top) and x.tag != "h1":
                x.drop = True
    out: list[str] = []
    _blocks(best.parent or best, out)
    return "\n".join(t for t in (" ".join(b.split()) for b in out) if t)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "html"):
        texts = [main_text(p.as_py()) for p in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` -> ``page_id, url, text, n_chars``, one row per input row, from the whole html.

    Null or empty html, and pages with nothing but furniture, give an empty text. Null ids and urls pass through; rows
    that repeat are each extracted. Character references are decoded; white space, no-break space included, becomes one
    space in a block; a line break element is white space. Other columns are ignored. There is no shuffle.
    """
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
