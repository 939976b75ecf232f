"""Operator 10: main text of web pages by composite text density.

A page becomes a tree of elements. For every node the composite density is its characters per tag, adjusted by its
links; a node's density sum adds up its children's densities. The subtree with the largest sum is the kernel of the main
text. The least density on its path up to the body is the threshold: the kernel grows to its parent as long as what
the parent adds (its other children together) is at least that dense, so it takes in headings and short paragraphs
beside it and stops before menus and footers. A kernel inside an article or main element grows to that element.

What is never main text (scripts, forms, navigation, hidden elements, those whose class or id names an advert, a
sidebar, comments and the like) counts in the densities and isn't given out. A name is judged whole: each of its words
must be such a word or a neutral one ("ad-box", not "post-share-text"), and an element that holds most of the page's
text isn't furniture whatever its name.

Defined results: a null or empty page, and one without any text, gives an empty text. White space (as Python
knows it, no-break spaces included) within a block becomes one space, blocks are joined by one. Unclosed elements
end with their parent, a tag with an unclosed quote ends at the next ">", and a page that breaks off is read as far as it
goes. Repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, and usual names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label".split())
DROPPED = frozenset("script style noscript template iframe object embed svg math canvas audio video map head title nav footer aside form fieldset button select option textarea input dialog menu datalist noembed noframes".split())
FURNITURE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer foot masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond reply replies responses discussion related recommended recommendations share sharing social toolbar pagination pager widget widgets search searchbox copyright skip".split())
NEUTRAL = frozenset("a box bar area block body bottom bot button buttons col column container content count field fixed form group head header holder icon icons id inner item items js l left link links list main media new news outer page panel post posts primary r right row section secondary site slot small text thread title to top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())
MAIN = frozenset(("article", "main"))
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tr"), "tfoot": ("tbody", "tr")}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "p": ("table", "td", "th", "caption", "button", "html", "body")}
#: Elements that hold text rather than blocks: none of them is a page's main part.
TEXT_LEVEL = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead pre blockquote figcaption caption address summary".split())

# a quoted value ends where an attribute can end; a quote that doesn't is left to LOOSE, which knows no quotes
_VALUES = r"(?>[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*+"
TOKEN = re.compile(rf"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<other>[!?][^>]*(?:>|\Z))|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>{_VALUES})(?P<close>>)|/[^a-zA-Z][^>]*>?)", re.S)
LOOSE = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)(?P<close>>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "parent", "children", "bits", "depth", "inside", "cut", "hinted", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children, self.bits = tag, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.inside = bool(parent) and (parent.inside or parent.tag in MAIN)  # of an article or main element
        self.cut = self.hinted = False  # never main text; so by its name alone
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def furniture(tag: str, attrs: str, inside_main: bool) -> tuple[bool, bool]:
    """Whether an element is never part of the main text, and whether its name says so."""
    if tag in DROPPED or (tag == "header" and not inside_main):
        return True, False
    if not attrs or tag in ("html", "body"):
        return False, False
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True, False
    if found.get("role", "").lower() in ROLES:
        return True, False
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        if not FURNITURE.isdisjoint(words) and all(w in FURNITURE or w in NEUTRAL for w in words):
            return False, True
    return False, False


class Builder:
    """The tree of a page. Open elements are also kept by name, so that what an end tag or a new element closes is
    found without walking up: the work is linear in the page, however deep its elements are."""

    def __init__(self):
        self.root = self.at = Node("#root", None)
        self.open: dict[str, list[Node]] = {}
        self.blocks: list[Node] = []  # open elements that aren't inline

    def last(self, tags) -> int:
        """Depth of the deepest open element of these names."""
        return max((self.open[t][-1].depth for t in tags if self.open.get(t)), default=-1)

    def push(self, node: Node) -> None:
        self.at = node
        self.open.setdefault(node.tag, []).append(node)
        if node.tag not in INLINE:
            self.blocks.append(node)

    def close(self, node: Node) -> None:
        """``node`` and all that is open in it."""
        end = node.parent
        while self.at is not end:
            self.open[self.at.tag].pop()
            if self.blocks and self.blocks[-1] is self.at:
                self.blocks.pop()
            self.at = self.at.parent

    def end(self, name: str) -> None:
        if not self.open.get(name):
            return
        node = self.open[name][-1]
        if name in INLINE and self.blocks and self.blocks[-1].depth > node.depth:
            return  # a stray end of an inline element
        self.close(node)

    def begin(self, name: str, attrs: str) -> Node:
        if name in ENDS_P and self.last(("p",)) > self.last(STOPS["p"]):
            self.close(self.open["p"][-1])
        if name in CLOSES:
            stop = self.last(STOPS.get(name, ("table",)))
            while (depth := self.last(CLOSES[name])) > stop:
                self.close(next(self.open[t][-1] for t in CLOSES[name] if self.open.get(t) and self.open[t][-1].depth == depth))
                if name not in ("tr", "thead", "tbody", "tfoot"):
                    break
        node = Node(name, self.at)
        node.cut, node.hinted = furniture(name, attrs, node.inside)
        self.at.children.append(node)
        self.at.bits.append(node)
        return node


def tree(page: str) -> Node:
    """The elements of a page; text stands in their parents' ``bits``, in order with the children."""
    made, pos, n = Builder(), 0, len(page)

    def text(raw: str) -> None:
        if raw:
            made.at.bits.append(entities.unescape(raw))

    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            text(page[pos:])
            break
        m = TOKEN.match(page, lt) or LOOSE.match(page, lt)
        if not m:
            nxt = page.find("<", lt + 1)
            text(page[pos : nxt if nxt >= 0 else n])
            pos = nxt if nxt >= 0 else n
            continue
        text(page[pos:lt])
        pos = m.end()
        if not m["name"] or not m["close"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "br":
                made.at.bits.append(Node("br", made.at))
            else:
                made.end(name)
            continue
        node = made.begin(name, m["attrs"])
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, pos)
            if name in ("title", "textarea", "xmp"):
                node.bits.append(entities.unescape(page[pos : end.start() if end else n]))
            pos = end.end() if end else n
        elif name not in VOID and not (m["attrs"].endswith("/") and name in ("path", "circle", "rect")):
            made.push(node)  # a slash closes void elements only
    return made.root


def measure(root: Node) -> list[Node]:
    """Characters, tags and links of every node, then densities and density sums; nodes in page order. Furniture
    counts, for it tells how dense the rest of the page is; scripts and the head don't."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag not in ("script", "style", "noscript", "template", "head", "title"):
            order.append(node)
            todo.extend(reversed(node.children))
        else:
            node.bits = []
    for node in reversed(order):
        own = sum(len(" ".join(b.split())) for b in node.bits if isinstance(b, str))
        kids = node.children
        node.chars = own + sum(c.chars for c in kids)
        node.tags = len(kids) + sum(c.tags for c in kids)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(c.link_chars for c in kids)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in kids)
    body = next((x for x in order if x.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for node in order:
        node.density = composite(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in order:
        node.total = sum(c.density for c in node.children)
    return order


def composite(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag times log(c t / (lc lt)) to a base that grows with links; ``share`` is the page's share of
    characters in links."""
    if not chars:
        return 0.0
    c, t, lc, lt = chars, max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(c / max(c - link_chars, 1) * link_chars + share * c + math.e)
    return c / t * math.log(max(c * t / (lc * lt), 1.0)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else c / t


def settle(order: list[Node]) -> None:
    """Elements named like furniture are cut, but for those that an article or main element fills by half, and, in a
    page whose text isn't in such an element, one with nine tenths of the text."""
    text: dict[int, int] = {}  # characters of each node outside certain furniture, and those in article or main
    main: dict[int, int] = {}
    for x in reversed(order):
        text[id(x)] = 0 if x.cut else x.chars - sum(c.chars - text.get(id(c), 0) for c in x.children)
        main[id(x)] = 0 if x.cut else text[id(x)] if x.tag in MAIN and not x.hinted else sum(main.get(id(c), 0) for c in x.children)
    whole, found = text[id(order[0])], main[id(order[0])]
    for x in order:
        if x.hinted:
            own, inner = text[id(x)], main[id(x)]
            x.cut = not (2 * inner > own or (found == inner and 10 * own > 9 * whole))


def kernel(order: list[Node], frame: bool = True) -> Node | None:
    """The root of the main text's subtree; ``frame``: whether article and main elements count as its bounds."""
    hidden: set[int] = set()
    for x in order:
        if x.cut or (x.parent is not None and id(x.parent) in hidden):
            hidden.add(id(x))
    open_ = [x for x in order if x.chars and id(x) not in hidden]
    if not open_:
        return None
    best = max(open_, key=lambda x: x.total)  # the first of equals
    while best.tag in TEXT_LEVEL and best.parent is not None:
        best = best.parent
    body = next((x for x in order if x.tag == "body"), order[0])
    share = body.link_chars / max(body.chars, 1)
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    least = min(x.density for x in path)
    for up in path[1:]:
        more = composite(up.chars - best.chars, up.tags - best.tags - 1, up.link_chars - best.link_chars, up.link_tags - best.link_tags, share)
        if more < least and up.chars > best.chars:
            break
        best = up
    around = [x for x in path if x.tag in MAIN]
    if frame and around and around[-1].depth < best.depth:
        best = around[-1]
    return best


def text_of(node: Node) -> list[str]:
    """The blocks of text below a node, in page order."""
    parts: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.cut:
            edge = [] if x.tag in INLINE else ["\n"]
            todo.extend([*edge, *reversed(x.bits), *edge])
    return [" ".join(b.split()) for b in "".join(parts).split("\n") if b.strip()]


def main_text(page: str | None, frame: bool = True) -> str:
    if not page:
        return ""
    order = measure(tree(page))
    settle(order)
    node = kernel(order, frame)
    return " ".join(text_of(node)) if node else ""


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    frame = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return frame.mapInArrow(run, f"page_id {frame.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
