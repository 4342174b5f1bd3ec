"""Main-text extraction by tag-path ratios.

A page is read once into text blocks, each at the leaf of a root-to-leaf tag path. Per
path, text length, punctuation and link text are summed over its blocks; the
path's ratio is text per block, raised by punctuation and lowered by links.
Ratios are smoothed over neighbouring blocks in page order, fused with the
ratio of the best enclosing container path up to the content root (so a headline,
a one-word paragraph or a list of short entries shares the weight of the text it
stands in), and paths below a share of the best fused ratio are dropped. The root
is the ``article`` or ``main``; on a page without, the innermost element with
nearly all text of weight that leaves out no headline, list or table.

Page furniture has no part in this, whatever its length: elements that HTML itself names so, hidden ones, and
elements whose class, id or role names it. A class or id names furniture if all its words do or are words
of layout ("comment-list", "sidebar-left"; not "with-sidebar" or "related-work"). ``article`` and ``main`` are never
furniture by name, nor are headings inside them, nor is an element that holds an article (unless one at least as long stands
outside it: comments and teasers are articles too), nor, where no sentence stands outside such names, the named element
with the most text of weight.

Text of a block: character references decoded, white space runs as one space,
trimmed; blocks are joined by an empty line.

Time and memory follow the page's length: open elements are linked to their parents, paths are numbers made from the
parent's path and a tag, and sums run once up and once down the tree.

Defined cases: null or empty html gives the empty text; malformed markup is
read as far as it goes (open paragraphs end at the next block, stray end tags
are skipped, a quote that is not closed is a character, an unclosed comment, script or style hides the rest); a page
without any content path gives the empty text; pages are independent, so
repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_columns

#: HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select object canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("nav aside footer form menu dialog search button fieldset head label".split())
CONTENT = frozenset("article main".split())
#: Words in class, id or role attributes that name page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment "
    "comments complementary consent contentinfo cookie cookies copyright disqus footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related "
    "replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar "
    "widget widgets".split())
#: Words of layout that may stand beside them.
LAYOUT_WORDS = frozenset(
    "area article articles bar block body bottom box btn button center col column container content contents element "
    "entry first footer form global group header holder inner inside item items last left link links list main module "
    "news outer page panel post posts primary reader readers right row second secondary section site sticky stories story "
    "sub text thread title top user users wrap wrapper".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、¿¡]")
SENTENCE = re.compile(r"[.!?…。！？]")
#: Nothing in it is tried twice: possessive repeats, and a quote without an end is a character.
TOKEN = re.compile(r"<!--(?s:.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table blockquote pre".split())
LAYOUT = frozenset("html body div center section table tbody tr td".split())
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

#: A path stays if its fused ratio is at least this share of the page's best.
SHARE = 0.15
CONTENT_WEIGHT = 4.0
#: Characters of a block that counts as a sentence of the page.
SENTENCE_CHARS = 40

#: Elements that an opening block element closes: an open paragraph, and items of the same kind.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th")}


@dataclass(eq=False, slots=True)
class Node:
    """A block element, linked to its parent."""

    tag: str
    parent: Node | None
    role: bool = False  # furniture by its element, or hidden
    named: bool = False  # furniture by its class, id or role
    furniture: bool = False  # furniture by role, or inside it
    article: Node | None = None  # innermost article or main, itself included
    lists: int = 0  # list elements from the page to here
    heads: int = 0
    inline: dict[str, list[bool]] | None = None  # open inline elements in it, and whether they hide
    dropped: bool = False  # furniture or named, or inside such
    path: int = 0
    inside: bool = False  # within the content root


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    links: int
    punctuation: int


def _names_furniture(value: str, words: frozenset[str]) -> bool:
    """Whether one class or id is made of furniture and layout words, furniture among them."""
    for token in value.split():
        for own in ([w.lower() for w in WORD.findall(token)], re.findall(r"[a-z]+", token.lower())):
            if any(w in words for w in own) and all(w in words or w in LAYOUT_WORDS for w in own):
                return True
    return False


def marks(tag: str, attributes: str, inside_content: bool) -> tuple[bool, bool]:
    """Whether the attributes hide an element, and whether they name it as furniture."""
    hidden, named = False, False
    words = FURNITURE_WORDS - {"header"} if inside_content else FURNITURE_WORDS
    for name, *groups in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(groups)
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (
                name == "style" and NO_DISPLAY.search(value)):
            hidden = True
        elif name in ("class", "role") or (name == "id" and tag not in HEADINGS):  # a heading's id is its text
            named = named or _names_furniture(value, words)
    if tag in CONTENT or (inside_content and tag in HEADINGS):
        return hidden, False
    return hidden, named


class Page:
    """The blocks of a page in its order, and its elements (the page itself first, parents before children)."""

    def __init__(self, page: str):
        self.nodes = [Node("", None, inline={})]
        self.blocks: list[Block] = []
        self._top = self.nodes[0]
        self._open: dict[str, int] = {}  # open elements of each tag
        self._buffer: list[str] = []
        self._links = self._anchors = self._hiding = 0
        self._read(page)

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join(entities.unescape("".join(self._buffer)).split())
            if text:
                self.blocks.append(Block(self._top, text, min(self._links, len(text)), len(PUNCTUATION.findall(text))))
            self._buffer.clear()
        self._links = 0

    def _add(self, text: str) -> None:
        if not self._hiding:
            self._buffer.append(text)
            if self._anchors:
                self._links += len(text)

    def _pop(self) -> None:
        node = self._top
        self._open[node.tag] -= 1
        self._anchors -= len(node.inline.get("a", ()))
        self._hiding -= sum(map(sum, node.inline.values()))
        node.inline = None
        self._top = node.parent

    def _close(self, tags: tuple[str, ...], until: frozenset[str]) -> None:
        if not any(self._open.get(t) for t in tags):
            return
        node = self._top
        while node.parent is not None and node.tag not in until:
            if node.tag in tags:
                self._flush()
                while self._top is not node:
                    self._pop()
                self._pop()
                return
            node = node.parent

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            if self._open.get(tag):
                self._flush()
                while self._top.tag != tag:
                    self._pop()
                self._pop()
        elif self._top.inline.get(tag):
            self._hiding -= self._top.inline[tag].pop()
            self._anchors -= tag == "a"

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._close(("p",), frozenset(("table", "td", "th")))
            if tag in ENDS:
                self._close(ENDS[tag], frozenset(("ul", "ol", "dl", "table", "menu")))
            self._flush()
        up = self._top
        hidden, named = marks(tag, attributes, up.article is not None) if attributes and tag not in ("html", "body") else (
            False, False)
        role = tag in FURNITURE or (tag == "header" and up.article is None) or hidden
        if tag not in BLOCKS:
            up.inline.setdefault(tag, []).append(role)
            self._hiding += role
            self._anchors += tag == "a"
            return
        self._top = Node(tag, up, role, named, role or up.furniture, None, up.lists + (tag in LISTS),
                         up.heads + (tag in HEADINGS), {})
        self._top.article = self._top if tag in CONTENT else up.article
        self._open[tag] = self._open.get(tag, 0) + 1
        self.nodes.append(self._top)

    def _read(self, page: str) -> None:
        at, raw = 0, None
        while True:
            if raw is not None:  # raw text ends at its own end tag only
                end = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(page, at)
                if end is None:
                    break
                at, raw = end.start(), None
            m = TOKEN.search(page, at)
            if m is None:
                self._add(page[at:])
                break
            if m.start() > at:
                self._add(page[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag, attributes = m[2].lower(), m[3]
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    raw = tag
            elif tag == "br":
                self._add(" ")
            elif tag == "hr":
                self._flush()
            elif tag not in VOID:
                self._start(tag, attributes)
        self._flush()


def settle(page: Page) -> None:
    """Decide which names count, then which blocks are furniture."""
    size: dict[Node, int] = {}  # text of each article outside the articles in it
    for b in page.blocks:
        if b.node.article is not None and not b.node.furniture:
            size[b.node.article] = size.get(b.node.article, 0) + len(b.text)
    above: dict[Node, Node | None] = {}  # nearest named element around
    for n in page.nodes:
        up = n.parent
        above[n] = None if up is None else up if up.named else above[up]

    def names(n: Node):
        while (n := above[n]) is not None:
            yield n

    inner: dict[Node, int] = {}  # longest article in a named element
    under: dict[Node | None, int] = {}  # longest article with that innermost named element around it
    for article, n in size.items():
        for e in names(article):
            inner[e] = max(inner.get(e, 0), n)
        under[above[article]] = max(under.get(above[article], 0), n)
    plain = [e for e, n in inner.items() if max(under.get(o, 0) for o in [None, *names(e)]) <= n]
    for e in plain:
        e.named = False
    # no sentence outside the names: the named element with the most text of weight is the page's text, down to one
    # that has a sentence of its own
    of_article = any(b.node.article is not None and not b.node.furniture for b in page.blocks)
    near: dict[Node, Node | None] = {}
    for n in page.nodes:
        near[n] = n if n.named else None if n.parent is None else near[n.parent]
    mass: dict[Node | None, int] = {}
    speaks: set[Node | None] = set()
    for b in page.blocks:
        if not b.node.furniture and (b.node.article is not None or not of_article):
            e = near[b.node]
            mass[e] = mass.get(e, 0) + (len(b.text) - b.links) * (len(b.text) + 10 * b.punctuation)
            if len(b.text) >= SENTENCE_CHARS and SENTENCE.search(b.text) and 2 * b.links < len(b.text):
                speaks.add(e)
    within: dict[Node | None, list[Node]] = {}
    for n in reversed(page.nodes):
        if n.named and mass.get(n):
            up = near[n.parent] if n.parent is not None else None
            within.setdefault(up, []).append(n)
            if up is not None:
                mass[up] = mass.get(up, 0) + mass[n]
    at = None
    while at not in speaks and within.get(at):
        at = max(reversed(within[at]), key=mass.get)
        at.named = False
    for n in page.nodes:
        n.dropped = n.furniture or n.named or (n.parent is not None and n.parent.dropped)


def content_root(page: Page) -> Node:
    """The element with the text of a page without an article, or the page itself."""
    mass: dict[Node, int] = {}
    own: dict[Node, list[Block]] = {}
    for b in page.blocks:
        if not b.node.dropped:
            mass[b.node] = mass.get(b.node, 0) + (len(b.text) - b.links) * (len(b.text) + 10 * b.punctuation)
            own.setdefault(b.node, []).append(b)
    count = {n: len(x) for n, x in own.items()}
    below: dict[Node, list[Node]] = {}
    for n in reversed(page.nodes):
        if n in count and n.parent is not None:
            mass[n.parent] = mass.get(n.parent, 0) + mass[n]
            count[n.parent] = count.get(n.parent, 0) + count[n]
            below.setdefault(n.parent, []).append(n)
    root = page.nodes[0]
    while True:
        children = below.get(root, [])[::-1]  # in page order
        best = max(children, key=mass.get, default=None)
        if best is None or mass[best] < (1 - SHARE) * mass[root]:
            return root
        if best.tag not in LAYOUT or count[best] < 2 or any(2 * b.links <= len(b.text) for b in own.get(root, ())):
            return root
        heads = texts = 0
        for c in children:
            if c is best:
                continue
            head = text = False
            todo = [c]
            while todo:
                n = todo.pop()
                todo += below.get(n, ())
                if any(2 * b.links <= len(b.text) for b in own.get(n, ())):
                    if n.lists > root.lists or c.tag in HEADINGS:
                        return root
                    head, text = head or n.heads > root.heads, text or n.heads == root.heads
            heads, texts = heads + head, texts + text
            if head and text:
                return root
        root = best


def content_text(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    page = Page(html)
    settle(page)
    whole = not any(b.node.article is not None and not b.node.dropped for b in page.blocks)
    root = content_root(page) if whole else None
    # paths: a number for each sequence of tags from the page down; elements inside the content root have their own
    paths: dict[tuple[int, str, bool], int] = {}
    parent, inside = [-1], [root is page.nodes[0]]
    page.nodes[0].inside = inside[0]
    for n in page.nodes[1:]:
        n.inside = n.parent.inside or n is root or (not whole and n.tag in CONTENT)
        key = (n.parent.path, n.tag + "!" * n.dropped, n.inside)
        n.path = paths.setdefault(key, len(parent))
        if n.path == len(parent):
            parent.append(n.parent.path)
            inside.append(n.inside)
    size, number, weight = [0] * len(parent), [0] * len(parent), [0.0] * len(parent)
    marked, linked = [0] * len(parent), [0] * len(parent)
    drop = [True] * len(parent)
    for b in page.blocks:
        p = b.node.path
        size[p] += len(b.text)
        number[p] += 1
        marked[p] += b.punctuation
        linked[p] += b.links
        drop[p] = b.node.dropped
    ratio = [n / k * (1 + 10 * m / n) * (1 - x / n) if n else 0.0
             for n, k, m, x in zip(size, number, marked, linked, strict=True)]
    # smooth over neighbours in page order, furniture apart, then average back per path
    smooth = [0.0] * len(parent)
    line = [0.0 if b.node.dropped else ratio[b.node.path] for b in page.blocks]
    for i, b in enumerate(page.blocks):
        before, own, after = (line[j] if 0 <= j < len(line) else line[i] for j in (i - 1, i, i + 1))
        smooth[b.node.path] += 0.25 * before + 0.5 * own + 0.25 * after
    # containers: the parent with its own children's text; inside the content root, every path up to the root, with all
    # text below. Children have larger numbers than their parents: one pass up, one down.
    tops = [inside[p] and (p == 0 or not inside[parent[p]]) for p in range(len(parent))]
    text, mass = [0] * len(parent), [0.0] * len(parent)
    deep_text, deep_mass = [0] * len(parent), [0.0] * len(parent)  # below a path inside the root
    for p in range(len(parent) - 1, -1, -1):
        if not drop[p]:
            weight[p] = size[p] * ratio[p]
        n = 0 if drop[p] else size[p]
        if p and inside[p] and not tops[p]:
            deep_text[parent[p]] += n + deep_text[p]
            deep_mass[parent[p]] += weight[p] + deep_mass[p]
        elif p:
            text[parent[p]] += n
            mass[parent[p]] += weight[p]
    best = [0.0] * len(parent)  # best container up to the root, the path itself included
    fused = [0.0] * len(parent)
    for p in range(len(parent)):
        if inside[p]:
            own = deep_mass[p] / deep_text[p] if deep_text[p] else 0.0
            best[p] = own if tops[p] else max(best[parent[p]], own)
        if drop[p] or not size[p]:
            continue
        if not p:
            container = max(best[0], ratio[0])
        elif inside[p] and not tops[p]:
            container = best[parent[p]]
        else:
            container = mass[parent[p]] / text[parent[p]]
        fused[p] = math.sqrt(max(smooth[p] / number[p], container) * container)
        if not whole and inside[p]:
            fused[p] *= CONTENT_WEIGHT
    bar = SHARE * max(fused)
    return "\n\n".join(b.text for b in page.blocks if not b.node.dropped and fused[b.node.path] > 0
                       and fused[b.node.path] >= bar)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Append ``text`` (empty if nothing is content) and ``n_chars`` (its code points); same-named columns go."""

    def start():
        def fn(batch):
            texts = [content_text(p) for p in batch.column(html).to_pylist()]
            return [texts, [len(t) for t in texts]]

        return fn

    return map_columns(pages, html, [("text", T.StringType()), ("n_chars", T.LongType())], start,
                       limit=4 << 20, keep=keep)
