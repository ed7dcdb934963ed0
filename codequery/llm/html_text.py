"""Main text of web pages by composite text density.

A page is read into a tree. Elements that can't be part of an article (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments, hidden ones) are cut off by tag or role, and by class or id where a
whole token of it consists of structural words; words that an article's own section may be called by count only on
elements that hold the lesser part of the page's text. Every node gets the link-adjusted density
``C / T * log_b(C / LC * T / LT)`` with ``b = ln(C / (C - LC) * LC + LCb / Cb * C + e)``: characters C, tags T,
characters LC and tags LT in links, Cb and LCb those of the body; a zero divisor counts as one. A node's density sum is
that of its children, and the subtree with the largest sum is the core of the text. The threshold is the least density
on the path from the core to the body, the body itself not counted.

Where the page marks articles, the core decides between them: the marked article around it or inside it, or, if the
core is apart from all of them, the marked one with the largest sum unless the core's is five times that. Without marks
the text is the core, with those branches beside its path that reach the threshold and are not mostly links, and with
the headings before it. In either case blocks of several links and little else below the threshold are left out.

Edge cases: null or empty html gives an empty text; unclosed tags, comments and scripts end where a browser would end
them, or with the page; html without tags is all text; if all text is cut, names are not looked at; pages of any length
and depth of nesting are read whole in time that grows with their length; repeated rows are each read; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as _html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is not markup.
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others part blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
#: Elements without a place in the text: what is on either side of them stays one.
UNSEEN = frozenset("script style noscript template".split())
#: Start tags that close an open element of the first set, as far as one of the second does not hold it.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
_CLOSE_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)
_P_HOLDERS = frozenset("html body article section main div td th li blockquote button object".split())
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
#: Elements that no article holds.
CUT_TAGS = frozenset(
    "head nav footer aside form button select textarea input script style noscript template iframe svg canvas object audio "
    "video dialog menu title".split()
)
CUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
#: Words of class names and ids that mark what is cut, whatever its length.
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies gdpr popup overlay sidebar "
    "comment comments disqus reply replies respond nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager "
    "footer masthead topbar newsletter subscribe signup login skip toolbar".split()
)
#: Words that an article's section may be called by: they cut only where the lesser part of the page's text is inside.
WEAK_WORDS = frozenset(
    "banner consent notice notices promotion modal widget widgets related recommended share sharing social discussion header "
    "subscription toc tags".split()
)
#: Words that go with them in a name.
PLAIN_WORDS = frozenset(
    "site page main global top bottom left right inner outer box block list item wrapper wrap container section area slot "
    "unit bar panel content links link buttons button form thread primary secondary js small large fixed sticky the and my "
    "legal policy posts post stories articles".split()
)
#: The largest share of the page's text inside an element that a weak word cuts.
LESSER = 1 / 3
#: How much larger than a marked article's the core's sum must be to outweigh the mark.
OUTWEIGHS = 5
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("all_chars", "attrs", "chars", "children", "cut", "density", "inside", "link", "link_chars", "link_tags", "parent", "parts", "sum", "tag", "tags")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.parts: list[str | Node] = []
        self.cut = False
        self.link = tag == "a" or bool(parent and parent.link)
        #: Whether an article or main is around it.
        self.inside = bool(parent and (parent.inside or parent.tag in ("article", "main")))
        self.chars = self.tags = self.link_chars = self.link_tags = self.all_chars = 0
        self.density = self.sum = 0.0


class _Open:
    """The open elements, and where in the stack those of a tag are."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.at: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        for key in self.keys(node.tag):
            self.at.setdefault(key, []).append(len(self.stack))
        self.stack.append(node)

    def keys(self, tag: str) -> tuple[str, ...]:
        return (tag, *(["#block"] if tag not in INLINE else []), *(["#holder"] if tag in _P_HOLDERS else []))

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of the tags; 0 for none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def first_after(self, tags: set[str], place: int) -> int:
        """The place of the outermost open element of the tags inside that at ``place``; 0 for none."""
        found = [p[k] for t in tags if (p := self.at.get(t)) and (k := bisect_right(p, place)) < len(p)]
        return min(found, default=0)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            for key in self.keys(self.stack.pop().tag):
                self.at[key].pop()


def parse(page: str) -> tuple[Node, list[Node]]:
    """(root, every node, parents first) of a page."""
    root = Node("#root", {}, None)
    opened, nodes, at = _Open(root), [root], 0
    stack = opened.stack

    def text(raw: str) -> None:
        if raw:
            stack[-1].parts.append(_html.unescape(raw) if "&" in raw else raw)

    while at < len(page):
        m = _MARKUP.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            place = opened.last(tag)
            if place and (tag not in INLINE or place > opened.last("#block")):
                opened.close(place)
            continue
        if tag in _CLOSE_P and (place := opened.last("p")) > opened.last("#holder"):
            opened.close(place)
        if tag in _CLOSES:
            ends, holds = _CLOSES[tag]
            if place := opened.first_after(ends, opened.last(*holds)):
                opened.close(place)
        if tag == "body" and stack[-1].tag == "head":
            opened.close(len(stack) - 1)
        raw = m["attrs"]
        attrs = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(raw)} if raw.strip(" /\n\t") else {}
        node = Node(tag, attrs, stack[-1])
        stack[-1].children.append(node)
        stack[-1].parts.append(node)
        nodes.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif tag not in VOID and not (raw.endswith("/") and tag in ("svg", "path")):
            opened.push(node)  # a slash closes nothing but void elements
    return root, nodes


def _hidden(node: Node) -> bool:
    a = node.attrs
    if a.get("role", "").lower() in CUT_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I))


def _named(node: Node) -> int:
    """2 if class or id names something that is cut, 1 if it may: a whole token of nothing but structural words."""
    found = 0
    for token in (t for name in ("class", "id") for t in node.attrs.get(name, "").split()):
        words = [w.lower() for w in _WORDS.findall(token) if not w.isdigit()]
        if all(w in CUT_WORDS or w in WEAK_WORDS or w in PLAIN_WORDS for w in words):
            found = max([found, *(2 * (w in CUT_WORDS) or (w in WEAK_WORDS) for w in words)])
    return found


def _mark(node: Node) -> int:
    """3 for an article, 2 for the body of one, 1 for the main part of a page."""
    role = node.attrs.get("role", "").lower()
    if node.tag == "article" or role == "article":
        return 3
    return 2 if node.attrs.get("itemprop", "").lower() == "articlebody" else int(node.tag == "main" or role == "main")


def _prune(nodes: list[Node], by_name: bool = True) -> None:
    """Marks what is cut. Needs ``all_chars``."""
    holds: set[int] = set()
    for n in reversed(nodes):
        if n.parent and (_mark(n) or id(n) in holds or n.tag in ("html", "body")):
            holds.add(id(n.parent))
    most = LESSER * nodes[0].all_chars
    for n in nodes:
        if n.parent is None or n.tag in ("html", "body") or id(n) in holds:
            n.cut = bool(n.parent and n.parent.cut)
            continue
        name = _named(n) if by_name and n.attrs else 0
        named = name == 2 or (name == 1 and n.all_chars <= most)
        header = n.tag == "header" and not (n.inside and any(c.tag in HEADINGS for c in n.children))
        if _mark(n):
            named &= n.tag == "article" and n.inside  # reader comments are articles at times
        n.cut = n.parent.cut or n.tag in CUT_TAGS or header or named or (bool(n.attrs) and not _mark(n) and _hidden(n))


def _length(node: Node) -> int:
    return sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))


def _count_all(nodes: list[Node]) -> None:
    for n in reversed(nodes):
        n.all_chars += _length(n)
        if n.parent and n.tag not in UNSEEN:
            n.parent.all_chars += n.all_chars


def _measure(nodes: list[Node]) -> None:
    for n in nodes:
        n.chars = 0 if n.cut else _length(n)
        n.link_chars = n.chars if n.link else 0
        n.tags = n.link_tags = 0
    for n in reversed(nodes):
        if n.parent and not n.cut:
            p = n.parent
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags + (n.tag == "a")


def density(c: int, t: int, lc: int, lt: int, rate: float) -> float:
    """The density of a node by its characters and tags, those in links, and the body's share of characters in links."""
    if not c:
        return 0.0
    value = c / max(lc, 1) * max(t, 1) / max(lt, 1)
    base = math.log(c / max(c - lc, 1) * lc + rate * c + math.e)
    # A base of one, where the page has no links, is as good as none.
    return c / max(t, 1) * math.log(value) / (math.log(base) if base > 1 + 1e-9 else 1.0)


def _weigh(nodes: list[Node], body: Node) -> None:
    rate = body.link_chars / max(body.chars, 1)
    for n in nodes:
        n.density = 0.0 if n.cut else density(n.chars, n.tags, n.link_chars, n.link_tags, rate)
        n.sum = 0.0
    for n in nodes:
        if n.parent and not n.cut:
            n.parent.sum += n.density


def _path(node: Node, top: Node) -> list[Node]:
    """The node and what is around it, up to but without ``top``."""
    out = []
    while node and node is not top:
        out.append(node)
        node = node.parent
    return out


def _outermost(nodes: list[Node], kind: int) -> list[Node]:
    found: list[Node] = []
    around: set[int] = set()
    for n in nodes:
        if n.parent and id(n.parent) in around:
            around.add(id(n))
        elif not n.cut and n.chars and _mark(n) == kind:
            found.append(n)
            around.add(id(n))
    return found


def _pick(nodes: list[Node], body: Node) -> Node:
    """The node whose uncut text is the page's; cuts off what is beside it."""
    places = {id(n): i for i, n in enumerate(nodes)}
    first = places[id(body)]
    ends = [0] * len(nodes)  # the place after a node's last one
    for i in range(len(nodes) - 1, -1, -1):
        ends[i] = max(ends[i], i + 1)
        if nodes[i].parent:
            p = places[id(nodes[i].parent)]
            ends[p] = max(ends[p], ends[i])
    inner = [n for n in nodes[first : ends[first]] if not n.cut and n.chars]
    if not inner:
        return body
    core = max(inner, key=lambda n: (n.sum, n.chars))
    path = _path(core, body)
    least = min((n.density for n in path), default=core.density)

    def is_in(n: Node, m: Node) -> bool:
        return places[id(m)] <= places[id(n)] < ends[places[id(m)]]

    for kind in (3, 2, 1):
        marked = _outermost(inner, kind)
        if not marked:
            continue
        sums = {id(m): max(n.sum for n in nodes[places[id(m)] : ends[places[id(m)]]] if not n.cut) for m in marked}
        best = next((m for m in marked if is_in(core, m)), None) or max(marked, key=lambda m: (sums[id(m)], m.chars))
        if is_in(core, best) or is_in(best, core) or core.sum <= OUTWEIGHS * sums[id(best)]:
            _cut_links(nodes[places[id(best)] + 1 : ends[places[id(best)]]], min(least, best.density))
            return best
    on_path = {id(n) for n in path}
    top, node = core, core
    while node is not body and node.parent:
        around = node.parent
        for c in around.children:
            if id(c) in on_path or c.cut:
                continue
            heading = c.tag in HEADINGS and places[id(c)] < places[id(core)]
            if heading or (c.density >= least > 0 and 2 * c.link_chars <= c.chars):
                top = around
            else:
                c.cut = True
        around.parts = [p for p in around.parts if not isinstance(p, str)]
        node = around
    _cut_links(nodes[places[id(core)] + 1 : ends[places[id(core)]]], least)
    return top


def _cut_links(nodes: list[Node], least: float) -> None:
    """Cuts blocks of several links and little else whose density is below ``least``."""
    for n in nodes:
        if n.parent.cut:
            n.cut = True
        elif n.tag not in INLINE and n.link_tags >= 3 and 4 * n.link_chars >= 3 * n.chars and n.density < least:
            n.cut = True


def _written(node: Node) -> str:
    out: list[str] = []
    todo: list[str | Node] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.cut:
            part = x.tag not in INLINE
            if part:
                out.append(" ")
                todo.append(" ")
            todo += reversed(x.parts)
        elif x.tag not in INLINE and x.tag not in UNSEEN:
            out.append(" ")
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page:
        return ""
    root, nodes = parse(page)
    body = next((n for n in nodes if n.tag == "body"), root)
    _count_all(nodes)
    for by_name in (True, False):
        _prune(nodes, by_name)
        _measure(nodes)
        if body.chars:
            break
    _weigh(nodes, body)
    return _written(_pick(nodes, body))


def extracted(df: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    schema = df.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return df.select("page_id", "url", "html").mapInArrow(run, schema)
