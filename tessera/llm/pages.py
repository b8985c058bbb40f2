"""Main text of web pages by composite text density.

Every node of the page's tree has characters C, tags T, characters LC and tags LT within links. Its
composite density is C/T, weighed by a logarithm that falls as links take more of the text. The
subtree whose children's densities have the largest sum is the heart of the page; the lowest
density on the path from it to the body is the threshold, and every other node that reaches it gives
the subtree of largest sum within it as well. The logarithm's base has one added to it, as it would
otherwise be 1 on a page without links.

Elements that never hold article text (menus, forms, scripts, ...) go before anything is counted.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video nav footer aside form button select option textarea label fieldset dialog menu".split()
)
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table caption thead tbody tfoot tr td th ul".split()
)
#: Elements that the start of one of the others closes, and where the search for them ends.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_IN_HEAD = frozenset("head title meta link base script style noscript template".split())
_P_SCOPE = frozenset("button td th caption table".split())
#: Parts of class and id names of what stands beside an article.
_BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|menu|nav|navbar|navigation|breadcrumbs?|sidebar|widgets?|footer|masthead|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|respond|replies|pagination|pager|copyright|toolbar)(?=$|[\s_-])",
    re.IGNORECASE,
)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|top-?bar)(?=$|[\s_-])", re.IGNORECASE)
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_ARTICLE = frozenset(("article", "main"))


class _Node:
    __slots__ = ("tag", "parent", "children", "beside", "holds", "within", "chars", "tags", "link_chars", "link_tags", "density", "total", "best")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.beside = tag, parent, False
        self.children: list[_Node | str] = []
        self.holds = tag in _ARTICLE
        self.within = parent is not None and (parent.within or parent.holds and parent.tag in _ARTICLE)

    def inner(self) -> list[_Node]:
        return [c for c in self.children if not isinstance(c, str)]


class _Tree(HTMLParser):
    """The page as nodes; broken markup is closed where browsers would close it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("html", None)
        self.open: Counter[str] = Counter()

    def _close(self, names, stop) -> None:
        if not any(self.open[n] for n in names):
            return
        node = self.at
        while node.parent is not None and node.tag not in names and node.tag not in stop:
            node = node.parent
        if node.tag in names and node.parent is not None:
            while self.at is not node.parent:
                self.open[self.at.tag] -= 1
                self.at = self.at.parent

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "html" or tag == "body" and self.open["body"]:
            return
        if tag not in _IN_HEAD:
            self._close(("head",), ())
        if tag in _BLOCK:
            self._close(("p",), _P_SCOPE)
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        node = _Node(tag, self.at)
        node.beside = _beside(tag, attrs, node.within)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node
            self.open[tag] += 1
        if node.holds:
            up = node.parent
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes void elements only

    def handle_endtag(self, tag: str) -> None:
        if tag not in ("html", "body"):  # what follows still belongs to the page
            self._close((tag,), () if tag in _BLOCK or tag in _DROPPED else _BLOCK)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _beside(tag: str, attrs, within: bool) -> bool:
    """Whether the element stands beside article text, judged by its tag and attributes."""
    if tag in _DROPPED:
        return True
    if tag in ("html", "body", "main"):
        return False
    if tag == "article" and not within:
        return False
    own = dict(attrs)
    if "hidden" in own or own.get("aria-hidden") == "true" or (own.get("role") or "").lower() in _ROLES or _HIDDEN.search(own.get("style") or ""):
        return True
    names = f"{own.get('class') or ''} {own.get('id') or ''}"
    if _BESIDE.search(names):
        return True
    # an article's own header has its title
    return not within and (tag == "header" or bool(_HEADER.search(names)))


def _measured(root: _Node) -> list[_Node]:
    """The nodes left, parents first, with characters, tags and those within links counted."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        # a name, or a form, does not take away what an article element lies in
        node.children = [c for c in node.children if isinstance(c, str) or not c.beside or c.holds and (c.tag == "form" or c.tag not in _DROPPED | {"article"})]
        order.append(node)
        stack.extend(reversed(node.inner()))
    for node in reversed(order):
        inner = node.inner()
        node.chars = sum(len(" ".join(c.split())) if isinstance(c, str) else c.chars for c in node.children)
        node.tags = sum(1 + c.tags for c in inner)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
        else:
            node.link_chars = sum(c.link_chars for c in inner)
            node.link_tags = sum(c.link_tags + (c.tag == "a") for c in inner)
    return order


def _weigh(order: list[_Node], body: _Node) -> None:
    """Composite densities, the sums of the children's, and where in each subtree the largest sum is; a count of zero in a divisor is one."""
    page = max(body.link_chars, 1) / max(body.chars, 1)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        node.density = 0.0
        if c:
            base = c / max(c - node.link_chars, 1) * lc + page * c + math.e
            node.density = c / t * max(math.log(c / lc * t / lt), 0.0) / math.log(math.log(base) + 1)
        inner = node.inner()
        node.total = sum(child.density for child in inner) if inner else node.density
        node.best = node  # of equal sums the outermost, then the first
        for child in inner:
            if child.best.total > node.best.total:
                node.best = child.best


def _content(body: _Node) -> list[_Node]:
    """The chosen subtrees in page order; article elements around them are taken whole."""
    heart = body.best
    lowest, node = heart.density, heart
    while node is not body:
        node = node.parent
        lowest = min(lowest, node.density)
    hearts: set[int] = set()
    path: set[int] = set()

    def mark(top: _Node) -> None:
        at = top.best
        hearts.add(id(at))
        while at is not top:
            at = at.parent
            path.add(id(at))

    mark(body)
    chosen, stack = [], [body]
    while stack:
        node = stack.pop()
        if node.chars and node.density >= lowest and id(node) not in path:
            mark(node)
        if id(node) not in hearts:
            stack.extend(reversed(node.inner()))
            continue
        up, whole = node, node
        while up is not None:
            whole = up if up.tag == "article" else whole
            up = up.parent
        if not chosen or chosen[-1] is not whole:
            chosen.append(whole)
    return chosen


def main_text(html: str | None) -> str:
    """The main text of one page: blocks in page order, one line each; empty for a page without."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    order = _measured(tree.root)
    body = next((n for n in order if n.tag == "body"), tree.root)
    if not body.chars:
        body = tree.root
    _weigh(order, body)
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    for top in _content(body):
        stack: list = [top]
        while stack:
            at = stack.pop()
            if at is None:
                end()
            elif isinstance(at, str):
                line.append(at)
            elif at.tag == "br":
                line.append(" ")
            else:
                if at.tag in _BLOCK:
                    end()
                    stack.append(None)
                stack.extend(reversed(at.children))
        end()
    return "\n".join(blocks)


def extract(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """pages with a string column `name`: the main text of the whole html.

    Blocks (paragraphs, headings, list items, cells, ...) are lines; character references are
    decoded, white space within a block (line breaks too) is one space, ends are trimmed. Null,
    empty and textless pages give the empty string. Every row stays, repeated ones too, and all
    columns but one that already has the name, which is replaced.
    """

    @F.arrow_udf("string")
    def texts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([main_text(h.as_py()) for h in part], type=pa.string())
        give_back()

    return pages.withColumn(name, texts(F.col(html).cast("string")))
