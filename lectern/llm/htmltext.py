"""Main text of web pages by composite text density.

Every node of a page's tree gets a density: its characters per tag, lowered by the share of link text. The
subtree with the greatest sum of its children's densities is the article; the least density on its path up to
the body is the threshold for further parts beside it. Names, roles and element kinds that articles seldom have are a
prior: they lower the density of a subtree to a tenth. So an article wins inside a container with such a name, as
long as most of the page's text is there, while the same name makes a short advert lose. Only what holds no prose at all
(scripts, menus, fields and so on) is cut out before.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
DROPPED = frozenset("nav footer aside script style noscript template iframe svg canvas object embed audio video button select textarea input dialog menu head title frameset map".split())
FAINT = 0.1  # the prior of a subtree with a name, role or kind that articles seldom have
PROSE = 400  # characters from which on a subtree may be an article in spite of its name
COMMENTS = re.compile(r"\W*\d*\W*(comments?|responses?|replies|kommentare?|commentaires?|comentarios?)\b.{0,15}", re.IGNORECASE | re.DOTALL)
RIGHTS = re.compile(r"\s*(©|\(c\)\s*\d|copyright\b)", re.IGNORECASE)
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense advertising sponsor sponsored promo promotion banner banners cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond discussion menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside widget widgets "
    "share sharing social related recommended recommendations footer masthead toolbar pagination pager skip toc".split()
)
PLAIN_HINTS = frozenset("ad ads advert comment cookie notice".split())
HEADER = frozenset(("header", "topbar"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
WHOLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: an opening tag ends an open element of these kinds, unless one of the second kinds stands between
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",)), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",))}
STOP_P = frozenset("article aside blockquote body button div footer form header main nav section table td th li".split())
WORD = re.compile(r"[a-z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "parent", "parts", "drop", "prior", "sure", "kids", "weight", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, prior: float = 1.0, sure: bool = False):
        self.tag, self.parent, self.drop, self.prior, self.sure, self.parts, self.kids = tag, parent, drop, prior, sure, [], []


def _prior(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> tuple[float, bool]:
    """An element's prior by its kind, role and names, and whether they say nothing else. ``inside``: of an article."""
    if tag == "form":
        return FAINT, False
    if tag == "header" and not inside:
        return FAINT, True
    if tag in ("html", "body", "article", "main"):
        return 1.0, False
    prior, sure = 1.0, False
    for name, value in attrs:
        v = (value or "").lower()
        if name == "hidden" or name == "role" and v.strip() in ROLES or name == "aria-hidden" and v == "true":
            prior, sure = FAINT, True
        if name == "style" and "display:none" in v.replace(" ", ""):
            prior, sure = FAINT, True
        if name in ("class", "id") and v:
            listed = HINTS if tag not in HEADINGS and tag not in ("p", "b", "i", "em", "strong") else PLAIN_HINTS
            for own in v.split():
                words = set(WORD.findall(own))
                known = words & listed if inside else words & listed | words & HEADER
                if known:
                    prior, sure = FAINT, sure or known == words
    return prior, sure


class _Tree(HTMLParser):
    """A forgiving tree builder: ends that match nothing are ignored, open elements end where HTML says so."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", None)
        self.open: dict[str, int] = {}

    def _inside(self) -> bool:
        return bool(self.open.get("article") or self.open.get("main"))

    def _push(self, tag, drop, prior, sure):
        node = Node(tag, self.at, drop or self.at.drop, prior, sure)
        self.at.parts.append(node)
        self.at = node
        self.open[tag] = self.open.get(tag, 0) + 1

    def _pop_to(self, node):
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _end(self, kinds, stops):
        n = self.at
        while n is not self.root and n.tag not in stops:
            if n.tag in kinds:
                self._pop_to(n.parent)
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in VOID:
            if tag != "br":
                self.at.parts.append(Node(tag, self.at, True) if tag not in ("hr", "img", "wbr") else Node(tag, self.at))
            else:
                self.at.parts.append(" ")
            return
        if tag in ENDS_P and self.open.get("p"):
            self._end(("p",), STOP_P)
        if tag in ENDS:
            kinds, stops = ENDS[tag]
            for _ in kinds if tag in ("tr", "tbody") else (0,):
                if any(self.open.get(k) for k in kinds):
                    self._end(kinds, stops)
        if tag == "a" and self.open.get("a"):
            self._end(("a",), STOP_P)
        self._push(tag, tag in DROPPED, *_prior(tag, attrs, self._inside()))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self._pop_to(n.parent)

    def handle_data(self, data):
        self.at.parts.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    todo = [tree.root]
    while todo:
        n = todo.pop()
        n.kids = [x for x in n.parts if isinstance(x, Node) and not x.drop]
        todo += n.kids
    return tree.root


def _order(root: Node) -> list[Node]:
    """The kept nodes, parents before children; no recursion, as trees may be deep."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += reversed(n.kids)
    return out


def _told(nodes: list[Node]) -> None:
    """Lines that say by their words what they are: rights, and headings of comments with all that follows."""
    for n in nodes:
        begin = next((x for x in n.parts if isinstance(x, str) and x.strip()), "")
        if begin and RIGHTS.match(begin):
            n.prior, n.sure = FAINT, True
        if n.tag in HEADINGS and n.tag != "h1" and n.parent is not None and COMMENTS.fullmatch(" ".join(_blocks([n])).strip()):
            after = n.parent.kids[n.parent.kids.index(n) :]
            for x in after:
                x.prior, x.sure = FAINT, True


def _measure(nodes: list[Node]) -> None:
    """Each node's characters, tags and links, its density, and the sum of its children's weighted densities."""
    for n in reversed(nodes):
        own = sum(len(" ".join(x.split())) for x in n.parts if isinstance(x, str))
        n.chars = own + sum(x.chars for x in n.kids)
        n.tags = sum(x.tags + 1 for x in n.kids)
        n.link_chars = n.chars if n.tag == "a" else sum(x.link_chars for x in n.kids)
        n.link_tags = sum(x.link_tags + (x.tag == "a") for x in n.kids)
    body = nodes[0]
    share = body.link_chars / max(body.chars, 1)
    for n in nodes:
        n.weight = n.prior if n.parent is None else min(n.prior, n.parent.weight)
        n.density = _density(n.chars, n.tags, n.link_chars, n.link_tags, share)
    for n in nodes:
        n.total = sum(x.density * x.weight for x in n.kids)
        if n.tag not in INLINE and any(isinstance(x, str) and x.strip() for x in n.parts):
            n.total = max(n.total, n.density * n.weight)


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag times the logarithm of the same without links, to a base that grows with the links' share."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    ratio = math.log(max(chars / links * tags / link_tags, 1.0))
    return chars / tags * ratio / (math.log(base) if base > 1.0 + 1e-9 else 1.0)


def _path(node: Node | None) -> list[Node]:
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def _best(root: Node, nodes: list[Node]) -> Node | None:
    """The subtree with the greatest sum, the innermost of equal ones. None where names speak against it.

    Under a faint name it must hold half of the page's text, few links, and be prose, in an article or have a name that
    may mean something else.
    """
    best = nodes[0]
    for n in nodes:
        if n.total >= best.total:
            best = n
    if best.weight < 1:
        path = _path(best)
        doubtful = not any(n.sure for n in path) or any(n.tag in WHOLE for n in path) or best.chars >= PROSE
        if not doubtful or 2 * best.chars < root.chars or 3 * best.link_chars > best.chars:
            return None
    return best


def _chosen(root: Node) -> list[Node]:
    nodes = _order(root)
    _told(nodes)
    _measure(nodes)
    best = _best(root, nodes)
    kept = {id(n) for n in _path(best)}
    for n in nodes:  # what has a faint name stays only if the densest subtree is in it
        n.kids = [x for x in n.kids if x.prior == 1 or id(x) in kept]
    nodes = _order(root)
    for n in nodes:
        n.prior = 1.0
    _measure(nodes)
    best = best or _best(root, nodes)
    best = next((n for n in _path(best) if n.tag in WHOLE), best)  # an article is taken whole
    threshold = min(n.density for n in _path(best))
    if best.tag in WHOLE:
        return [x for x in nodes if x is best or x.tag == best.tag and x.density >= threshold and not _under(x, best)]
    marked: set[int] = {id(best)}
    greatest: dict[int, Node] = {}
    for n in reversed(nodes):  # of each subtree, the node with the greatest sum
        own = n
        for x in n.kids:
            if greatest[id(x)].total > own.total:
                own = greatest[id(x)]
        greatest[id(n)] = own
    todo = [root]
    while todo:
        n = todo.pop()
        if n.density >= threshold:
            if greatest[id(n)].total > 0:
                marked.add(id(greatest[id(n)]))
            todo += n.kids
    return [x for x in nodes if id(x) in marked]


def _under(node: Node, above: Node) -> bool:
    while node is not None:
        if node is above:
            return True
        node = node.parent
    return False


def _blocks(nodes: list[Node]) -> list[str]:
    """The text of the nodes' blocks in page order; a node inside another one counts once."""
    out: list[str] = []
    line: list[str] = []
    done: set[int] = set()

    def flush():
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    for top in nodes:
        if id(top) in done:
            continue
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            else:
                done.add(id(x))
                if x.tag not in INLINE:
                    flush()
                    todo.append(None)
                inner = set(map(id, x.kids))
                todo += [y for y in reversed(x.parts) if isinstance(y, str) or id(y) in inner]
        flush()
    return out


def main_text(html: str | None) -> str:
    """The article of a page, blocks joined by line feeds. Null, empty or textless pages give an empty text."""
    if not html or not html.strip():
        return ""
    return "\n".join(_blocks(_chosen(parse(html))))


def extract(pages: DataFrame, keep: tuple = ("page_id", "url")) -> DataFrame:
    """Adds text and n_chars to the columns ``keep`` of ``pages`` (html). One pass without a shuffle.

    Null, empty and textless pages give an empty text; repeated rows are read alike. Columns in ``keep`` called text or
    n_chars are refused.
    """
    common.fresh(list(keep), ["text", "n_chars"])
    n = len(keep)
    source = pages.select(*keep, F.col("html").alias("_page"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                texts = [main_text(x).encode("utf-8", "replace").decode() for x in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return source.mapInArrow(common.lean(run), f"{schema}, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(common.table(spark, sf_dir, "pages"))
