"""Operator 7: main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCK = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address header footer nav aside form fieldset legend details summary hr center hgroup dialog option".split())
#: Elements that never hold the article, and words of class or id that say so too.
DROP = frozenset("nav footer aside form script style textarea noscript iframe button select template svg math head title menu dialog object canvas audio video xmp noembed noframes".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies disqus cookie cookies consent notice notices notification gdpr popup modal overlay share sharing social related recommended newsletter subscribe signup login search pagination pager widget toolbar copyright legal disclaimer skip".split())
#: Words of layout, which name a part of the article together with a word for content ("article-header")
#: and inside <article> or <main>.
LAYOUT = frozenset("banner copyright disclaimer footer header legal masthead notice notices notification notifications promotion side".split())
CONTENT = frozenset("article chapter content entry post section story title".split())
#: Words that are often a subject ("market-share"): inside, they count where the name is one of a bar, list or form.
SUBJECT = frozenset("related recommended replies reply search share sharing skip social widget".split())
BAR = re.compile(rf"(?:(?:{'|'.join(sorted(CONTENT))})[-_])?(?:(?:{'|'.join(sorted(SUBJECT))}|bars?|box|buttons?|form|icons?|items|links?|lists?|news|articles|posts|stories|tools)[-_]?)+", re.I)
#: An element that opens one of the first closes an open one of the second, up to the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: First parts of names that tell how a container is laid out ("with-sidebar"), not what it is.
STATES = frozenset("with has no without show hide".split())
#: What may follow "<", up to the name of a tag; and a tag's rest, quoted values whole. The quantifiers
#: are possessive, so that a scan never steps back.
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>")
_ATTR = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z]+")


class Node:
    __slots__ = ("tag", "parent", "items", "drop", "named", "inside", "chars", "link_chars", "tags", "links", "density", "total")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, named: bool = False):
        self.tag, self.parent, self.items, self.drop, self.named = tag, parent, [], drop or named, named
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.chars = self.link_chars = self.tags = self.links = 0
        self.density = self.total = 0.0


def _named_off(tag: str, attrs: str, inside: bool) -> bool:
    """By the attribute hidden, or the names in class, id and role; attributes are taken as pairs of
    name and value, so that no value is read as a name."""
    if attrs and tag not in ("html", "body", "main"):
        for m in _ATTR.finditer(attrs):
            name = m[1].lower()
            if name == "hidden":
                return True
            if name in ("class", "id", "role"):
                if any(_names_boilerplate(x, inside) for x in (m[2] or m[3] or m[4] or "").split()):
                    return True
    return False


def _names_boilerplate(name: str, inside: bool) -> bool:
    parts = _SPLIT.split(name.lower())
    words = set(parts)
    hit = words & WORDS
    if not hit or parts[0] in STATES:
        return False
    if inside:
        hit -= LAYOUT
        return bool(hit - SUBJECT) or bool(hit) and bool(BAR.fullmatch(name))
    return not (hit <= LAYOUT and words & CONTENT)


def parse(page: str) -> Node:
    """A tree of elements and text pieces, in time linear in the page. Comments are left out, raw text
    elements are leaves; a missing end tag of p, li, dt, dd, tr, td, th or option is implied, a stray
    end tag ignored, and open elements end with the page. Once quotes have swallowed all that is left,
    later tags end at their first ">"; a tag without any is text."""
    root = node = Node("", None)
    at, size, last, quotes = 0, len(page), page.rfind(">"), True
    open_: dict[str, int] = {}

    def leave(to: Node) -> None:
        nonlocal node
        while node is not to:
            open_[node.tag] -= 1
            node = node.parent

    while at < size:
        m = _OPEN.search(page, at)
        if not m:
            node.items.append(page[at:])
            break
        if m.start() > at:
            node.items.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            mark = "-->" if m[0] == "<!--" else ">"
            end = page.find(mark, at)
            at = size if end < 0 else end + len(mark)
            continue
        rest = _REST.match(page, at) if quotes else None
        quotes = quotes and rest is not None
        end = rest.end() if rest else page.find(">", at) + 1 if at <= last else 0
        if not end:
            node.items.append(page[m.start() :])
            break
        attrs, at = page[at : end - 1], end
        tag = m[2].lower()
        if m[1]:
            if open_.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up.parent)
            elif tag == "br":
                node.items.append(" ")
            continue
        if tag in VOID:
            if tag == "br":
                node.items.append(" ")
            elif tag == "hr":
                node.items.append(Node("hr", node))
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if tag in BLOCK and open_.get("p"):  # a block ends an open paragraph
            up = node
            while up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p":
                leave(up.parent)
        if tag in CLOSES:
            same, stop = CLOSES[tag]
            if any(open_.get(t) for t in same):
                up = node
                while up.parent and up.tag not in same and up.tag not in stop:
                    up = up.parent
                if up.tag in same:
                    leave(up.parent)
        child = Node(tag, node, tag in DROP)
        child.drop = child.drop or tag == "header" and not child.inside
        if not child.drop and _named_off(tag, attrs, child.inside):
            child.drop = child.named = True
        node.items.append(child)
        if not attrs.endswith("/") or tag in BLOCK:
            node = child
            open_[tag] = open_.get(tag, 0) + 1
    return root


def restore(root: Node) -> None:
    """Takes back what names dropped where they must be wrong: an element that holds most of the page's
    text (but for what goes by its tag) and a heading, article or main that isn't dropped itself."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in n.items if isinstance(c, Node) and (c.named or not c.drop)]
    chars: dict[Node, int] = {}
    heads: set[Node] = set()
    for n in reversed(order):
        chars[n] = sum(chars.get(c, 0) if isinstance(c, Node) else len(c) - c.count(" ") for c in n.items)
        if n.tag in ("h1", "article", "main") and not n.drop or any(isinstance(c, Node) and c in heads and (not c.named or c.tag not in ("article", "main")) for c in n.items):
            heads.add(n)
    for n in order:
        if n.named and n in heads and 2 * chars[n] > chars[root]:
            n.drop = n.named = False


def _order(root: Node) -> list[Node]:
    """All kept nodes, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.items) if isinstance(c, Node) and not c.drop]
    return out


def measure(root: Node) -> list[Node]:
    """Characters, tags, and the densities of all kept nodes.

    density = chars / tags * log_b(chars / link chars * tags / link tags), where b grows with the
    share of linked characters here and in the page; total is the sum over the children.
    """
    nodes = _order(root)
    for n in reversed(nodes):
        for c in n.items:
            if isinstance(c, Node):
                if not c.drop:
                    n.chars += c.chars
                    n.link_chars += c.link_chars
                    n.tags += c.tags + 1
                    n.links += c.links + (c.tag == "a")
            else:
                n.chars += len("".join(c.split()))
        if n.tag == "a":
            n.link_chars = n.chars
    share = root.link_chars / max(1, root.chars)
    for n in nodes:
        if n.chars:
            base = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + share * n.chars + math.e)
            worth = n.chars / max(1, n.link_chars) * max(1, n.tags) / max(1, n.links)
            n.density = n.chars / max(1, n.tags) * math.log(max(1.0, worth)) / math.log(max(base, 1.0) + 1e-9 + (base <= 1))
        if n.parent:
            n.parent.total += n.density
    return nodes


def _blocks(nodes: list[Node], out: list[str]) -> None:
    """The text of some subtrees: white space runs as one space, blocks in order."""
    part: list[str] = []

    def close() -> None:
        if part:
            t = " ".join(html.unescape("".join(part)).split())
            if t:
                out.append(t)
            part.clear()

    for top in nodes:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                part.append(x)
            elif not x.drop:
                block = x.tag in BLOCK
                if block:
                    close()
                    todo.append(None)
                todo += reversed(x.items)
        close()


def extract(page: str | None) -> str:
    """The main text: blocks of the article, one a line; empty for a null, empty or textless page.

    Menus, page headers, footers, asides, forms, adverts, notices and comments go by element and
    by the words of class and id, but for an element with the page's heading and most of its text. Of
    what stays, the node with the largest sum of child densities wins. All of its container stays: its
    outermost <article> or <main>, or without those the outermost element around it, below the body
    (the body, if the node stands in it alone); but for blocks of several links that hold most of the
    characters. Outside it, subtrees whose density reaches the least on the node's path to the body stay:
    where the page marks articles, only further ones; else at any depth, with the first headings (h1)
    and loose text in the body.
    """
    if not page:
        return ""
    root = parse(page)
    restore(root)
    nodes = measure(root)
    if not root.chars:
        return ""
    best = max(nodes, key=lambda n: n.total)
    if not best.total:
        best = root
    path, up, marked = [], best, None
    while up and up.tag not in ("body", "html", ""):
        path.append(up)
        if up.tag in ("article", "main"):
            marked = up
        up = up.parent
    limit = min((n.density for n in path), default=0.0)
    top = marked or (path[-1] if len(path) > 1 else None)  # None: all of the body, with the node's neighbours
    out: list[str] = []
    on = set(path)
    if marked:  # the container and others like it, in page order
        others = [n for n in nodes if n.tag == marked.tag and n not in on and not n.inside and n.density >= limit]
        tops = {marked, *others}
    else:
        tops = {top}
    todo: list[tuple[Node, bool]] = [(root, top is None)]
    while todo:
        n, within = todo.pop()
        within = within or n in tops
        if not within and (marked or n.tag not in ("", "html", "body")):
            n.items = [c for c in n.items if isinstance(c, Node)]  # loose text of what does not reach the limit
        for c in n.items:
            if not isinstance(c, Node) or c.drop or c is best and within:
                continue
            if within and c not in on and c.tag in BLOCK and c.tag not in ("html", "body") and c.links > 1 and 2 * c.link_chars > c.chars:
                c.drop = True
            elif within or marked or c is top or c.tag in ("html", "body") or not (c.tag == "h1" or c.density >= limit):
                todo.append((c, within))
    _blocks([root], out)
    return "\n".join(out)


def texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Repeated rows come out each, an empty table gives an empty one, other columns are not read,
    whatever their names.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            t = [extract(x) for x in p["html"]]
            yield pd.DataFrame({"page_id": p["page_id"], "url": p["url"], "text": t, "n_chars": [len(x) for x in t]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "pages"))
