"""The main text of web pages by composite text density (Sun, Song and Liao: "DOM based content extraction via text density").

Every node of a page's tree has its characters and tags, and those inside links. Its composite density is characters
a tag, adjusted by links; a node's sum is that of its children's densities. The node of the greatest sum holds the
article; the least density on the path from body to it is the threshold above which other subtrees are content too.
Marks inside a line (b, span and the like) are no tags of their own, and the text that lies in a block outside its inner
blocks counts as a child of one tag: otherwise one paragraph in bold would outweigh its article. If the node lies in an
article element, that element is the content.

Menus, notices, adverts, forms and comments are taken out of the tree first where their element, role, class or id says
so: a thread of comments is as dense as an article. A subtree whose characters are mostly links is a menu as well.
"""

from __future__ import annotations

import math
import re
from collections.abc import Collection, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: names of HTML elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas audio video map datalist".split())
FORMS = frozenset("form button select textarea input option label fieldset dialog".split())
ASIDE = frozenset("nav aside footer menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th label button input select textarea".split())
CELLS = frozenset({"td", "th"})
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
# words of a class or an id that say what an element is for
PURPOSE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner sidebar sidenav nav navbar navigation subnav menu submenu topbar breadcrumb breadcrumbs masthead footer"
    " cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay disclaimer newsletter subscribe subscription signup login share sharing sharebar social related recommended recommendations"
    " comment comments commentlist disqus replies reply respond discussion widget widgets toolbar pagination pager skip skiplink search searchbox form".split()
)
ARTICLE = frozenset({"article", "main"})
P, HOLDS_P, NOTHING = {"p"}, frozenset("td th li div article section button table blockquote aside main".split()), {}
# a comment, a declaration, a tag with its attributes (a ">" in quotes doesn't end it), and a tag whose quotes don't close
MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NAMING = re.compile(r"class|id|role|hidden|style", re.I)
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
LINKS = 0.6  # share of a subtree's characters that lie in links from which on it is a menu,
PROSE = 40  # unless a block in it has so many characters outside links, or it holds an article


class Node:
    """An element; parts holds texts and child elements in page order."""

    __slots__ = ("tag", "attrs", "parent", "parts", "place", "own", "chars", "tags", "link_chars", "link_tags", "plain", "density", "total")

    def __init__(self, tag: str, attrs: dict, parent: Node | None, place: int):
        self.tag, self.attrs, self.parent, self.parts, self.place, self.own = tag, attrs, parent, [], place, 0


class Tree:
    """The tree of a page, with the end tags that HTML lets authors leave out; nodes lists it in page order."""

    def __init__(self, html: str):
        self.root = self.at = Node("body", {}, None, 0)
        self.nodes, self.open = [self.root], {}
        at, size = 0, len(html)
        while at < size:
            m = MARKUP.search(html, at)
            stop = m.start() if m else size
            if stop > at:
                text = html[at:stop]
                self.text(unescape(text) if "&" in text else text)
            if not m:
                break
            at, name = m.end(), m[2] or m[5]
            if not name:
                continue  # a comment or a declaration
            tag = name.lower()
            if m[1] or m[4]:
                self.end(tag)
                continue
            self.start(tag, m[3] or m[6] or "")
            if tag in RAW:  # what it holds isn't markup
                close = RAW[tag].search(html, at)
                at = close.start() if close else size

    def close_to(self, tags: Collection, stop: Collection) -> None:
        """Ends all open elements of tags up to the nearest one of stop."""
        if not any(self.open.get(t) for t in tags):
            return
        node, outermost = self.at, None
        while node is not self.root and node.tag not in stop:
            if node.tag in tags:
                outermost = node
            node = node.parent
        if outermost is not None:
            self.leave(outermost)

    def leave(self, node: Node) -> None:
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def start(self, tag: str, attrs: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P:
            self.close_to(P, HOLDS_P)
        if tag in ENDED_BY:
            self.close_to(*ENDED_BY[tag])
        named = {k.lower(): (v or "").strip("\"'").lower() for k, v in ATTRIBUTE.findall(attrs)} if NAMING.search(attrs) else NOTHING
        node = Node(tag, named, self.at, len(self.nodes))
        self.at.parts.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        node = self.at
        while self.open.get(tag) and node is not self.root:
            if node.tag == tag:
                self.leave(node)
                return
            if tag in INLINE and node.tag not in INLINE:
                return  # a stray end tag doesn't reach over a block
            node = node.parent

    def text(self, data: str) -> None:
        self.at.parts.append(data)
        self.at.own += len(data.strip())


def _purposes(node: Node) -> bool:
    """True if the element's role, class or id names what isn't an article."""
    a = node.attrs
    if a.get("role") in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    words = set(re.split(r"[^a-z]+", a.get("class", "") + " " + a.get("id", "")))
    return bool(words & PURPOSE) or "header" in words and not words & {"article", "post", "entry", "content", "story"} and not _inside(node)


def _upward(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _inside(node: Node) -> bool:
    return any(n.tag in ARTICLE for n in _upward(node.parent))


def _dropped(nodes: list[Node], named: bool) -> set[int]:
    """Ids of the elements that aren't article text, whatever their density. named: by class, id and role too; an
    element that holds an article of the page is kept whatever its name."""
    out: set[int] = set()
    suspects: list[Node] = []
    for n in nodes[1:]:
        if n.tag in UNSEEN or n.tag in FORMS or n.tag in ASIDE or n.tag == "header" and not _inside(n):
            out.add(id(n))
        elif named and n.attrs and _purposes(n):
            suspects.append(n)
    if suspects:
        bad, holds = {id(n) for n in suspects}, set()
        for n in nodes:
            if n.tag in ARTICLE and id(n) not in bad:
                chain = list(_upward(n.parent))
                if not any("comment" in x.attrs.get("class", "") + x.attrs.get("id", "") for x in chain if id(x) in bad):
                    holds.update(map(id, chain))
        out |= bad - holds
    return out


def _measure(nodes: list[Node], dropped: set[int]) -> None:
    """Sets chars, tags, link_chars, link_tags, density and total of every node; what is dropped counts nothing."""
    gone = set(dropped)
    for n in nodes:
        n.chars, n.tags, n.link_chars, n.link_tags, n.plain, n.total = n.own, 0, 0, 0, 0, 0.0
        if n.parent is not None and id(n.parent) in gone:
            gone.add(id(n))
    flow = [[n.own, 0, 0] for n in nodes]  # characters, link characters and links of a block outside its inner blocks
    for k in range(len(nodes) - 1, 0, -1):
        n, up = nodes[k], nodes[k].parent
        if id(n) in gone:
            n.chars = 0
            continue
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
            flow[k][1:] = flow[k][0], flow[k][2] + 1
        up.chars += n.chars
        up.tags += n.tags + (n.tag == "a" or n.tag == "br" or n.tag not in INLINE)
        up.link_chars += n.link_chars
        up.link_tags += n.link_tags
        if n.tag in INLINE:
            for j in range(3):
                flow[up.place][j] += flow[k][j]
        else:
            up.plain = max(up.plain, n.plain, flow[k][0] - flow[k][1], PROSE * (n.tag in ARTICLE))
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for n, (own, linked, links) in zip(nodes, flow, strict=True):
        n.density = composite(n.chars, n.tags, n.link_chars, n.link_tags, share)
        if id(n) in gone or n.tag in INLINE and n.tag not in CELLS:
            continue
        n.total += composite(own, 1 + links, linked, links, share)
        if n.parent is not None:
            n.parent.total += n.density


def composite(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters a tag, times a logarithm that falls with the share of links; share is that of the whole body.

    Counts that are nought and stand below a line count as one, as the authors of the measure have it.
    """
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    ratio = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    return chars / max(1, tags) * math.log(max(ratio, 1.0)) / max(base, 1.0)


def _content(nodes: list[Node], dropped: set[int]) -> set[int]:
    """Ids of the roots of the content: in each subtree at least as dense as the threshold the node of the greatest sum."""
    last = list(range(len(nodes)))  # index of the last descendant
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k].parent.place
        last[up] = max(last[up], last[k])
    live = [n.chars > 0 and id(n) not in dropped for n in nodes]

    def densest(k: int) -> int:
        return max((j for j in range(k, last[k] + 1) if live[j]), key=lambda j: (nodes[j].total, -j))

    if not live[0]:
        return set()
    node, path = nodes[densest(0)], []
    node = next((n for n in _upward(node) if n.tag == "article"), node)
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min(n.density for n in path)
    chosen: set[int] = {id(path[0])}
    on_path = set(map(id, path))
    k = 0
    while k < len(nodes):
        n = nodes[k]
        if id(n) in chosen:
            k = last[k] + 1  # the whole subtree is content already
        elif id(n) in on_path:
            k += 1
        else:
            if live[k] and n.density >= threshold:
                chosen.add(id(nodes[densest(k)]))
            k = last[k] + 1
    return chosen


def _blocks(root: Node, chosen: set[int], dropped: set[int]) -> list[str]:
    """The texts of the blocks in chosen subtrees, white space as one space, in page order; no recursion: trees may be deep."""
    out, run = [], []

    def flush():
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack = [(root, id(root) in chosen, iter(root.parts))]
    while stack:
        node, inside, rest = stack[-1]
        part = next(rest, None)
        if part is None:
            stack.pop()
            if node.tag not in INLINE:
                flush()
            elif node.tag in ("td", "th"):
                run.append(" ")
        elif type(part) is str:
            if inside:
                run.append(part)
        elif id(part) not in dropped:
            if part.tag not in INLINE:
                flush()
            elif part.tag == "br":
                run.append(" ")
            stack.append((part, inside or id(part) in chosen, iter(part.parts)))
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article of one page: its blocks, each with single spaces, one a line; empty if the page has no text.

    A page whose named parts (class, id, role) are all it has is judged by elements alone. An unknown character
    reference stays as it is written; a page that breaks off ends there.
    """
    if not html:
        return ""
    tree = Tree(html)
    for named in (True, False):
        dropped = _dropped(tree.nodes, named)
        _measure(tree.nodes, dropped)
        menus = {id(n) for n in tree.nodes[1:] if n.link_tags > 1 and n.link_chars >= LINKS * n.chars and n.plain < PROSE and n.tag not in INLINE}
        if menus and tree.root.link_chars < tree.root.chars:
            dropped |= menus
            _measure(tree.nodes, dropped)
        chosen = _content(tree.nodes, dropped)
        if chosen:
            return "\n".join(_blocks(tree.root, chosen, dropped))
    return ""


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages without the column html and with out, the article of each page; row by row, without a shuffle.

    Null and empty html give an empty text; repeated rows stay; a column of pages named like out is replaced, others stay.
    """

    @F.pandas_udf("string")
    def articles(part: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in part:
            yield s.map(main_text, na_action=None).astype(object)

    return pages.select(*[F.col(c) for c in pages.columns if c not in (html, out)], articles(F.col(html)).alias(out))


def page_texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points); every row of pages has one, an empty table none."""
    return extract(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
