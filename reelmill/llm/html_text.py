"""Main text of web pages by composite text density.

Each block node of the page gets a density: its characters per tag, lowered by the share of characters and tags that belong to
links. The node whose children have the largest sum of densities is the centre of the article; the least density on the way
from ``body`` to it is the threshold, and below every node at or over the threshold the subtree of the largest sum is content.
Before that, what is never article text is taken out: scripts, styles, forms, navigation, asides, footers, page headers, and
containers one of whose whole names (class, id or role) means adverts, notices, menus, sidebars or reader comments. Names that only
hold such a word (``has-sidebar``, ``related-work``) mean nothing, and neither headings, paragraphs nor inline elements go by class or id. A
named container or form that holds the bulk of the page's text stays.

A null or empty page has the empty text. Broken markup never fails: open elements end with the page, stray end tags and a tag
cut off at the end are ignored; the time grows with the page's length, however its tags are nested. Character references are decoded, white space (of any kind) inside a block becomes one space,
blocks are joined by a line feed in page order. Nothing is cut short.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from reelmill.llm.arrow import append_columns

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|</?[a-zA-Z][^>]*\Z",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in "script style textarea title xmp iframe noembed noframes".split()}
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
NO_TEXT = frozenset(
    "head title script style noscript template nav footer aside form button input select option textarea iframe object embed "
    "svg canvas audio video dialog menu annotation annotation-xml noembed noframes xmp applet".split()
)
#: Elements that class and id names can take out.
CONTAINERS = frozenset("address aside center details dir div dl fieldset figure footer form header menu nav ol section table ul".split())
#: Words of class and id names, and roles, that mark what isn't the article.
NO_TEXT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promos promotion cookie "
    "cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup login sidebar sidebars "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies respond related recommended "
    "share sharing social widget widgets pagination pager toolbar topbar masthead copyright disclaimer skip".split()
)
#: Words that may stand beside them in a name of the same meaning.
NAME_REST = frozenset(
    "area article articles bar block box button buttons container form global item items link links list main page panel post posts "
    "primary secondary section site slot thread unit wrapper".split()
)
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: An element around one of these is never taken out by its name.
CENTRAL = frozenset(["article", "main", "h1"])
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
#: Implied ends don't reach beyond these.
SCOPE = frozenset("html body article aside div section main table ul ol dl td th li blockquote form nav footer header".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "inside")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Node | str] = []
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))


def parse(page: str) -> Node:
    """The page as a tree of elements and texts, with the usual repairs of missing end tags."""
    root = at = Node("#page", "", None)
    open_tags: list[Node] = [root]
    places: dict[str, list[int]] = {}  # where in open_tags each tag stands
    scopes: list[int] = []  # and where the tags of SCOPE do

    def close(depth: int) -> Node:
        for node in open_tags[depth:]:
            places[node.tag].pop()
            if node.tag in SCOPE:
                scopes.pop()
        del open_tags[depth:]
        return open_tags[-1]

    place = 0
    while True:
        m = TAG.search(page, place)
        end = m.start() if m else len(page)
        if end > place:
            raw = page[place:end]
            at.parts.append(html.unescape(raw) if "&" in raw else raw)
        if not m:
            return root
        place = m.end()
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if closing:
            if places.get(tag):
                at = close(places[tag][-1])
            continue
        if shut := CLOSES.get(tag, ()) + (("p",) if tag in BLOCK else ()):
            k = len(scopes) - 1
            while k >= 0 and open_tags[scopes[k]].tag in shut:
                k -= 1
            stop = scopes[k] if k >= 0 else 0
            standing = [(places[t], bisect_right(places[t], stop)) for t in shut if places.get(t)]
            if ended := [where[i] for where, i in standing if i < len(where)]:
                at = close(min(ended))
        node = Node(tag, attrs, at)
        at.parts.append(node)
        if tag in RAW:
            m = RAW[tag].search(page, place)
            place = m.end() if m else len(page)
        elif tag not in VOID:
            places.setdefault(tag, []).append(len(open_tags))
            if tag in SCOPE:
                scopes.append(len(open_tags))
            open_tags.append(node)
            at = node


def means_no_text(name: str) -> bool:
    """Whether a class or id as a whole means something that isn't part of an article."""
    words = [w.lower() for w in NAME_PART.findall(name)]
    return any(w in NO_TEXT_NAMES for w in words) and all(w in NO_TEXT_NAMES or w in NAME_REST or w.isdigit() or len(w) == 1 for w in words)


def named_out(node: Node) -> bool:
    """Whether the names of an element say that it isn't part of an article."""
    if not node.attrs or node.tag in ("html", "body"):
        return False
    for name, *values in ATTRIBUTE.findall(node.attrs):
        name, value = name.lower(), html.unescape("".join(values))
        # the id of a section inside an article is made from its heading
        if name == "class" or name == "id" and not (node.inside and node.tag == "section"):
            if node.tag in CONTAINERS and any(map(means_no_text, value.split())):
                return True
            if not node.inside and node.tag in CONTAINERS and value.strip().lower() in ("header", "site-header", "page-header"):
                return True
        if name == "role" and value.strip().lower() in NO_TEXT_ROLES:
            return True
        if name == "hidden":
            return True
    return False


def walk(root: Node) -> list[Node]:
    """All elements, each before its children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(p for p in reversed(node.parts) if type(p) is Node)
    return out


def bulk(nodes: list[Node], gone: set[int], named: list[Node]) -> set[int]:
    """Those of the ``named`` that hold half of the page's text outside links or more, unless an article stands beside them."""
    names = {id(n) for n in named}
    text, central = {}, {}  # characters outside links; those in article or main and in nothing named
    for node in reversed(nodes):
        c = m = 0
        if id(node) not in gone and node.tag != "a":
            for p in node.parts:
                if type(p) is str:
                    n = sum(map(len, p.split()))
                    c += n
                    m += n * (node.inside or node.tag in ("article", "main"))
                else:
                    c, m = c + text[id(p)], m + central[id(p)]
        text[id(node)], central[id(node)] = c, 0 if id(node) in names else m
    every, article = text[id(nodes[0])], central[id(nodes[0])]
    return {k for k in names if 2 * text[k] >= every and 10 * article < text[k]}


def prune(root: Node) -> None:
    """Take out the elements that hold no article text."""
    nodes = walk(root)
    around: set[int] = set()
    for node in reversed(nodes):
        if id(node) in around or node.tag in CENTRAL:
            around.add(id(node.parent))
    gone, named = set(), []
    for node in nodes:
        if node.tag in ("script", "style", "head"):
            gone.add(id(node))
        elif node.tag in CENTRAL or id(node) in around:
            continue
        elif node.tag == "form" or node.tag not in NO_TEXT and named_out(node):
            named.append(node)
        elif node.tag in NO_TEXT and not (node.tag == "dialog" and node.inside) or node.tag == "header" and not node.inside:
            gone.add(id(node))
    if named:
        gone.update({id(n) for n in named} - bulk(nodes, gone, named))
    if gone:
        for node in nodes:
            node.parts = [p for p in node.parts if type(p) is str or id(p) not in gone]


def main_text(page: str | None) -> str:
    """The article of one page."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    nodes = walk(root)
    chars, tags, link_chars, link_tags = {}, {}, {}, {}
    for node in reversed(nodes):
        c = t = lc = lt = 0
        for p in node.parts:
            if type(p) is str:
                c += sum(map(len, p.split()))
            else:
                k = id(p)
                c, t, lc, lt = c + chars[k], t + tags[k] + 1, lc + link_chars[k], lt + link_tags[k] + (p.tag == "a")
        k = id(node)
        chars[k], tags[k], link_chars[k], link_tags[k] = c, t, c if node.tag == "a" else lc, lt
    body = next((n for n in nodes if n.tag == "body"), root)
    if not chars[id(body)]:
        body = root
    share = link_chars[id(body)] / chars[id(body)] if chars[id(body)] else 0.0

    density = {}
    for node in nodes:
        k = id(node)
        c, lc, t, lt = chars[k], link_chars[k], max(tags[k], 1), max(link_tags[k], 1)
        if not c:
            density[k] = 0.0
            continue
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        density[k] = c / t * max(math.log(max(c / max(lc, 1) * t / lt, 1.0)), 0.01) / max(math.log(base), 1.0) if base > 1 else c / t
    blocks = [n for n in nodes if n.tag in BLOCK or n is root]
    total = {}
    for node in blocks:
        inner = [id(p) for p in node.parts if type(p) is not str and p.tag in BLOCK]
        # text that stands in the block itself, outside its child blocks, counts by its share of the block's density
        own = 1 - sum(chars[k] for k in inner) / chars[id(node)] if chars[id(node)] else 0.0
        total[id(node)] = sum(density[k] for k in inner) + own * density[id(node)]

    under = {id(n) for n in walk(body)}
    best = max((n for n in blocks if id(n) in under), key=lambda n: total[id(n)], default=body)
    threshold, node = density[id(best)], best
    while node is not body and node.parent is not None:
        node = node.parent
        threshold = min(threshold, density[id(node)])
    largest = {id(n): n for n in blocks}
    for node in reversed(blocks):
        for p in node.parts:
            if type(p) is not str and id(p) in largest and total[id(largest[id(p)])] > total[id(largest[id(node)])]:
                largest[id(node)] = largest[id(p)]
    chosen = {id(largest[id(n)]) for n in blocks if id(n) in under and density[id(n)] >= threshold}
    return "\n".join(block_texts(body, chosen))


def block_texts(body: Node, chosen: set[int]) -> list[str]:
    """Texts of the blocks in the chosen subtrees."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    todo: list[tuple[Node | str | None, bool]] = [(body, False)]
    while todo:
        part, taken = todo.pop()
        if part is None:
            flush()
        elif type(part) is str:
            if taken:
                run.append(part)
        else:
            taken = taken or id(part) in chosen
            block = part.tag in BLOCK
            if block:
                flush()
                todo.append((None, taken))
            elif part.tag == "br":
                run.append(" ")
            todo.extend((p, taken) for p in reversed(part.parts))
    flush()
    return out


def extract_main_text(df: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """``df`` with the main text of each page; an input column called ``text`` is replaced."""

    def make():
        return lambda pages: [pa.array([main_text(p) for p in pages.to_pylist()], pa.string())]

    return append_columns(df, page, f"`{text}` string", make)
