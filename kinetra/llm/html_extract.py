"""Main text of web pages by tree scoring.

A page is parsed to a tree and boilerplate (menus, page headers and footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) is cut by element, by role, and by a class or id that names boilerplate as a
whole ("cookie-notice", not "search-methods"). Neither a name nor a form cuts what holds the main element or most of the page's
text, and within an article no name cuts a heading, a paragraph, or prose under a word that is also a topic. Every
paragraph then passes points, for being there, for its length and its commas, to its ancestors: all to the
parent, half to the next, a sixth, a ninth and so on up to ``LEVELS``. A container's points are discounted by its
link density; the best one is kept with those siblings that score well or read like its paragraphs. A
container inside ``article`` or ``main`` stands for that element. Nothing else is dropped or shortened.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import map_batches, texts_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead"
    " tr ul".split()
)
#: What an opening tag ends: the open elements named, up to the nearest element of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
ENDS["thead"] = ENDS["tfoot"] = ENDS["tbody"]
#: Where an open paragraph is not looked for.
PARAGRAPH_SCOPE = frozenset("button table td th caption html object".split())

DROPPED = frozenset(
    "nav aside footer form script style noscript template iframe button select option input textarea svg canvas object embed"
    " dialog menu audio video head title datalist map annotation annotation-xml".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of class or id that mark boilerplate.
DROPPED_WORDS = re.compile(
    r"^(nav|navbar|navigation|menu|menus|sidebar|sidenav|aside|footer|breadcrumbs?|ads?|adverts?|advertisements?|advertising|adsense"
    r"|sponsors?|sponsored|promos?|promotion|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|subscription|signup|login"
    r"|comments?|commentlist|respond|disqus|replies|share|sharing|social|related|recommended|popup|modal|overlay|widgets?|masthead"
    r"|pagination|pager|toolbar|topbar|skip|skiplink|paywall|feedback|search|searchbox|tags|alert)$"
)
#: Words that may stand beside those in the name of a piece of boilerplate: "related-posts" is one, "related-work" is a topic.
NAME_PARTS = frozenset(
    "area bar block bottom box btn button buttons col column container content footer form global google group header holder icon icons"
    " inner item items left link links list main message outer page panel placeholder post posts primary right secondary section sidebar site slot space"
    " the thread top unit user view wrap wrapper article articles reader story stories".split()
)
#: Boilerplate words that are topics as well: prose under these stays within an article.
TOPICS = frozenset("social related recommended search feedback alert tags share sharing respond replies overlay banner promotion promos promo login skip notices menus widgets".split())
#: Characters outside links from which a part counts as prose.
PROSE = 140
#: Elements that no name cuts within an article.
TEXT_LEVEL = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote li dt dd td th tr tbody figure figcaption math code em strong b i span a q cite".split())
HEADER_WORDS = frozenset(("header", "masthead", "topbar"))
COMMENT_WORDS = frozenset("comments comment commentlist respond disqus replies".split())
#: Words that may stand beside those in the name of a comment section; a state such as "comments-open" names none.
COMMENT_PARTS = frozenset("list area section thread wrapper wrap container box block user reader post the".split())
NEVER_BY_WORD = frozenset(("html", "body", "article", "main"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: How far a paragraph's points go up: beyond, the share would be under a hundredth.
LEVELS = 33


class Node:
    __slots__ = ("attrs", "children", "in_article", "in_main", "in_p", "length", "linked", "open_p", "parent", "score", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.score = 0.0
        self.length = self.linked = 0
        #: Whether an element above is an article, an article or main, a paragraph; the paragraph that a block ends.
        self.in_article = parent is not None and (parent.in_article or parent.tag == "article")
        self.in_main = parent is not None and (parent.in_main or parent.tag in ("article", "main"))
        self.in_p = parent is not None and (parent.in_p or parent.tag == "p")
        self.open_p: Node | None = self if tag == "p" else None if parent is None or tag in PARAGRAPH_SCOPE else parent.open_p


class _Path:
    """The open elements; every one is closed once, so a page costs no more than its length."""

    def __init__(self) -> None:
        self.root = self.here = Node("#root", {}, None)
        self.open: Counter = Counter()

    def enter(self, node: Node) -> None:
        self.here = node
        self.open[node.tag] += 1

    def leave(self, node: Node) -> None:
        """Close ``node`` and all that is open in it."""
        while self.here is not node.parent:
            self.open[self.here.tag] -= 1
            self.here = self.here.parent

    def last(self, tags: set[str], stop: set[str]) -> Node | None:
        """The outermost open element of ``tags`` within the nearest of ``stop``."""
        node, out = self.here, None
        if any(self.open[t] for t in tags):
            while node.parent is not None and node.tag not in stop:
                out = node if node.tag in tags else out
                node = node.parent
        return out


def parse(page: str) -> Node:
    """Tree of the page; wrong nesting is mended as browsers do in the common cases."""
    path = _Path()
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            path.here.children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            path.here.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                path.here.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if path.open[tag] > 0:
                node = path.here
                while node.tag != tag:
                    node = node.parent
                path.leave(node)
            elif tag == "p":
                path.here.children.append(Node("p", {}, path.here))
            continue
        if tag in BLOCK and path.here.open_p is not None:
            path.leave(path.here.open_p)
        ended = path.last(*ENDS[tag]) if tag in ENDS else None
        if ended is not None:
            path.leave(ended)
        raw = m[3] or m[6] or ""
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}
        node = Node(tag, attrs, path.here)
        path.here.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = end if close is None else max(page.find(">", close.start()) + 1, close.end())
        elif tag not in VOID:
            path.enter(node)
    return path.root


def names_of(node: Node) -> list[list[str]]:
    """The words of each class and of the id."""
    names = [*node.attrs.get("class", "").lower().split(), node.attrs.get("id", "").lower()]
    return [w for w in ([w for w in re.split(r"[^a-z]+", name) if w] for name in names) if w]


def holds_comments(node: Node) -> bool:
    """Whether a class or the id, as a whole, names a comment section."""
    for name in [*node.attrs.get("class", "").lower().split(), node.attrs.get("id", "").lower()]:
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if words & COMMENT_WORDS and words <= COMMENT_WORDS | COMMENT_PARTS:
            return True
    return False


def is_boilerplate(node: Node) -> bool:
    """Whether the element is cut by itself, whatever it holds."""
    tag, attrs = node.tag, node.attrs
    if tag in DROPPED and tag != "form":
        return True
    if tag == "header":
        return not node.in_main
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style", "")):
        return True
    return attrs.get("role", "").lower() in DROPPED_ROLES - {"form"}


def is_marked(node: Node, prose: int = 0) -> bool:
    """Whether the element, with ``prose`` characters outside links, is a form or named as boilerplate: it is cut unless it holds the page's text."""
    tag, attrs = node.tag, node.attrs
    if tag == "form" or attrs.get("role", "").lower() == "form":
        return True
    if not attrs or tag in NEVER_BY_WORD and not (tag == "article" and node.in_article) or node.in_main and tag in TEXT_LEVEL:
        return False
    for words in names_of(node):
        marks = [w for w in words if DROPPED_WORDS.match(w) or w in HEADER_WORDS and not node.in_main]
        if marks and all(w in marks or w in NAME_PARTS for w in words):
            if not (node.in_main and prose >= PROSE and all(w in TOPICS for w in marks)):
                return True
    return False


def _weights(root: Node) -> tuple[list[Node], dict[int, int]]:
    """The nodes, parents first, without those cut by themselves, and the characters outside links in each."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str) and not is_boilerplate(c)]
    weight: dict[int, int] = {}
    for node in reversed(order):
        own = sum(len(" ".join(c.split())) if isinstance(c, str) else weight.get(id(c), 0) for c in node.children)
        weight[id(node)] = 0 if node.tag == "a" else own
    return order, weight


def _holders(order: list[Node], weight: dict[int, int]) -> set[int]:
    """Ids of the nodes that hold a main element, or most of the page's text and of that in articles.

    A node marked as comments needs a main, or an unmarked article with most of the text.
    """
    half = weight[id(order[0])] / 2
    mains: set[int] = set()
    articles: dict[int, int] = {}
    most_in: set[int] = set()
    for node in reversed(order):
        inner = [c for c in node.children if not isinstance(c, str)]
        if node.tag == "main" or node.attrs.get("role") == "main" or any(id(c) in mains for c in inner):
            mains.add(id(node))
        plain = node.tag == "article" and not is_marked(node) and not holds_comments(node)
        articles[id(node)] = weight[id(node)] if plain else sum(articles.get(id(c), 0) for c in inner)
        if weight[id(node)] > half and (plain or any(id(c) in most_in for c in inner)):
            most_in.add(id(node))
    every = articles[id(order[0])]
    return mains | {id(n) for n in order if weight[id(n)] > half and 2 * articles[id(n)] >= every and (id(n) in most_in or not holds_comments(n))}


def _prune(root: Node) -> list[Node]:
    """Cut boilerplate; the other nodes, parents first."""
    order, weight = _weights(root)
    holders = _holders(order, weight)
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not (is_boilerplate(c) or id(c) not in holders and is_marked(c, weight[id(c)]))]
        todo += [c for c in node.children if not isinstance(c, str)]
    return order


def _measure(order: list[Node]) -> None:
    """Text lengths, inside links too, and the points of paragraphs to their ancestors."""
    for node in reversed(order):
        own = [len(" ".join(c.split())) for c in node.children if isinstance(c, str)]
        node.length += sum(own)
        if node.tag == "a":
            node.linked = node.length
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
    for node in order:
        if node.tag not in BLOCK or node.parent is None:
            continue
        text = " ".join(inline(node).split())
        if not text:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        # loose text of a container counts for the container itself
        up = node.parent if node.tag in ("p", "pre", "li", "blockquote", "td", "dd", "dt") or node.tag[0] == "h" and node.tag[1:].isdigit() else node
        level = 0
        while up is not None and up.tag != "#root" and level <= LEVELS:
            up.score += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            up, level = up.parent, level + 1


def inline(node: Node) -> str:
    """Text of a block without that of the blocks in it."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or x.tag not in BLOCK:
            if x.tag == "br":
                out.append(" ")
            todo += reversed(x.children)
        else:
            out.append(" ")
    return "".join(out)


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def kept_nodes(order: list[Node]) -> list[Node]:
    """The best container, or the article it is in, and the siblings that belong to it."""
    best = max(order, key=lambda n: n.score * (1 - density(n)))
    if best.score <= 0:
        return order[:1]
    up, article = best, None
    while up is not None:
        if up.tag in ("article", "main") or up.attrs.get("role") == "main" or up.attrs.get("itemprop") == "articleBody":
            article = up
            if up.tag == "article":
                break
        up = up.parent
    best = article or best
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * best.score)
    out = []
    for x in best.parent.children:
        if isinstance(x, str) or x is best:
            out += [x] if x is best else []
        elif x.tag == "h1" or x.score * (1 - density(x)) >= least or (article is not None and x.tag == "article" and article.tag == "article"):
            out.append(x)
        elif x.tag == "p" and x.length and density(x) < 0.25 and (x.length > 80 or re.search(r"[.!?]\s*$", inline(x))):
            out.append(x)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order, white space folded; lists and boxes of links alone are menus outside an article."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in BLOCK:
            flush()
            if x.tag in ("ul", "ol", "div", "dl", "table", "section") and density(x) > 0.8 and not x.in_main:
                continue
            todo.append(None)
            todo += reversed(x.children)
        else:
            todo += reversed(x.children)
    flush()
    return out


def main_text(page: str) -> str:
    order = _prune(parse(page))
    _measure(order)
    return "\n\n".join(blocks(kept_nodes(order)))


def extract(pages: DataFrame) -> DataFrame:
    """Rows ``(page_id, url, text, n_chars)``, one for each row of ``pages(page_id, url, html)``.

    A null or empty page, or one without text, has an empty text. Pages are read whole. Repeated rows and
    null ids or addresses are returned as they come. An empty table gives no rows; other columns are not
    read.
    """

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in texts_of(rows, "html")]
        return pa.RecordBatch.from_arrays(
            [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_batches(own, run, "page_id long, url string, text string, n_chars long")
