"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Paragraphs score for their length and commas and pass points to their ancestors, halved at each level; a
container's points are discounted by the share of its text that lies in links. The best container is kept with those siblings that score close to it
or read like prose, and all that stands between them. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are cut before anything is scored: by element, and by the words of their class, id and role. Words alone do not cut what holds the page's
heading or most of its prose, nor, where they have other meanings, what reads like prose. Every step takes time in proportion to the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes plaintext".split())
INLINE = frozenset(
    "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover semantics a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split()
)
#: Elements that are never part of an article's text.
CUT = frozenset(
    "script style noscript template iframe embed applet svg annotation annotation-xml nav aside footer button select option optgroup datalist input textarea "
    "menu dialog head title meta link base noembed noframes map area".split()
)
#: Elements that go unless the article itself stands in them: some pages are one form.
FORMS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre td blockquote li dd dt figcaption".split())
#: An opening tag of one of these ends an open p.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split()
)
#: An opening tag ends open elements of these names, up to the nearest of the boundaries.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Words of class, id and role that mark what is not the article. They are whole words: parts between -, _, digits, spaces and capitals.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertorial adsense sponsor sponsored sponsors promo promos promoted "
    "nav navbar navigation menu menus menubar breadcrumb breadcrumbs crumbs pager pagination toc "
    "sidebar sidebars aside widget widgets complementary recommended recommendations outbrain taboola "
    "masthead topbar footer colophon contentinfo "
    "cookie cookies consent gdpr notice notices notification notifications modal popup popover overlay lightbox toast paywall "
    "sharing social subscribe newsletter signup login signin searchbox hidden skiplink toolbar".split()
)
#: Those of lists of links, which a paragraph of prose in an article is not, whatever its class says.
LINKS = frozenset("nav navbar navigation menu menus menubar breadcrumb breadcrumbs crumbs pager pagination toc toolbar".split())
#: Words of reader comments. These may be longer than the article.
COMMENTS = frozenset("comment comments commentlist disqus respond".split())
#: Words that may just as well name a part of the article: they cut what does not read like prose.
AMBIGUOUS = frozenset(
    "banner promotion rail related recommend popular trending header legal copyright discussion reactions replies reply alert share follow subscription register search form skip".split()
)
#: A class that begins or ends with one of these tells a state of the page: has-sidebar, comments-open.
STATE_FIRST, STATE_LAST = frozenset("has no with without not show hide".split()), frozenset("open opened closed enabled disabled on off free layout template active".split())
GOOD = frozenset("article articlebody body content entry main page post story text blog hentry".split())
#: Characters of a paragraph that reads like prose, and of so much prose that a word of two meanings does not cut it.
PROSE, MUCH_PROSE = 80, 200
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TAG = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*>?"""
    r"""|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>|(?P<broken>/?[a-zA-Z][^>]*)(?:>|\Z))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_KEPT_ATTRIBUTES = re.compile(r"class|id|role|hidden|style|href", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    """An element. length, linked: characters of its text and of that in links; flow...: the same (and commas) of the text that stands in it outside blocks."""

    __slots__ = ("name", "attributes", "children", "parent", "score", "length", "linked", "flow", "flow_linked", "commas", "prose", "holds", "scored")

    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[Node | str] = []
        self.score = 0.0
        self.scored = False

    def measure(self) -> None:
        """Sums over children that are measured already. prose: characters of paragraphs that read like it; holds: 1 for a page heading or main, 2 for an article."""
        self.length = self.linked = self.flow = self.flow_linked = self.commas = self.prose = 0
        self.holds = 1 if self.name in ("h1", "main") else 2 if self.name == "article" else 0
        for c in self.children:
            if isinstance(c, str):
                n = len(c.strip())
                self.length += n
                self.flow += n
                self.commas += c.count(",")
                continue
            link = c.name == "a" and "href" in c.attributes
            self.length += c.length
            self.linked += c.length if link else c.linked
            self.prose += c.prose
            self.holds |= c.holds
            if c.name in INLINE:
                self.flow += c.flow
                self.flow_linked += c.flow if link else c.flow_linked
                self.commas += c.commas
        if self.name not in INLINE and self.name not in HEADINGS and self.flow >= PROSE and 3 * self.flow_linked < self.flow:
            self.prose += self.flow


def _attributes(text: str) -> dict[str, str]:
    if not text or not _KEPT_ATTRIBUTES.search(text):
        return {}
    out: dict[str, str] = {}
    for k, v in _ATTRIBUTE.findall(text):
        v = v[1:-1] if v[:1] in ("'", '"') else v
        out.setdefault(k.lower(), html.unescape(v) if "&" in v else v)
    return out


class _Open:
    """The open elements, from the root on, with the places of each name and of all blocks, so that no step walks along them."""

    def __init__(self, root: Node):
        self.nodes, self.blocks, self.places = [root], [0], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        if node.name not in INLINE:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Closes the element at that place and all within it."""
        while len(self.nodes) > at:
            name = self.nodes.pop().name
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()

    def last(self, name: str) -> int:
        found = self.places.get(name)
        return found[-1] if found else 0

    def first_after(self, name: str, at: int) -> int | None:
        found = self.places.get(name, ())
        i = bisect_right(found, at)
        return found[i] if i < len(found) else None

    def open_p(self) -> int:
        """The place of an open p within which only inline elements were opened, else 0."""
        return self.blocks[-1] if self.nodes[self.blocks[-1]].name == "p" else 0


def parse(source: str) -> Node:
    """The tree of a page, however badly its tags are closed; character references in text are decoded once."""
    root = Node("#root", {}, None)
    up = _Open(root)
    position = 0
    n = len(source)
    while position < n:
        start = source.find("<", position)
        if start < 0:
            start = n
        if start > position:
            text = source[position:start]
            up.nodes[-1].children.append(html.unescape(text) if "&" in text else text)
        if start == n:
            break
        m = _TAG.match(source, start)
        if not m:
            up.nodes[-1].children.append("<")
            position = start + 1
            continue
        position = m.end()
        name = m["name"]
        if name is None:
            if m["cdata"]:
                up.nodes[-1].children.append(m["cdata"])
            broken = m["broken"]
            if not broken or m.end() == n and source[-1] != ">":
                continue
            close, name, attributes = broken[0] == "/", broken.lstrip("/").split(None, 1)[0].rstrip("/"), ""
        else:
            close, attributes = m["close"], m["attributes"]
        name = name.lower()
        if close:
            at = up.last(name)
            if name == "br" or name == "p" and not at:
                up.nodes[-1].children.append(Node(name, {}, up.nodes[-1]))
            elif at and not (name in INLINE and up.blocks[-1] > at):  # a stray inline end does not close a block
                up.cut(at)
            continue
        if name in ENDS_P and (at := up.open_p()):
            up.cut(at)
        if name in ENDS:
            ended, boundary = ENDS[name]
            edge = max(up.last(x) for x in boundary)
            found = [at for x in ended if (at := up.first_after(x, edge)) is not None]
            if found:
                up.cut(min(found))
        node = Node(name, _attributes(attributes), up.nodes[-1])
        up.nodes[-1].children.append(node)
        if name in VOID or attributes.endswith("/") and name in ("path", "rect", "circle", "use"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, position)
            position = end.end() if end else n
            continue
        up.push(node)
    return root


def _marks(node: Node) -> tuple[set[str], set[str]]:
    """Words of class and role, and of id."""
    a, out = node.attributes, (set(), set())
    for k, found in (("class", out[0]), ("role", out[0]), ("id", out[1])):
        for x in a.get(k, "").split():
            words = [w.lower() for w in _WORDS.findall(x)]
            if words and not (len(words) > 1 and (words[0] in STATE_FIRST or words[-1] in STATE_LAST)):
                found.update(words)
    return out


def _in_article(node: Node) -> bool:
    up = node.parent
    while up is not None and up.name not in ("article", "main"):
        up = up.parent
    return up is not None


def _is_noise(node: Node, page: Node) -> bool:
    """Whether the measured node goes. page: the whole page."""
    name = node.name
    if name in CUT:
        return True
    # What holds the page's heading, or most of its prose, is the article or holds it.
    most = node.prose >= MUCH_PROSE and 2 * node.prose > page.prose
    if name in FORMS:
        return not (node.holds or most)
    if name == "header":
        # A page's header; that of an article holds its heading.
        up = node.parent
        while up is not None and up.name not in ("article", "main", "section", "header"):
            up = up.parent
        return up is None and not most
    a = node.attributes
    if not a or name in ("body", "html", "article", "main"):
        return False
    if "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower() or a.get("aria-hidden", "").lower() == "true":
        return True
    kind, identity = _marks(node)
    if name in INLINE:
        return bool(kind & {"ad", "ads", "advert", "advertisement"})
    if name in PARAGRAPHS and name != "td":
        prose = node.flow >= PROSE and 3 * node.linked < node.length and _in_article(node)
        return bool(kind & ((NOISE - LINKS if prose else NOISE) | COMMENTS))
    marks = kind | identity
    if marks & COMMENTS and not node.holds & 1:
        return True
    if marks & NOISE and not (node.holds or most):
        return True
    return bool(marks & AMBIGUOUS) and not node.holds and not (node.prose >= MUCH_PROSE and 3 * node.linked < node.length)


def _without(root: Node, gone: Callable[[Node], bool]) -> list[Node]:
    """Cuts elements; those that are left, parents before children, measured."""
    order = [root]
    for x in order:
        x.children = [c for c in x.children if isinstance(c, str) or not gone(c)]
        order += [c for c in x.children if not isinstance(c, str)]
    for x in reversed(order):
        x.measure()
    return order


def prune(root: Node) -> list[Node]:
    """Cut what is never article text; the elements that are left, measured."""
    _without(root, lambda x: x.name in CUT)
    return _without(root, lambda x: _is_noise(x, root))


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def best_container(order: list[Node]) -> Node | None:
    """The element with the highest score after paragraphs have passed on their points; None without any paragraph."""
    scored: list[Node] = []

    def give(node: Node, points: float) -> None:
        if not node.scored:
            node.scored = True
            marks = set().union(*_marks(node))
            node.score += (25 if marks & GOOD else 0) + {"article": 30, "main": 25, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3}.get(node.name, 0)
            node.score -= 3 if node.name in ("ul", "ol", "dl", "dd", "dt", "li", "address") else 0
            scored.append(node)
        node.score += points

    for x in order:
        paragraph = x.name in PARAGRAPHS
        # Text that stands in a container itself, outside any paragraph, is a paragraph of that container.
        if x.name in INLINE or not x.flow or not paragraph and x.flow < 25:
            continue
        points = (1 + x.commas + min(x.flow / 100, 30)) * (1 - x.flow_linked / x.flow) * (0.25 if x.name in HEADINGS else 1)
        up, share = (x.parent if paragraph and x.parent is not None else x), 1.0
        while up is not None and share > 0.05:
            give(up, points * share)
            up, share = up.parent, share / 2
    for x in scored:
        x.score *= 1 - _density(x)
    return max(scored, key=lambda x: x.score, default=None)


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks below node, in page order, each with single spaces."""
    out: list[str] = []
    pieces: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(pieces)).strip()
        pieces.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node | str | None, bool]] = [(node, False)]
    while stack:
        x, done = stack.pop()
        if isinstance(x, str):
            pieces.append(x)
        elif done:
            end()
        elif x.name in ("br", "hr", "wbr", "img"):
            pieces.append("" if x.name in ("wbr", "img") else " ")
        else:
            if x.name not in INLINE:
                end()
                stack.append((x, True))
            stack += [(c, False) for c in reversed(x.children)]
    end()
    return out


def _like_prose(node: Node) -> bool:
    """Whether a sibling of the best container belongs to it by its own text."""
    if node.name in HEADINGS:
        return bool(node.length) and not node.linked
    if node.name in PARAGRAPHS:
        return node.length > PROSE and _density(node) < 0.25 or bool(node.length and not node.linked and re.search(r"[.!?。]\s*$", " ".join(_blocks(node))))
    # A block above the text that holds little but the page's heading.
    return bool(node.holds & 1) and node.length < 400 and _density(node) < 0.25


def _kept(best: Node) -> list[Node | str]:
    """The best container, its siblings that belong to it, and what stands between them."""
    parent = best.parent
    if parent is None:
        return [best]
    enough = best.score * 0.2
    if best.name in ("article", "main"):
        return [c for c in parent.children if c is best or not isinstance(c, str) and c.name == best.name == "article" and c.scored and c.score >= enough]
    around = parent.children
    own = [not isinstance(c, str) and (c is best or c.scored and c.score >= max(10.0, enough) or _like_prose(c)) for c in around]
    at = [i for i, x in enumerate(own) if x]
    return [c for i, c in enumerate(around) if own[i] or at[0] < i < at[-1] and (isinstance(c, str) or _density(c) < 0.5)]


def main_text(source: str | None) -> str:
    """The main text of a page; empty for null, empty or textless pages."""
    if not source:
        return ""
    root = parse(source)
    best = best_container(prune(root))
    if best is None:
        return " ".join(_blocks(root))
    # The article around the best container is the container; so is a main element that holds little else.
    up, article = best, None
    while up is not None:
        if up.name == "article" and article is None:
            article = up
        elif up.name == "main" and article is None and up.length <= 2 * best.length + 200:
            best = up
        up = up.parent
    page = Node("div", {}, None)
    page.children = _kept(article or best)
    return " ".join(_blocks(page))


def extract(pages: DataFrame, source: str = "html", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """pages with the columns text (main text of the whole source column, null: empty) and n_chars (its code points).

    One pass, no shuffle: each page is a tree of its own, and a very long one needs time and memory in proportion to it. Columns of these names are replaced, others kept;
    repeated rows stay repeated; an empty table gives an empty result. Text nested however deep is read without recursion.
    """
    rest = pages.drop(text, chars)
    schema = rest.selectExpr("*", f"'' AS `{text}`", f"0L AS `{chars}`").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(x) for x in b.column(b.schema.get_field_index(source)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*b.schema.names, text, chars])

    return rest.mapInArrow(run, schema)


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
