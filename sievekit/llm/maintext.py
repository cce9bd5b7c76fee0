"""Main text of web pages by the distribution of text over line blocks.

A page's markup is stripped into lines: every boundary of a block element ends
a line, so elements that hold no text of their own leave empty lines, and
places with much markup and little text become gaps. Over windows of WINDOW
lines the lengths of text outside links are summed. Text begins at a surge,
where a window's sum passes SURGE, and ends at a dive, where DIVE lines are
empty; what lies between is kept.

What a reader doesn't see, or what markup itself names as something else than
the article, is taken away before lines are counted: scripts, styles, forms,
`nav`, `footer`, `aside`, page headers, and elements whose role, class or id
has one of the words of MARKS, unless such an element holds the article or most
of the page. Where a page has an `article` (or else a `main`), surges are looked
for inside the one with the most text. The run with the most text is the core;
it is grown to the edges of the smallest element around it, so that short
headings and last lines stay, and to runs in like elements beside it.
Directly in the body, where no element bounds the article, short blocks of
another kind and lists of links are cut off at both ends instead.

Edge cases: a null or empty page, or one without text, gives an empty text. A
page whose text nowhere passes SURGE keeps its longest run. Of runs with equally
much text the first is the core. Repeated pages are extracted each for itself;
unclosed elements end with the element around them, a cut tag or comment ends
with the page. Other columns of the input are carried along unless their name
is one of the results'.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_batches, read

#: Lines of a window, characters that make a surge, empty lines that make a dive, and the share of link text from which a line counts as links.
WINDOW, SURGE, DIVE, LINKS = 6, 80, 2, 0.6

# Elements of HTML by what they do to text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style noscript template svg canvas object embed audio video select option datalist textarea button input iframe title xmp noembed noframes".split())
ASIDE = frozenset("nav footer aside menu dialog".split())
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]), "body": frozenset(["head"]),
}
#: Elements inside which an open element of the same kind isn't closed by a new one.
SCOPES = frozenset("ul ol dl table div section article main aside nav blockquote body html form figure header footer td th".split())
#: Block elements that a new paragraph isn't part of.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IN_HEAD = frozenset("title meta link base script style noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre li dd dt figcaption tr".split())

HOLDERS = frozenset("ul ol dl table tbody thead blockquote figure pre li tr".split())

#: Words of a class, id or role that say that an element isn't the article.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs colophon comment commentlist comments
    complementary consent contentinfo cookie cookies copyright dialog alertdialog discussion disqus footer gdpr masthead menu menubar modal nav navbar
    navigation navlinks newsletter notice notices notification overlay pager pagination popup promo promotion promoted recommendations recommended related
    replies respond responses rail search sharing sidebar sidenav signup skyscraper social sponsor sponsored subscribe subscription toolbar topbar
    alert login share disclaimer""".split()
)
#: Words that a page's own header is named by, alone or together; that of an article holds the headline and stays.
HEADER = frozenset("header masthead banner topbar site page top main global wrapper container inner".split())
COMMENTS = frozenset(["comment", "comments", "commentlist", "discussion", "disqus", "replies", "respond", "responses"])
#: Headings behind which readers' comments begin.
COMMENT_HEADING = re.compile(r"(?:\d+\s+)?(?:reader\s+|user\s+)?(?:comments?|kommentare?|leserkommentare|commentaires?|comentarios?|responses|replies|leave a (?:comment|reply))(?:\s*[(:]?\s*\d*\s*\)?)", re.I)

MARKUP = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z)) | <[!?/](?![A-Za-z])[^>]*+(?:>|\Z) | <![A-Za-z][^>]*+(?:>|\Z)
    | <(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?>[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)
    | <(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Node:
    """An element: where its lines begin and end, and whether its text counts."""

    name: str
    parent: Node | None
    first: int
    words: frozenset = frozenset()
    hidden: bool = False
    like: str = ""
    last: int = 0
    holds: bool = False
    out: bool = False


@dataclass(slots=True)
class Line:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    size: int = 0


def _attributes(rest: str) -> tuple[frozenset, bool, str]:
    """(words of class, id and role, whether the element is hidden, what tells like elements)."""
    words, hidden, like = set(), False, ""
    for name, a, b, c in ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop"):
            value = html.unescape(value)
            words.update(w.lower() for w in WORD.findall(value))
            # sideBar and side-bar are a sidebar
            words.update(MARKS.intersection(re.sub(r"[^a-z]", "", one.lower()) for one in value.split()))
            if name == "class":
                like = value
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return frozenset(words), hidden, like


class Page:
    """The lines of a page and its elements."""

    def __init__(self, source: str):
        self.lines: list[Line] = []
        self.nodes: list[Node] = []
        root = Node("", None, 0)
        self.nodes.append(root)
        self.stack = [root]
        self.links = 0
        self._line()
        at, n = 0, len(source)
        while at < n:
            cut = source.find("<", at)
            if cut < 0:
                self._text(source[at:])
                break
            if cut > at:
                self._text(source[at:cut])
            m = MARKUP.match(source, cut)
            if not m:
                self._text("<")
                at = cut + 1
                continue
            at = m.end()
            name = m["name"] or m["name2"]
            if not name:
                continue
            name = name.lower()
            if m["close"] or m["close2"]:
                self._close(name)
            else:
                rest = m["rest"] if m["name"] else m["rest2"]
                self._open(name, rest or "")
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])|\Z", re.I).search(source, at)
                    at = end.start()
        while len(self.stack) > 1:
            self._pop()
        root.last = len(self.lines)
        for line in self.lines:
            line.text = " ".join(html.unescape("".join(line.parts)).split())
            line.size = len(line.text)

    def _line(self) -> None:
        self.lines.append(Line(self.stack[-1]))

    def _text(self, text: str) -> None:
        if not self.stack[-1].hidden:
            self.lines[-1].parts.append(text)
            if self.links:
                self.lines[-1].linked += len(text.strip())

    def _open(self, name: str, rest: str) -> None:
        if name in CLOSES:
            self._close_until(CLOSES[name])
        elif name in ENDS_P:
            self._close_until(CLOSES["p"])
        if name == "a":
            if self.links:
                self._close("a")
            self.links += 1
        if self.stack[-1].name == "head" and name not in IN_HEAD:
            self._pop()
        top = self.stack[-1]
        if name in INLINE:
            if name == "br":
                self.lines[-1].parts.append(" ")
            elif name not in VOID:
                hidden = top.hidden or bool(rest and _attributes(rest)[1])
                self.stack.append(Node(name, top, len(self.lines) - 1, hidden=hidden))
            return
        if name in VOID:
            if name == "hr":
                self._line()
            return
        words, hidden, like = _attributes(rest) if rest else (frozenset(), False, "")
        if name in ("td", "th") and not words & MARKS:  # a row is a line
            self.lines[-1].parts.append(" ")
            self.stack.append(Node(name, top, len(self.lines) - 1, words, top.hidden or hidden, name))
            return
        node = Node(name, top, len(self.lines), words, top.hidden or hidden or name in UNSEEN, like=f"{name} {like}")
        self.nodes.append(node)
        self.stack.append(node)
        self._line()

    def _pop(self) -> None:
        node = self.stack.pop()
        if node.name == "a":
            self.links -= 1
        if node.like in ("td", "th"):
            self.lines[-1].parts.append(" ")
        elif node.name not in INLINE:
            node.last = len(self.lines)
            self._line()

    def _close_until(self, names: frozenset) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name in names:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k].name in SCOPES:
                return

    def _close(self, name: str) -> None:
        if name == "p" and not any(n.name == "p" for n in self.stack):
            self._line()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name == name:
                while len(self.stack) > k:
                    self._pop()
                return
            if name in INLINE and self.stack[k].name not in INLINE:
                return


def _within(node: Node | None, names: tuple[str, ...]) -> bool:
    while node:
        if node.name in names:
            return True
        node = node.parent
    return False


def _take_out(page: Page) -> None:
    """Marks the elements whose text isn't the article's."""
    before = [0]
    for line in page.lines:
        before.append(before[-1] + (0 if line.node.hidden else line.size))
    size = lambda n: before[n.last] - before[n.first]
    # the article proper: the largest one that isn't part of another or of something aside
    own = lambda n: n.name == "article" and not n.words & COMMENTS and not _within(n.parent, ("article", "aside", "footer", "nav"))
    articles = [n for n in page.nodes if not n.hidden and own(n)]
    for n in [n for n in page.nodes if not n.hidden and n.name == "main"] + ([max(articles, key=size)] if articles else []):
        up = n.parent
        while up and not up.holds:
            up.holds = True
            up = up.parent
    whole = before[-1]
    asides = sum(size(n) for n in page.nodes if n.name in ASIDE and not n.hidden and not n.holds and not _within(n.parent, tuple(ASIDE)))
    for n in page.nodes:
        if n.parent and n.parent.out:
            n.out = True
        elif n.hidden or n.name in ("", "html", "body", "main"):
            n.out = n.hidden
        else:
            rest = whole - asides - size(n)
            inside = _within(n.parent, ("article", "main"))
            if n.name in ASIDE or n.name == "header" and not inside:
                n.out = not n.holds
            elif n.holds:
                continue
            elif n.words & COMMENTS:
                n.out = rest >= SURGE
            elif n.name == "form" or n.words & MARKS - HEADER or n.words and n.words <= HEADER and n.words & MARKS | n.words & {"header"} and not inside:
                n.out = 4 * rest >= size(n)


def _comments_begin(page: Page, kept: list[int]) -> set[int]:
    """The lines from a heading of readers' comments to the end of the element around it, where enough text stands before it."""
    gone: set[int] = set()
    seen = 0
    for i in kept:
        line = page.lines[i]
        if i not in gone and line.size and seen >= SURGE and line.node.name in HEADINGS and COMMENT_HEADING.fullmatch(line.text):
            gone.update(range(i, line.node.parent.last))
        seen += line.size
    return gone


def surges(weights: list[int]) -> list[tuple[int, int]]:
    """Runs of lines from a surge to the dive behind it: [first, behind the last)."""
    sums = [0]
    for w in weights:
        sums.append(sums[-1] + w)
    n = len(weights)
    window = lambda i: sums[min(i + WINDOW, n)] - sums[i]
    runs, begin = [], None
    for i in range(n):
        if begin is None and 4 * weights[i] >= SURGE and window(i) >= SURGE:
            begin = i
        elif begin is not None and sums[min(i + DIVE, n)] == sums[i]:
            runs.append((begin, i))
            begin = None
    return runs + ([(begin, n)] if begin is not None else [])


def _chain(node: Node) -> list[Node]:
    found = []
    while node:
        found.append(node)
        node = node.parent
    return found[::-1]


def _around(lines: list[Line]) -> Node:
    """The smallest element that holds all the lines."""
    common = _chain(lines[0].node)
    for line in lines[1:]:
        other = _chain(line.node)
        k = 0
        while k < min(len(common), len(other)) and common[k] is other[k]:
            k += 1
        common = common[:k]
    return common[-1]


def _is_links(line: Line) -> bool:
    return line.size > 0 and line.linked >= LINKS * line.size


def blocks(source: str) -> list[str]:
    """The blocks of a page's main text, in the page's order."""
    page = Page(source)
    _take_out(page)
    kept = [i for i, line in enumerate(page.lines) if not line.node.out and not line.node.hidden]
    gone = _comments_begin(page, kept)
    kept = [i for i in kept if i not in gone]
    if not any(page.lines[i].size for i in kept):
        return []
    size = lambda n: sum(page.lines[i].size for i in kept if n.first <= i < n.last)
    scope = page.nodes[0]
    for choice in (
        lambda n: n.name == "article" and not _within(n.parent, ("article",)),
        lambda n: "articlebody" in "".join(sorted(n.words)) or {"article", "body"} <= n.words and n.name in ("div", "section"),
        lambda n: n.name == "main" or "main" in n.words and n.name != "body",
    ):
        found = [n for n in page.nodes if choice(n) and not n.out and not n.hidden]
        best = max(found, key=size, default=None)
        if best and size(best) >= SURGE:
            scope = best
            break
    inside = [i for i in kept if scope.first <= i < scope.last] if scope is not page.nodes[0] else kept
    chosen = inside if scope.name == "article" else _core(page, inside, scope)
    return [page.lines[i].text for i in _without_lists(page, chosen) if page.lines[i].size]


def _core(page: Page, inside: list[int], scope: Node) -> list[int]:
    """The lines between surge and dive with the most text, grown to the element around them."""
    lines = [page.lines[i] for i in inside]
    weights = [0 if _is_links(x) else x.size - min(x.linked, x.size) for x in lines]
    runs = surges(weights)
    if not runs:  # a short text: from its first line to its last, or the longest run without a gap
        ends = [k for k, w in enumerate(weights) if w]
        if not ends:
            return inside
        groups, at = [], ends[0]
        for a, b in zip(ends, ends[1:] + [None]):
            if b is None or b - a > DIVE:
                groups.append((at, a + 1))
                at = b
        runs = groups
    first, behind = max(runs, key=lambda r: sum(weights[r[0] : r[1]]))
    around = _around([lines[k] for k in range(first, behind) if weights[k]])
    top = ("", "html", "body")
    while around.name in PROSE and around is not scope and around.parent.name not in top:
        around = around.parent
    while around.name not in (*top, "main") and around is not scope and around.parent.name not in top:
        up = around.parent
        like = unlike = heads = 0
        for k, w in enumerate(weights):
            if w and up.first <= inside[k] < up.last and not around.first <= inside[k] < around.last:
                if lines[k].node.name in HEADINGS:
                    heads += w
                elif _child(lines[k].node, up).like == around.like or _plain(lines[k].node, up):
                    like += w
                else:
                    unlike += w
        if not (like >= max(unlike, 1) or heads and unlike < SURGE):
            break
        around = up
    if around.name not in top:
        return [i for i in inside if around.first <= i < around.last]
    plain = lambda k: lines[k].size == 0 or _plain(lines[k].node, around) and not _is_links(lines[k])
    while first > 0 and plain(first - 1):
        first -= 1
    while lines[behind - 1].size < SURGE <= sum(weights[first : behind - 1]) and not plain(behind - 1):
        behind -= 1
        while lines[behind - 1].size == 0:
            behind -= 1
    while behind < len(lines) and plain(behind):
        behind += 1
    return inside[first:behind]


def _child(node: Node, up: Node) -> Node:
    """The child of `up` that holds the node, or the node itself."""
    while node.parent is not None and node.parent is not up and node is not up:
        node = node.parent
    return node


def _plain(node: Node, up: Node) -> bool:
    """Whether a line of prose stands in `up` with nothing but lists, tables or quotations between."""
    if node.name not in PROSE:
        return False
    node = node.parent
    while node is not None and node is not up:
        if node.name not in HOLDERS:
            return False
        node = node.parent
    return node is up


def _without_lists(page: Page, chosen: list[int]) -> list[int]:
    """Without three or more lines of links in a row outside paragraphs: menus that markup doesn't name."""
    out, run = [], []
    for i in chosen:
        line = page.lines[i]
        if line.size and not (_is_links(line) and line.node.name not in ("p", *HEADINGS)):
            out += (run if sum(page.lines[k].size > 0 for k in run) < 3 else []) + [i]
            run = []
        elif line.size or run:
            run.append(i)
    return out + (run if sum(page.lines[k].size > 0 for k in run) < 3 else [])


def main_text(source: str | None) -> str:
    return "\n\n".join(blocks(source or ""))


def extract(pages: DataFrame, content: str = "html", into: str = "text") -> DataFrame:
    """Replaces the pages by their main text and its length: adds `into` and n_chars and drops the content."""
    pages = pages.drop(*[c for c in (into, "n_chars") if c != content])
    carried = [f for f in pages.schema.fields if f.name != content]
    made = [StructField(into, StringType()), StructField("n_chars", LongType())]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            texts = [main_text(x) for x in b[content].to_pylist()]
            yield {f.name: b[f.name] for f in carried} | {into: pa.array(texts, pa.large_string()), "n_chars": [len(t) for t in texts]}

    return map_batches(pages.withColumn(content, F.col(content).cast("string")), run, StructType(carried + made))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op12_main_text": op12_main_text}
#: The markup of a page has no SQL form; tests compare texts with hand-made pages and with the supplied pages' own layout.
ORACLES: dict[str, str] = {}
