"""Visible text of HTML pages by layout-aware rendering.

A tokenizer feeds a tree builder that knows void elements, raw-text elements and implied end tags; the tree is rendered to lines. Blocks
stand on lines of their own, paragraphs, headings, lists, quotes and tables are set off by a blank line, list items get a marker
and indentation, preformatted text keeps its white space, other white space is collapsed, and the cells of a table's columns are padded to
equal width; cells keep their place beside others that span rows or columns. Invisible are: what has no box (head, script, style, template,
noscript and the like), elements with `hidden`, with display:none or visibility hidden or collapse in their style attribute (the last valid
declaration counts, important ones before others; a display that is given outweighs `hidden`), and closed dialogs. visibility visible or initial
inside shows again, inherit and unset change nothing. Of inputs the captions (value) of buttons come out, of drawings the text of text and
foreignObject elements, of formulas all but annotations. Everything else that is visible comes out: navigation, footers and advertisements as well.

Time grows with the length of a page, and so does the output, whatever the nesting: indentation ends at MAX_INDENT columns; cells of several lines, or
wider than MAX_CELL, don't count for the width of their column; a cell begins at column MAX_PAD at most, else two spaces after the one before;
tables within more than MAX_TABLES others have their cells on lines of their own; MAX_SPAN bounds the rows and columns that a cell spans.

Defined results: null and empty pages have an empty text. Unclosed and misnested tags are closed where HTML implies it, else with their parent;
end tags without a start are ignored, but </p> and </br> act as HTML says. Rendering walks the tree without recursion, so depth is no limit.
Widths count code points, full-width ones double. Repeated rows come out as often as they went in; other columns go through unchanged;
`extracted` is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes plaintext".split())
ESCAPABLE_RAW = set("title textarea".split())
NO_BOX = set("head script style template noscript iframe noembed noframes object audio video canvas datalist rp area base col colgroup link meta param source track title".split())
SVG_SHOWN, MATH_HIDDEN = {"text", "foreignobject"}, {"annotation", "annotation-xml"}
SVG_HIDDEN = set("defs symbol metadata desc title clippath mask pattern marker lineargradient radialgradient script style".split())
#: Start tags that end a drawing or formula, and the elements of these that hold HTML.
ENDS_FOREIGN = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HTML_WITHIN = ("foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext")
CAPTIONED = {"submit", "reset", "button"}
DISPLAYS = set("block inline inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell table-row-group table-header-group table-footer-group table-column table-column-group table-caption list-item contents flow-root flow ruby run-in none initial inherit unset revert".split())
VISIBILITIES = {"visible": True, "initial": True, "hidden": False, "collapse": False, "inherit": None, "unset": None, "revert": None}
BLOCKS = set("address article aside body center details dialog dd div dl dt fieldset figcaption figure footer form header hgroup html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table ul xmp blockquote h1 h2 h3 h4 h5 h6 hr caption tbody thead tfoot tr td th".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre table figure hr listing xmp plaintext".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul xmp dd dt plaintext".split())
#: A start tag (key) ends open elements of these names, unless one of the barriers is nearer.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, set()),
    "h1": ({"h1", "h2", "h3", "h4", "h5", "h6"}, {"div", "section", "article", "td", "th", "li", "body"}),
}
ENDS |= {f"h{i}": ENDS["h1"] for i in range(2, 7)}
#: A start tag that belongs in the body ends the head.
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title head html body".split())
#: An end tag does not reach past these; one of a table's part not past its table.
SCOPE = {"table", "td", "th", "caption", "template", "html"}
TABLE_PARTS = {"tr", "tbody", "thead", "tfoot", "td", "th", "caption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S)
LOOSE = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)>")
ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"[ \t\n\f\r]+")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
MAX_INDENT, MAX_CELL, MAX_PAD, MAX_TABLES, MAX_SPAN = 40, 80, 240, 6, 200


@dataclass(slots=True)
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(html: str) -> Node:
    root = Node("#root")
    open_: list[Node] = [root]
    places: dict[str, list[int]] = {}  # of each name, where it stands in open_
    at, gt = 0, -1

    def close(n: int) -> None:
        for node in reversed(open_[n:]):
            places[node.name].pop()
        del open_[n:]

    def last(names: Iterable[str]) -> int:
        """The innermost open element of names, 0 if there is none."""
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def end_any(names: set[str], barriers: set[str]) -> None:
        """Closes the outermost of names above the nearest barrier."""
        barrier = last(barriers)
        found = [of[i] for x in names if (of := places.get(x)) and (i := bisect_right(of, barrier)) < len(of)]
        if found:
            close(min(found))

    def text(s: str) -> None:
        if s:
            if open_[-1].name == "head" and s.strip():
                close(len(open_) - 1)
            open_[-1].children.append(unescape(s) if "&" in s else s)

    n = len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        if gt < lt:
            gt = html.find(">", lt)
            gt = gt if gt >= 0 else n
        if gt == n and not html.startswith("<!--", lt):  # no tag ends from here on
            end = html.find("<!--", lt)
            text(html[at : end if end >= 0 else n])
            break
        m = TOKEN.match(html, lt) or LOOSE.match(html, lt)
        if m is None:
            text(html[at : lt + 1])
            at = lt + 1
            continue
        text(html[at:lt])
        at = m.end()
        if not m.re.groups or not m["name"]:
            continue
        name = m["name"].lower()
        if m["close"]:
            if name == "br":
                open_[-1].children.append(Node("br"))
                continue
            barriers = ({"table"} if name in TABLE_PARTS else SCOPE) if name not in ("table", "html", "body") else ()
            i = last(HEADINGS if name in HEADINGS else (name,))
            if i and i >= last(barriers):
                close(i)
            elif name == "p":
                open_[-1].children.append(Node("p"))
            continue
        foreign = last(("svg", "math"))
        if foreign and name in ENDS_FOREIGN and foreign > last(HTML_WITHIN):
            close(foreign)
        if name not in IN_HEAD:
            end_any({"head"}, {"body", "template"})
        if name in ENDS_P:
            end_any({"p"}, {"table", "td", "th", "caption", "button", "template", "object"})
        if name in ENDS:
            end_any(*ENDS[name])
        node = Node(name, attributes(m["attrs"]) if m["attrs"].strip(" \t\n\f\r/") else {})
        open_[-1].children.append(node)
        if name in VOID or foreign and m["attrs"].endswith("/"):
            continue
        if name in RAW or name in ESCAPABLE_RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at) if name != "plaintext" else None
            inside = html[at : end.start() if end else n]
            if inside:
                node.children.append(unescape(inside) if name in ESCAPABLE_RAW else inside)
            at = end.end() if end else n
            continue
        places.setdefault(name, []).append(len(open_))
        open_.append(node)
    return root


def shown(node: Node) -> tuple[bool, bool | None]:
    """(has a box, visibility that it sets)."""
    a = node.attrs
    if node.name in NO_BOX or node.name == "input" and a.get("type", "").strip().lower() not in CAPTIONED:
        return False, None
    display, visibility = declared(a["style"]) if a.get("style") else (None, None)
    if display == "none" or display is None and ("hidden" in a or node.name == "dialog" and "open" not in a):
        return False, None
    return True, VISIBILITIES.get(visibility)


def declared(style: str) -> tuple[str | None, str | None]:
    """The display and the visibility that a style attribute sets."""
    found: dict[str, tuple[bool, str]] = {}
    for part in COMMENT.sub(" ", style).lower().split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip(), value.strip()
        important = value.endswith("important") and value.removesuffix("important").rstrip().endswith("!")
        value = value.partition("!")[0].strip()
        if (value in VISIBILITIES if name == "visibility" else name == "display" and value in DISPLAYS) and important >= found.get(name, (False,))[0]:
            found[name] = (important, value)
    return tuple(found.get(k, (False, None))[1] for k in ("display", "visibility"))


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of one block of text."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []  # of the line that is open
        self.space = False  # collapsed white space that waits for more text
        self.gap = 0  # 1: the next text begins a line, 2: after a blank one
        self.indent = 0
        self.marker = ""

    def words(self, text: str) -> None:
        text = SPACE.sub(" ", text)
        if text == " " or not text:
            self.space |= bool(text) and bool(self.now)
            return
        lead = text[0] == " " and bool(self.now) or self.space
        self.begin()
        self.now.append((" " if lead and self.now else "") + text.strip(" "))
        self.space = text[-1] == " "

    def begin(self) -> None:
        if not self.now:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0

    def end(self, gap: int) -> None:
        """The open line ends, if there is one."""
        if self.now or self.marker and gap < 0:
            self.put("".join(self.now))
            self.now = []
        self.space = False
        self.gap = max(self.gap, gap)

    def put(self, line: str) -> None:
        pad = " " * max(0, min(self.indent, MAX_INDENT) - len(self.marker)) + self.marker
        self.marker = ""
        self.lines.append((pad + line).rstrip(" "))

    def newline(self) -> None:
        if self.now:
            self.end(1)
        elif self.lines and not self.gap:
            self.gap = 2
        else:
            self.gap = min(2, self.gap + 1)

    def raw(self, lines: list[str]) -> None:
        for line in lines:
            self.begin()
            self.put(line)

    def preformatted(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self.begin()
        self.now.append(first)
        for line in rest:
            self.put("".join(self.now))
            self.now = [line] if line else []
        self.space = False

    def done(self) -> list[str]:
        self.end(0)
        return self.lines


Cell = tuple[int, int, list[str]]  # columns and rows spanned (0: all that follow), lines


def placed(rows: list[list[Cell]]) -> list[list[tuple[int, int, list[str]]]]:
    """(column, columns spanned, lines) of each row's cells, beside those that reach down from above."""
    taken: dict[int, float] = {}  # by column, the first row in which it is free again
    out = []
    for r, row in enumerate(rows):
        at, cells = 0, []
        for span, down, lines in row:
            while at < MAX_SPAN and taken.get(at, 0) > r:
                at += 1
            for k in range(at, min(at + span, MAX_SPAN)) if down != 1 else ():
                taken[k] = r + down if down else float("inf")
            cells.append((at, span, lines))
            at = min(at + span, MAX_SPAN)
        out.append(cells)
    return out


def laid_out(rows: list[list[Cell]]) -> list[str]:
    """A table's rows of cells, padded to their column's width and set two spaces apart."""
    grid = placed(rows)
    widths = [0] * (MAX_SPAN + 1)
    for row in grid:
        for at, span, lines in row:
            if span == 1 and len(lines) == 1 and (n := width(lines[0])) <= MAX_CELL:
                widths[at] = max(widths[at], n)
    begins, begin = [], 0
    for n in widths:
        begins.append(min(begin, MAX_PAD))
        begin += n + 2
    out = []
    for row in grid:
        for k in range(max([1, *(len(lines) for *_, lines in row)]) if row else 0):
            line, long = "", 0
            for at, _, lines in row:
                part = lines[k] if k < len(lines) else ""
                if part:
                    pad = max(begins[at] - long, 2 if long else 0)
                    line += " " * pad + part
                    long += pad + width(part)
            out.append(line.rstrip(" "))
    while out and not out[-1]:
        out.pop()
    return [x for x in out if x] if all(len(lines) <= 1 for row in rows for *_, lines in row) else out


class _Table:
    def __init__(self):
        self.rows: list[list[Cell]] = []


def spanned(node: Node, name: str, least: int) -> int:
    value = node.attrs.get(name, "1").strip()
    return min(MAX_SPAN, max(least, int(value))) if re.fullmatch(r"[0-9]{1,9}", value) else 1


def render(html: str) -> str:
    """The visible text."""
    flow = Flow()
    flows: list[Flow] = [flow]
    tables: list[_Table] = []
    lists: list[list] = []  # [ordered, next number]
    pre = 0
    inside: list[str] = []  # svg and math elements that are open
    todo: list[tuple] = [("open", parse(html), True)]
    while todo:
        what, node, visible = todo.pop()
        if what == "text":
            if visible and not (inside and inside[-1] == "svg"):
                flow.preformatted(node) if pre else flow.words(node)
            continue
        name = node.name
        if what == "open":
            box, sets = shown(node)
            if not box or inside and name in (SVG_HIDDEN if inside[-1] != "math" else MATH_HIDDEN):
                continue
            visible = visible if sets is None else sets
            if name == "br":
                flow.newline() if not pre else flow.preformatted("\n")
                continue
            if name == "img":
                continue
            if name == "input":
                if visible and node.attrs.get("value"):
                    flow.words(node.attrs["value"])
                continue
            if name in ("svg", "math"):
                inside.append(name)
            elif inside and name in SVG_SHOWN:
                flow.end(1)
                inside.append(name)
            if inside and name not in SVG_SHOWN and inside[-1] in ("svg", "math"):
                pass
            elif name in ("td", "th") and 0 < len(tables) <= MAX_TABLES:
                flows.append(flow := Flow())
            elif name == "tr" and 0 < len(tables) <= MAX_TABLES:
                tables[-1].rows.append([])
            elif name in BLOCKS:
                flow.end(2 if name in SPACED and not (lists and name in ("ul", "ol", "menu")) else 1)
                if name == "table":
                    tables.append(_Table())
                elif name in ("ul", "ol", "menu"):
                    start = node.attrs.get("start", "1")
                    lists.append([name == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                elif name == "li":
                    kind = lists[-1] if lists else [False, 1]
                    value = node.attrs.get("value", "")
                    kind[1] = int(value) if kind[0] and re.fullmatch(r"-?\d{1,9}", value) else kind[1]
                    flow.marker = f"{kind[1]}. " if kind[0] else "- "
                    kind[1] += 1
                    flow.indent += len(flow.marker)
                    node.attrs["#indent"] = str(len(flow.marker))
                elif name in ("dd", "blockquote"):
                    flow.indent += 4
                elif name in ("pre", "listing", "xmp", "plaintext"):
                    pre += 1
                    if node.children and isinstance(node.children[0], str):
                        node.children[0] = node.children[0].removeprefix("\r\n").removeprefix("\n")
            todo.append(("close", node, visible))
            todo += [("text" if isinstance(c, str) else "open", c, visible) for c in reversed(node.children)]
            continue
        if inside and name == inside[-1]:
            inside.pop()
            if name in SVG_SHOWN:
                flow.end(1)
        elif inside and inside[-1] in ("svg", "math"):
            pass
        elif name in ("td", "th") and 0 < len(tables) <= MAX_TABLES:
            lines = flow.done()
            flows.pop()
            flow = flows[-1]
            if not tables[-1].rows:
                tables[-1].rows.append([])
            tables[-1].rows[-1].append((spanned(node, "colspan", 1), spanned(node, "rowspan", 0), lines))
        elif name in BLOCKS and not (name == "tr" and 0 < len(tables) <= MAX_TABLES):
            if name in ("pre", "listing", "xmp", "plaintext"):
                pre -= 1
            flow.end(1)
            if name == "table":
                flow.raw(laid_out(tables.pop().rows))
            elif name in ("ul", "ol", "menu"):
                lists.pop()
            elif name == "li":
                flow.indent -= int(node.attrs["#indent"])
                flow.marker = ""
            elif name in ("dd", "blockquote"):
                flow.indent -= 4
            flow.end(2 if name in SPACED and not (lists and name in ("ul", "ol", "menu")) else 1)
    return "\n".join(flow.done())


@F.pandas_udf(T.StringType())
def _rendered(pages: pd.Series) -> pd.Series:
    return pd.Series([render(p) for p in pages], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """pages with extracted, the visible text of column html."""
    prepare(pages.sparkSession)
    return pages.drop("extracted").withColumn("extracted", _rendered(F.coalesce("html", F.lit(""))))
