"""Layout-aware HTML rendering (operator 6).

A tokenizer and a tree builder with implied tags (an open ``p``, ``li``, table cell, ...
ends where its successor or its container's end says so) make a tree; what is no part of a
table moves before it, and a form directly in a table is transparent; visibility rules
drop what a browser would not show (what is hidden by inherited visibility shows again where
it is set visible; of closed ``details`` the summary shows); the renderer writes all visible text.  Blocks stand on
lines of their own, paragraphs and the like with an empty line between, list items with
their marks and indents, and the cells of a table in columns padded to one width; a
cell of several rows keeps its columns in the rows below, to the end of its row group at most.

Each page is rendered on its own, so the step is narrow.  Tree and renderer keep their own
stacks: depth of nesting is not bounded by the interpreter's.

Defined cases: a null or empty page renders to an empty text; unclosed and stray tags,
comments and quotes never raise; text outside ``body`` is body text; repeated pages each
get their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
import unicodedata
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, prepare, texts

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title"}
HIDDEN = {"head", "script", "style", "template", "title", "noscript", "iframe", "object", "audio", "video", "canvas",
          "datalist", "noembed", "noframes", "param"}
# not shown inside svg or math; there, text elements stand on lines of their own
FOREIGN = {"svg", "math"}
FOREIGN_HIDDEN = {"desc", "metadata", "defs", "symbol", "clippath", "mask", "pattern", "marker", "annotation", "annotation-xml"}
FOREIGN_LINES = {"text", "foreignobject"}
# HTML content begins again inside these, and these start tags end svg or math
_INTEGRATION = {"foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
_BREAKOUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu "
                "meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "table", "ul", "ol", "dl", "hr",
          "fieldset"}
BLOCK = SPACED | {"html", "body", "address", "article", "aside", "details", "dialog", "dd", "div", "dt", "figcaption",
                  "footer", "form", "header", "hgroup", "legend", "li", "main", "menu", "nav", "section", "summary",
                  "center", "optgroup", "option", "caption"}
TABLE = {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}
# a start tag closes these open elements, unless one of the barriers is nearer
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
           "td": ({"td", "th", "caption"}, {"table"}), "th": ({"td", "th", "caption"}, {"table"}),
           "tr": ({"tr", "td", "th", "caption"}, {"table"}),
           **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
           "body": ({"head"}, set())}
# parts of a table, and the open elements a part's start tag goes back to
PARTS = {"caption": {"table"}, "colgroup": {"table"}, "col": {"table", "colgroup"}, **{t: {"table"} for t in ("thead", "tbody", "tfoot")},
         "tr": {"table", "thead", "tbody", "tfoot"}, **{t: {"table", "thead", "tbody", "tfoot", "tr"} for t in ("td", "th")}}
# directly in these stand only parts of a table; other content moves before the table
STRICT = {"table", "colgroup", "thead", "tbody", "tfoot", "tr"}
CLOSES_P = BLOCK - {"html", "body", "li", "dt", "dd", "option", "optgroup", "caption", "legend", "summary"}
_P_BARRIER = {"td", "th", "caption", "table", "button", "object"}

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|[!?](?P<decl>[^>]*)(?:>|\Z)|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|"""
                  r"""(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_STYLE_OFF = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "shown")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.shown = tag, attrs, [], True

    def attributes(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for name, *values in _ATTR.findall(self.attrs):
            out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
        return out

    def hidden(self) -> bool:
        if self.tag in HIDDEN:
            return True
        if not self.attrs:
            return False
        a = self.attributes()
        return ("hidden" in a and a["hidden"].lower() != "until-found" or bool(_STYLE_OFF.search(a.get("style", "")))
                or (self.tag == "dialog" and "open" not in a))

    def settle(self, inherited: bool) -> None:
        """Whether its own text shows, given its parent's; a closed ``details`` keeps its summary alone."""
        own = _VISIBILITY.findall(self.attributes().get("style", "")) if "isibility" in self.attrs or "ISIBILITY" in self.attrs else []
        self.shown = own[-1].lower() == "visible" if own else inherited
        if self.tag == "details" and "open" not in self.attributes():
            self.children = [c for c in self.children if isinstance(c, Node) and c.tag == "summary"][:1]


def parse(page: str) -> Node:
    root = Node("#root")
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements in the stack, by tag
    page = page.replace("\r\n", "\n").replace("\0", "")

    def add(x: Node | str) -> None:
        if stack[-1].tag in STRICT and not (isinstance(x, Node) and (x.tag in PARTS or x.tag in HIDDEN)):
            # an open table is its parent's last child
            stack[places["table"][-1] - 1].children.insert(-1, x)
        else:
            stack[-1].children.append(x)

    def text(raw: str) -> None:
        if raw and not (stack[-1].tag in STRICT and not raw.strip(" \t\n\r\f")):
            add(html.unescape(raw) if "&" in raw else raw)

    def push(node: Node) -> None:
        places[node.tag].append(len(stack))
        stack.append(node)

    def cut(to: int) -> None:
        while len(stack) > to:
            places[stack.pop().tag].pop()

    def nearest(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(names: set[str], barrier: set[str]) -> None:
        """Close up to the outermost of ``names`` inside the nearest barrier."""
        floor = nearest(barrier)
        inside = [places[t][k] for t in names if places.get(t) and (k := bisect.bisect_right(places[t], floor)) < len(places[t])]
        if inside:
            cut(min(inside))

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _TAG.match(page, lt)
        if not m:  # a lone < is text
            text(page[at:lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        if m["start"]:
            tag = m["start"].lower()
            while tag in _BREAKOUT and (inside := nearest(FOREIGN)) > nearest(_INTEGRATION):
                cut(inside)
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag in CLOSES_P:
                close({"p"}, _P_BARRIER)
            if tag in PARTS and places.get("table"):
                cut(max(nearest(PARTS[tag]), places["table"][-1]) + 1)
                if tag in ("tr", "td", "th") and stack[-1].tag == "table":
                    add(b := Node("tbody"))
                    push(b)
                if tag in ("td", "th") and stack[-1].tag != "tr":
                    add(r := Node("tr"))
                    push(r)
                if tag == "col" and stack[-1].tag == "table":
                    continue
            elif tag in PARTS and tag in STRICT:
                continue  # no table to be part of
            if tag == "table" and stack[-1].tag in STRICT:  # one directly in another follows it
                cut(places["table"][-1])
            if tag == "form" and stack[-1].tag in STRICT:
                continue  # has no content there
            foreign = bool(places.get("svg") or places.get("math"))
            node = Node(tag, m["attrs"] + " hidden" if foreign and tag in FOREIGN_HIDDEN else m["attrs"])
            if tag in ("html", "body") and places.get(tag):
                continue  # a second one adds nothing
            add(node)
            if foreign and m["attrs"].endswith("/"):
                continue
            if tag in VOID or m["attrs"].endswith("/") and tag in ("svg", "math"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                stop = end.start() if end else n
                raw = page[at:stop]
                node.children.append(html.unescape(raw.removeprefix("\n")) if tag == "textarea" else raw)
                at = end.end() if end else n
            elif tag == "plaintext":
                node.children.append(page[at:])
                break
            else:
                push(node)
        elif m["end"]:
            tag = m["end"].lower()
            if tag == "br":
                add(Node("br"))
            elif tag == "p" and not places.get("p"):
                add(Node("p"))
            elif tag not in ("html", "body"):
                # an end tag does not reach out of a table, nor an inline one out of its cell
                barrier = set() if tag == "table" else {"table"} if tag in BLOCK | TABLE else {"table", "td", "th"}
                if places.get(tag) and places[tag][-1] >= nearest(barrier):
                    cut(places[tag][-1])
    return root


def width(s: str) -> int:
    """Columns of a text: wide characters take two, combining ones none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Lines under construction: inline text collapses white space, blocks break lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.filled = False
        self.gap = False  # an empty line is due
        self.indent = ""
        self.mark: str | None = None  # a list mark that stands before the next line

    def inline(self, raw: str) -> None:
        s = _SPACE.sub(" ", raw)
        if s == " " or not s:
            self.space = self.space or bool(s and self.filled)
            return
        if s[0] == " " or self.space:
            s = (" " if self.filled else "") + s.lstrip(" ")
        self.space = s[-1] == " "
        self.parts.append(s.rstrip(" "))
        self.filled = True

    def verbatim(self, raw: str) -> None:
        first, *more = raw.split("\n")
        for k, s in enumerate([first, *more]):
            if k:
                self.flush(force=True)
            if s:
                self.parts.append((" " if self.space else "") + s)
                self.space, self.filled = False, True

    def flush(self, force: bool = False) -> None:
        """End the line."""
        if self.filled or force or (self.mark is not None and force):
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            line = "".join(self.parts)
            if self.mark is not None:
                line = self.indent[:len(self.indent) - len(self.mark)] + self.mark + line
                self.mark = None
            elif line:
                line = self.indent + line
            self.lines.append(line)
        self.parts, self.space, self.filled = [], False, False

    def spaced(self) -> None:
        self.flush()
        self.gap = True

    def text(self) -> str:
        self.flush()
        return "\n".join(self.lines)


def _cells(table: Node) -> tuple[list[Node], list[list[list[Node]]]]:
    """Captions and the row groups of a table, head first and foot last."""
    captions, parts = [], {"thead": [], "tbody": [], "tfoot": []}
    for x in table.children:
        if not isinstance(x, Node) or x.hidden():
            continue
        if x.tag == "caption":
            captions.append(x)
        elif x.tag in parts:
            parts[x.tag].append([[c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th") and not c.hidden()]
                                 for r in x.children if isinstance(r, Node) and r.tag == "tr" and not r.hidden()])
    return captions, parts["thead"] + parts["tbody"] + parts["tfoot"]


def _span(cell: Node) -> tuple[int, int]:
    """Columns and rows of a cell; rows 0: to the end of the group. The limits are the HTML standard's."""
    a = cell.attributes() if "span" in cell.attrs.lower() else {}
    col, row = a.get("colspan", "").strip(), a.get("rowspan", "").strip()
    number = re.compile("[0-9]{1,9}").fullmatch
    return max(1, min(int(col), 1000)) if number(col) else 1, min(int(row), 65534) if number(row) else 1


def _placed(group: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, str]]]:
    """(column, columns, content) of the cells of a row group's rows: each at the first column that no cell above holds."""
    free: list[tuple[int, float]] = [(0, float("inf"))]  # columns that no cell of a row above holds, in order
    ends: dict[int, list[tuple[int, float]]] = defaultdict(list)  # columns that are free again from a row on
    out = []
    for r, row in enumerate(group):
        for x in ends.pop(r, ()):
            bisect.insort(free, x)
        at, cells = 0, []
        for content, span, rows in row:
            k = max(bisect.bisect_right(free, (at, float("inf"))) - 1, 0)
            if free[k][1] <= at:
                k += 1
            at = max(at, free[k][0])
            cells.append((at, span, content))
            stop = at + span
            if rows != 1:
                while k < len(free) and free[k][0] < stop:  # where it overlaps another, that one keeps the columns
                    a, b = free.pop(k)
                    rest = [(x, y) for x, y in ((a, min(at, b)), (stop, b)) if x < y]
                    free[k:k] = rest
                    k += bool(rest) and rest[0][0] < at
                    if rows:
                        ends[r + rows].append((max(a, at), min(b, stop)))
                    if rest and rest[-1][0] == stop:
                        break
            at = stop
        out.append(cells)
    return out


def _aligned(rows: list[list[tuple[int, int, str]]]) -> list[str]:
    """Lines of a table: every column as wide as its widest line, two blanks between."""
    wide: dict[int, int] = {}
    split = [[(col, span, content.split("\n")) for col, span, content in row] for row in rows]
    for col, span, lines in itertools.chain.from_iterable(split):
        if span == 1:
            wide[col] = max(wide.get(col, 0), max(map(width, lines)))
    columns = sorted(wide)
    ahead = [0, *itertools.accumulate(wide[c] + 2 for c in columns)]
    out = []
    for cells in split:
        for k in range(max((len(c[2]) for c in cells), default=0)):
            line, used = [], 0
            for n, (col, _, lines) in enumerate(cells):
                s = lines[k] if k < len(lines) else ""
                if s:
                    pad = max(ahead[bisect.bisect_left(columns, col)] - used, 2 if n and used else 0)
                    line.append(" " * pad + s)
                    used += pad + width(s)
            out.append("".join(line).rstrip())
    return out


def render(page: str | None) -> str:
    """All visible text of a page."""
    root = parse(page or "")
    # tables are rendered inside out: each finished one becomes a list of lines
    done: dict[int, list[str]] = {}
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.attrs or x.tag == "details":
            x.settle(x.shown)
        if x.tag == "table":
            order.append(x)
        inside = [c for c in x.children if isinstance(c, Node) and not c.hidden()]
        for c in inside:
            c.shown = x.shown
        todo += inside
    for table in reversed(order):  # found before the tables inside it
        captions, groups = _cells(table)
        lines = [line for c in captions for line in _flow(c, done).split("\n") if line]
        rows = [r for group in groups for r in _placed([[(_flow(c, done), *_span(c)) for c in row] for row in group])]
        lines += _aligned([r for r in rows if any(content for _, _, content in r)])
        done[id(table)] = lines
    return _flow(root, done)


def _whole(written: str | None, other: int) -> int:
    return int(written) if re.fullmatch(r"\s*-?[0-9]{1,9}\s*", written or "") else other


def _steps(x: Node) -> list[tuple[str, object]]:
    """A node's children, last first; its own text only where that shows."""
    return [("text" if isinstance(c, str) else "in", c) for c in reversed(x.children) if x.shown or isinstance(c, Node)]


def _flow(top: Node, done: dict[int, list[str]]) -> str:
    page = Page()
    lists: list[list] = []  # [kind, next number, step]
    indents: list[str] = []
    pre = 0
    # ("in", node) enters, ("out", node) leaves, ("text", s) writes
    todo: list[tuple[str, object]] = _steps(top)
    while todo:
        what, x = todo.pop()
        if what == "text":
            (page.verbatim if pre else page.inline)(x)
            continue
        tag = x.tag
        if what == "in":
            if x.hidden():
                continue
            if tag == "br":
                page.flush(force=True)
                continue
            if tag == "wbr":
                continue
            if x.shown and tag in ("option", "optgroup") and x.attrs and (tag == "optgroup" or not x.children):
                page.flush()
                page.inline(x.attributes().get("label", ""))
                page.flush()
            if tag in ("img", "input"):
                a = x.attributes()
                shown = a.get("alt", "") if tag == "img" else (
                    a.get("value", "") if a.get("type", "text").lower() in ("submit", "button", "reset") else "")
                if x.shown and shown.strip():
                    page.inline(shown)
                continue
            if tag == "table" and id(x) in done:
                page.spaced()
                for line in done[id(x)]:
                    page.parts, page.filled = [line], True
                    page.flush(force=True)
                page.spaced()
                continue
            if tag in SPACED and not (tag in ("ul", "ol") and lists):
                page.spaced()
            elif tag in BLOCK or tag in TABLE or tag in FOREIGN_LINES:
                page.flush()
            if tag == "hr":
                continue
            if tag in ("ul", "ol", "menu"):
                a = x.attributes() if tag == "ol" and x.attrs else {}
                first = sum(isinstance(c, Node) and c.tag == "li" and not c.hidden() for c in x.children) if "reversed" in a else 1
                lists.append([tag, _whole(a.get("start"), first), -1 if "reversed" in a else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1, 1]
                if x.attrs and kind[0] == "ol":
                    kind[1] = _whole(x.attributes().get("value"), kind[1])
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += kind[2]
                if page.mark is not None:  # the item outside holds nothing before its list
                    page.flush(force=True)
                indents.append(page.indent)
                page.indent += " " * len(mark)
                page.mark = mark if x.shown else None
            elif tag in ("dd", "blockquote"):
                indents.append(page.indent)
                page.indent += "  "
            elif tag == "q" and x.shown:
                page.inline('"')
            elif tag in ("pre", "textarea"):
                pre += 1
            if not x.children and tag not in BLOCK and tag not in TABLE:
                continue
            todo.append(("out", x))
            todo += _steps(x)
            continue
        if tag in ("pre", "textarea"):
            pre -= 1
        if tag == "q" and x.shown:
            page.parts.append('"')
            page.filled = True
        if tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1):
            page.spaced()
        elif tag in BLOCK or tag in TABLE or tag in FOREIGN_LINES:
            page.flush()
        if tag in ("ul", "ol", "menu") and lists:
            lists.pop()
        elif tag in ("li", "dd", "blockquote"):
            if tag == "li":
                page.mark = None
            page.indent = indents.pop()
    return page.text()


def rendered(pages: DataFrame) -> DataFrame:
    """(page_id, text): the visible text of every page."""
    prepare(pages.sparkSession)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([render(x) for x in texts(b.column(1))], pa.string())],
                                          ["page_id", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(pages.select("page_id", "html"), batch, f"page_id {kind}, text string")


def report(pages: DataFrame) -> DataFrame:
    """page_id, n_lines, n_chars, text_sha256, text."""
    out = rendered(pages)
    lines = F.when(F.length("text") == 0, 0).otherwise(F.size(F.split("text", "\n")))
    return out.select("page_id", lines.cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"),
                      F.sha2("text", 256).alias("text_sha256"), "text")
