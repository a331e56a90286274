"""Layout-aware HTML extraction: a small tree builder, then a renderer of everything that would be visible.

A hand-written scanner reads tags by the attribute states of HTML (quoted, unquoted, missing values), so each character
is looked at a bounded number of times. The builder applies implied tags (an opening p ends an open p, li ends li, td
ends td, and so on), void elements, raw text elements and character references. The renderer skips invisible elements,
keeps blocks apart, marks list items, and writes tables with aligned columns, inner tables first, so that nothing
recurses. Each page is one row's work; nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object canvas audio video select datalist title param".split())
UNSEEN_INSIDE = {"svg": frozenset("desc metadata defs symbol".split()), "math": frozenset("annotation annotation-xml".split())}
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
LISTS = frozenset({"ul", "ol", "menu"})
CLOSES_P = BLOCKS - {"body", "html", "li", "dd", "dt", "legend"}
P_SCOPE = frozenset({"td", "th", "button", "table", "div", "li"})
#: An opening tag ends the open elements of these names, as far as the nearest boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
CELL_ENDS = frozenset({"table", "td", "th"})
ENDS_CELLS = frozenset({"table", "tr", "tbody", "thead", "tfoot", "body", "html"})
KEPT = frozenset("style hidden type start colspan rowspan alt open".split())  # the attributes that matter here
DEEPEST = 512  # deeper elements become children of the deepest one kept, as in browsers
ALIGNED = 80  # columns are padded up to this width, cells over several columns up to four times that
SPANNING = 64  # columns up to which cells over several rows keep their place

NAME = re.compile(r"[^\s/>]*+")
GAP = re.compile(r"[\s/]*+")
BLANK = re.compile(r"\s*+")
ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*+")
UNQUOTED = re.compile(r"[^\s>]*+")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attrs", "children", "lines")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children, self.lines = name, attrs or {}, [], None


def read_tag(html: str, at: int) -> tuple[str, dict[str, str], bool, int]:
    """The tag whose name starts at a place: name, attributes, whether it closes itself, and where it ends (-1: never)."""
    n = len(html)
    found = NAME.match(html, at)
    name, attrs, at = found[0].lower(), {}, found.end()
    while True:
        gap = GAP.match(html, at)
        at = gap.end()
        if at >= n:
            return name, attrs, False, -1
        if html[at] == ">":
            return name, attrs, gap[0].endswith("/"), at + 1
        found = ATTRIBUTE.match(html, at)
        key, value, at = found[0].lower(), "", found.end()
        equals = BLANK.match(html, at).end()
        if equals < n and html[equals] == "=":
            at = BLANK.match(html, equals + 1).end()
            quote = html[at : at + 1]
            if quote in ('"', "'") and quote:
                stop = html.find(quote, at + 1)
                if stop < 0:
                    return name, attrs, False, -1
                value, at = html[at + 1 : stop], stop + 1
            else:
                found = UNQUOTED.match(html, at)
                value, at = found[0], found.end()
        if key in KEPT:
            attrs.setdefault(key, unescape(value) if "&" in value else value)


class Builder:
    def __init__(self):
        self.root = Node("#root")
        self.stack = [self.root]
        self.open: Counter[str] = Counter()  # names on the stack
        self.skipped: Counter[str] = Counter()  # names opened below DEEPEST
        self.outer: tuple[int, Node] | None = None  # the last outermost svg or math and its place in the stack

    def text(self, part: str) -> None:
        if part:
            self.stack[-1].children.append(unescape(part) if "&" in part else part)

    def cut(self, i: int) -> None:
        for node in self.stack[i:]:
            self.open[node.name] -= 1
        del self.stack[i:]

    def close(self, names, until) -> None:
        """Close the open elements of these names above the nearest of until."""
        if not any(self.open[x] for x in names):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name in until:
                return
            if self.stack[i].name in names:
                self.cut(i)

    def end(self, name: str) -> None:
        if self.skipped[name]:
            self.skipped[name] -= 1
        elif not self.open[name]:
            if name == "p":
                self.stack[-1].children.append(Node("p"))
        else:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].name == name:
                    self.cut(i)
                    break
                if self.stack[i].name in CELL_ENDS and name not in ENDS_CELLS:
                    break

    def start(self, name: str, attrs: dict[str, str], closed: bool) -> Node:
        stack = self.stack
        if name in IMPLIED:
            self.close(*IMPLIED[name])
        if name in CLOSES_P and self.open["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    self.cut(i)
                    break
                if stack[i].name in P_SCOPE:
                    break
        outer = self.outer
        foreign = stack[outer[0]].name if outer and outer[0] < len(stack) and stack[outer[0]] is outer[1] else ""
        if foreign == "svg" and name == "text":
            self.text(" ")  # such texts stand apart
        if name in UNSEEN_INSIDE.get(foreign, ()):
            attrs["hidden"] = ""
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in VOID or closed and (foreign or name in ("svg", "path", "math")):
            return node
        if name in UNSEEN_INSIDE and not foreign:
            self.outer = (len(stack), node)
        if name not in RAW:
            if len(stack) < DEEPEST:
                stack.append(node)
                self.open[name] += 1
            else:
                self.skipped[name] += 1
        return node


_ends: dict[str, re.Pattern] = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW}


def build(html: str) -> Node:
    """The tree of a page. A comment or an attribute that never ends takes the rest of the page, as in browsers; a tag
    that the page's end cuts off inside its name is text."""
    builder, at, n = Builder(), 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 >= n:
            builder.text(html[at:])
            break
        kind = html[lt + 1]
        after = html[lt + 2 : lt + 3] if kind == "/" else kind
        if after.isascii() and after.isalpha():
            builder.text(html[at:lt])
            begin = lt + 1 + (kind == "/")
            name, attrs, closed, stop = read_tag(html, begin)
            if stop < 0:
                if kind != "/" and begin + len(name) >= n:
                    builder.text(html[lt:])
                break
            at = stop
            if kind == "/":
                builder.end(name)
                continue
            node = builder.start(name, attrs, closed)
            if name in RAW:
                end = _ends[name].search(html, at)
                close = html.find(">", end.end()) if end else -1
                # an end tag that never closes is none, and as no later one closes either, the rest is the element's
                body = html[at : end.start()] if close >= 0 else html[at:]
                node.children.append(unescape(body) if name in ("textarea", "title") else body)
                at = close + 1 if close >= 0 else n
        elif kind in "!?" or kind == "/" and after:
            builder.text(html[at:lt])
            comment = html.startswith("<!--", lt)
            stop = html.find("-->" if comment else ">", lt + 2)
            if stop < 0:
                break
            at = stop + (3 if comment else 1)
        else:
            builder.text(html[at : lt + 1])
            at = lt + 1
    return builder.root


def displayed(node: Node) -> bool:
    if node.name in HIDDEN:
        return False
    attrs = node.attrs
    if node.name == "dialog" and "open" not in attrs:
        return False
    if not attrs:
        return True
    return not ("hidden" in attrs or "style" in attrs and NO_DISPLAY.search(attrs["style"]) or node.name == "input" and attrs.get("type", "").lower() == "hidden")


def visible(node: Node, inherited: bool) -> bool:
    """visibility is inherited, and an element inside a hidden one can be visible again."""
    found = VISIBILITY.search(node.attrs["style"]) if "style" in node.attrs else None
    return found[1].lower() == "visible" if found else inherited


class Page:
    """Lines of text: words with single spaces, a break at each block's edge, a blank line at each spaced edge."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.margins: list[int] = []  # of the open list items
        self.margin = 0
        self.mark = ""  # of the list item whose first word is still to come

    def indent(self, by: int) -> None:
        self.margins.append(by)
        self.margin += by

    def outdent(self) -> None:
        self.margin -= self.margins.pop()

    def start(self) -> str:
        """Begin a line; what stands before its first word."""
        if self.blank and self.lines:
            self.lines.append("")
        mark, self.mark, self.blank = self.mark, "", False
        return " " * (min(self.margin, ALIGNED) - len(mark)) + mark

    def write(self, text: str) -> None:
        for i, part in enumerate(SPACE.split(text)):
            self.space |= i > 0
            if part:
                if not self.line:
                    self.line.append(self.start())
                elif self.space:
                    self.line.append(" ")
                self.line.append(part)
                self.space = False

    def whole_lines(self, lines: list[str]) -> None:
        """Lines whose spaces stay, with blank lines around."""
        self.end(True)
        for line in lines:
            self.lines.append(f"{self.start()}{line}".rstrip())
        self.end(True)

    def end(self, blank: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        self.space = False
        self.blank |= blank

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines)


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def number(text: str, default: int) -> int:
    return int(text) if re.fullmatch(r"-?\d{1,9}", text, re.A) else default


def render(nodes: list, page: Page, seen: bool = True) -> None:
    """Write the nodes' visible text. The stack is explicit, and tables have their lines already."""
    work: list[tuple] = [(x, seen, False) for x in reversed(nodes)]
    numbers: list[int | None] = []  # of the open lists: the next item's
    while work:
        item, seen, over = work.pop()
        if isinstance(item, str):
            if seen:
                page.write(item)
            continue
        name = item.name
        if over:
            if name in LISTS:
                numbers.pop()
            page.end(name in SPACED and not (name in LISTS and numbers))
            if name == "li":
                page.outdent()
                page.mark = ""
            continue
        if not displayed(item):
            continue
        if item.attrs:
            seen = visible(item, seen)
        if name == "br":
            if not page.line:
                page.blank = bool(page.lines)
            page.end()
        elif name == "img":
            if seen:
                page.write(item.attrs.get("alt", ""))
        elif name == "table":
            page.whole_lines(item.lines)
        elif name == "pre":
            body = "".join(texts(item, seen)).strip("\n")
            page.whole_lines(body.split("\n") if body.strip() else [])
        else:
            if name in BLOCKS:
                page.end(name in SPACED and not (name in LISTS and numbers))
                work.append((item, seen, True))
            if name in LISTS:
                numbers.append(number(item.attrs.get("start", "1"), 1) if name == "ol" else None)
            elif name == "li":
                page.mark = "- "
                if numbers and numbers[-1] is not None:
                    page.mark = f"{numbers[-1]}. "
                    numbers[-1] += 1
                page.indent(len(page.mark))
            work.extend((c, seen, False) for c in reversed(item.children))


def texts(node: Node, seen: bool) -> Iterator[str]:
    """The text inside pre, with its spaces."""
    work: list[tuple] = [(node, seen)]
    while work:
        item, seen = work.pop()
        if isinstance(item, str):
            if seen:
                yield item
        elif item.name == "br":
            yield "\n"
        elif displayed(item):
            seen = visible(item, seen)
            if item.name == "img" and seen:
                yield item.attrs.get("alt", "")
            elif item.name == "table" and item.lines:
                yield "\n" + "\n".join(item.lines) + "\n"
            else:
                work.extend((c, seen) for c in reversed(item.children))


def cell_lines(nodes: list, seen: bool) -> list[str]:
    page = Page()
    render(nodes, page, seen)
    return [x for x in page.text().split("\n") if x]


def table_lines(table: Node, seen: bool) -> list[str]:
    """The table's rows with aligned columns; cells with several lines take several lines."""
    rows: list[list[tuple[list[str], int, int]]] = []  # cells: lines, columns, rows
    captions: list[str] = []
    work = [(x, seen) for x in reversed(table.children)]
    while work:
        item, seen = work.pop()
        if isinstance(item, str):
            if seen and item.strip():
                rows.append([([" ".join(item.split())], 1, 1)])
            continue
        if not displayed(item):
            continue
        seen = visible(item, seen)
        if item.name == "tr":
            cells = []
            for c in item.children:
                if isinstance(c, str):
                    if seen and c.strip():
                        cells.append(([" ".join(c.split())], 1, 1))
                elif displayed(c):
                    columns, down = (max(1, number(c.attrs.get(x, "1"), 1)) for x in ("colspan", "rowspan"))
                    inner = c.children if c.name in ("td", "th") else [c]
                    cells.append((cell_lines(inner, visible(c, seen)), min(1000, columns), min(65534, down)))
            rows.append(cells)
        elif item.name in ("td", "th"):
            rows.append([(cell_lines(item.children, seen), 1, 1)])
        elif item.name in ("thead", "tbody", "tfoot"):
            work.extend((x, seen) for x in reversed(item.children))
        else:
            captions += cell_lines(item.children if item.name == "caption" else [item], seen)
    return captions + aligned(rows)


def placed(rows: list) -> list[list[tuple[int, int, list[str]]]]:
    """The cells of each row with their first and last column; cells over several rows hold their columns."""
    out, held = [], []  # held: (first, last, rows left), in order
    for cells in rows:
        row, col, at = [], 0, 0
        for lines, columns, down in cells:
            while at < len(held) and held[at][0] < col + columns:
                col = max(col, held[at][1])
                at += 1
            row.append((col, col + columns, lines, down))
            col += columns
        out.append([x[:3] for x in row])
        held = [(a, b, n - 1) for a, b, n in held if n > 1] + [(a, b, n - 1) for a, b, _, n in row if n > 1 and b <= SPANNING]
        held.sort()
    return out


def aligned(rows: list) -> list[str]:
    grid = placed(rows)
    starts = sorted({a for row in grid for a, _, _ in row})
    widths = [0] * len(starts)
    spans = [[(i := bisect_left(starts, a), max(i + 1, bisect_left(starts, b)), lines) for a, b, lines in row] for row in grid]
    for row in spans:
        for i, j, lines in row:
            if j == i + 1:
                widths[i] = max(widths[i], *(min(ALIGNED, width(x)) for x in lines), 0)
    total = [0, *accumulate(w + 3 for w in widths)]
    out = []
    for row in spans:
        k, left = 0, [cell for cell in row if cell[2]]
        while left:  # cells that still have lines, so that a tall cell in a wide row costs its own lines only
            parts, at = [], 0
            for i, j, lines in left:
                if i > at:  # columns that cells above hold, that are empty, or whose cells have ended
                    parts.append(" " * min(4 * ALIGNED, total[i] - total[at] - 3))
                parts.append(lines[k] + " " * (min(4 * ALIGNED, total[j] - total[i] - 3) - width(lines[k])))
                at = j
            if any(x.strip() for x in parts):
                out.append(" | ".join([*parts, ""] if at < row[-1][1] else parts).rstrip())  # one mark for all that have ended
            k += 1
            left = [cell for cell in left if len(cell[2]) > k]
    return out


def html_to_text(html: str | None) -> str:
    if not html:
        return ""
    root = build(html)
    # inner tables come first, so that outer ones find their lines
    tables, work = [], [(root, True)]
    while work:
        node, seen = work.pop()
        if not displayed(node):
            continue
        seen = visible(node, seen)
        if node.name == "table":
            tables.append((node, seen))
        work.extend((c, seen) for c in reversed(node.children) if not isinstance(c, str))
    for node, seen in reversed(tables):
        node.lines = table_lines(node, seen)
        node.children = []
    page = Page()
    render(root.children, page)
    return page.text()


def extract_text(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Add text, the visible text of html_col, to the columns in keep.

    A null or empty page has an empty text. Broken markup is read as browsers read it: stray quotes, unclosed tags and
    missing values lose no text, but a comment or quoted value that never ends hides the rest of its page. Not taken as
    visible: elements with the hidden attribute, display:none or visibility:hidden in their style attribute (a
    visibility:visible inside is shown), closed dialogs, the options of select, and what object, canvas, audio and video
    hold for browsers that can't show them. Style sheets are not applied; what a closed details element holds is shown.
    Elements more than DEEPEST levels deep are flattened; columns wider than ALIGNED are not padded further; rowspan is
    read in the first SPANNING columns. Rows that repeat, and null ids, are rendered like any other; columns outside
    keep are ignored, whatever their names. An empty table gives no rows. Whole pages are read, however long, in time
    proportional to their length.
    """
    picked = pages.select(*keep, F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [html_to_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*keep, "text"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{fields}text string")
