"""HTML extraction: a tree builder and a layout-aware text renderer."""

from __future__ import annotations

import html as entities
import re
import sys
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.kernels import slices
from nearfield.session import quoted, ship

#: Elements nested deeper than this are laid out as if they ended at once, as browsers do.
DEEPEST = 512
#: A table whose aligned form would have over so many blanks for each character, and over LEAST_PADDING, is aligned up to cells of WIDEST only.
PADDING, LEAST_PADDING, WIDEST = 8, 1 << 16, 60
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
OTHER = re.compile(r"<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>", re.S)
START = re.compile(r"<([a-zA-Z][^\s/>]*+)")
MARKS = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""", re.S)
BLANKS = re.compile(r"[ \t\n\r\f]+")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
TELLING = re.compile("hidden|style", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)

words = lambda s: frozenset(s.split())
VOID = words("area base br col embed hr img input link meta param source track wbr")
RAW = words("script style textarea title xmp iframe noembed noframes")
HIDDEN = words("head script style template noscript title iframe noembed noframes datalist audio video canvas rp area base link meta param source track annotation annotation-xml")
#: What a drawing shows of its text.
DRAWN = words("text foreignobject")
IN_HEAD = words("base link meta title style script noscript template")
#: Blocks with a blank line around them, and those that only begin a new line.
SPACED = words("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre xmp figure table hr fieldset")
BLOCK = words("html body address article aside center dd details dialog div dt fieldset figcaption footer form header hgroup legend li main nav option optgroup search section select summary textarea caption tr td th thead tbody tfoot") | SPACED
CLOSES_P = (BLOCK | words("listing plaintext")) - words("option optgroup select textarea caption tr td th thead tbody tfoot html body legend")
HEADINGS = words("h1 h2 h3 h4 h5 h6")
#: What a start tag ends, and the elements that it can't see through.
ENDS = {
    "li": (words("li"), words("ul ol menu dir table td th")),
    "dt": (words("dt dd"), words("dl table td th")),
    "dd": (words("dt dd"), words("dl table td th")),
    "option": (words("option"), words("select optgroup datalist")),
    "optgroup": (words("option optgroup"), words("select datalist")),
    "tr": (words("tr td th caption colgroup"), words("table")),
    "td": (words("td th caption colgroup"), words("tr table")),
    "th": (words("td th caption colgroup"), words("tr table")),
    "thead": (words("thead tbody tfoot tr td th caption colgroup"), words("table")),
    "tbody": (words("thead tbody tfoot tr td th caption colgroup"), words("table")),
    "tfoot": (words("thead tbody tfoot tr td th caption colgroup"), words("table")),
    "caption": (words("caption colgroup"), words("table")),
    "rt": (words("rt rp"), words("ruby")),
    "rp": (words("rt rp"), words("ruby")),
}
SECTIONS = words("thead tbody tfoot")
CELL_BARRIER = words("td th caption table")
TABLE_PARTS = words("table thead tbody tfoot tr td th caption")


class Node:
    __slots__ = ("children", "hidden", "raw", "shown", "tag")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.raw, self.children = tag, raw, []
        self.hidden, self.shown = tag in HIDDEN, None
        if raw and TELLING.search(raw):
            own = attributes(raw)
            style = own.get("style", "")
            if "hidden" in own or NO_DISPLAY.search(style) or (tag == "input" and own.get("type", "").lower() == "hidden"):
                self.hidden = True
            if found := VISIBILITY.findall(style):
                self.shown = found[-1].lower() == "visible"
        if tag == "dialog" and "open" not in attributes(raw):
            self.hidden = True


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a start tag, names in lower case; of repeated ones the first."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


class Ends:
    """Where start tags end: at the first '>' outside of quotes.

    Every stretch of the text is looked at once at most for each kind of quote, as
    places from which no tag ends are remembered.
    """

    def __init__(self, text: str):
        self.text, self.at, self.dead = text, None, set()
        self.last = text.rfind(">")

    def of(self, begin: int) -> int:
        """The place of the '>', or that of the first one at all if all are in quotes."""
        gt = self.text.find(">", begin)
        if not self.quoted(begin, gt):
            return gt
        if self.at is None:
            self.at = [m.start() for m in MARKS.finditer(self.text)]
            self.next = {}
            after = {}
            for k in range(len(self.at) - 1, -1, -1):  # the next mark of the same kind
                c = self.text[self.at[k]]
                self.next[k] = after.get(c)
                after[c] = k
        k, path = bisect_left(self.at, begin), []
        while k < len(self.at) and k not in self.dead:
            if self.text[self.at[k]] == ">":
                return self.at[k]
            path.append(k)
            if self.next[k] is None:
                break
            k = self.next[k] + 1
        self.dead.update(path)
        if k < len(self.at):
            self.dead.add(k)
        return gt

    def quoted(self, begin: int, end: int) -> bool:
        return self.text.find('"', begin, end) >= 0 or self.text.find("'", begin, end) >= 0


def tree(text: str) -> Node:
    """The document's tree, with the elements and ends that its tags imply."""
    root = Node("body")
    stack = [root]
    open_: Counter = Counter()  # by tag
    ends = Ends(text)

    def cut(k: int) -> None:
        """End all open elements from the k-th on."""
        for x in stack[k:]:
            open_[x.tag] -= 1
        del stack[k:]

    def put_text(s: str) -> None:
        if stack[-1].tag == "head" and s.strip():
            cut(len(stack) - 1)
        if s:
            stack[-1].children.append(entities.unescape(s) if "&" in s else s)

    def close(wanted: frozenset, barrier: frozenset) -> None:
        """End the outermost open element of `wanted` above the barrier."""
        if not any(open_[w] for w in wanted):
            return
        found = 0
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k].tag
            if tag in wanted:
                found = k
            elif tag in barrier:
                break
        if found:
            cut(found)

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        if len(stack) < DEEPEST:
            stack.append(node)
            open_[node.tag] += 1

    at, n = 0, len(text)
    while at < n:
        begin = text.find("<", at)
        if begin < 0:
            put_text(text[at:])
            break
        end, tag, raw, stop = "", "", "", -1
        if text.startswith("<!--", begin):
            stop = COMMENT.match(text, begin).end()
        elif begin < ends.last:
            if m := OTHER.match(text, begin):
                end, stop = m[1] or "", m.end()
            elif m := START.match(text, begin):
                stop = ends.of(m.end())
                tag, raw = m[1].lower(), text[m.end() : stop]
                stop += 1
        if stop < 0:
            put_text(text[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            put_text(text[at:begin])
        at = stop
        if end:
            tag = end.lower()
            if tag in ("html", "body"):
                continue
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            if tag in HEADINGS:  # any heading's end tag ends the open one
                close(HEADINGS, CELL_BARRIER)
                continue
            if not open_[tag]:
                continue
            barrier = frozenset() if tag == "table" else words("table") if tag in TABLE_PARTS else CELL_BARRIER
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag in BLOCK or not any(x.tag in BLOCK for x in stack[k + 1 :]):
                        cut(k)
                    else:  # blocks inside stay open
                        open_[tag] -= 1
                        del stack[k]
                    break
                if stack[k].tag in barrier:
                    break
            continue
        if not tag or tag in ("html", "body"):
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            cut(len(stack) - 1)
        if tag in ENDS:
            close(*ENDS[tag])
        elif tag in HEADINGS and stack[-1].tag in HEADINGS:
            cut(len(stack) - 1)
        if tag in CLOSES_P:
            close(words("p"), CELL_BARRIER | words("button"))
        if tag in ("td", "th") and stack[-1].tag in SECTIONS | {"table"}:
            push(Node("tr"))
        if tag in VOID:
            stack[-1].children.append(Node(tag, raw))
            continue
        push(Node(tag, raw))
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(text, at)
            if stack[-1].tag == tag and tag in ("textarea", "xmp"):
                own = text[at : stop.start()]
                stack[-1].children.append(entities.unescape(own) if tag == "textarea" else own)
            if stack[-1].tag == tag:
                cut(len(stack) - 1)
            at = stop.end()
    return root


def wide(s: str) -> int:
    """Columns that a text takes."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Flow:
    """Lines of a block; at most one blank line between paragraphs."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.add(first)
            for x in rest:
                self.newline()
                self.add(x)
            return
        parts = BLANKS.split(s)
        if len(parts) > 1 and parts[0] == "" and self.line:
            self.space = True
        got = [p for p in parts if p]
        if got:
            self.add((" " if self.space and self.line else "") + " ".join(got))
            self.space = parts[-1] == ""

    def add(self, s: str) -> None:
        if not s:
            return
        if not self.line and self.gap:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
        self.line.append(s)

    def flush(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def newline(self) -> None:
        """A forced line break."""
        if self.line:
            self.flush()
        elif self.lines:
            self.lines.append("")

    def edge(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def block(self, lines: list[str], gap: int) -> None:
        self.edge(gap)
        if lines:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.lines += lines
            self.gap = gap

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        k = 0
        while k < len(self.lines) and not self.lines[k]:
            k += 1
        return self.lines[k:]


def number(raw: str, name: str, otherwise: int) -> int:
    try:
        return int(attributes(raw).get(name, otherwise))
    except ValueError:
        return otherwise


def inside(node: Node, shown: bool, pre: bool, depth: int) -> list[str]:
    flow = Flow()
    lay(node.children, flow, shown if node.shown is None else node.shown, pre, depth)
    return flow.done()


def lay(children: list, flow: Flow, shown: bool, pre: bool, depth: int) -> None:
    """Lay out children into the flow. depth: of lists around them."""
    for c in children:
        if isinstance(c, str):
            if shown:
                flow.text(c, pre)
            continue
        tag = c.tag
        if c.hidden:
            continue
        own = shown if c.shown is None else c.shown
        if tag == "br":
            flow.newline()
        elif tag == "hr":
            flow.edge(2)
        elif tag == "wbr" or tag == "img":
            continue
        elif tag == "input":
            a = attributes(c.raw)
            if own and a.get("type", "").lower() in ("submit", "button", "reset") and a.get("value"):
                flow.text(" " + a["value"] + " ", False)
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.block(items(c, own, pre, depth), 2 if depth == 0 else 1)
        elif tag == "table":
            flow.block(table(c, own, pre), 2)
        elif tag in ("blockquote", "dd"):
            flow.block(["    " + x if x else x for x in inside(c, shown, pre, depth)], 2 if tag == "blockquote" else 1)
        elif tag in ("pre", "xmp", "textarea"):
            lines = inside(c, shown, True, depth)
            flow.block(lines, 2 if tag != "textarea" else 1)
        elif tag == "svg":
            for x in drawn(c):
                flow.text(" ", False)
                lay(x.children, flow, own if x.shown is None else x.shown, pre, depth)
                flow.text(" ", False)
        elif tag == "details" and "open" not in attributes(c.raw):
            flow.edge(1)
            lay([x for x in c.children if isinstance(x, Node) and x.tag == "summary"][:1], flow, own, pre, depth)
            flow.edge(1)
        elif tag in BLOCK:
            gap = 2 if tag in SPACED else 1
            flow.edge(gap)
            lay(c.children, flow, own, pre, depth)
            flow.edge(gap)
        else:
            lay(c.children, flow, own, pre, depth)


def drawn(node: Node) -> Iterator[Node]:
    """The shown texts of a drawing."""
    for c in node.children:
        if isinstance(c, Node) and not c.hidden and c.tag not in ("defs", "desc", "metadata", "symbol"):
            if c.tag in DRAWN:
                yield c
            else:
                yield from drawn(c)


def items(node: Node, shown: bool, pre: bool, depth: int) -> list[str]:
    """A list's lines: each item after its mark, its further lines below its first."""
    ordered = node.tag == "ol"
    count, lines = number(node.raw, "start", 1), []
    for c in node.children:
        if isinstance(c, Node) and c.tag == "li":
            if c.hidden:
                continue
            if ordered and c.raw:
                count = number(c.raw, "value", count)
            mark = f"{count}. " if ordered else "* "
            count += 1
            own = inside(c, shown, pre, depth + 1)
            if own:
                lines.append(mark + own[0])
                lines += [" " * len(mark) + x if x else x for x in own[1:]]
        else:
            flow = Flow()
            lay([c], flow, shown, pre, depth + 1)
            lines += ["  " + x if x else x for x in flow.done()]
    return lines


def rows_of(node: Node, shown: bool) -> Iterator[tuple[Node, bool]]:
    """Rows in the order in which they are shown: heads, bodies, feet."""
    parts = [(c, shown if c.shown is None else c.shown) for c in node.children if isinstance(c, Node) and not c.hidden]
    for kinds in (("thead",), ("tbody", "tr"), ("tfoot",)):
        for c, own in parts:
            if c.tag in kinds:
                if c.tag == "tr":
                    yield c, own
                else:
                    yield from ((r, own if r.shown is None else r.shown) for r in c.children if isinstance(r, Node) and r.tag == "tr" and not r.hidden)


def strays(node: Node, allowed: frozenset) -> list:
    """What stands in a table outside its cells; it is shown above the table."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                out.append(c)
        elif c.tag in SECTIONS:
            if not c.hidden:
                out += strays(c, words("tr"))
        elif c.tag == "tr":
            if not c.hidden:
                out += [x for x in c.children if (x.strip() if isinstance(x, str) else x.tag not in ("td", "th"))]
        elif c.tag not in allowed:
            out.append(c)
    return out


def table(node: Node, shown: bool, pre: bool) -> list[str]:
    """A table's lines: caption, then rows with their cells in columns, two blanks apart."""
    flow = Flow()
    lay(strays(node, SECTIONS | words("tr caption colgroup col")), flow, shown, pre, 0)
    for c in node.children:
        if isinstance(c, Node) and c.tag == "caption" and not c.hidden:
            flow.block(inside(c, shown, pre, 0), 1)
    above = flow.done()
    grid: list[list[tuple[int, int, list[str]]]] = []  # for each row (column, columns, lines)
    taken: dict[int, int] = {}  # rows for which a cell above still fills a column
    for row, own in rows_of(node, shown):
        cells, column = [], 0
        for c in row.children:
            if not isinstance(c, Node) or c.tag not in ("td", "th") or c.hidden:
                continue
            while taken.get(column, 0) > 0:
                column += 1
            across = min(1000, max(1, number(c.raw, "colspan", 1))) if c.raw else 1
            down = min(65534, max(1, number(c.raw, "rowspan", 1))) if c.raw else 1
            cells.append((column, across, inside(c, own, pre, 0)))
            if down > 1:
                for k in range(column, column + across):
                    taken[k] = down
            column += across
        taken = {k: v - 1 for k, v in taken.items() if v > 1}
        grid.append(cells)
    out = aligned(grid, None)
    return above + (aligned(grid, WIDEST) if out is None else out)


def aligned(grid: list[list[tuple[int, int, list[str]]]], most: int | None) -> list[str] | None:
    """Rows of cells (column, columns, lines) in columns as wide as their widest cell.

    Cells wider than most don't count and push the rest of their row; without most,
    None if that took too many blanks.
    """
    full = [[c for c in cells if c[2]] for cells in grid]
    if all(len(cells) < 2 for cells in full) and len({c[:2] for cells in full for c in cells}) < 2:  # one column needs no blanks
        return [x for cells in full for c in cells for x in c[2]]
    width: dict[int, int] = {}
    for spanned in (False, True):
        for cells in grid:
            for column, across, lines in cells:
                if (across > 1) != spanned:
                    continue
                w = max((x for x in map(wide, lines) if most is None or x <= most), default=0)
                have = sum(width.get(k, 0) for k in range(column, column + across)) + 2 * (across - 1)
                if w > have:
                    width[column + across - 1] = width.get(column + across - 1, 0) + w - have
    used = sorted(k for k, w in width.items() if w)
    start, x = {}, 0
    for k in used:
        start[k] = x
        x += width[k] + 2
    out, blanks, size = [], 0, 0
    for cells in grid:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, at = [], 0
            for column, across, lines in cells:
                if k < len(lines) and lines[k]:
                    to = next((start[c] for c in range(column, column + across) if c in start), at)
                    pad = max(to - at, 2 if at else 0)
                    blanks, size = blanks + pad, size + len(lines[k])
                    if most is None and blanks > max(LEAST_PADDING, PADDING * size):
                        return None
                    line.append(" " * pad + lines[k])
                    at += pad + wide(lines[k])
            out.append("".join(line))
    while out and not out[-1]:
        out.pop()
    return out


def rendered(html: str | None) -> str | None:
    """All visible text of a page, laid out in lines. Null for a null page."""
    if html is None:
        return None
    if sys.getrecursionlimit() < 8 * DEEPEST:
        sys.setrecursionlimit(8 * DEEPEST)
    lines = inside(tree(html.replace("\0", "")), True, False, 0)
    return "\n".join(lines).replace("\xa0", " ")


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    text holds all that a browser shows with scripts on: what heads, scripts, styles,
    templates, noscript elements, hidden attributes, display: none, hidden
    visibility, closed dialogs and closed details hold is left out; images and
    frames have no text, drawings that of their text elements, formulas theirs
    without annotations, objects what stands in for them. Paragraphs, headings, lists, tables and quotations
    are set off by blank lines, other blocks by line ends; list items have marks or
    numbers and indents; cells of a table are aligned in columns; pre keeps its
    blanks. Missing and wrongly nested tags are mended as browsers do; elements
    deeper than DEEPEST nest no further.

    A null page has a null text and n_chars, an empty one an empty text. Empty tables
    give no row. Repeated rows are rendered each; null ids and urls stay. Pages of
    any length are rendered whole, in time in proportion to it also where tags,
    quotes or comments don't end. Columns but id_col, url_col and html_col are not
    read. Ids must be integers or cast to them.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, urls in slices(batches):
            out = [rendered(t) for t in texts]
            size = [None if t is None else len(t) for t in out]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(out, pa.string()), pa.array(size, pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(quoted(id_col)).cast("bigint").alias("id"), F.col(quoted(html_col)).cast("string").alias("text"), F.col(quoted(url_col)).cast("string").alias("url"))
    return source.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
