"""HTML extraction by layout-aware rendering.

A tree builder with implied end tags reads any markup; visibility rules leave out what a reader would not
see; a renderer lays the rest out as text: blocks on lines of their own with the blank lines of their
margins, list markers and indents, preformatted text as it is, and table cells aligned in columns.
Elements nest as deep as they come. Work on a page is in proportion to its size: from ``DEPTH`` levels on
lists, tables and quotes are not indented or aligned (visible text stays, blocks keep lines of their own),
and cells are padded to at most ``WIDEST`` characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

DEPTH = 120
WIDEST = 80

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![A-Za-z])[^>]*+(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?""")
_WORTH = re.compile(r"hidden|style|start|span|value|open|reversed", re.I)
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())  # their content is no markup
RCDATA = frozenset("title textarea".split())
UNSEEN = frozenset("head script style template title iframe noembed noframes object embed canvas audio video svg math datalist map param meta link base area source track input img rp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote hr figure menu dir fieldset xmp".split())
BLOCK = SPACED | frozenset("address article aside body center details dialog dd div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tr caption thead tbody tfoot td th select noscript".split())
_ENDS_P = SPACED | frozenset("address article aside center details dialog dd div dt figcaption footer form header hgroup li main nav search section summary".split())
#: A start tag ends an open element of the first set, as long as none of the second is met before.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
_GROUPS = ("thead", "tbody", "tfoot")
_P_SCOPE = {"table", "td", "th", "caption", "button", "object", "html"}
_CELL_SCOPE = {"table", "td", "th", "caption"}
_HEAD_ONLY = frozenset("title meta link base script style template noscript noframes".split())


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(raw: str) -> dict[str, str]:
    if not _WORTH.search(raw):
        return {}
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _needed(inside: str, tag: str) -> tuple[str, ...]:
    """The table parts that a start tag implies."""
    if tag in ("td", "th"):
        return ("tbody", "tr") if inside == "table" else ("tr",) if inside in _GROUPS else ()
    return ("tbody",) if tag == "tr" and inside == "table" else ()


def parse(html: str) -> Node:
    """The element tree; text nodes are strings with character references resolved."""
    root = Node("html")
    stack, born = [root], [0]  # open elements, and a number that grows with each
    where: dict[str, list[int]] = {}  # by tag, and under "" for all blocks: the numbers of the open ones

    def push(node: Node) -> None:
        born.append(born[-1] + 1)
        stack.append(node)
        for k in (node.tag, "") if node.tag in BLOCK else (node.tag,):
            where.setdefault(k, []).append(born[-1])

    def cut(i: int) -> None:
        for n in stack[i:]:
            where[n.tag].pop()
            if n.tag in BLOCK:
                where[""].pop()
        del stack[i:], born[i:]

    def close(tags: set[str] | frozenset[str], scope: set[str]) -> None:
        last = max((where[t][-1] for t in tags if where.get(t)), default=0)
        if not last or any(where.get(t) and where[t][-1] > last for t in scope):
            return
        i = bisect_left(born, last)
        if stack[i].tag in BLOCK or not where.get("") or where[""][-1] < last:
            cut(i)
        else:  # the end of an inline element ends no block inside it
            where[stack[i].tag].pop()
            del stack[i], born[i]

    def text(data: str) -> None:
        if data:
            if stack[-1].tag == "head" and not data.isspace():
                cut(len(stack) - 1)
            stack[-1].children.append(unescape(data) if "&" in data else data)

    at = 0
    while (m := _TOKEN.search(html, at)) is not None:
        text(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["data"]:
                stack[-1].children.append(m["data"])
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in ("html", "body"):
                close({tag}, _CELL_SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag})
            continue
        if tag == "html":
            continue
        if stack[-1].tag == "head" and tag not in _HEAD_ONLY:
            cut(len(stack) - 1)
        if tag in _ENDS_P:
            close({"p"}, _P_SCOPE)
        if tag in _IMPLIED:
            close(*_IMPLIED[tag])
            if tag == "tr" or tag in ("thead", "tbody", "tfoot"):
                close({"td", "th"}, {"table", "tr"})
        for needed in _needed(stack[-1].tag, tag):
            stack[-1].children.append(Node(needed))
            push(stack[-1].children[-1])
        node = Node(tag, _attributes(m["attrs"]))
        stack[-1].children.append(node)
        if tag in RAW or tag in RCDATA:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            content = html[at : end.start() if end else len(html)]
            node.children.append(unescape(content) if tag in RCDATA else content)
            at = len(html) if end is None else (html.find(">", end.end()) + 1 or len(html))
        elif tag not in VOID and not (tag == "form" and stack[-1].tag in ("table", "tr", *_GROUPS)):  # a form between cells holds nothing
            push(node)
    text(html[at:])
    return root


def visible(node: Node, inside: Node | None = None) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or _HIDING.search(a.get("style", "")):
        return False
    if node.tag == "dialog":
        return "open" in a
    return not (inside is not None and inside.tag == "details" and "open" not in inside.attrs and node.tag != "summary")


class _Page:
    """Lines laid out so far, the line in the making, and the blank lines due before the next."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.due = 0

    def inline(self, data: str) -> None:
        data = _SPACES.sub(" ", data)
        if data[:1] == " " and (not self.parts or self.parts[-1][-1:] == " "):
            data = data[1:]
        if data:
            self.parts.append(data)

    def end_line(self, keep_empty: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ").replace("\xa0", " ")
        self.parts = []
        if line or keep_empty:
            self.add([line])

    def add(self, lines: list[str]) -> None:
        if self.lines and self.due:
            self.lines.extend([""] * self.due)
        self.due = 0
        self.lines.extend(lines)

    def gap(self, blank: int) -> None:
        self.end_line()
        self.due = max(self.due, blank)


def _lines(node: Node, depth: int = 0) -> list[str]:
    page = _Page()
    _render(node, page, depth)
    page.end_line()
    return page.lines


def _number(value: str | None, default: int) -> int:
    return int(value) if value is not None and re.fullmatch(r"-?[0-9]{1,9}", value.strip()) else default


def _list(node: Node, page: _Page, depth: int) -> None:
    items = [c for c in node.children if not isinstance(c, str) or c.strip()]
    down = node.tag == "ol" and "reversed" in node.attrs
    n = _number(node.attrs.get("start"), sum(not isinstance(c, str) and c.tag == "li" for c in items) if down else 1)
    for c in items:
        if isinstance(c, str):
            page.inline(c)
            page.end_line()
        elif c.tag != "li":
            if visible(c, node):
                page.gap(0)
                page.add(["  " + x if x else x for x in _lines(_around(c), depth + 1)])
        else:
            n = _number(c.attrs.get("value"), n)
            if visible(c, node):
                mark = f"{n}. " if node.tag == "ol" else "- "
                inner = _lines(c, depth + 1) or [""]
                page.gap(0)
                page.add([(mark + inner[0]).rstrip(), *[" " * len(mark) + x if x else x for x in inner[1:]]])
            n += -1 if down else 1


def _around(node: Node) -> Node:
    out = Node("div")
    out.children.append(node)
    return out


def _rows(node: Node) -> Iterator[Node]:
    for c in node.children:
        if not isinstance(c, str) and visible(c, node):
            if c.tag == "tr":
                yield c
            elif c.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(c)


def _stray(node: Node) -> Iterator[Node | str]:
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                yield c
        elif c.tag in (*_GROUPS, "tr") and node.tag != "tr":
            if visible(c, node):
                yield from _stray(c)
        elif c.tag not in ("td", "th", "col", "colgroup"):
            yield c


def _table(node: Node, page: _Page, depth: int) -> None:
    loose = Node("div")  # text and elements between the cells come before the table, as browsers lay them out
    loose.children = list(_stray(node))
    page.add(_lines(loose, depth + 1)) if loose.children else None
    grid: list[list[tuple[int, int, list[str]]]] = []
    held: dict[int, int] = {}  # column: rows that a cell above still fills
    for row in _rows(node):
        cells, column, new = [], 0, {}
        for c in row.children:
            if isinstance(c, str) or c.tag not in ("td", "th") or not visible(c, row):
                continue
            while held.get(column, 0):
                column += 1
            wide = min(max(1, _number(c.attrs.get("colspan"), 1)), 1000)
            tall = min(max(1, _number(c.attrs.get("rowspan"), 1)), 65534)
            cells.append((column, wide, _lines(c, depth + 1)))
            new |= {column + i: tall for i in range(wide) if tall > 1}
            column += wide
        held = {k: v - 1 for k, v in held.items() if v > 1} | {k: v - 1 for k, v in new.items()}
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for column, wide, lines in cells:
            if wide == 1 and lines:
                width[column] = max(width.get(column, 0), min(WIDEST, max(map(len, lines))))
    place, x = {}, 0
    for column in range(max((c + w for cells in grid for c, w, _ in cells), default=0)):
        place[column] = x
        x += width.get(column, 0) + 2 if column in width else 0
    for cells in grid:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line = ""
            for column, _, lines in cells:
                if k < len(lines) and lines[k]:
                    line = line.ljust(place[column]) if len(line) < place[column] or not line else line + "  "
                    line += lines[k]
            page.add([line.rstrip()])


def _kept(node: Node, page: _Page) -> None:
    """Text as it is."""
    page.gap(1 if node.tag != "textarea" else 0)
    raw = _plain(node).replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ")
    page.add(raw.removeprefix("\n").rstrip("\n").split("\n") if raw.strip() else [])
    page.gap(1 if node.tag != "textarea" else 0)


def _flat(node: Node, page: _Page) -> None:
    """What lies too deep for a layout: its visible text, blocks on lines of their own."""
    todo = [(node, iter(node.children))]
    while todo:
        parent, rest = todo[-1]
        c = next(rest, None)
        if c is None:
            todo.pop()
            if todo and parent.tag in BLOCK:
                page.gap(0)
            elif todo and parent.tag == "q":
                page.inline('"')
        elif isinstance(c, str):
            if parent.tag != "details" or "open" in parent.attrs:
                page.inline(c)
        elif visible(c, parent):
            if c.tag == "br":
                page.end_line(keep_empty=True)
            elif c.tag in ("pre", "textarea", "xmp"):
                _kept(c, page)
            else:
                if c.tag in BLOCK or c.tag == "hr":
                    page.gap(0)
                elif c.tag == "q":
                    page.inline('"')
                todo.append((c, iter(c.children)))


def _render(node: Node, page: _Page, depth: int) -> None:
    if depth >= DEPTH:
        _flat(node, page)
        return
    for c in node.children:
        if isinstance(c, str):
            if node.tag != "details" or "open" in node.attrs:
                page.inline(c)
            continue
        if not visible(c, node):
            continue
        tag = c.tag
        if tag == "br":
            page.end_line(keep_empty=True)
        elif tag == "wbr":
            continue
        elif tag in ("pre", "textarea", "xmp"):
            _kept(c, page)
        elif tag == "hr":
            page.gap(1)
        elif tag in BLOCK:
            space = 1 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and node.tag == "li") else 0
            page.gap(space)
            if tag in ("ul", "ol", "menu", "dir"):
                _list(c, page, depth + 1)
            elif tag == "table":
                _table(c, page, depth + 1)
            elif tag in ("blockquote", "dd"):
                inner = _lines(c, depth + 1)
                page.add(["  " + x if x else x for x in inner]) if inner else None
            elif tag == "li":
                inner = _lines(c, depth + 1)
                page.add(["- " + inner[0], *["  " + x if x else x for x in inner[1:]]]) if inner else None
            else:
                _render(c, page, depth + 1)
            page.gap(space)
        else:
            if tag == "q":
                page.inline('"')
            _render(c, page, depth + 1)
            if tag == "q":
                page.inline('"')


def _plain(node: Node) -> str:
    out, todo = [], [(node, c) for c in reversed(node.children)]
    while todo:
        parent, c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append("\n")
        elif visible(c, parent):
            todo.extend((c, x) for x in reversed(c.children))
    return "".join(out)


def render(html: str | None) -> str | None:
    """The visible text of a page as it is laid out; null for null."""
    return None if html is None else "\n".join(_lines(parse(html))).strip("\n")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """One row (id, ``text``) per input row. Null markup gives null, empty markup an empty text; broken
    markup is read as browsers do, never refused. Repeated rows stay; other columns are not read."""
    rows = pages.select(pages[id_col].alias("id"), pages[html_col].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 22):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(x) for x in part.column(1).to_pylist()], pa.string())], [id_col, out_col])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, `{out_col}` string")
