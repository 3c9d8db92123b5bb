"""HTML to the text that a reader sees, laid out: a tree builder with implied tags, visibility rules, and a renderer of blocks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator
from html import unescape
from unicodedata import combining, east_asian_width

import pandas as pd
from pyspark.sql import DataFrame

from deskloom.functions.markup import tag_at

#: Fixed values of HTML: elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed values of HTML: elements whose content isn't shown.
UNSEEN = frozenset("head script style template noscript title datalist audio video canvas iframe object svg math".split())
#: Fixed values of HTML: blocks with a blank line around them, and those on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset menu hr".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside header footer nav main address form li dt dd tr td th thead tbody tfoot caption figcaption legend details summary dialog center option optgroup".split()
)
#: What an opening tag closes, if it is open above the barrier.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "caption"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "body": (("head",), ()),
}

_SPACE = re.compile(r"[ \t\n\f\r]+")
_INTEGER = re.compile(r"[ \t\n\f\r]*([+-]?[0-9]{1,9})(?![0-9])")
#: Fixed values of HTML: elements whose content is text up to their end tag, and of these those in which entities count.
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
RESOLVED = frozenset(("textarea", "title"))
#: Fixed values of HTML: the most columns and rows that a cell spans.
COLUMNS, ROWS = 1000, 65534
#: Columns of indentation; what nests deeper isn't indented further.
DEEPEST = 80


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """(kind, tag or text, attributes) of start tags, end tags and text, in one pass over the page.

    Comments, declarations and what browsers take for them are left out, and so is a
    tag or a comment in which the page ends. Of attributes given twice the first counts.
    """
    at = 0
    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            start = len(html)
        if start > at:
            yield "text", unescape(html[at:start]), None
        if start == len(html):
            return
        closing = html.startswith("</", start)
        first = html[start + 1 + closing : start + 2 + closing]
        if first.isascii() and first.isalpha():
            found = tag_at(html, start + 1 + closing)
            if not found:
                return
            tag, attributes, at = found
            if closing:
                yield "end", tag, None
                continue
            yield "start", tag, dict(reversed(attributes))
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                raw = html[at : end.start() if end else len(html)]
                yield "text", unescape(raw) if tag in RESOLVED else raw, None
                at = end.start() if end else len(html)
        elif html.startswith("<!--", start):
            if html.startswith((">", "->"), start + 4):
                at = html.index(">", start + 4) + 1
            else:
                end = html.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(html)
        elif first in ("!", "?") or closing:
            end = html.find(">", start + 1)
            at = end + 1 if end >= 0 else len(html)
        else:
            yield "text", "<", None
            at = start + 1


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder:
    """The tree of a page, with the tags that HTML lets authors leave out."""

    def __init__(self, html: str):
        self.root = Node("html", {})
        self.open = [self.root]
        #: Where elements of a tag are open, apart from the root: looked up, as pages may nest without end.
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        for kind, value, attributes in tokens(html):
            if kind == "text":
                self.text(value)
            elif kind == "start":
                self.start(value, attributes)
            else:
                self.end(value)

    def _push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.open))
        self.open.append(node)

    def _cut(self, at: int) -> None:
        """Closes the open elements from the one at a depth."""
        while len(self.open) > at:
            self.at[self.open.pop().tag].pop()

    def _last(self, tags: tuple[str, ...]) -> int:
        """The depth of the innermost open element of these tags, or 0."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _close(self, tags: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        """Closes the outermost open element of these tags that no barrier shields."""
        shield = self._last(barriers)
        found = [at[i] for t in tags if (at := self.at.get(t)) and (i := bisect_right(at, shield)) < len(at)]
        if found:
            self._cut(min(found))

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            return
        if tag in BLOCKS:
            self._close(("p",), ("td", "th", "table", "li", "dd", "blockquote", "button"))
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in BLOCKS and self.open[-1].tag == "head":
            self._cut(len(self.open) - 1)
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self._push(node)

    def end(self, tag: str) -> None:
        barriers = ("table",) if tag not in ("table", "body", "html") else ()
        if tag not in CLOSES["td"][1] + ("thead", "tbody", "tfoot"):
            barriers += ("td", "th")
        at = self._last((tag,))
        if at and at >= self._last(barriers):
            self._cut(at)

    def text(self, data: str) -> None:
        top = self.open[-1]
        if top.tag == "head" and data.strip():
            self._cut(len(self.open) - 1)
            top = self.open[-1]
        top.children.append(data)


class Box:
    """Lines of laid-out text. Containers within it indent their lines, and start with a mark; blank lines at their edges go."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.blank = False, 0
        #: The indentation, what takes its place before the next line, and whether the container has lines.
        self.indent, self.mark, self.some = "", None, False
        self.outer: list[list] = []

    def text(self, data: str) -> None:
        words = [w for w in _SPACE.split(data) if w]
        if not words:
            self.space = self.space or bool(data)
            return
        if self.line and (self.space or data[0] in " \t\n\f\r"):
            self.line.append(" ")
        self.begin()
        self.line.append(" ".join(words))
        self.space = data[-1] in " \t\n\f\r"

    def begin(self) -> None:
        """The line that follows has text, or is a line anyway: blank lines before it are due."""
        if not self.line:
            blank, known, i = self.blank, self.some, len(self.outer)
            while not known and i:  # each container is gone through once, at its first line
                i -= 1
                known, blank = self.outer[i][2], self.outer[i][3]
                self.outer[i][2] = True
            if known:
                self.lines += [""] * blank
            self.some = True
        self.blank = 0

    def end_line(self, blank: int = 0, always: bool = False) -> None:
        if self.line or always:
            text = "".join(self.line)
            self.lines.append((self.indent if self.mark is None else self.mark) + text if text else text)
            if text:
                self.mark = None
            self.line = []
        self.space = False
        self.blank = max(self.blank, blank)

    def add(self, lines: list[str]) -> None:
        """Whole lines, as they are."""
        self.end_line()
        for line in lines:
            self.begin()
            self.line = [line]
            self.end_line(always=True)

    def enter(self, mark: str, shown: bool) -> None:
        """A container whose lines are indented as far as a mark, which stands before its first line if it is shown."""
        self.end_line()
        self.outer.append([self.indent, self.mark, self.some, self.blank])
        before = self.indent if self.mark is None else self.mark
        if shown:
            self.mark = before[: DEEPEST - len(mark)] + mark
        elif self.mark is not None:
            self.mark = (before + " " * len(mark))[:DEEPEST]
        self.indent = (self.indent + " " * len(mark))[:DEEPEST]
        self.some, self.blank = False, 0

    def leave(self) -> None:
        self.end_line()
        mine, (self.indent, mark, some, blank) = self.some, self.outer.pop()
        self.mark = None if mine else mark
        self.some, self.blank = some or mine, 0 if mine else blank

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _styles(style: str) -> dict[str, str]:
    """The last display and visibility that a style declares; important ones outdo others."""
    found: dict[str, tuple[bool, str]] = {}
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        value, _, important = value.partition("!")
        if name.strip() in ("display", "visibility") and value.strip():
            held = "important" in important
            if held or not found.get(name.strip(), (False,))[0]:
                found[name.strip()] = held, value.strip()
    return {name: value for name, (_, value) in found.items()}


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether a node takes part in the layout, and whether its text is visible."""
    if node.tag in UNSEEN or "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs:
        return False, False
    styles = _styles(node.attrs.get("style", ""))
    if styles.get("display") == "none":
        return False, False
    seen = styles.get("visibility", "inherit")
    return True, visible if seen == "inherit" else seen not in ("hidden", "collapse")


def _width(text: str) -> int:
    """The columns of a line: wide characters take two, combining ones none."""
    return len(text) if text.isascii() else sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


def _number(value: str | None, otherwise: int, least: int = -(10**9), most: int = 10**9) -> int:
    """The whole number that a value begins with, within bounds; otherwise without one of nine digits at most."""
    found = _INTEGER.match(value or "")
    return min(most, max(least, int(found[1]))) if found else otherwise


#: A part of the layout: it yields the parts that it needs, and is sent what they return.
Part = Generator["Part", object, object]


def _finished(part: Part) -> object:
    """What a part returns, worked out with a stack of its own, as pages may nest deeper than calls can."""
    stack, value = [part], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def _table(node: Node, visible: bool) -> Part:
    """Rows of cells, padded to their column's width; a cell may have many lines, and may span columns and rows."""
    captions, rows = [], []
    held: dict[int, int] = {}  # by column the row up to which a cell above spans

    def row(tr: Node, seen: bool) -> Part:
        cells, at, below = [], 0, {}
        for cell in tr.children:
            if isinstance(cell, str):
                fine, shown, span, deep = bool(cell.strip()), seen, 1, 1
            else:
                fine, shown = _shown(cell, seen)
                span, deep = _number(cell.attrs.get("colspan"), 1, 1, COLUMNS), _number(cell.attrs.get("rowspan"), 1, 0, ROWS) or ROWS
            if fine:
                while held.get(at, 0) > len(rows):
                    at += 1
                inner = cell.children if not isinstance(cell, str) and cell.tag in ("td", "th") else [cell]
                cells.append(((yield _lines(inner, shown)), at, span))
                if deep > 1:
                    below |= dict.fromkeys(range(at, at + span), len(rows) + deep)
                at += span
        held.update(below)
        rows.append(cells)

    def walk(parent: Node, seen: bool) -> Part:
        for child in parent.children:
            if isinstance(child, str):
                if child.strip() and seen:
                    captions.extend((yield _lines([child], seen)))
                continue
            there, shows = _shown(child, seen)
            if not there:
                continue
            if child.tag == "tr":
                yield row(child, shows)
            elif child.tag in ("thead", "tbody", "tfoot", "colgroup", "col"):
                yield walk(child, shows)
            else:
                captions.extend((yield _lines([child], shows)))

    yield walk(node, visible)
    # columns in which no cell of one column stands have no width of their own
    widths: dict[int, int] = {}
    for cells in rows:
        for lines, at, span in cells:
            if span == 1:
                widths[at] = max([widths.get(at, 0), *map(_width, lines)])
    columns = sorted(widths)
    starts = [0]
    for c in columns:
        starts.append(starts[-1] + widths[c] + 2)
    place = lambda c: starts[bisect_left(columns, c)]
    out = list(captions)
    for cells in rows:
        for i in range(max((len(lines) for lines, _, _ in cells), default=0)):
            line, wide = [], 0
            for lines, at, _ in cells:
                if i < len(lines) and lines[i]:
                    gap = max(place(at) - wide, 2 if line else 0)
                    line.append(" " * gap + lines[i])
                    wide += gap + _width(lines[i])
            out.append("".join(line).rstrip())
    return out


def _lines(nodes: list, visible: bool) -> Part:
    box = Box()
    yield _render(nodes, box, visible, False)
    return box.done()


def _render(nodes: list, box: Box, visible: bool, pre: bool) -> Part:
    for node in nodes:
        if isinstance(node, str):
            if not visible:
                continue
            if pre:
                first, *rest = node.replace("\r\n", "\n").expandtabs(8).split("\n")
                for i, part in enumerate([first, *rest]):
                    if i:
                        box.begin()
                        box.end_line(always=True)
                    if part:
                        box.begin()
                        box.line.append(part)
            else:
                box.text(node)
            continue
        there, shows = _shown(node, visible)
        if not there:
            continue
        tag = node.tag
        if tag == "br":
            box.begin()
            box.end_line(always=True)
            continue
        block, blank = tag in BLOCKS, int(tag in SPACED)
        if block:
            box.end_line(blank)
        if tag == "table":
            box.add((yield _table(node, shows)))
        elif tag in ("ul", "ol", "menu"):
            items = [c for c in node.children if not isinstance(c, str) and c.tag == "li" and _shown(c, shows)[0]]
            back = tag == "ol" and "reversed" in node.attrs
            number = _number(node.attrs.get("start"), len(items) if back else 1)
            for child in node.children:
                if isinstance(child, str) or child.tag != "li":
                    box.enter("", False)
                    yield _render([child], box, shows, pre)
                    box.leave()
                    continue
                fine, shown = _shown(child, shows)
                if fine:
                    number = _number(child.attrs.get("value"), number) if tag == "ol" else number
                    box.enter(f"{number}. " if tag == "ol" else "- ", True)
                    yield _render(child.children, box, shown, pre)
                    box.leave()
                    number += -1 if back else 1
        elif tag in ("dd", "blockquote"):
            box.enter("  ", False)
            yield _render(node.children, box, shows, pre)
            box.leave()
        elif tag == "details" and "open" not in node.attrs:
            yield _render([c for c in node.children if not isinstance(c, str) and c.tag == "summary"], box, shows, pre)
        else:
            yield _render(node.children, box, shows, pre or tag in ("pre", "textarea"))
        if block:
            box.end_line(blank)


def visible_text(html: str | None) -> str:
    """The visible text of a page: paragraphs, headings, lists and tables apart by blank lines, other blocks by line ends."""
    if not html:
        return ""
    lines = [x.rstrip() for x in _finished(_lines([TreeBuilder(html).root], True))]
    return "\n".join(lines).strip("\n")


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with a column text: what a reader sees of each page's html.

    Styles count where they stand on the element (hidden, display, visibility);
    style sheets and scripts aren't run. A null or empty page has an empty text.
    Malformed markup is read as browsers do: a tag or comment in which the page ends
    is left out, and a script that isn't closed goes on to the end. Numbers of more
    than nine digits count as missing; indentation ends at DEEPEST columns.
    Rows stay as they are, and a column named text is replaced.
    """
    kept = [f for f in pages.schema.fields if f.name != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns=[text], errors="ignore").assign(**{text: [visible_text(h) for h in batch[html]]})

    return pages.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{text}` string")
