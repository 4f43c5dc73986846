"""Visible text of HTML pages, laid out: a tree with implied tags, rules for what is seen, and blocks, lists and tables as text.

Pages are parsed one by one in the tasks that read them; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Generator, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.words import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link object iframe svg math canvas audio video datalist select textarea rp".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup legend li main menu nav ol p pre section summary table caption tbody thead tfoot tr ul".split()
)
#: Blocks with an empty line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends open elements of these names, as far up as the scope that is named.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head", "title"}, {"html"}),
}
#: End tags don't reach out of these.
WALLS = frozenset("table td th caption html".split())
#: Elements that hold rows of a table.
ROWS = frozenset("table thead tbody tfoot".split())
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
#: Columns at which indents end; what is nested deeper stands there as well, with all its text.
INDENT = 400
#: Cells with a longer line don't widen their column: they break out of it, so that no row is filled up to them.
WIDE = 200
_WHITE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str | None]):
        self.name, self.attributes, self.children = name, attributes, []


class Tree(HTMLParser):
    """Builds the tree of a page: elements that may be left open are ended by what follows, table parts that were left out are put in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        #: How many elements of a name are open, so that an end tag without one costs no search.
        self.names: Counter[str] = Counter()

    def _close(self, k: int) -> None:
        self.names.subtract(n.name for n in self.open[k:])
        del self.open[k:]

    def _end(self, names: set[str], scope: Iterable[str]) -> None:
        """Ends the outermost open element of these names above the nearest of the scope."""
        found = None
        if not any(self.names[n] for n in names):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in scope:
                break
            if self.open[k].name in names:
                found = k
        if found:
            self._close(found)

    def _start(self, name: str, attributes: dict[str, str | None]) -> None:
        node = Node(name, attributes)
        self.open[-1].children.append(node)
        if name not in VOID:
            self.open.append(node)
            self.names[name] += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            self.root.attributes |= dict(attrs)
            return
        if tag in ENDS:
            self._end(*ENDS[tag])
        elif tag in BLOCK:
            self._end({"p"}, {"button", *WALLS})
            if tag in HEADINGS and self.open[-1].name in HEADINGS:
                self._close(len(self.open) - 1)
        if self.open[-1].name == "head" and (tag in BLOCK or tag in ("a", "b", "i", "span", "img", "br")):
            self._close(len(self.open) - 1)
        if tag in ("td", "th") and self.open[-1].name in ROWS:
            self._start("tr", {})
        self._start(tag, dict(attrs))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self._start("br", {})
        if tag == "p" and not self.names["p"]:
            self._start("p", {})
        if not self.names[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                self._close(k)
                return
            if self.open[k].name in WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].name == "head" and data.strip():
            self._close(len(self.open) - 1)
        self.open[-1].children.append(data)


def seen(node: Node) -> bool:
    """Whether an element and what is in it can be seen."""
    if node.name in UNSEEN or "hidden" in node.attributes:
        return False
    if node.name == "input" and (node.attributes.get("type") or "").lower() == "hidden" or node.name == "dialog" and "open" not in node.attributes:
        return False
    return not _HIDDEN.search(node.attributes.get("style") or "")


def folded(node: Node) -> Node:
    """Of a closed <details> only its summary can be seen."""
    if node.name != "details" or "open" in node.attributes:
        return node
    out = Node("div", {})
    out.children = [c for c in node.children if isinstance(c, Node) and c.name == "summary"][:1]
    return out


def whole_number(text: str | None, other: int) -> int:
    text = (text or "").strip()
    return int(text) if re.fullmatch(r"-?[0-9]{1,9}", text) else other


class Page:
    """Lines of text as they are written: pieces of a line, with at most one blank between words, and gaps between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = self.gap = False
        self.indent = ""
        self.mark = ""

    def write(self, text: str) -> None:
        for k, part in enumerate(_WHITE.split(text)):
            if k:
                self.blank = True
            if part:
                if self.blank and self.line:
                    self.line.append(" ")
                self.line.append(part)
                self.blank = False

    def end(self, gap: bool = False, forced: bool = False) -> None:
        """Ends the line; with a gap, the next line comes after an empty one."""
        if self.line or forced:
            self.put("".join(self.line))
        self.line, self.blank = [], False
        self.gap |= gap

    def put(self, line: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        self.lines.append((self.indent + self.mark + line).rstrip(" "))
        self.indent, self.mark = (self.indent + " " * len(self.mark))[:INDENT], ""

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def run_steps(step: Generator) -> object:
    """Runs a generator that yields those it calls, on a stack of its own: elements may be nested to any depth."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def render(node: Node, page: Page) -> Generator:
    """Writes what can be seen of an element; for `run_steps`, as all that go down the tree."""
    for child in node.children:
        if isinstance(child, str):
            page.write(child)
        elif not seen(child):
            continue
        elif child.name == "br":
            page.end(forced=True)
        elif child.name == "hr":
            page.end(gap=True)
        elif child.name == "img":
            page.write(child.attributes.get("alt") or "")
        elif child.name == "pre":
            page.end(gap=True)
            for line in (yield _flat(child)).strip("\n").split("\n"):
                page.put(line)
            page.gap = True
        elif child.name == "table":
            page.end(gap=True)
            for line in (yield _table(child)):
                page.put(line)
            page.gap = True
        elif child.name in ("ul", "ol", "menu"):
            yield _list(child, page, child.name == "ol")
        elif child.name in BLOCK:
            gap = child.name in SPACED
            page.end(gap)
            before, mark = page.indent, page.mark
            page.indent = (page.indent + ("  " if child.name in ("blockquote", "dd") else ""))[:INDENT]
            yield render(folded(child), page)
            page.end(gap)
            # What follows the block that took a list item's mark stands under its text.
            page.indent = (before + " " * (len(mark) if not page.mark else 0))[:INDENT]
        else:
            yield render(child, page)


def _flat(node: Node) -> Generator:
    out = []
    for c in node.children:
        out.append(c if isinstance(c, str) else "\n" if c.name == "br" else (yield _flat(c)) if seen(c) else "")
    return "".join(out)


def _list(node: Node, page: Page, numbered: bool) -> Generator:
    nested = bool(page.indent or page.mark)
    page.end(gap=not nested)
    before, number = page.indent, whole_number(node.attributes.get("start"), 1)
    for child in node.children:
        if isinstance(child, Node) and child.name == "li" and seen(child):
            number = whole_number(child.attributes.get("value"), number)
            page.indent, page.mark = before, f"{number}. " if numbered else "- "
            number += 1
            yield render(child, page)
            page.end()
        elif isinstance(child, Node):
            wrapped = Node("div", {})
            wrapped.children = [child]
            page.indent, page.mark = (before + "  ")[:INDENT], ""
            yield render(wrapped, page)
            page.end()
        elif child.strip():
            page.write(child)
            page.end()
        page.indent, page.mark = before, ""
    page.gap |= not nested


def _table(node: Node) -> Generator:
    """Captions and rows; the cells of a column start at one place. Other content of a table comes before it."""
    rows: list[list[str]] = []
    before: list[str] = []

    def gather(part: Node) -> Generator:
        for child in part.children:
            if isinstance(child, str):
                before.extend(_WHITE.sub(" ", child).strip().splitlines())
            elif not seen(child):
                continue
            elif child.name in ROWS:
                yield gather(child)
            elif child.name == "tr":
                cells: list[str] = []
                for cell in child.children:
                    if isinstance(cell, Node) and seen(cell):
                        cells.append((yield _cell(cell)))
                        span = cell.attributes.get("colspan") or ""
                        cells.extend([""] * (min(int(span), 1000) - 1 if span.isascii() and span.isdigit() else 0))
                    elif isinstance(cell, str) and cell.strip():
                        before.append(_WHITE.sub(" ", cell).strip())
                rows.append(cells)
            elif child.name not in ("colgroup", "col"):
                before.append((yield _cell(child)))

    yield gather(node)
    widths: list[int] = []
    for row in rows:
        widths.extend([0] * (len(row) - len(widths)))
        for k, cell in enumerate(row):
            widths[k] = max(widths[k], *(n if (n := len(line)) <= WIDE else 0 for line in cell.split("\n")))
    out = [line for line in before if line]
    for row in rows:
        parts = [cell.split("\n") for cell in row]
        for k in range(max(map(len, parts), default=0)):
            line = [p[k] if k < len(p) else "" for p in parts]
            while line and not line[-1].strip(" "):
                line.pop()
            out.append(" | ".join(text.ljust(widths[c]) for c, text in enumerate(line)).rstrip(" "))
    return [line for line in out if line]


def _cell(node: Node) -> Generator:
    page = Page()
    yield render(node, page)
    return re.sub(r"\n{2,}", "\n", page.text())


def extract(html: str | None) -> str | None:
    """The text of a page that can be seen; null for a null page."""
    if html is None:
        return None
    tree = Tree()
    tree.feed(html)
    tree.close()
    page = Page()
    if seen(tree.root):
        run_steps(render(tree.root, page))
    return page.text()


def html_text(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """One row per row of `pages`: id, text (all that can be seen, laid out), n_chars, n_lines.

    Blocks stand on lines of their own, with an empty line around paragraphs, headings, lists, tables and quotations; list items have marks and
    indents, cells of a table's column start at one place, but for what stands right of lines of over WIDE characters. Elements may be nested to any depth; indents end at INDENT columns. White space is one blank, but not in <pre>. Scripts, styles, templates, embedded
    objects, form choices, hidden elements and what closed <details> hold are not seen; style sheets are not applied. A null page has a null text, an empty one an empty text; whatever is not well formed
    is read as far as it goes; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([extract(h) for h in batch.column("html").to_pylist()], pa.string())], ["id", "text"])

    found = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(html).alias("html")).mapInArrow(run, "id long, text string")
    n_lines = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
    return found.withColumns({"n_chars": F.length("text").cast("bigint"), "n_lines": n_lines.cast("bigint")})
