"""HTML extraction by layout-aware rendering.

A tree builder turns each page's tags into a tree, supplying implied end tags;
visibility rules cut what a reader does not see; a renderer emits the visible
text with the spacing of blocks, bullets and numbers of lists, and table cells
aligned in columns. Spark deals the pages out; one page is one row of work.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import rebatched

# Fixed values of the HTML standard: element kinds, and which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style".split())
HIDDEN = frozenset("script style head title meta link template noscript iframe datalist audio video canvas".split())
# what drawings and formulas hold beside what they show, and inputs whose value is not shown
HIDDEN_WITHIN = {"svg": frozenset("defs desc metadata symbol clippath mask pattern marker".split()), "math": frozenset({"annotation", "annotation-xml"})}
NO_VALUE = frozenset("hidden password checkbox radio file range color image".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol p pre section summary table tr td th ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
# an open paragraph or head ends where a block begins, within its table cell or button
PARAGRAPH_LIMIT = frozenset({"button", "td", "th", "caption", "table"})
TABLE_PARTS = frozenset({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"})
# tables within tables that are still aligned; what lies deeper is laid out as blocks
NESTED = 12
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    name: str
    attributes: dict[str, str | None] = field(default_factory=dict)
    children: list = field(default_factory=list)
    within: str = ""  # svg or math, if inside one

    @property
    def seen(self) -> bool:
        own = self.attributes
        return not (
            self.name in HIDDEN or "hidden" in own or (own.get("aria-hidden") or "").lower() == "true"
            or UNSEEN.search(own.get("style") or "") or self.name in HIDDEN_WITHIN.get(self.within, ())
            or (self.name == "dialog" and "open" not in own)
        )

    def shows(self, inherited: bool) -> bool:
        """Whether its own text shows: visibility is inherited, and may be set anew."""
        own = VISIBILITY.findall(self.attributes.get("style") or "")
        word = own[-1].lower() if own else ""
        return word == "visible" or (inherited and word not in ("hidden", "collapse"))


def words_of(node: Node) -> str:
    """All text below a node."""
    out, work = [], [node]
    while work:
        node = work.pop()
        if isinstance(node, str):
            out.append(node)
        else:
            work.extend(reversed(node.children))
    return "".join(out)


def options(select: Node) -> list[str]:
    """What a select shows: the chosen option, or in a list box all options and names of groups."""
    found, work = [], list(reversed(select.children))
    while work:
        node = work.pop()
        if isinstance(node, str) or not node.seen:
            continue
        if node.name == "option":
            found.append((node, node.attributes.get("label") or BLANKS.sub(" ", words_of(node)).strip()))
            continue
        if node.name == "optgroup":
            found.append((node, node.attributes.get("label") or ""))
        work.extend(reversed(node.children))
    if "multiple" in select.attributes or whole(select.attributes.get("size"), 1, 1000) > 1:
        return [text for _, text in found if text]
    own = [(n, text) for n, text in found if n.name == "option"]
    chosen = [text for n, text in own if "selected" in n.attributes][-1:] or [text for n, text in own if "disabled" not in n.attributes][:1]
    return chosen


def whole(value: str | None, default: int, most: int) -> int:
    digits = re.match(r"\s*\+?0*(\d+)", value or "")
    return min(int(digits[1][:9]), most) if digits else default


class Builder(HTMLParser):
    """Builds the tree; never fails, whatever the tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.held: Counter[str] = Counter()  # open elements by name

    def close_until(self, names: set[str], limits: set[str] | frozenset[str], every: bool = True) -> None:
        """Ends the open elements of `names` (and what they hold) above the nearest of `limits`."""
        if not any(self.held[n] for n in names):
            return
        lowest = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in limits:
                break
            if self.open[i].name in names:
                lowest = i
                if not every:
                    break
        if lowest is not None:
            self.cut(lowest)

    def cut(self, depth: int) -> None:
        self.held.subtract(n.name for n in self.open[depth:])
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in ENDS:
            self.close_until(*ENDS[tag])
        if tag in BLOCKS and tag not in ("html", "body"):
            self.close_until({"p"}, PARAGRAPH_LIMIT)
            self.close_until({"head"}, frozenset())
        if re.fullmatch("h[1-6]", tag):
            if re.fullmatch("h[1-6]", self.open[-1].name):
                self.cut(len(self.open) - 1)
        if tag in ("td", "th") and self.open[-1].name in ("table", "thead", "tbody", "tfoot"):
            self.handle_starttag("tr", [])
        node = Node(tag, dict(reversed(attrs)), within="svg" if self.held["svg"] else "math" if self.held["math"] else "")
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.held[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag):
        if tag == "p" and not self.held["p"]:
            self.open[-1].children.append(Node("p"))  # an end tag alone is an empty paragraph
        elif tag == "br":
            self.open[-1].children.append(Node("br"))
        elif tag not in ("html", "body"):
            # a table is left by its own end tag only, a cell by that of its row or group too
            limits = frozenset() if tag == "table" else frozenset({"table"}) if tag in TABLE_PARTS else PARAGRAPH_LIMIT
            self.close_until({tag}, limits, every=False)

    def handle_data(self, data):
        if self.open[-1].name in ("table", "thead", "tbody", "tfoot", "tr") and not data.strip():
            return
        self.open[-1].children.append(data)


class Renderer:
    """Visible text of a tree. `lines` holds finished lines; `line` the current one."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a blank is due before the next word

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.split("\n")
            self.line.append(first)
            for part in rest:
                self.end_line()
                self.line.append(part)
            return
        words = BLANKS.split(data)
        for i, word in enumerate(words):
            if i:
                self.gap = True
            if word:
                if self.gap and self.line:
                    self.line.append(" ")
                self.gap = False
                self.line.append(word)

    def end_line(self, force: bool = True) -> None:
        text = "".join(self.line).rstrip(" ")
        if text or force:
            self.lines.append(text)
        self.line, self.gap = [], False

    def block(self, spaced: bool) -> None:
        """Begins a new line, after an empty one if `spaced`."""
        if "".join(self.line).strip(" "):
            self.end_line()
        self.line, self.gap = [], False
        if spaced and self.lines and self.lines[-1]:
            self.lines.append("")

    def done(self) -> str:
        self.block(False)
        out: list[str] = []
        for line in self.lines:
            if line or (out and out[-1]):
                out.append(line)
        while out and not out[-1]:
            out.pop()
        return "\n".join(out)


def rendered(children: list, pre: bool = False, depth: int = 0, shown: bool = True) -> list[str]:
    """Lines of a list of nodes. Depth is kept on a stack of its own, so deep pages cannot exhaust Python's."""
    page = Renderer()
    # work: (what, node, pre, shown); "in" enters a node, "out" leaves it
    work: list[tuple] = [("in", c, pre, shown) for c in reversed(children)]
    lists: list[list] = []
    while work:
        what, node, pre, shown = work.pop()
        if what == "out":
            if node.name in ("ul", "ol"):
                lists.pop()
            page.block(node.name in SPACED and not (node.name in ("ul", "ol") and lists))
            continue
        if isinstance(node, str):
            if shown:
                page.text(node, pre)
            continue
        if not node.seen:
            continue
        name, shown = node.name, node.shows(shown)
        if name == "br":
            page.end_line()
        elif name == "hr":
            page.block(True)
        elif name == "wbr":
            pass
        elif name == "img":
            if shown and (alt := BLANKS.sub(" ", node.attributes.get("alt") or "").strip()):
                page.text(alt, False)
        elif name == "input":
            kind = (node.attributes.get("type") or "").strip().lower()
            value = node.attributes.get("alt" if kind == "image" else "value") or ""
            if shown and value.strip() and (kind == "image" or kind not in NO_VALUE):
                page.text(f" {value} ", False)
        elif name == "textarea":
            if shown and (value := words_of(node).removeprefix("\n")).strip():
                page.block(False)
                page.text(value, True)
                page.block(False)
        elif name == "select":
            for k, value in enumerate(options(node) if shown else []):
                if k:
                    page.end_line()
                page.text(f" {value} ", False)
        elif name == "table" and depth < NESTED:
            page.block(True)
            page.lines.extend(table_lines(node, depth + 1, shown))
            page.block(True)
        else:
            if name in BLOCKS or (name == "text" and node.within == "svg"):
                page.block(name in SPACED and not (name in ("ul", "ol") and lists))
                if name in ("ul", "ol"):
                    start = node.attributes.get("start") or ""
                    lists.append([name, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                if name == "li":
                    mark = "- "
                    if lists and lists[-1][0] == "ol":
                        mark = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    page.line = ["  " * max(0, len(lists) - 1) + mark] if shown else []
                elif name == "dd":
                    page.line = ["  "]
                work.append(("out", node, pre, shown))
            inner = pre or name == "pre"
            work.extend(("in", c, inner, shown) for c in reversed(node.children))
    return page.done().split("\n")


def cells(table: Node, shown: bool = True) -> Iterator[tuple[str, list, bool]]:
    """("text", nodes, shown), ("row", cell nodes, shown) and ("group", [], shown) where a group of rows begins or ends."""
    work: list = [(c, shown) for c in reversed(table.children)]
    while work:
        node, shown = work.pop()
        if node is None:
            yield "group", [], shown
            continue
        if isinstance(node, str):
            if node.strip():
                yield "text", [node], shown
            continue
        if not node.seen:
            continue
        if node.name not in ("tr", "thead", "tbody", "tfoot", "colgroup", "caption"):
            yield "text", [node], shown
            continue
        shown = node.shows(shown)
        if node.name == "tr":
            yield "row", [c for c in node.children if isinstance(c, Node) and c.name in ("td", "th") and c.seen], shown
            stray = [c for c in node.children if isinstance(c, str) and c.strip() or isinstance(c, Node) and c.name not in ("td", "th")]
            if stray:
                yield "text", stray, shown
        elif node.name == "caption":
            yield "text", node.children, shown
        else:
            work.extend([(None, shown), *((c, shown) for c in reversed(node.children)), (None, shown)])


# the largest spans of the HTML standard
COLUMNS, ROWS = 1000, 65534


def table_lines(table: Node, depth: int = 0, shown: bool = True) -> list[str]:
    """Rows with cells aligned in columns; a cell of several lines takes several lines.

    A cell over several rows stands in the first; its columns are left free in the others, up to the end of their group.
    """
    before, rows = [], []
    until: list[float] = []  # per column, the number of the row from which on it is free
    at = 0
    for kind, nodes, seen in cells(table, shown):
        if kind == "text":
            before.extend(line for line in rendered(nodes, False, depth, seen) if line)
            continue
        if kind == "group":
            until = []
            continue
        row: list[list[str]] = []
        for cell in nodes:
            while len(row) < len(until) and until[len(row)] > at:
                row.append([""])
            down = whole(cell.attributes.get("rowspan"), 1, ROWS)
            lines = [line for line in rendered(cell.children, False, depth, cell.shows(seen)) if line] or [""]
            for k in range(max(1, whole(cell.attributes.get("colspan"), 1, COLUMNS))):
                if len(row) == len(until):
                    until.append(0)
                until[len(row)] = max(until[len(row)], at + down if down else float("inf"))
                row.append([""] if k else lines)
        at += 1
        if any(any(c) for c in row):
            rows.append(row)
    width: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            if i == len(width):
                width.append(0)
            width[i] = max(width[i], *map(len, cell))
    out = before
    for row in rows:
        for k in range(max(map(len, row))):
            out.append(" | ".join((cell[k] if k < len(cell) else "").ljust(width[i]) for i, cell in enumerate(row)).rstrip(" |"))
    return [line for line in out if line]


def render(html: str) -> str:
    last = html.rfind("<")
    if last >= 0 and ">" not in html[last:] and re.match("</?[a-zA-Z]", html[last:]):
        html = html[:last]  # a tag that the end of the page cuts off is none
    builder = Builder()
    builder.feed(html)
    builder.close()
    return "\n".join(rendered([builder.root]))


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per input row: page_id, text, n_chars, n_lines.

    * null or empty HTML, or nothing visible: empty text, no lines;
    * broken, unclosed or misnested tags: repaired as browsers do in the
      common cases; never an error;
    * null ids and repeated rows: a row each; very long and very deep pages:
      whole; empty table: no rows; further columns are ignored.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, "html", 8 << 20):
            found = [render(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(found, pa.string())], ["page_id", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    text = F.col("text")
    return rows.mapInArrow(run, f"page_id {kind}, text string").select(
        "page_id", "text", F.length(text).cast("long").alias("n_chars"),
        F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n", -1))).cast("long").alias("n_lines"),
    )
