"""Layout-aware text of HTML pages.

A tokenizer feeds a tree builder that knows void elements and implied end tags
(an open paragraph ends at the next block, a list item at the next item, a cell
at the next cell or row, the head at whatever can't be in it). Invisible elements
(by name, a ``hidden`` attribute, or an inline style) are skipped whole. The renderer joins inline text with single blanks,
starts blocks on new lines, leaves one empty line around paragraphs and
headings, marks and indents list items, keeps preformatted text, and pads the
cells of a table to columns (a cell's own blocks and tables are joined by
blanks, ``colspan`` leaves columns free).

All of it is linear in the page: a tag is found by possessive patterns, an end
of a tag that its quotes swallow is looked for once, the places of the open
elements are kept by name, and nothing recurses.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe object svg audio video canvas datalist noembed noframes title".split())
#: Anything else ends the head. In a foreign element a slash at the tag's end closes it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
FOREIGN = frozenset("svg math".split())
#: These end an open foreign element, unless inside one of its text elements.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset article section".split())
BLOCK = SPACED | frozenset("html body div main header footer nav aside address form li dt dd hr center figcaption details summary tr caption thead tbody tfoot option".split())
#: An opening tag ends these open elements, up to the given boundary.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Comment, declaration, or tag; quotes hide a ``>`` in an attribute's value.
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++))?+)*+)>", re.S)
#: The same without regard to quotes.
_PLAIN_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN_STYLE = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!\s*important\s*)?(?=;|$)")
_SPAN = re.compile(r"(?i)(?:^|\s)colspan\s*=\s*[\"']?\s*([0-9]{1,9})")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_BARE_END = re.compile(r"=\s*[^\s\"'>]+$")
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "hidden", "children", "span")

    def __init__(self, tag: str, hidden: bool = False):
        self.tag, self.hidden, self.children, self.span = tag, hidden, [], 1


def _hidden(attributes: str) -> bool:
    """Whether there is a ``hidden`` attribute or a style that hides; values of others don't count."""
    seen = set()
    for name, double, single, bare in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in seen:  # the first of a name counts
            continue
        seen.add(name)
        if name == "hidden" or name == "style" and _UNSEEN_STYLE.search(_COMMENT.sub("", entities.unescape(double or single or bare))):
            return True
    return False


class _Open:
    """The stack of open elements with their places by name."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def end(self, tags: Iterable[str], bounds: Iterable[str]) -> None:
        """Close the open elements of these names that lie inside the nearest boundary."""
        bound = self.last(*bounds)
        outer = min((p[bisect_right(p, bound)] for t in tags if (p := self.places.get(t)) and p[-1] > bound), default=0)
        if outer:
            self.cut(outer)

    def foreign(self) -> int:
        """Place of the foreign element that holds the next tag, 0 if none."""
        at = self.last(*FOREIGN)
        return at if at > self.last(*INTEGRATION) else 0


def build(page: str) -> Node:
    """The tree of a page; text nodes are strings with entities resolved."""
    root = Node("html")
    tree = _Open(root)
    at = 0
    head = foreign = False
    token, last_end = _TOKEN, page.rfind(">")

    def leave_head() -> None:
        nonlocal head
        head = False
        tree.end(("head",), ("template", "noscript"))

    def text(part: str) -> None:
        if part:
            if head and tree.stack[-1].tag == "head" and part.strip():
                leave_head()
            tree.stack[-1].children.append(entities.unescape(part) if "&" in part else part)

    while at <= last_end or page.find("<!--", at) >= 0:
        found = _PLAIN_TOKEN.search(page, at)
        if not found:
            break
        if token is _TOKEN:
            if quoted := _TOKEN.match(page, found.start()):
                found = quoted
            else:  # its quotes hold every later end: from here on they are ordinary characters
                token = _PLAIN_TOKEN
        text(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            # without its element it is ignored; in a table so is one from outside
            place = tree.last(tag)
            if place and (place > tree.last("table") or tag in ("table", "body", "html", "div")):
                tree.cut(place)
            continue
        if head and tag not in IN_HEAD and tree.stack[-1].tag == "head":
            leave_head()
        if tag in ("html", "body") and tree.places.get(tag):
            continue
        if foreign and tag in BREAKOUT and (i := tree.foreign()):
            tree.cut(i)
        if tag in BLOCK:
            tree.end(("p",), ("table", "td", "th", "button", "li"))
        if tag in ENDS:
            tree.end(*ENDS[tag])
        node = Node(tag, tag in UNSEEN or bool(attributes and _hidden(attributes)))
        if tag in ("td", "th") and attributes and (span := _SPAN.search(attributes)):
            node.span = min(max(1, int(span[1])), 1000)  # the standard's bound
        tree.stack[-1].children.append(node)
        head = head or tag == "head"
        foreign = foreign or tag in FOREIGN
        if foreign and attributes.endswith("/") and not _BARE_END.search(attributes) and (tag in FOREIGN or tree.foreign()):
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            stop = end.start() if end else len(page)
            node.children.append(page[at:stop] if tag in ("script", "style") else entities.unescape(page[at:stop]))
            at = page.find(">", stop) + 1 if end else len(page)
            at = at or len(page)
        elif tag not in VOID:
            tree.push(node)
    text(page[at:])
    return root


class _Out:
    """Lines being written: ``gap`` empty lines are due before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = self.spaced = False
        self.indent = ""
        self.mark = ""

    def inline(self, part: str) -> None:
        words = _BLANK.sub(" ", part)
        if not words.strip(" "):
            self.blank = self.blank or bool(words)
            return
        if self.line and (self.blank or words[0] == " "):
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.blank = words[-1] == " "

    def end_line(self) -> None:
        if self.line:
            self._put(self.indent + self.mark + "".join(self.line))
        self.line, self.blank = [], False

    def line_break(self) -> None:
        """The first ends the line, each further one leaves an empty line."""
        if self.line:
            self.end_line()
        elif self.lines and not self.spaced:
            self.lines.append("")

    def _put(self, line: str) -> None:
        if self.spaced and self.lines and self.lines[-1]:
            self.lines.append("")
        self.spaced = False
        self.lines.append(line.rstrip())
        if self.mark:
            self.indent += " " * len(self.mark)
            self.mark = ""

    def block(self, lines: list[str]) -> None:
        self.end_line()
        for line in lines:
            self._put(self.indent + self.mark + line if line else line)

    def space(self) -> None:
        self.end_line()
        self.spaced = True


def render(root: Node) -> str:
    out = _Out()
    _render(root, out)
    out.end_line()
    return "\n".join(out.lines).strip("\n")


def _render(root: Node, out: _Out) -> None:
    """Walk with an own stack, so that deep nesting can't exhaust Python's."""
    work: list = [("open", root)]
    counters: list[list] = []
    while work:
        action, item = work.pop()
        if action == "do":
            item()
            continue
        if isinstance(item, str):
            out.inline(item)
            continue
        if item.hidden:
            continue
        tag = item.tag
        if tag == "br":
            out.line_break()
            continue
        if tag == "img":
            continue
        if tag == "hr":
            out.space()
            continue
        if tag == "pre":
            out.space()
            out.block(_raw_text(item).strip("\n").split("\n"))
            out.space()
            continue
        if tag == "table":
            out.space()
            out.block(_table(item))
            out.space()
            continue
        after = []
        if tag in BLOCK:
            (out.space if tag in SPACED and not (tag in ("ul", "ol") and counters) else out.end_line)()
            after.append(out.space if tag in SPACED and not (tag in ("ul", "ol") and len(counters) > 0) else out.end_line)
        if tag in ("ul", "ol"):
            counters.append([tag, 0])
            after.append(counters.pop)
        elif tag == "li":
            before = out.indent
            if counters:
                counters[-1][1] += 1
            out.mark = f"{counters[-1][1]}. " if counters and counters[-1][0] == "ol" else "- "

            def leave(before=before):
                out.end_line()
                out.indent, out.mark = before, ""

            after.append(leave)
        elif tag in ("blockquote", "dd"):
            before = out.indent
            out.indent += "  "

            def back(before=before):
                out.end_line()
                out.indent = before

            after.append(back)
        elif tag in ("td", "th"):
            out.blank = True
        work += [("do", f) for f in after]
        work += [("open", c) for c in reversed(item.children)]


def _raw_text(node: Node) -> str:
    parts, work = [], [node]
    while work:
        item = work.pop()
        if isinstance(item, str):
            parts.append(item)
        elif item.tag == "br":
            parts.append("\n")
        elif not item.hidden:
            work += reversed(item.children)
    return "".join(parts)


def _flat(node: Node) -> str:
    """The text of a cell on one line: blocks, items and inner tables are apart by blanks."""
    parts: list[str] = []
    counters: list[list] = []
    work: list = list(reversed(node.children))
    while work:
        item = work.pop()
        if item is None:
            counters.pop()
        elif isinstance(item, str):
            parts.append(item)
        elif not item.hidden:
            tag = item.tag
            apart = tag in BLOCK or tag in ("br", "td", "th", "table")
            if apart:
                parts.append(" ")
                work.append(" ")
            if tag in ("ul", "ol"):
                counters.append([tag, 0])
                work.append(None)
            elif tag == "li":
                if counters:
                    counters[-1][1] += 1
                parts.append(f"{counters[-1][1]}. " if counters and counters[-1][0] == "ol" else "- ")
            work += reversed(item.children)
    return " ".join("".join(parts).split())


def _table(table: Node) -> list[str]:
    """Rows with cells padded to the width of their column; a caption first."""
    before: list[str] = []
    rows: list[list[tuple[str, int]]] = []
    work: list = list(reversed(table.children))
    while work:
        item = work.pop()
        if isinstance(item, str):
            if item.strip():
                before.append(_BLANK.sub(" ", item).strip(" "))
        elif item.hidden:
            continue
        elif item.tag == "tr":
            cells = []
            for c in item.children:
                if isinstance(c, str):
                    if c.strip():
                        cells.append((_BLANK.sub(" ", c).strip(" "), 1))
                elif not c.hidden:
                    cells.append((_flat(c), c.span))
            rows.append(cells)
        elif item.tag in ("thead", "tbody", "tfoot"):
            work += reversed(item.children)
        elif inner := _flat(_around(item)):
            before.append(inner)
    widths: dict[int, int] = {}
    for cells in rows:
        place = 0
        for text, span in cells:
            if span == 1:
                widths[place] = max(widths.get(place, 0), len(text))
            place += span
    lines = []
    for cells in rows:
        line, place = [], 0
        for text, span in cells:
            room = sum(widths.get(i, 0) for i in range(place, place + span)) + 2 * (sum(i in widths for i in range(place, place + span)) - 1)
            line.append(text.ljust(room))
            place += span
        if any(text for text, _ in cells):
            lines.append("  ".join(line).rstrip())
    return before + lines


def _around(node: Node) -> Node:
    outer = Node("div")
    outer.children.append(node)
    return outer


def page_text(page: str) -> str:
    return render(build(page))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: id, ``text`` (all visible text), ``n_chars`` and ``n_lines``.

    Null and empty html give an empty text (0, 0); pages of any length and depth
    are read whole. Null ids stay null; repeated rows give repeated results; an
    empty table gives an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = [page_text(p) if p else "" for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                names=["id", "text", "n_chars", "n_lines"],
            )

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string, n_chars long, n_lines long").withColumnRenamed("id", id_col)
