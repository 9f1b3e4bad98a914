"""Layout-aware text of HTML pages: a tree with implied tags, visibility rules, and a rendering that keeps block spacing,
lists and aligned table cells."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import blank_null, ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: What may stand in a head; any other element ends it.
IN_HEAD = frozenset("title meta link base basefont bgsound script style noscript noframes template".split())
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist".split())
#: Parts of svg and math elements that aren't drawn; elsewhere these are unknown names, which are shown.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml mphantom".split())
#: Parts of them that stand apart from what is before and after.
APART = frozenset("text mtr mtd".split())
#: Blocks with a blank line around them, and those with a line break alone.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset details".split())
BLOCKS = SPACED | frozenset("html body div section article aside header footer nav main form address li dt dd tr caption figcaption legend summary thead tbody tfoot center option".split())
#: A start tag ends these open elements, up to a boundary.
ENDS = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "td", "th"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select",)),
    "body": (("head",), ("html",)),
}
_P_ENDERS = BLOCKS - frozenset("li dt dd tr caption thead tbody tfoot option html body".split())
#: End tags that reach out of a cell or table.
_THROUGH = frozenset("table tr tbody thead tfoot body html td th".split())
_P_BOUNDS = frozenset("td th table li blockquote div section article body".split())
#: An attribute's name and value; quotes count only where a value begins.
_NAME, _VALUE = r"(?:=[^\s/>=]*+|[^\s/>=]++)", r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)"
_BARE = r"(?:\"[^\"<]*+\"|'[^'<]*+'|[^\s>\"'<][^\s><]*+|(?=[>/\s]))"
#: A comment, declaration, tag or text; only tags without another "<" in them, so a try ends where the next piece begins.
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/><]*+)((?:[\s/]++|(?:=[^\s/>=<]*+|[^\s/>=<]++)(?:\s*+=\s*+{_BARE}|(?!\s*+=)))*+)>|[^<]+|<", re.S)
_OPEN, _GAP, _NAMED, _UNQUOTED = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)"), re.compile(r"[\s/]*+"), re.compile(rf"{_NAME}(\s*+=\s*+)?+"), re.compile(r"[^\s>]*+")
_ATTR = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE})?+)?+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
#: Columns in which cells may span rows; further right each is taken for one row.
SPANNED = 200
#: Tables within tables whose cells are aligned; what is nested deeper comes out as blocks.
TABLES = 16
#: Indents and list marks that stand before a line; those of lists within lists within lists beyond that are left out.
DEPTH = 40
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        return {k.lower(): unescape(v[1:-1] if v[:1] in ("'", '"') else v) for k, v in _ATTR.findall(self.attrs)}


class _Tags:
    """Ends of tags that have a "<" within. A way to the end of the page without one is walked once, so that the time for a page
    is in proportion to its length whatever stands in it."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in "\"'>"}
        self.dead: set[int] = set()  # quotes from which no end is found
        self.hopeless = 0  # tags that begin before this place have none

    def end(self, at: int, start: int) -> int:
        """The place of ">" for a tag that begins at start and whose attributes begin at at; -1 if there's none."""
        page, n = self.page, len(self.page)
        if start < self.hopeless or start > self.last[">"]:
            return -1
        passed: list[int] = []
        while True:
            at = _GAP.match(page, at).end()
            if at >= n or at > self.last[">"]:
                break
            if page[at] == ">":
                return at
            m = _NAMED.match(page, at)
            at = m.end()
            if m[1] is None or at >= n:
                continue
            if (quote := page[at]) not in "\"'":
                at = _UNQUOTED.match(page, at).end()
            elif at < self.last[quote]:
                if at in self.dead:
                    break
                passed.append(at)
                at = page.index(quote, at + 1) + 1
        self.hopeless = passed[0] if passed else n
        self.dead.update(passed)
        return -1


class _Stack:
    """Open elements, and where those of a name stand."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        for node in self.nodes[at:]:
            self.places[node.tag].pop()
        del self.nodes[at:]

    def last(self, *tags: str) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def imply(self, ended, bounds) -> None:
        """Closes the outermost of ended that's open within the innermost of bounds."""
        if not any(self.places.get(t) for t in ended):
            return
        # an element that is both ended and a bound ends
        bound = self.last(*[t for t in bounds if t not in ended])
        inside = [p[k] for t in ended if (p := self.places.get(t)) and (k := bisect_right(p, bound)) < len(p)]
        if inside:
            self.cut(min(inside))


def parse(page: str) -> Node:
    """The tree of a page; missing end tags are implied, stray ones are passed over."""
    root = Node("#root")
    stack, tags, at, n = _Stack(root), _Tags(page), 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        start, at, tag = at, m.end(), m[2]
        closing, attrs = m[1], m[3]
        if tag is None and m[0] == "<" and (m := _OPEN.match(page, start)) and (end := tags.end(m.end(), start)) >= 0:
            closing, tag, attrs, at = m[1], m[2], page[m.end() : end], end + 1
        top = stack.nodes[-1]
        if tag is None:
            if (text := page[start:at])[:2] not in ("<!", "<?"):
                if top.tag == "head" and text.strip(" \t\n\r\f"):
                    stack.cut(len(stack.nodes) - 1)
                stack.nodes[-1].children.append(text)
            continue
        tag = tag.lower()
        if closing:
            if (own := stack.last(tag)) and (tag in _THROUGH or own > stack.last("td", "th", "table")):
                stack.cut(own)
            continue
        if top.tag == "head":
            if tag == "head":
                continue
            if tag not in IN_HEAD:
                stack.cut(len(stack.nodes) - 1)
        if tag in ENDS:
            stack.imply(*ENDS[tag])
        if tag in _P_ENDERS:
            stack.imply(("p",), _P_BOUNDS)
        node = Node(tag, attrs)
        stack.nodes[-1].children.append(node)
        if tag in RAW and not (attrs.endswith("/") and stack.last("svg", "math")):
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            shut = page.find(">", end.end()) if end else -1
            node.children.append(page[at : end.start() if shut >= 0 else n])
            at = shut + 1 if shut >= 0 else n
        elif tag not in VOID and not attrs.endswith("/"):
            stack.push(node)
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    if not node.attrs or node.attrs.isspace():
        return True
    low = node.attrs.lower()
    if "hidden" not in low and "display" not in low and "visibility" not in low:
        return True
    a = node.attributes()
    return not ("hidden" in a or _UNSEEN.search(a.get("style", "")) or (node.tag == "input" and a.get("type", "").lower() == "hidden"))


class Page:
    """Text under way: finished lines, the open line, and the blank lines owed before it."""

    def __init__(self):
        self.lines: list[str] = []
        self.open: list[str] = []
        self.indent: list[str] = []
        self.mark = ""
        self.blank = False

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", unescape(s) if "&" in s else s)
        if not self.open or self.open[-1].endswith(" "):
            s = s.lstrip(" ")
        if s:
            self.open.append(s)

    def pre(self, s: str) -> None:
        first, *rest = (unescape(s) if "&" in s else s).split("\n")
        self.open.append(first)
        for line in rest:
            self.end_line(keep=True)
            self.open.append(line)

    def end_line(self, keep: bool = False) -> None:
        line = "".join(self.open)
        line = line.rstrip("\r") if keep else line.strip(" ")
        self.open = []
        if line or keep:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            indent = "".join(self.indent[:DEPTH])
            self.lines.append((indent[: -len(self.mark)] + self.mark if self.mark else indent) + line)
            self.mark = ""

    def gap(self) -> None:
        self.end_line()
        self.blank = True

    def done(self) -> str:
        self.end_line()
        return "\n".join(x.rstrip() for x in self.lines).strip("\n")


def grid(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table's rows of cells (text, columns, rows that it spans), padded to the width of their columns; a cell of
    several lines takes several rows. A spanned place is left blank; a span over columns in which no cell begins is one column."""
    placed: list[list[tuple[int, int, str]]] = []  # first column, the one after the last, text
    below: dict[int, tuple[int, int]] = {}  # first column -> column after the last, rows left
    for row in rows:
        at, own, held = 0, [], {}
        for text, columns, down in row:
            while at in below:
                own.append((at, below[at][0], ""))
                held[at] = below[at]
                at = below[at][0]
            own.append((at, at + columns, text))
            if down > 1 and at < SPANNED:
                held[at] = (at + columns, down)
            at += columns
        for k, x in below.items():
            if k >= at:
                held[k] = x
                own.append((k, x[0], ""))
        while own and not own[-1][2] and len(own) > len(row):
            own.pop()
        placed.append(own)
        below = {k: (e, left - 1) for k, (e, left) in held.items() if left > 1}
    used = sorted({a for row in placed for a, _, _ in row})
    rank = {a: i for i, a in enumerate(used)}
    lines = [[(rank[a], max(rank[a] + 1, bisect_left(used, z)), text.split("\n")) for a, z, text in row] for row in placed]
    width = [0] * len(used)
    for wide in (False, True):  # cells of one column first; what a wider one lacks goes to its last column
        for row in lines:
            for a, z, cell in row:
                if (z - a > 1) == wide:
                    short = max(map(len, cell)) - sum(width[a:z]) - 3 * (z - a - 1)
                    width[z - 1] += max(0, short)
    out = []
    for row in lines:
        for k in range(max((len(c) for _, _, c in row), default=0)):
            out.append(" | ".join((c[k] if k < len(c) else "").ljust(sum(width[a:z]) + 3 * (z - a - 1)) for a, z, c in row).rstrip())
    return out


def spans(node: Node) -> tuple[int, int]:
    """Columns and rows that a cell spans."""
    if "span" not in node.attrs.lower():
        return 1, 1
    given = node.attributes()
    of = lambda name, most: min(most, max(1, int(m[0]))) if (m := re.match(r"\s*0*([0-9]{1,6})", given.get(name, ""))) and m[1] else 1
    return of("colspan", 1000), of("rowspan", 65534)


def render(root: Node) -> str:
    """All visible text. Nodes are walked with a stack of our own, so nesting of any depth will do."""
    page = Page()
    tables: list[tuple[Page, list[list[tuple[str, int, int]]]]] = []
    lists: list[list] = []
    pre = drawn = level = 0
    todo: list = [("in", root)]
    while todo:
        step, x = todo.pop()
        if step == "in":
            if isinstance(x, str):
                page.pre(x) if pre else page.text(x)
                continue
            tag = x.tag
            if not visible(x) or (drawn and tag in UNDRAWN):
                continue
            if tag == "br":
                page.end_line(keep=bool(page.open) and pre > 0)
                continue
            if tag in ("img", "input"):
                if "alt" in x.attrs and (alt := x.attributes().get("alt")):
                    page.text(f" {alt} ")
                continue
            if tag == "hr":
                page.gap()
                continue
            todo.append(("out", x))
            todo += [("in", c) for c in reversed(x.children)]
            if tag in ("svg", "math"):
                drawn += 1
            elif drawn and tag in APART:
                page.text(" ")
            level += tag == "table"
            if level > TABLES and tag in ("td", "th", "tr", "table"):
                page.end_line()
            elif tag in ("td", "th") and tables:
                if not tables[-1][1]:
                    tables[-1][1].append([])
                tables.append((page, []))
                page = Page()
            elif tag == "table":
                page.gap()
                tables.append((page, []))
            elif tag == "tr" and tables:
                page.end_line()
                tables[-1][1].append([])
            elif tag in SPACED:
                nested = tag in ("ul", "ol") and lists
                page.end_line() if nested else page.gap()
                if tag in ("ul", "ol"):
                    lists.append([tag, 0])
                elif tag == "blockquote":
                    page.indent.append("> ")
                elif tag == "pre":
                    pre += 1
            elif tag == "li":
                page.end_line()
                kind = lists[-1] if lists else ["ul", 0]
                kind[1] += 1
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                page.indent.append(" " * len(mark))
                page.mark = mark
            elif tag == "dd":
                page.end_line()
                page.indent.append("  ")
            elif tag in BLOCKS:
                page.end_line()
            continue
        tag = x.tag
        if tag in ("svg", "math"):
            drawn -= 1
        elif drawn and tag in APART:
            page.text(" ")
        deep = level > TABLES
        level -= tag == "table"
        if deep and tag in ("td", "th", "tr", "table"):
            page.end_line()
        elif tag in ("td", "th") and tables:
            outer, _ = tables.pop()
            cell = page.done()
            page = outer
            tables[-1][1][-1].append((cell, *spans(x)))
        elif tag == "table":
            _, rows = tables.pop()
            page.end_line()
            for line in grid([r for r in rows if r]):
                page.open.append(line)
                page.end_line(keep=True)
            page.gap()
        elif tag in SPACED:
            if tag == "pre":
                pre -= 1
                page.end_line(keep=bool("".join(page.open)))
            if tag in ("ul", "ol"):
                lists.pop()
            elif tag == "blockquote":
                page.end_line()
                page.indent.pop()
            page.end_line() if tag in ("ul", "ol") and lists else page.gap()
        elif tag in ("li", "dd"):
            page.end_line()
            if page.indent:
                page.indent.pop()
            page.mark = ""
        elif tag in BLOCKS:
            page.end_line()
    return page.done()


def page_text(html: str) -> str:
    return render(parse(html))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text of all pages (page_id, html; other columns are ignored).

    A null or empty page gives an empty text. Each row is rendered on its own, so null and repeated ids and repeated rows
    stay as they are; broken markup of any kind gives some text. An empty table gives no row.
    """
    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch["page_id"], pa.array([page_text(h) for h in batch["html"].to_pylist()], pa.string())], names=["page_id", "text"])

    return pages.select("page_id", blank_null("html").alias("html")).mapInArrow(run, "page_id long, text string")
