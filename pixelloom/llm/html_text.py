"""Layout-aware text of HTML pages.

A tree builder closes what HTML implies to be closed, visibility rules drop what a browser wouldn't
show, and a renderer writes all other text: blocks on lines of their own, paragraphs apart, lists
with marks and indents, table cells aligned in columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
HIDDEN = frozenset("head script style template noscript noembed noframes iframe object audio video canvas datalist title desc defs param source track area base link meta rp".split())
#: Line breaks that an element asks for before and after it: two stand for an empty line.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre figure hr listing xmp".split())
BLOCK = APART | frozenset(
    "html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup legend li main nav optgroup option search section summary caption thead tbody tfoot tr".split()
)
#: An open <p> ends where one of these begins.
ENDS_P = APART | frozenset("address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup li main nav search section summary".split())
#: Start tag -> open elements that it closes, and those that it doesn't look beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
#: An end tag doesn't reach out of these.
WALLS = frozenset("table td th caption button object template".split())
#: Lines of a cell are broken between words at this width, so that columns stay aligned and layout tables don't blow up.
WIDEST = 120
#: Most columns and rows that a cell may span (fixed by the HTML standard).
MOST_SPANNED = {"colspan": 1000, "rowspan": 65534}

_NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_OPEN_QUOTE = re.compile(r"\s*=\s*[\"']")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_NOT_CSS = re.compile(r"/\*.*?\*/|<!--|-->|\"[^\"\n]*\"|'[^'\n]*'", re.S)
_CSS_MARK = re.compile(r"[{};]")
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
_UNSEEN = {"display": {"none"}, "visibility": {"hidden", "collapse"}}
_ON_SCREEN = re.compile(r"(?:(?:only\s+)?(?:all|screen))?", re.I)
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_SIMPLE = re.compile(r"(?:[a-z][a-z0-9]*|\*)?(?:[.#][\w-]+)?", re.I)


class Node:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on, and the place after the tag's ``>`` (the first of a name counts)."""
    found: dict[str, str] = {}
    while True:
        while at < len(html) and html[at] in " \t\n\r\f/":
            at += 1
        if at >= len(html) or html[at] == ">":
            return found, at + 1
        if not (m := _ATTRIBUTE.match(html, at)) or m.end() == at:
            at += 1
            continue
        at = m.end()
        if at == m.end(1) and _OPEN_QUOTE.match(html, at):  # a quote that never ends
            return found, len(html)
        found.setdefault(m[1].lower(), unescape(next((v for v in m.groups()[1:] if v is not None), "")))


def parse(html: str) -> tuple[Node, list[str]]:
    """The tree, and the texts of its style sheets."""
    root = node = Node("#root", {}, None)
    sheets: list[str] = []
    at, n = 0, len(html)
    depth = Counter()  # open elements by tag, so that deep pages aren't walked up in vain

    def leave(x: Node) -> None:
        """Ends ``x`` and all that is open within it."""
        nonlocal node
        while node is not x:
            depth[node.tag] -= 1
            node = node.parent
        depth[x.tag] -= 1
        node = x.parent

    def close(tags: set, walls: frozenset | set) -> None:
        """Ends the outermost open element of ``tags`` inside the nearest wall."""
        if not any(depth[t] for t in tags):
            return
        x, last = node, None
        while x is not root and x.tag not in walls:
            if x.tag in tags:
                last = x
            x = x.parent
        if last is not None:
            leave(last)

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            node.children.append(unescape(html[at:lt]))
        if lt >= n:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 2)
            at = n if end < 0 else end + 3
        elif html[lt + 1 : lt + 2] in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
        elif m := _NAME.match(html, lt + 2) if html[lt + 1 : lt + 2] == "/" else None:
            end = html.find(">", m.end())
            at = n if end < 0 else end + 1
            tag = m[0].lower()
            if tag == "br":
                node.children.append(Node("br", {}, node))
            elif depth[tag]:
                x = node
                walls = WALLS - {tag} - ({"td", "th", "caption"} if tag in ("table", "tr", "thead", "tbody", "tfoot") else set())
                while x is not root and x.tag != tag and x.tag not in walls:
                    x = x.parent
                if x is not root and x.tag == tag:
                    leave(x)
        elif m := _NAME.match(html, lt + 1):
            tag = m[0].lower()
            attributes, at = _attributes(html, m.end())
            if tag in ENDS_P and depth["p"]:
                x = node
                while x is not root and x.tag != "p" and x.tag not in WALLS:
                    x = x.parent
                if x.tag == "p":
                    leave(x)
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            elif node.tag == "head" and (tag in BLOCK or tag in ("a", "b", "i", "span", "img", "br")):
                leave(node)
            if tag in ("td", "th") and node.tag in ("table", "thead", "tbody", "tfoot"):
                node.children.append(x := Node("tr", {}, node))
                node = x
                depth["tr"] += 1
            own = Node(tag, attributes, node)
            node.children.append(own)
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                body = html[at : end.start() if end else n]
                own.children.append(unescape(body) if tag in ("textarea", "title") else body)
                if tag == "style" and _on_screen(attributes.get("media", "")):
                    sheets.append(body)
                at = n if not end else html.find(">", end.end()) + 1 or n
            elif tag not in VOID:
                node = own
                depth[tag] += 1
        else:
            node.children.append("<")
            at = lt + 1
    return root, sheets


def _on_screen(media: str) -> bool:
    """Whether a list of media holds on a screen of any size."""
    return any(_ON_SCREEN.fullmatch(m.strip()) for m in media.split(","))


def _applies(rule: str) -> bool:
    """Whether rules within an at-rule count."""
    name, _, rest = rule[1:].replace("(", " (", 1).partition(" ")
    name, rest = name.strip().lower(), rest.strip()
    return _on_screen(rest) if name == "media" else name == "layer" or (name == "supports" and not rest.lower().startswith("not"))


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on any screen; what never ends goes to the end."""
    sheet = _NOT_CSS.sub(" ", sheet)
    open_: list[tuple[bool, str | None, list[str]]] = []  # whether it counts, selectors unless it is an at-rule, declarations
    at = 0
    while at < len(sheet) or open_:
        m = _CSS_MARK.search(sheet, at)
        text, mark, at = (sheet[at : m.start()], m[0], m.end()) if m else (sheet[at:], "}", len(sheet))
        counts, selectors, body = open_[-1] if open_ else (True, None, [])
        if mark == "{":
            rule = " ".join(text.split())
            if selectors is not None:  # within a rule: for other elements, or at times only
                open_.append((False, None, []))
            elif rule.startswith("@"):
                open_.append((counts and _applies(rule), None, []))
            else:
                open_.append((counts, rule, []))
        else:
            body.append(text)
            if mark == "}" and open_:
                open_.pop()
                if counts and selectors is not None:
                    yield selectors, ";".join(body)


def _declared(body: str) -> dict[str, tuple[bool, bool]]:
    """display and visibility: whether the declaration that counts is important, and whether it hides."""
    found: dict[str, tuple[bool, bool]] = {}
    for name, value, important in _DECLARATION.findall(body):
        name = name.lower()
        if name not in found or bool(important) >= found[name][0]:
            found[name] = bool(important), value.lower() in _UNSEEN[name]
    return found


def _hiding(sheets: list[str]) -> dict[str, list]:
    """Simple selectors (tag, .class, #id, tag.class) -> (rank, property, whether it hides); none if no rule hides.

    A rank is importance, then what the selector names, then the place.
    """
    out: dict[str, list] = {}
    hides = False
    for n, (selectors, body) in enumerate(rule for sheet in sheets for rule in _rules(sheet)):
        for name, (important, unseen) in _declared(body).items():
            for s in selectors.split(","):
                if (s := s.strip().lower()) and _SIMPLE.fullmatch(s):
                    hides |= unseen
                    rank = (important, ("#" in s, "." in s, s[0] not in ".#*"), n)
                    out.setdefault(s, []).append((rank, name, unseen))
    return out if hides else {}


def _visible(x: Node, hiding: dict[str, list]) -> bool:
    a = x.attributes
    if x.tag in HIDDEN or "hidden" in a or (x.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    # the style of an element itself is above all selectors
    best = {name: ((important, (2, 0, 0), 0), unseen) for name, (important, unseen) in _declared(a["style"]).items()} if a.get("style") else {}
    if hiding:
        own = [f".{c.lower()}" for c in a.get("class", "").split()] + ([f"#{a['id'].lower()}"] if a.get("id") else [])
        for s in {x.tag, "*", *own, *(x.tag + s for s in own), *("*" + s for s in own)}:
            for rank, name, unseen in hiding.get(s, ()):
                if name not in best or rank > best[name][0]:
                    best[name] = rank, unseen
    return not any(unseen for _, unseen in best.values())


class _Flow:
    """Lines of text with collapsed blanks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # one is due before the next word
        self.breaks = 0
        self.indents: list[str] = []
        self.mark = ""

    def _open(self) -> None:
        if self.lines and self.breaks > 1:
            self.lines.append("")
        self.breaks = 0
        if self.mark:
            self.line.append("".join(self.indents[:-1]) + self.mark)
            self.mark = ""
        else:
            self.line.append("".join(self.indents))

    def text(self, s: str) -> None:
        for i, part in enumerate(_BLANKS.split(s)):
            if i and self.line:
                self.blank = True
            if part:
                if not self.line:
                    self._open()
                elif self.blank:
                    self.line.append(" ")
                self.blank = False
                self.line.append(part)

    def newline(self) -> None:
        if not self.line:
            self._open()
        self._end()

    def _end(self) -> None:
        self.lines.append("".join(self.line).rstrip())
        self.line, self.blank = [], False

    def block(self, breaks: int) -> None:
        if self.line:
            self._end()
        self.breaks = max(self.breaks, breaks)

    def exact(self, lines: list[str]) -> None:
        """Lines as they are, but for the indent."""
        for i, s in enumerate(lines):
            if i or not self.line:
                if i:
                    self._end()
                self._open()
            elif self.blank:
                self.line.append(" ")
                self.blank = False
            self.line.append(s)

    def result(self) -> list[str]:
        if self.line:
            self._end()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        first = next((i for i, s in enumerate(lines) if s), len(lines))
        return lines[first:]


def _span(x: Node, name: str) -> int:
    value = x.attributes.get(name, "1").strip()
    return min(max(int(value), 1), MOST_SPANNED[name]) if value.isascii() and value.isdigit() else 1


def _broken(line: str, widest: int) -> list[str]:
    """The line in parts of at most ``widest`` characters, broken at single blanks; a longer word stays whole."""
    parts, rest = [], line
    while len(rest) > widest:
        at = max((m.start() for m in _SINGLE.finditer(rest, 0, widest + 2) if m.start() <= widest), default=-1)
        if at < 0:
            m = _SINGLE.search(rest, widest)
            at = m.start() if m else -1
        if at < 0:
            break
        parts.append(rest[:at])
        rest = rest[at + 1 :]
    return [*parts, rest]


def _table(rows: list[list[tuple[list[str], int, int]]], widest: int) -> list[str]:
    """Lines of a table from rows of (lines, columns, rows) cells, two blanks between columns.

    A line with a word beyond ``widest`` doesn't count for its column's width and moves what follows in it.
    """
    placed, taken = [], {}
    for r, row in enumerate(rows):
        c = 0
        for lines, across, down in row:
            lines = [part for line in lines for part in _broken(line, widest)]
            while taken.get(c, 0) > r:
                c += 1
            placed.append((r, c, across, lines))
            for k in range(c, c + across):
                taken[k] = r + down
            c += across
    widths: dict[int, int] = {}
    for _, c, across, lines in sorted(placed, key=lambda p: p[2]):
        need = max((len(line) for line in lines if len(line) <= widest), default=0)
        have = sum(widths.get(k, 0) for k in range(c, c + across)) + 2 * (across - 1)
        last = c + across - 1
        widths[last] = widths.get(last, 0) + max(0, need - have)
    starts, at = {}, 0
    for c in range(max((p[1] + p[2] for p in placed), default=0)):
        starts[c] = at
        at += widths.get(c, 0) + 2
    by_row: list[list] = [[] for _ in rows]
    for r, c, _, lines in placed:
        by_row[r].append((starts[c], lines))
    out = []
    for cells in by_row:
        for i in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for start, lines in cells:
                if i < len(lines):
                    line = line.ljust(start) if len(line) <= start - 2 or not line else line + "  "
                    line += lines[i]
            out.append(line.rstrip())
    return out


def render(html: str, widest: int = WIDEST) -> str:
    """All visible text of a page. Walks the tree with a stack of its own, so depth is no matter."""
    root, sheets = parse(html)
    hiding = _hiding(sheets)
    flows, tables, counters = [_Flow()], [], []
    pre = 0
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        x, leaving = stack.pop()
        flow = flows[-1]
        if isinstance(x, str):
            if pre:
                flow.exact(x.replace("\r\n", "\n").split("\n"))
            else:
                flow.text(x)
            continue
        tag = x.tag
        cell = tag in ("td", "th") and bool(tables)
        if not leaving:
            if not _visible(x, hiding):
                continue
            if tag == "br":
                flow.newline()
                continue
            if tag == "input":
                if x.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                    flow.text(x.attributes.get("value", ""))
                continue
            if cell:
                flows.append(_Flow())
            elif tag in BLOCK and not (tag == "tr" and tables):
                nested = tag in ("ul", "ol", "menu", "dir") and counters
                flow.block(2 if tag in APART and not nested else 1)
            if tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("ul", "ol", "menu", "dir"):
                start = x.attributes.get("start", "1").strip()
                counters.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                mark = "- "
                if counters and counters[-1][0]:
                    value = x.attributes.get("value", "").strip()
                    if re.fullmatch(r"-?\d{1,9}", value):
                        counters[-1][1] = int(value)
                    mark = f"{counters[-1][1]}. "
                    counters[-1][1] += 1
                flow.indents.append(" " * len(mark))
                flow.mark = mark
            elif tag in ("dd", "blockquote"):
                flow.indents.append("  ")
            elif tag in ("pre", "listing", "textarea", "xmp"):
                pre += 1
                if x.children and isinstance(x.children[0], str):
                    x.children[0] = re.sub(r"^\r?\n", "", x.children[0])
            stack.append((x, True))
            stack.extend((child, False) for child in reversed(x.children))
            continue
        if cell:
            lines = flows.pop().result()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((lines, _span(x, "colspan"), _span(x, "rowspan")))
        elif tag == "table":
            lines = _table(tables.pop(), widest)
            if lines:
                flow.block(2)
                for line in lines:
                    flow.exact([line])
                    flow.block(0)
            flow.block(2)
        elif tag in ("pre", "listing", "textarea", "xmp"):
            pre -= 1
        elif tag in ("dd", "blockquote", "li"):
            flow.block(1)
            flow.indents.pop()
            if tag == "li":
                flow.mark = ""
        elif tag in ("ul", "ol", "menu", "dir"):
            counters.pop()
        if tag in BLOCK and not cell and not (tag == "tr" and tables):
            nested = tag in ("ul", "ol", "menu", "dir") and counters
            flow.block(2 if tag in APART and not nested else 1)
    return "\n".join(flows[0].result())


def extract(pages: DataFrame, html: str = "html", text: str = "text", widest: int = WIDEST) -> DataFrame:
    """All rows and other columns of ``pages``, with the visible text in place of the HTML.

    Cells of tables are broken at ``widest`` characters. Null and empty pages give an empty text; a column named like the result is replaced; repeated
    rows each give a row.
    """
    kept = [f for f in pages.schema.fields if f.name not in (html, text)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{text}` string"])

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns=html).assign(**{text: [render(h or "", widest) for h in b[html]]})

    return pages.select(*(f.name for f in kept), F.col(html).alias(html)).mapInPandas(compute, schema)
