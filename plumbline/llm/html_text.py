"""Layout-aware rendering of HTML to the text that a reader would see.

A tree builder takes the tags in order, adds the end tags that HTML implies (a paragraph ends where a block
starts, an item where the next one starts, cells, rows and options likewise) and leaves out what is not shown:
head, scripts, styles, templates, comments, elements that are hidden by attribute, by inline style or by the page's own style
sheets, as far as their selectors name an element, classes and ids (no combinators, no external sheets). What is
``visibility: hidden`` shows no text, but what is made visible inside it does. Of a drawing (svg) the
text elements and embedded HTML are shown, set apart by spaces, of a formula (math) all but annotations. The tree is
then laid out: runs of white space become one space, blocks start on lines of their own, paragraphs, headings, lists and
tables are set off by blank lines, list items get bullets or numbers and are indented by depth, preformatted text
keeps its lines, line breaks in a row leave blank lines, and the cells of a table are padded so that columns line up; a
cell that spans several rows keeps its columns in all of them.

A null or empty page gives the empty text. Broken markup never fails: stray end tags are ignored, open elements end
with the page, a ``<`` that begins no tag is text. A ``>`` inside quotes does not end a tag, however long the quoted
value and however many there are. Pages of any length are rendered whole; repeated rows are each rendered, further columns
are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: element names by their role in HTML ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title iframe object datalist audio video canvas".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside header footer nav main address fieldset form li dt dd details summary "
    "figcaption hgroup menu dir center legend caption tr option optgroup".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("html body caption tr option optgroup legend".split())
#: A start tag of the key ends open elements of the value, up to the nearest boundary.
IMPLIED = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("td", "th", "tr", "caption", "colgroup"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"),
    "thead": ("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"),
    "tfoot": ("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"),
    "body": ("head",),
}
BOUNDARY = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "optgroup": ("select",)}
#: Elements of drawings and formulas that are not shown as they stand.
FOREIGN_UNSEEN = frozenset(
    "defs symbol clippath mask marker pattern metadata desc lineargradient radialgradient filter "
    "annotation annotation-xml mphantom".split()
)
#: Inside these, HTML goes on; elsewhere in a drawing or formula a tag of ``BREAKS_OUT`` ends it.
HTML_INSIDE = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SPACED_MATH = frozenset("mfrac mroot msub msup msubsup munder mover munderover mtable mtr mmultiscripts".split())
IN_HEAD = frozenset("head title meta link base script style noscript template html".split())

#: A comment or declaration, or a tag; most tags end within its bounds, the others are left to :func:`_tag_end`.
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]{0,200}+\"|'[^']{0,200}+'){0,20}+)(>?)",
    re.S,
)
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_STYLE = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([a-zA-Z-]+)\s*(!\s*important)?", re.I)
_SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_NAME = re.compile(r"[.#][\w-]+")
_SHOWN_ON = re.compile(r"\s*(?:@media\s+)?(?:(?:only\s+)?screen|all)?\s*", re.I)
#: Tables inside tables are laid out to this depth; deeper ones show their text as blocks.
_TABLES = 20
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str] | None = None):
        self.name, self.attributes, self.children = name, attributes or {}, []


class _Stack(list):
    """Open elements, with how many there are of each name, so that a search for none costs nothing."""

    def __init__(self, root: Element):
        super().__init__([root])
        self.open: Counter[str] = Counter()
        self.roots = [0]  # per element: where the drawing or formula around it starts, 0 in HTML

    def foreign(self) -> int:
        """Where the drawing or formula starts that a new element would belong to, 0 in HTML."""
        return 0 if self[-1].name in HTML_INSIDE else self.roots[-1]

    def push(self, element: Element) -> None:
        self.roots.append(self.foreign() or (len(self) if element.name in ("svg", "math") else 0))
        self.append(element)
        self.open[element.name] += 1

    def end(self, k: int) -> None:
        """End the k-th element and all inside it."""
        for element in self[k:]:
            self.open[element.name] -= 1
        del self[k:]
        del self.roots[k:]


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the first ``>`` outside quotes is; where quotes don't pair up, the first ``>``; -1 if there is none.

    ``dead`` gathers the quotes of a page that lead to no such end. No quote is followed twice, so all
    calls for a page together take time in proportion to its length.
    """
    start, passed = at, []
    while (m := _QUOTE_OR_END.search(page, at)) is not None:
        if m[0] == ">":
            return m.start()
        if m.start() in dead:
            break
        passed.append(m.start())
        at = page.find(m[0], m.end()) + 1
        if not at:
            break
    dead.update(passed)
    return page.find(">", start)


def parse(page: str) -> Element:
    """The element tree of a page, with implied end tags."""
    root = Element("html")
    stack, at = _Stack(root), 0
    ends_of: dict[str, re.Pattern] = {}
    dead: set[int] = set()
    sheets: list[str] = []
    styled = False

    def add_text(text: str) -> None:
        if text:
            if stack[-1].name == "head" and text.strip():
                stack.end(len(stack) - 1)
            stack[-1].children.append(text)

    while (m := _TAG.search(page, at)) is not None:
        end, inside = m.end(), m[3]
        if m[2] and not m[4]:
            close = _tag_end(page, m.end(2), dead)
            if close < 0:  # no tag can follow, and a comment has no end
                rest = re.compile(r"<[!?]").search(page, m.start())
                page = page[: rest.start()] if rest else page
                break
            end, inside = close + 1, page[m.end(2) : close]
        add_text(unescape(page[at : m.start()]))
        at, name = end, (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            _close(stack, name)
            continue
        if stack[-1].name == "head" and name not in IN_HEAD:
            stack.end(len(stack) - 1)
        if name == "html":
            continue
        if name in BREAKS_OUT and stack.foreign():
            stack.end(stack.foreign())
        attributes, bare = {}, 0
        if inside:
            for a in _ATTRIBUTE.finditer(inside):
                attributes.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
                bare = a.end(4)
        if name in ENDS_PARAGRAPH:
            _end_within(stack, ("p",), ("table", "td", "th", "button", "li", "dd"))
        if name in IMPLIED:
            _end_within(stack, IMPLIED[name], BOUNDARY.get(name, ("table",)))
        element = Element(name, attributes)
        styled = styled or "style" in attributes
        stack[-1].children.append(element)
        if stack.foreign() or name in ("svg", "math"):
            if name in FOREIGN_UNSEEN or attributes.get("display") == "none" or attributes.get("visibility") in ("hidden", "collapse"):
                element.attributes["hidden"] = ""
            # a slash at the end of a value without quotes belongs to the value
            if inside.endswith("/") and bare != len(inside):
                continue
        if name in RAW:
            end = ends_of.setdefault(name, re.compile(rf"</{name}\s*/?>", re.I)).search(page, at)
            text = page[at : end.start()] if end else page[at:]
            if name == "style" and _SHOWN_ON.fullmatch(attributes.get("media", "")):
                sheets.append(text)
            element.children.append(unescape(text) if name in ("textarea", "title") else text)
            at = end.end() if end else len(page)
        elif name not in VOID:
            stack.push(element)
    add_text(unescape(page[at:]))
    if styled or sheets:
        _styled(root, _Sheet(sheets))
    return root


def _close(stack: _Stack, name: str) -> None:
    """End the nearest open element of that name and all inside it; cells shield what is outside their table."""
    for k in range(len(stack) - 1, 0, -1) if stack.open[name] else ():
        if stack[k].name == name:
            stack.end(k)
            return
        if stack[k].name in ("td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body"):
            return


def _end_within(stack: _Stack, names: tuple[str, ...], boundary: tuple[str, ...]) -> None:
    """End the outermost open element among ``names`` that lies inside the nearest ``boundary``."""
    found = None
    for k in range(len(stack) - 1, 0, -1) if any(stack.open[n] for n in names) else ():
        if stack[k].name in names:
            found = k
        elif stack[k].name in boundary:
            break
    if found is not None:
        stack.end(found)


def hidden(element: Element) -> bool:
    a = element.attributes
    return (
        element.name in UNSEEN
        or "hidden" in a
        or (element.name == "input" and a.get("type", "").lower() == "hidden")
        or (element.name == "dialog" and "open" not in a)
        or "\0none" in a
    )


class _Sheet:
    """Declarations of display and visibility in the style sheets of a page, by what their selectors name."""

    def __init__(self, texts: list[str]):
        #: by element name, class or id, the rarest part of a selector: (all its parts, specificity, order, declarations)
        self.rules: dict[str, list[tuple]] = {}
        self.count = 0
        for text in texts:
            self._read(re.sub(r"/\*.*?(?:\*/|\Z)", "", text, flags=re.S))

    def _read(self, text: str) -> None:
        open_blocks: list[str] = []
        before = ""
        for part in re.split(r"([{}])", text):
            if part == "{":
                open_blocks.append(before.rsplit(";", 1)[-1].strip())
            elif part == "}":
                selectors = open_blocks.pop() if open_blocks else ""
                if not selectors.startswith("@") and all(b.startswith("@") and _SHOWN_ON.fullmatch(b) for b in open_blocks):
                    self._add(selectors, _STYLE.findall(before))
            before = part if part not in "{}" else ""

    def _add(self, selectors: str, declared: list[tuple[str, str, str]]) -> None:
        for selector in selectors.split(",") if declared else ():
            m = _SELECTOR.fullmatch(selector.strip())
            if m and m[0]:
                names = _NAME.findall(m[2])
                parts = {*names, *([m[1].lower()] if m[1] and m[1] != "*" else [])}
                ids = sum(n[0] == "#" for n in names)
                self.count += 1
                rule = (parts, (ids, len(names) - ids, len(parts) - len(set(names))), self.count, declared)
                self.rules.setdefault(next((n for k in "#." for n in names if n[0] == k), (m[1] or "").lower()), []).append(rule)

    def style(self, element: Element) -> dict[str, str]:
        """What holds for an element of its own: its inline style and the rules that fit it."""
        a = element.attributes
        inline = _STYLE.findall(a["style"]) if "style" in a else []
        found = [((bool(i), (9,)), name.lower(), value.lower()) for name, value, i in inline]
        if self.rules:
            own = {element.name, *(f".{c}" for c in a.get("class", "").split()), *([f"#{a['id']}"] if a.get("id") else [])}
            for key in (*own, "*"):
                for parts, weight, order, declared in self.rules.get(key, ()):
                    if parts <= own:
                        found += [((bool(i), (0, *weight, order)), name.lower(), value.lower()) for name, value, i in declared]
        return {name: value for _, name, value in sorted(found, key=lambda x: x[0])}


def _styled(root: Element, sheet: _Sheet) -> None:
    """Mark what is not displayed and take out the texts that are not visible."""
    work = [(root, True)]
    while work:
        element, visible = work.pop()
        style = sheet.style(element) if sheet.rules or "style" in element.attributes else {}
        if style.get("display") == "none":
            element.attributes["\0none"] = ""
            continue
        if "visibility" in style:
            visible = {"visible": True, "hidden": False, "collapse": False}.get(style["visibility"], visible)
        if not visible:
            element.attributes["\0unseen"] = ""
            element.children = [c for c in element.children if not isinstance(c, str)]
        work.extend((c, visible) for c in element.children if not isinstance(c, str))


def shown(element: Element) -> list:
    """What an element shows: its children, of a drawing its texts, with spaces between the parts of a fraction or the like."""
    if element.name in SPACED_MATH:
        return [part for child in element.children for part in (" ", child)][1:]
    if element.name != "svg":
        return element.children
    found, work = [], [*reversed(element.children)]
    while work:
        item = work.pop()
        if isinstance(item, str) or hidden(item):
            continue
        if item.name in ("text", "foreignobject"):
            found += [" ", item, " "]
        else:
            work.extend(reversed(item.children))
    return found


class _Layout:
    """Collects lines; text on one line is joined by single spaces."""

    def __init__(self, depth: int = 0):
        self.depth = depth  # of tables around
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a blank line is due before the next line
        self.breaks = 0  # so many blank lines are, from line breaks
        self.indent, self.marker = "", ""

    def end_line(self) -> None:
        text = _BLANK.sub(" ", "".join(self.line)).strip(" ")
        self.line = []
        if text or self.marker:
            self.put(text)

    def put(self, text: str) -> None:
        if self.lines:
            self.lines.extend([""] * max(self.gap, self.breaks))
        self.gap, self.breaks = False, 0
        if self.marker:
            self.lines.append(f"{self.indent[: -len(self.marker)]}{self.marker}{text}".rstrip(" "))
            self.marker = ""
        else:
            self.lines.append((self.indent + text).rstrip(" "))

    def space(self) -> None:
        self.end_line()
        self.gap = True


def render(page: str) -> str:
    """All visible text of a page, laid out."""
    layout = _Layout()
    _walk(parse(page), layout)
    layout.end_line()
    return "\n".join(layout.lines)


def _walk(top: Element, layout: _Layout) -> None:
    """Lay out an element; a stack of its own instead of recursion, as broken pages nest without bound."""
    work: list = [top]
    while work:
        item = work.pop()
        if isinstance(item, str):
            layout.line.append(item)
        elif callable(item):
            item()
        elif item.name == "table" and not hidden(item) and layout.depth < _TABLES:
            layout.space()
            for line in _table_lines(item, layout.depth + 1):
                layout.put(line)
            layout.space()
        elif item.name == "pre" and not hidden(item):
            layout.space()
            for line in _plain(item).strip("\n").split("\n"):
                layout.put(line)
            layout.space()
        elif item.name == "br":
            text = "".join(layout.line)
            if text.strip() or layout.marker:
                layout.end_line()
            else:
                layout.line.clear()
                layout.breaks += 1
        elif item.name == "hr" and not hidden(item):
            layout.space()
            if "\0unseen" not in item.attributes:
                layout.put("---")
            layout.space()
        elif not hidden(item):
            after = _enter(item, layout)
            if after:
                work.append(after)
            children = shown(item)
            if item.name in ("ol", "ul", "menu", "dir"):
                _number(item)
            work.extend(reversed(children))


def _number(items: Element) -> None:
    start = items.attributes.get("start", "1")
    n = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in items.children:
        if isinstance(child, Element) and child.name == "li" and not hidden(child):
            child.attributes["\0marker"] = f"{n}. " if items.name == "ol" else "- "
            n += 1


def _enter(element: Element, layout: _Layout):
    """Start a block; returns what to do at its end, if anything."""
    name = element.name
    if name not in BLOCK:
        return None
    nested = name in ("ul", "ol", "menu", "dir") and layout.indent != ""
    layout.space() if name in SPACED and not nested else layout.end_line()
    indent, marker = layout.indent, element.attributes.get("\0marker", "- " if name == "li" else "")
    if marker and "\0unseen" not in element.attributes:
        layout.indent, layout.marker = indent + " " * len(marker), marker
    elif name in ("blockquote", "dd"):
        layout.indent = indent + "    "

    def leave() -> None:
        layout.end_line()
        layout.indent = indent
        if name in SPACED and not nested:
            layout.gap = True

    return leave


def _plain(element: Element) -> str:
    """Text as it stands, with line breaks."""
    out, work = [], [element]
    while work:
        item = work.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.name == "br":
            out.append("\n")
        elif not hidden(item):
            work.extend(reversed(shown(item)))
    return "".join(out).replace("\r\n", "\n").replace("\r", "\n")


def _table_lines(table: Element, depth: int) -> list[str]:
    """The rows of a table with padded columns; several lines in a cell stay in its column."""
    captions: list[str] = []
    loose: list[str] = []
    rows: list[list[tuple[int, int, list[str]]]] = []  # of cells: first column, columns, lines
    taken: dict[int, int] = {}  # columns that cells above reach into, and for how many rows
    work: list = [*reversed(table.children)]
    while work:
        item = work.pop()
        if item is None:  # cells do not reach beyond their group of rows
            taken = {}
        elif isinstance(item, str):
            loose.append(item)
        elif hidden(item):
            continue
        elif item.name == "tr":
            row, column, reach = [], 0, {}
            for cell in item.children:
                if isinstance(cell, str):
                    loose.append(cell)
                elif cell.name in ("td", "th") and not hidden(cell):
                    inner = _Layout(depth)
                    _walk_children(cell, inner)
                    wide, deep = _span(cell, "colspan"), _span(cell, "rowspan")
                    while taken.get(column):
                        column += 1
                    row.append((column, wide, inner.lines))
                    reach.update(dict.fromkeys(range(column, column + wide), deep - 1))
                    column += wide
                elif not hidden(cell) and cell.name not in ("td", "th"):
                    loose.append(_plain(cell))
            taken = {c: n - 1 for c, n in taken.items() if n > 1} | {c: n for c, n in reach.items() if n}
            if row:
                rows.append(row)
        elif item.name in ("thead", "tbody", "tfoot"):
            work.append(None)
            work.extend(reversed(item.children))
            work.append(None)
        elif item.name == "caption":
            captions.append(_BLANK.sub(" ", _plain(item)).strip())
        else:
            loose.append(_plain(item) + " ")
    widths: list[int] = []
    for row in rows:
        for column, wide, lines in row:
            widths.extend([0] * (column + wide - len(widths)))
            if wide == 1:
                widths[column] = max(widths[column], max(map(len, lines), default=0))
    starts = [0]
    for width in widths:
        starts.append(starts[-1] + width + 2)
    out = [line for line in (*captions, _BLANK.sub(" ", "".join(loose)).strip()) if line]
    for row in rows:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            text = ""
            for column, _, lines in row:
                if k < len(lines) and lines[k]:
                    text = text.ljust(starts[column]) if len(text) + 2 <= starts[column] or not text else text + "  "
                    text += lines[k]
            out.append(text.rstrip(" "))
    return out


def _span(cell: Element, name: str) -> int:
    """How many columns or rows a cell takes; 0 rows mean all that are left of its group."""
    span = cell.attributes.get(name, "1")
    if name == "rowspan" and span == "0":
        return 1 << 16
    return int(span) if re.fullmatch(r"[1-9]\d{0,4}", span) and (name == "rowspan" or len(span) < 4) else 1


def _walk_children(cell: Element, layout: _Layout) -> None:
    body = Element("div")
    body.children = cell.children
    _walk(body, layout)
    layout.end_line()


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of every page of ``page_id, html``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(p) if p else "" for p in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, text string")
