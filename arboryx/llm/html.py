"""HTML extraction: a tree with implied tags, rendered as visible text with its layout.

Every step is linear in the page: open elements are looked up by name, tables inside tables are laid out
once, innermost first, and padding is bounded. Nothing visible is left out or cut short.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR_NAME = re.compile(r"[\s/]*([^\s/>=]*)")
_ATTR_VALUE = re.compile(r"\s*=\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_INTEGER = re.compile(r"\s*([+-]?\d{1,15})")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is text without markup up to the end tag.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Nothing in them is shown.
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes audio video canvas object datalist desc metadata defs symbol".split())
#: Blocks, and those with an empty line around them.
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table caption tbody thead tfoot tr td th ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu".split())
GROUPS = frozenset("tbody thead tfoot".split())
_CLOSES_P = (BLOCK - frozenset("html body tr td th tbody thead tfoot caption option optgroup legend".split())) | {"table"}
#: An opening tag ends an open element of these names, up to the nearest of those names.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
#: What a part of a table goes into: elements above the nearest of these are closed.
CONTEXT = {
    **dict.fromkeys(("tbody", "thead", "tfoot", "caption", "colgroup", "col"), frozenset({"table"})),
    "tr": GROUPS | {"table"},
    "td": GROUPS | {"table", "tr"},
    "th": GROUPS | {"table", "tr"},
}
#: An end tag does not reach beyond these.
_FENCES = frozenset("td th table caption template button object".split())
#: What may stand in the head; anything else begins the body.
_HEAD_ONLY = frozenset("base basefont bgsound link meta title script style template noscript head html".split())
#: Elements that may stand right in a table, a group of rows or a row.
_IN_TABLE = frozenset(CONTEXT) | frozenset("script style template table".split())
#: Elements in deeper ones than this become their siblings, as in browsers; their text stays.
MOST_DEEP = 256
#: Alignment: lines of a cell up to this width set the width of their column and are padded to it, and columns are aligned
#: up to this offset of a line. Indents end at the third. Longer lines and further columns are whole, but not padded.
CELL_WIDTH, LINE_WIDTH, INDENT = 60, 240, 80


class Node:
    __slots__ = ("tag", "attrs", "children", "lines")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.lines = tag, attrs or {}, [], None


class _Tags:
    """Tags of a page, in turn; text between them."""

    def __init__(self, page: str):
        self.page, self.low = page, None
        self.last = {q: page.rfind(q) for q in "\"'>"}

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """Attributes from ``at`` on, and where the tag ends. A quote that is never closed is part of an unquoted value."""
        page, attrs = self.page, {}
        while True:
            m = _ATTR_NAME.match(page, at)
            name, at = m.group(1), m.end()
            if not name:
                if at >= len(page):
                    return attrs, at
                if page[at] == ">":
                    return attrs, at + 1
                at += 1  # an equals sign without a name
                continue
            value, m = "", _ATTR_VALUE.match(page, at)
            if m:
                at = m.end()
                quote = page[at : at + 1]
                if quote and quote in "\"'" and self.last[quote] > at:
                    end = page.find(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    m = _UNQUOTED.match(page, at)
                    value, at = m.group(), m.end()
            attrs.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)

    def beyond(self, at: int) -> int:
        """The place after the next ``>``."""
        return self.page.find(">", at) + 1 if self.last[">"] >= at else len(self.page)

    def raw_end(self, name: str, at: int) -> int:
        if self.low is None:
            self.low = self.page.translate({c: c + 32 for c in range(65, 91)})
        end = self.low.find("</" + name, at)
        return len(self.page) if end < 0 else end


class _Builder:
    """The stack of open elements; where each name is open is known without a search."""

    def __init__(self):
        self.root = Node("#root")
        self.stack, self.open = [self.root], defaultdict(list)

    @property
    def tag(self) -> str:
        return self.stack[-1].tag

    @property
    def in_table(self) -> bool:
        """Right in a table, a group of rows or a row, where text has no place."""
        return bool(self.open["table"]) and (self.tag in GROUPS or self.tag in ("table", "tr"))

    def push(self, node: Node) -> None:
        if len(self.stack) > MOST_DEEP:
            self.pop()
        self.open[node.tag].append(len(self.stack))
        self.stack.append(node)

    def pop(self) -> None:
        self.open[self.stack.pop().tag].pop()

    def nearest(self, names) -> int:
        return max((self.open[n][-1] for n in names if self.open[n]), default=0)

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.pop()

    def close(self, names, fences) -> None:
        """Ends the innermost element of ``names`` and all in it, unless one of ``fences`` is nearer."""
        at = self.nearest(names)
        if at > self.nearest(fences):
            self.cut(at)

    def append(self, child) -> None:
        """Adds to the current element; what has no place in a table goes in front of it."""
        if self.in_table:
            fits = not child.strip(" \t\n\r\f") if isinstance(child, str) else child.tag in _IN_TABLE
            if not fits:
                at = self.nearest(("table",))
                around = self.stack[at - 1].children
                around.insert(len(around) - 1 if around and around[-1] is self.stack[at] else len(around), child)
                return
        self.stack[-1].children.append(child)


def parse(page: str) -> Node:
    """The page as a tree; end tags that HTML lets authors leave out are implied."""
    tags, built, at, n = _Tags(page), _Builder(), 0, len(page)

    def text(s: str) -> None:
        if s:
            if built.tag == "head" and s.strip(" \t\n\r\f"):
                built.pop()
            built.append(entities.unescape(s) if "&" in s else s)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            break
        after = page[start + 1 : start + 2]
        closing = after == "/"
        named = _NAME.match(page, start + 1 + closing)
        if not named:
            if page.startswith("<!--", start):
                text(page[at:start])
                end = _COMMENT_END.search(page, start + 2)
                at = end.end() if end else n
            elif after and (after in "!?" or closing and page[start + 2 : start + 3].strip()):
                text(page[at:start])
                at = tags.beyond(start)
            else:  # a lone sign is text
                text(page[at : start + 1])
                at = start + 1
            continue
        text(page[at:start])
        name = named.group().lower()
        attrs, at = tags.attributes(named.end())
        if closing:
            _end(built, name)
            continue
        if built.tag == "head" and name not in _HEAD_ONLY:
            built.pop()
        if name in ("html", "body") and built.open[name]:
            continue
        if name in CONTEXT and built.open["table"]:
            built.cut(built.nearest(CONTEXT[name]) + 1)
            if name in ("td", "th") and built.tag != "tr":
                row = Node("tr")
                built.append(row)
                built.push(row)
        elif name in IMPLIED:
            built.close(*IMPLIED[name])
        if name in _CLOSES_P:
            built.close({"p"}, _FENCES)
        if name in HEADINGS and built.tag in HEADINGS:
            built.pop()
        node = Node(name, attrs)
        if name == "table" and built.in_table:
            built.cut(built.nearest(("table",)))  # a table right in a table ends it
        in_table = built.in_table
        built.append(node)
        if name in RAW:
            end = tags.raw_end(name, at)
            inner, at = page[at:end], tags.beyond(end)
            node.children.append(entities.unescape(inner) if name in ("title", "textarea") else inner)
        elif name == "form" and in_table:
            pass  # its parts are the table's
        elif name not in VOID:
            built.push(node)
            if name == "pre" and page.startswith(("\n", "\r\n"), at):
                at += 1 + (page[at] == "\r")
    text(page[at:])
    return built.root


def _end(built: _Builder, name: str) -> None:
    if name == "br":
        built.append(Node("br"))
    elif name == "p" and not built.open["p"]:
        built.append(Node("p"))
    elif name in ("html", "body"):
        return  # what follows still belongs to the body
    elif name in HEADINGS:
        built.close(HEADINGS, _FENCES)
    else:
        built.close({name}, {"table"} - {name} if name in ("table", "tr", *GROUPS) else _FENCES - {name})


_RULE = re.compile(r"([^{};]*)([{};])")
_COMPOUND = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)", re.I)
#: The screen that media conditions are held against, in CSS pixels, and what else is known of it.
VIEWPORT = {"width": 1280.0, "height": 800.0, "device-width": 1280.0, "device-height": 800.0}
MEDIA = {
    "orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "scripting": "none",
    "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference",
}
_LENGTH = re.compile(r"\+?(\d*\.?\d+)(px|em|rem)?")
_RANGE = re.compile(r"(?:([^<>=]+?)\s*([<>]=?)\s*)?([a-z-]+)\s*(?:([<>]=?|=)\s*([^<>=]+))?")
_HOLDS = {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__, "=": float.__eq__}


def _pixels(value: str) -> float | None:
    m = _LENGTH.fullmatch(value.strip())
    return float(m.group(1)) * (16 if m.group(2) in ("em", "rem") else 1) if m and (m.group(2) or not float(m.group(1))) else None


def _feature(said: str) -> bool | None:
    """Whether a condition in parentheses holds; None if it cannot be read."""
    name, colon, value = (x.strip() for x in said.partition(":"))
    if colon:
        side, _, rest = name.partition("-")
        if side in ("min", "max") and rest in VIEWPORT or name in VIEWPORT:
            size = _pixels(value)
            own = VIEWPORT[name if name in VIEWPORT else rest]
            return None if size is None else own >= size if side == "min" else own <= size if side == "max" else own == size
        return MEDIA[name] == value if name in MEDIA else None
    m = _RANGE.fullmatch(name)
    if not m or m.group(3) not in VIEWPORT:
        return MEDIA[name] not in ("none", "no-preference") if name in MEDIA else True if name == "color" else None
    own, holds = VIEWPORT[m.group(3)], True
    for bound, sign, turned in ((m.group(1), m.group(2), True), (m.group(5), m.group(4), False)):
        if sign:
            size = _pixels(bound)
            if size is None:
                return None
            holds = holds and (_HOLDS[sign](size, own) if turned else _HOLDS[sign](own, size))
    return holds


def shown_media(queries: str) -> bool:
    """Whether a list of media queries holds for VIEWPORT; a query that cannot be read does not."""

    def one(query: str) -> bool:
        result, negated = True, False
        for number, part in enumerate(re.split(r"\band\b", query)):
            part = part.strip()
            head, _, _ = part.partition("(")
            words = head.split()
            if number == 0 and words[:1] in (["not"], ["only"]):
                negated = words.pop(0) == "not"
            inside = part[len(head) :]
            if inside:
                holds = _feature(inside[1:-1].strip()) if not words and inside.endswith(")") and inside.count("(") == 1 else None
            else:
                holds = {"all": True, "screen": True, "print": False, "speech": False}.get(words[0]) if number == 0 and len(words) == 1 else None
            if holds is None:
                return False
            result = result and holds
        return result != negated

    return not queries.strip() or any(one(q) for q in queries.lower().split(","))


def _declared(block: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a block of declarations, with whether they are important."""
    out = {}
    for part in block.split(";"):
        name, _, value = part.partition(":")
        name = name.strip().lower()
        if name in ("display", "visibility"):
            value, important, _ = value.lower().partition("!")
            if bool(important) or not out.get(name, (False,))[0]:
                out[name] = (bool(important), value.strip())
    return out


class Styles:
    """Rules of a page's style sheets that show or hide: selectors of one element's name, classes and id.

    Selectors with combinators, attributes or pseudo-classes, and rules for other media, are passed over.
    Rules of equal selectors are one, which keeps what wins of each property; a rule is looked up by the
    rarest of its marks; and elements that are alike are judged once.
    """

    def __init__(self, root: Node):
        merged, number, todo = {}, 0, [root]
        while todo:
            node = todo.pop()
            if node.tag == "style":
                for selectors, block in self._blocks("".join(c for c in node.children if isinstance(c, str))):
                    found = _declared(block)
                    for selector in selectors.split(",") if found else ():
                        m = _COMPOUND.fullmatch(selector.strip())
                        if not m or not m.group():
                            continue
                        tag, marks = (m.group(1) or "*").lower(), re.findall(r"[.#][\w-]+", m.group(2))
                        need = frozenset(marks)
                        weight = (sum(x[0] == "#" for x in marks), len(marks), tag != "*", number)
                        number += 1
                        own = merged.setdefault((tag, need), {})
                        for name, (important, value) in found.items():
                            if name not in own or (important, *weight) >= own[name][0]:
                                own[name] = ((important, *weight), value)
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        self.rules, self.known = defaultdict(list), {}
        often = Counter(m for _, need in merged for m in need)
        for (tag, need), own in merged.items():
            self.rules[min(need, key=lambda m: (often[m], m)) if need else tag].append((tag, need, own))

    @staticmethod
    def _blocks(css: str):
        css = re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S)
        heads: list[str] = []
        for m in _RULE.finditer(css):
            words, mark = m.groups()
            if mark == "{":
                heads.append(words.strip())
                body = []
            elif mark == ";":
                if heads:
                    body.append(words)
            elif heads:
                head, around = heads.pop(), heads
                if not head.startswith("@") and all(x.lower().startswith("@media") and shown_media(x[6:]) for x in around):
                    yield head, ";".join([*body, words])
                body = []

    def of(self, node: Node) -> tuple[bool, bool | None]:
        """Whether it is displayed, and whether it makes its content visible (None: as around it)."""
        attrs, tag = node.attrs, node.tag
        shown = tag not in UNSEEN and "hidden" not in attrs and (tag != "dialog" or "open" in attrs)
        seen = None
        if not self.rules and "style" not in attrs:
            return shown, seen
        like = tag, attrs.get("class"), attrs.get("id"), attrs.get("style"), shown
        if like in self.known:
            return self.known[like]
        marks = {"." + c for c in attrs.get("class", "").split()} | ({"#" + attrs["id"]} if attrs.get("id") else set())
        values: dict[str, tuple] = {}
        found = [own for key in (tag, "*", *marks) for of, need, own in self.rules.get(key, ()) if of in (tag, "*") and need <= marks]
        if "style" in attrs:
            found.append({name: ((important, 9, 9, 9, 9), value) for name, (important, value) in _declared(attrs["style"]).items()})
        for own in found:
            for name, (weight, value) in own.items():
                if name not in values or weight >= values[name][0]:
                    values[name] = (weight, value)
        if "display" in values and tag not in UNSEEN:
            shown = values["display"][1] != "none"
        if "visibility" in values:
            value = values["visibility"][1]
            seen = False if value in ("hidden", "collapse") else True if value in ("visible", "initial") else None
        self.known[like] = shown, seen
        return shown, seen


def _parts(node: Node) -> list:
    """Children that can be shown."""
    if node.tag == "details" and "open" not in node.attrs:
        return next(([c] for c in node.children if isinstance(c, Node) and c.tag == "summary"), [])
    if node.tag == "input":
        return [node.attrs["value"]] if node.attrs.get("type", "").lower() in ("submit", "button", "reset") and "value" in node.attrs else []
    return node.children


class _Text:
    """Lines of text; spaces collapse, and empty lines stand between blocks that want them."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.indents, self.mark = [""], ""
        self.gap, self.space = False, False

    def put(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if not s or s == " ":
            self.space = self.space or bool(s and self.now)
            return
        if self.now and (self.space or s[0] == " "):
            self.now.append(" ")
        self.now.append(s.strip(" "))
        self.space = s[-1] == " "

    def put_lines(self, s: str) -> None:
        """Text with its own spaces and line ends."""
        first, *more = s.replace("\r\n", "\n").split("\n")
        self.now.append(first)
        for line in more:
            self.end_line(always=True)
            self.now.append(line)

    def begin_item(self, mark: str, indent: int) -> None:
        self.mark += mark
        self.indents.append((self.indents[-1] + " " * indent)[:INDENT])

    def end_item(self) -> None:
        self.end_line(always=bool(self.mark))
        self.indents.pop()

    def end_line(self, always: bool = False) -> None:
        """Ends a line that has text; a list item's mark waits for its text."""
        line = "".join(self.now)
        if line or always:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            lead = self.indents[-2] + self.mark if self.mark and len(self.indents) > 1 else self.indents[-1]
            self.lines.append((lead + line).rstrip(" "))
            self.mark = ""
        self.now, self.space = [], False

    def spaced(self) -> None:
        self.gap = self.gap or not self.mark

    def raw_lines(self, lines: list[str]) -> None:
        for line in lines:
            self.now = [line]
            self.end_line(always=True)


def _integer(value: str | None, default: int) -> int:
    m = _INTEGER.match(value) if value else None
    return int(m.group(1)) if m else default


def _rows(table: Node, styles: Styles, seen: bool):
    """Rows of (visible, cell) of a table; head rows first, foot rows last. Each row knows its group."""
    groups: dict[str, list] = {"thead": [], "tbody": [], "tfoot": []}
    for number, part in enumerate(table.children):
        if not isinstance(part, Node) or part.tag not in GROUPS and part.tag != "tr":
            continue
        shown, own = styles.of(part)
        inside = seen if own is None else own
        for row in [part] if part.tag == "tr" else part.children:
            if not shown or not isinstance(row, Node) or row.tag != "tr":
                continue
            row_shown, row_own = styles.of(row)
            row_seen = inside if row_own is None else row_own
            cells = [(row_seen if s[1] is None else s[1], c) for c in row.children if isinstance(c, Node) and c.tag in ("td", "th") and (s := styles.of(c))[0]]
            if row_shown and cells:
                groups[part.tag if part.tag in groups else "tbody"].append((number if part.tag != "tr" else -1, cells))
    return groups["thead"] + groups["tbody"] + groups["tfoot"]


def _table_lines(table: Node, styles: Styles, seen: bool) -> list[str]:
    """Captions, then rows: cells aligned in columns, " | " apart; the lines of a cell stand under each other."""
    lines: list[str] = []
    for part in table.children:
        if isinstance(part, Node) and part.tag == "caption":
            shown, own = styles.of(part)
            if shown:
                lines += _lines(part.children, styles, seen if own is None else own)
    rows = _rows(table, styles, seen)
    if all(len(cells) == 1 for _, cells in rows):
        return lines + [x for _, [(own, cell)] in rows for x in _lines(cell.children, styles, own) or [""]]
    grid, held, columns = [], [], set()  # held: (first column, column after the last, row after the last), apart and in order
    last_of = {group: r for r, (group, _) in enumerate(rows)}
    for r, (group, cells) in enumerate(rows):
        held = [h for h in held if h[2] > r]
        row, col, at, new = [], 0, 0, []
        for own, cell in cells:
            while at < len(held) and held[at][0] <= col:
                col = max(col, held[at][1])
                at += 1
            row.append((col, _lines(cell.children, styles, own)))
            columns.add(col)
            wide = _integer(cell.attrs.get("colspan"), 1)
            wide = wide if 1 <= wide <= 1000 else 1  # the standard's own range
            high = min(_integer(cell.attrs.get("rowspan"), 1), 65534)
            until = last_of[group] + 1 if high == 0 else r + max(1, high)
            if until > r + 1:
                if new and new[-1][1:] == (col, until):
                    new[-1] = (new[-1][0], col + wide, until)
                else:
                    new.append((col, col + wide, until))
            col += wide
        held = sorted(held + new)
        grid.append(row)
    number = {c: i for i, c in enumerate(sorted(columns))}
    widths = [0] * len(number)
    for row in grid:
        for col, cell in row:
            widths[number[col]] = max(widths[number[col]], *(len(x) for x in cell if len(x) <= CELL_WIDTH), 0) if cell else widths[number[col]]
    blanks = [""]
    for w in widths:
        if len(blanks[-1]) + w + 3 > LINE_WIDTH:
            break
        blanks.append(blanks[-1] + " " * w + " | ")
    for row in grid:
        out: list[str] = [""] * max([1, *(len(cell) for _, cell in row)])
        for col, cell in row:
            j = number[col]
            for i, x in enumerate(cell):
                if x:
                    before = out[i]
                    room = blanks[j][len(before) :] if j < len(blanks) and (len(x) <= CELL_WIDTH or not i) else ""
                    out[i] = before + (room if len(room) >= 3 or not j else " | " if before else "") + x
        lines += [x.rstrip(" ") for x in out]
    return lines


def _lines(children: list, styles: Styles, seen: bool) -> list[str]:
    """Lines of text of some nodes; tables in them have their lines already."""
    out = _Text()
    lists: list[list] = []
    pre = 0
    todo: list = [(c, seen, "") for c in reversed(children)]
    while todo:
        x, seen, ending = todo.pop()
        if ending:
            if ending == "pre":
                if out.now and not "".join(out.now):
                    out.now = []  # the line end before the end tag
                pre -= 1
            elif ending == "list":
                lists.pop()
            if ending == "item":
                out.end_item()
            else:
                out.end_line()
            if x in SPACED and not (x in LISTS and lists):
                out.spaced()
            continue
        if isinstance(x, str):
            if seen:
                out.put_lines(x) if pre else out.put(x)
            continue
        shown, own = styles.of(x)
        if not shown:
            continue
        seen = seen if own is None else own
        tag = x.tag
        if tag == "br":
            out.end_line(always=seen)
        elif tag == "hr":
            out.end_line()
            out.spaced()
        elif tag == "table":
            out.end_line()
            if x.lines:
                out.spaced()
                out.raw_lines(x.lines)
                out.spaced()
        else:
            if tag in BLOCK or tag == "textarea":
                out.end_line()
                if tag in SPACED and not (tag in LISTS and lists):
                    out.spaced()
                todo.append((tag, seen, "pre" if tag in ("pre", "textarea") else "list" if tag in LISTS else "item" if tag in ("li", "dd") else "block"))
            if tag in ("pre", "textarea"):
                pre += 1
            elif tag in LISTS:
                count = sum(isinstance(c, Node) and c.tag == "li" for c in x.children) if "reversed" in x.attrs else 1
                lists.append([tag, _integer(x.attrs.get("start"), count), -1 if "reversed" in x.attrs else 1])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    now = _integer(x.attrs.get("value"), lists[-1][1])
                    mark, lists[-1][1] = f"{now}. ", now + lists[-1][2]
                out.begin_item(mark if seen else "", len(mark))
            elif tag == "dd":
                out.begin_item("", 2)
            elif tag == "q" and seen:
                out.put('"')
                todo.append(('"', seen, ""))
            todo += [(c, seen, "") for c in reversed(_parts(x))]
    out.end_line()
    return out.lines


def render(root: Node) -> str:
    """All visible text of a tree.

    Blocks begin a line; paragraphs, headings, lists and tables have an empty line around them. List
    items have "- " or their number, and their further lines stand under their text. Spaces collapse
    outside ``pre``. Hidden are what a style sheet or attribute hides, the content of closed ``details``, and
    elements that show none (UNSEEN); a visible part of a hidden one is shown.
    """
    styles, tables, todo = Styles(root), [], [(root, True)]
    while todo:
        node, seen = todo.pop()
        for c in reversed(_parts(node)):
            if isinstance(c, Node):
                shown, own = styles.of(c)
                if shown:
                    todo.append((c, seen if own is None else own))
        if node.tag == "table":
            tables.append((node, seen))
    for table, seen in reversed(tables):  # tables inside come after the ones around them
        table.lines = _table_lines(table, styles, seen)
    return "\n".join(_lines(root.children, styles, True)).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_chars, n_lines) for every page, each on its own.

    Null and empty pages have the empty text; tags left open are closed at the end; text outside any
    tag is shown. Pages may be very long: work grows in proportion. Repeated rows and rows without an
    id are rendered each; an empty table gives no row; extra columns are not looked at.
    """
    kind = dict(pages.dtypes)[id_col]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [render(parse(p.as_py() or "")) for p in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                    names=[id_col, "text", "n_chars", "n_lines"],
                )

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, text string, n_chars long, n_lines long")
