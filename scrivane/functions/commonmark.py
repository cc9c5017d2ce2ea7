"""Markdown to HTML by CommonMark's two phases, with pipe tables and struck text.

The first phase reads lines into a tree of blocks (quotes, lists and their items hold
others; paragraphs, headings, code, HTML, tables and rules do not) and takes link
definitions out of paragraphs. The second turns the text of each leaf into HTML, with
all definitions known, whatever their place. Neither recurses, so depth is no limit.

Blocks are written without line breaks between them. Raw HTML passes through: what
shows pages of strangers has to sanitise, as `document` does.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import escape, unescape
from html.entities import html5

from scrivane.functions.markup import parse, sanitise

# Fixed values of the specification: tags that begin a block of HTML, and ends of its other kinds.
HTML_TAGS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split()
HTML_ENDS = {"<!--": "-->", "<?": "?>", "<![CDATA[": "]]>"}
RAW_TAGS = ("pre", "script", "style", "textarea")

_ATTRIBUTE = r"""(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)"""
_TAG = rf"<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
_RAW = re.compile(rf"{_TAG}|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
_MAIL = re.compile(r"<([\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)>")
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#\d{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
_HEADING = re.compile(r"(#{1,6})(?:[ \t]+|$)(.*)")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"([-+*])(?=[ \t]|$)|(\d{1,9})([.)])(?=[ \t]|$)")
_DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML_BLOCK = re.compile(rf"<(?:(?P<raw>{'|'.join(RAW_TAGS)})(?=[\s>]|$)|/?(?:{'|'.join(HTML_TAGS)})(?=[\s>]|/>|$))", re.I)
_ONE_TAG = re.compile(rf"(?:{_TAG})[ \t]*$")
_BLANK = re.compile(r"[ \t]*")
_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_LABEL = re.compile(r"\[((?:[^\\\[\]]|\\.)*)\]", re.S)


class Block:
    __slots__ = ("kind", "parent", "children", "lines", "first", "last", "info")

    def __init__(self, kind: str, line: int, parent: "Block | None" = None, **info):
        self.kind, self.parent, self.first, self.last, self.info = kind, parent, line, line, info
        self.children: list[Block] = []
        self.lines: list[str] = []
        if parent is not None:
            parent.children.append(self)


class _Line:
    """A line that is read from the left; a tab reaches the next multiple of four columns, and may be taken in part."""

    def __init__(self, text: str):
        self.text, self.at, self.column, self.split = text, 0, 0, False

    def look(self) -> None:
        blank = _BLANK.match(self.text, self.at)[0]
        column = self.column + len(blank)
        if "\t" in blank:
            column = self.column
            for c in blank:
                column += 4 - column % 4 if c == "\t" else 1
        self.next, self.indent = self.at + len(blank), column - self.column
        self.blank = self.next >= len(self.text)

    def skip(self, columns: int) -> None:
        piece = self.text[self.at : self.at + columns]
        if "\t" not in piece:
            self.split = self.split and not piece
            self.at, self.column = self.at + len(piece), self.column + len(piece)
            return
        while columns > 0 and self.at < len(self.text):
            width = 4 - self.column % 4 if self.text[self.at] == "\t" else 1
            step = min(width, columns)
            self.split = step < width
            self.column += step
            self.at += not self.split
            columns -= step

    def to_text(self) -> None:
        self.look()
        self.skip(self.indent)

    def rest(self) -> str:
        return " " * (4 - self.column % 4) + self.text[self.at + 1 :] if self.split else self.text[self.at :]


class _Reader:
    HOLDERS = ("document", "quote", "list", "item")

    def __init__(self):
        self.root = Block("document", 0)
        self.tip = self.root
        self.links: dict[str, tuple[str, str]] = {}
        self.number = 0

    # Lines -------------------------------------------------------------------------------------------------------------------

    def read(self, text: str) -> None:
        for raw in text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "\ufffd").split("\n"):
            self.number += 1
            self.line(_Line(raw))
        self.close_to(None)

    def line(self, line: _Line) -> None:
        path, block = [], self.tip
        while block.parent is not None:
            path.append(block)
            block = block.parent
        block = self.root
        for child in reversed(path):
            line.look()
            goes_on = getattr(self, f"on_{child.kind}")(child, line)
            if goes_on is None:  # the line ended the block and is used up
                return
            if not goes_on:
                break
            block = child
        held = self.tip
        if block.kind not in ("fence", "html"):
            block = self.starts(block, line)
            if block is None:
                return
        line.look()
        if not line.blank and block is not held and held.kind == "paragraph" and block.kind in self.HOLDERS and self.tip is held:
            held.lines.append(line.text[line.next :])  # the paragraph goes on although its quote or item does not
            self.touch(held)
            return
        self.close_to(block)
        if block.kind in ("fence", "html", "code"):
            block.lines.append(line.rest())
            if not line.blank or block.kind == "fence":
                self.touch(block)
            if block.kind == "html" and block.info["end"] and block.info["end"].lower() in line.rest().lower():
                self.close_to(block.parent)
        elif line.blank:
            return
        elif block.kind == "paragraph":
            block.lines.append(line.text[line.next :])
            self.touch(block)
        elif block.kind == "table":
            block.lines.append(line.text[line.next :])
            self.touch(block)
        else:
            paragraph = self.add("paragraph", block)
            paragraph.lines.append(line.text[line.next :])

    def touch(self, block: Block) -> None:
        while block is not None and block.last != self.number:
            block.last = self.number
            block = block.parent

    def add(self, kind: str, parent: Block, **info) -> Block:
        while parent.kind not in self.HOLDERS or parent.kind == "list" and kind != "item":
            parent = parent.parent
        self.close_to(parent)
        self.tip = Block(kind, self.number, parent, **info)
        self.touch(parent)
        return self.tip

    def close_to(self, block: Block | None) -> None:
        """Close the open blocks below one."""
        while self.tip is not block and self.tip is not None:
            done = self.tip
            self.tip = done.parent
            if done.kind == "paragraph":
                self.take_definitions(done)
                if not done.lines:
                    done.parent.children.remove(done)
            if self.tip is None:
                return

    # Whether an open block goes on ---------------------------------------------------------------------------------------

    def on_quote(self, block, line):
        if line.indent > 3 or line.blank or line.text[line.next] != ">":
            return False
        line.to_text()
        line.skip(1)
        if line.at < len(line.text) and line.text[line.at] in " \t":
            line.skip(1)
        self.touch(block)
        return True

    def on_list(self, block, line):
        return True

    def on_item(self, block, line):
        if line.blank:
            if not block.children:
                return False
            line.to_text()
            return True
        if line.indent < block.info["width"]:
            return False
        line.skip(block.info["width"])
        return True

    def on_fence(self, block, line):
        mark = block.info["mark"]
        text = line.text[line.next :].rstrip(" \t")
        if line.indent <= 3 and len(text) >= len(mark) and set(text) == {mark[0]}:
            self.touch(block)
            self.close_to(block.parent)
            return None
        line.skip(min(line.indent, block.info["indent"]))
        return True

    def on_html(self, block, line):
        return not (line.blank and block.info["end"] is None)

    def on_code(self, block, line):
        if line.blank:
            line.skip(min(4, line.indent))
            return True
        if line.indent < 4:
            return False
        line.skip(4)
        return True

    def on_paragraph(self, block, line):
        return not line.blank

    def on_table(self, block, line):
        return not line.blank

    def on_heading(self, block, line):
        return False

    on_rule = on_heading

    # New blocks ------------------------------------------------------------------------------------------------------------

    def starts(self, block: Block, line: _Line) -> Block | None:
        """Open the blocks that begin on the line below `block`; the innermost, or None if the line is used up."""
        while True:
            line.look()
            if line.blank:
                return block
            text = line.text[line.next :]
            lazy = self.tip.kind == "paragraph"
            if line.indent > 3:
                if lazy or block.kind in ("paragraph", "code"):
                    return block
                line.skip(4)
                return self.add("code", block)
            if text[0] == ">":
                block = self.add("quote", block)
                self.on_quote(block, line)
                continue
            if m := _HEADING.match(text):
                done = self.add("heading", block, level=len(m[1]))
                body = m[2].rstrip(" \t")
                done.lines.append("" if re.fullmatch(r"#+", body) else re.sub(r"[ \t]+#+$", "", body))
                self.close_to(done.parent)
                return None
            if m := _FENCE.match(text):
                self.add("fence", block, mark=m[1] or m[3], words=(m[2] or m[4] or "").strip(), indent=line.indent)
                return None
            if text[0] == "<" and (kind := self.html_kind(text, lazy or block.kind == "paragraph")) is not None:
                return self.add("html", block, end=kind[0])
            if block.kind == "paragraph" and (m := re.fullmatch(r"(=+|-+)[ \t]*", text)):
                self.take_definitions(block)
                if block.lines:
                    block.kind, block.info = "heading", {"level": 1 if m[1][0] == "=" else 2}
                    self.touch(block)
                    self.close_to(block.parent)
                    return None
            if block.kind == "paragraph" and "-" in text and _DELIMITERS.match(text) and ("|" in text or "|" in block.lines[-1]) and len(cells(block.lines[-1])) == len(cells(text)):
                head = block.lines.pop()
                table = self.add("table", block)
                table.first -= 1
                table.lines.append(head)
                self.touch(table)
                return None
            if _RULE.match(text):
                self.add("rule", block)
                self.close_to(self.tip.parent)
                return None
            if m := _ITEM.match(text):
                after = text[m.end() :]
                inside = block.kind == "paragraph" and block is self.tip or lazy and self.tip.parent is block
                if inside and (not after.strip() or m[2] and int(m[2]) != 1):
                    return block
                block = self.item(block, line, m)
                continue
            return block

    def html_kind(self, text: str, in_paragraph: bool) -> tuple[str | None] | None:
        """What ends a block of HTML that begins so, in a tuple (None: a blank line); None if none begins."""
        for begin, end in HTML_ENDS.items():
            if text.startswith(begin):
                return (end,)
        if re.match(r"<![A-Za-z]", text):
            return (">",)
        if m := _HTML_BLOCK.match(text):
            return (f"</{m['raw'].lower()}>" if m["raw"] else None,)
        return (None,) if not in_paragraph and _ONE_TAG.match(text) else None

    def item(self, block: Block, line: _Line, m: re.Match) -> Block:
        mark, indent = m[1] or m[3], line.indent
        line.to_text()
        line.skip(m.end())
        line.look()
        space = line.indent if not line.blank and line.indent <= 4 else 1
        if not line.blank:
            line.skip(space)
        holder = block
        while holder.kind not in ("document", "quote", "item", "list"):
            holder = holder.parent
        if holder.kind != "list" or holder.info["mark"] != mark:
            holder = self.add("list", holder if holder.kind != "list" else holder.parent, mark=mark, start=int(m[2]) if m[2] else None)
        return self.add("item", holder, width=indent + m.end() + space)

    # Link definitions --------------------------------------------------------------------------------------------------------

    def take_definitions(self, block: Block) -> None:
        if not block.lines or not block.lines[0].startswith("["):
            return
        text, at = "\n".join(block.lines), 0
        while (found := definition(text, at)) is not None:
            at, label, target, title = found
            self.links.setdefault(label, (target, title))
        if at:
            rest = text[at:]
            block.first += text[:at].count("\n")
            block.lines = rest.split("\n") if rest.strip() else []


def shown_text(text: str) -> str:
    return escape(text, quote=False).replace('"', "&quot;")


def normal_label(label: str) -> str:
    return " ".join(label.split()).casefold()


def definition(text: str, at: int) -> tuple[int, str, str, str] | None:
    """(end, label, target, title) of a link definition at a place of a paragraph's text."""
    m = _LABEL.match(text, at)
    if not m or not m[1].strip() or len(m[1]) > 999 or text[m.end() : m.end() + 1] != ":":
        return None
    here = re.compile(r"[ \t]*\n?[ \t]*").match(text, m.end() + 1).end()
    if (found := destination(text, here)) is None or found[0] == here:
        return None
    end, target = found
    line_end = re.compile(r"[ \t]*(?:\n|$)")
    plain = line_end.match(text, end)
    gap = re.compile(r"[ \t]*\n[ \t]*|[ \t]+").match(text, end)
    if gap and (titled := title_at(text, gap.end())) and (over := line_end.match(text, titled[0])):
        return over.end(), normal_label(m[1]), target, titled[1]
    return (plain.end(), normal_label(m[1]), target, "") if plain else None


def plain(text: str) -> str:
    """Escapes and entities resolved."""
    return re.sub(rf"\\([!-/:-@\[-`{{-~])|{_ENTITY.pattern}", lambda m: m[1] or entity(m[0]), text)


def entity(text: str) -> str:
    if text[1] != "#":
        return html5.get(text[1:], text)
    code = int(text[3:-1], 16) if text[2] in "xX" else int(text[2:-1])
    return chr(code) if 0 < code < 0xD800 or 0xDFFF < code < 0x110000 else "\ufffd"


def destination(text: str, at: int) -> tuple[int, str] | None:
    """(end, address): in angle brackets, or a run without blanks whose parentheses are paired."""
    if text[at : at + 1] == "<":
        m = re.compile(r"<((?:[^<>\n\\]|\\.)*)>").match(text, at)
        return (m.end(), plain(m[1])) if m else None
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\" and text[i + 1 : i + 2] in _PUNCTUATION and i + 1 < len(text):
            i += 2
            continue
        if c <= " " or c == "\x7f":
            break
        depth += (c == "(") - (c == ")")
        if depth < 0 or depth > 32:
            break
        i += 1
    return None if depth > 0 else (i, plain(text[at:i]))


def title_at(text: str, at: int) -> tuple[int, str] | None:
    m = re.compile(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\'\\]|\\.)*)\'|\(((?:[^()\\]|\\.)*)\)', re.S).match(text, at)
    if not m or "\n\n" in m[0]:
        return None
    return m.end(), plain(next(g for g in m.groups() if g is not None))


def address(target: str) -> str:
    """An address as an attribute: what is no character of addresses as percent bytes."""
    out = "".join(c if c.isascii() and (c.isalnum() or c in "-_.~!*'();:@&=+$,/?#%") else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in target)
    return shown_text(out)


# Inline text ------------------------------------------------------------------------------------------------------------------


class _Mark:
    """A run of emphasis marks: what it closes and opens, and the marks that stay text."""

    __slots__ = ("char", "left", "size", "opens", "closes", "after", "before")

    def __init__(self, char, size, opens, closes):
        self.char, self.left, self.size, self.opens, self.closes = char, size, size, opens, closes
        self.before: list[str] = []
        self.after: list[str] = []

    def __str__(self) -> str:
        return "".join(self.before) + self.char * self.left + "".join(reversed(self.after))


def _is_space(c: str) -> bool:
    return not c or c.isspace()


def _is_mark(c: str) -> bool:
    import unicodedata

    return bool(c) and (c in _PUNCTUATION or unicodedata.category(c)[0] in "PS")


def emphasised(nodes: list) -> str:
    """The nodes (HTML texts and marks) as HTML, with the marks paired."""
    marks = [n for n in nodes if isinstance(n, _Mark)]
    before = list(range(-1, len(marks) - 1))
    after = [*range(1, len(marks) + 1)]
    bottom: dict[tuple, int] = {}

    def drop(i: int) -> None:
        if before[i] >= 0:
            after[before[i]] = after[i]
        if after[i] < len(marks):
            before[after[i]] = before[i]

    i = 0
    while i < len(marks):
        closer = marks[i]
        if not closer.closes or not closer.left:
            i = after[i]
            continue
        key = (closer.char, closer.opens, closer.size % 3 if closer.char != "~" else closer.size)
        j, least = before[i], bottom.get(key, -1)
        while j > least:
            opener = marks[j]
            fits = opener.char == closer.char and opener.opens and opener.left
            if fits and closer.char == "~":
                fits = opener.size == closer.size
            elif fits and (opener.closes or closer.opens) and (opener.size + closer.size) % 3 == 0:
                fits = opener.size % 3 == 0 and closer.size % 3 == 0
            if fits:
                break
            j = before[j]
        if j <= least:
            bottom[key] = before[i]
            following = after[i]
            if not closer.opens:
                drop(i)
            i = following
            continue
        opener = marks[j]
        n = opener.left if closer.char == "~" else 2 if opener.left >= 2 and closer.left >= 2 else 1
        tag = "del" if closer.char == "~" else "strong" if n == 2 else "em"
        opener.left -= n
        closer.left -= n
        opener.after.append(f"<{tag}>")
        closer.before.append(f"</{tag}>")
        k = before[i]
        while k > j:  # marks in between pair with nothing any more
            k, gone = before[k], k
            drop(gone)
        if not opener.left:
            drop(j)
        if not closer.left:
            following = after[i]
            drop(i)
            i = following
    return "".join(map(str, nodes))


class _Bracket:
    __slots__ = ("node", "at", "image", "live")

    def __init__(self, node, at, image):
        self.node, self.at, self.image, self.live = node, at, image, True


_PLAIN_RUN = re.compile(r"[^\\`*_~\[\]!<&\n ]+")


def inline(text: str, links: dict[str, tuple[str, str]] | None = None) -> str:
    """The HTML of a leaf's text."""
    links = links or {}
    nodes: list = []
    brackets: list[_Bracket] = []
    ticks: dict[int, list[int]] = {}
    for m in re.finditer("`+", text):
        ticks.setdefault(len(m[0]), []).append(m.start())
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if m := _PLAIN_RUN.match(text, i):
            nodes.append(shown_text(m[0]))
            i = m.end()
        elif c == "\\":
            following = text[i + 1 : i + 2]
            if following == "\n":
                nodes.append("<br>\n")
                i += 2
                i += len(text[i:]) - len(text[i:].lstrip(" ")) if text[i : i + 1] == " " else 0
            elif following in _PUNCTUATION and following:
                nodes.append(shown_text(following))
                i += 2
            else:
                nodes.append("\\")
                i += 1
        elif c == "`":
            size = len(re.compile("`+").match(text, i)[0])
            later = ticks[size]
            k = bisect_right(later, i)
            if k < len(later):
                body = text[i + size : later[k]].replace("\n", " ")
                if len(body) > 2 and body[0] == body[-1] == " " and body.strip(" "):
                    body = body[1:-1]
                nodes.append(f"<code>{shown_text(body)}</code>")
                i = later[k] + size
            else:
                nodes.append("`" * size)
                i += size
        elif c in "*_~":
            end = i
            while end < n and text[end] == c:
                end += 1
            nodes.append(_flanked(text, i, end))
            i = end
        elif c == "!" and text[i + 1 : i + 2] == "[":
            brackets.append(_Bracket(len(nodes), i + 2, True))
            nodes.append("![")
            i += 2
        elif c == "[":
            brackets.append(_Bracket(len(nodes), i + 1, False))
            nodes.append("[")
            i += 1
        elif c == "]":
            i = _closed(text, i, nodes, brackets, links)
        elif c == "<":
            if m := _AUTOLINK.match(text, i):
                nodes.append(f'<a href="{address(m[1])}">{shown_text(m[1])}</a>')
            elif m := _MAIL.match(text, i):
                nodes.append(f'<a href="mailto:{address(m[1])}">{shown_text(m[1])}</a>')
            elif m := _RAW.match(text, i):
                nodes.append(m[0])
            else:
                nodes.append("&lt;")
            i = m.end() if m else i + 1
        elif c == "&":
            m = _ENTITY.match(text, i)
            nodes.append(shown_text(entity(m[0])) if m else "&amp;")
            i = m.end() if m else i + 1
        elif c == " ":
            end = i
            while end < n and text[end] == " ":
                end += 1
            if end < n and text[end] == "\n":
                nodes.append("<br>" if end - i >= 2 else "")
            elif end < n:
                nodes.append(" " * (end - i))
            i = end
        elif c == "\n":
            nodes.append("\n")
            i += 1
            while i < n and text[i] in " \t":
                i += 1
        else:
            nodes.append(shown_text(c))
            i += 1
    return emphasised(nodes)


def _flanked(text: str, start: int, end: int) -> "_Mark | str":
    c, before, after = text[start], text[start - 1 : start] if start else "", text[end : end + 1]
    left = not _is_space(after) and (not _is_mark(after) or _is_space(before) or _is_mark(before))
    right = not _is_space(before) and (not _is_mark(before) or _is_space(after) or _is_mark(after))
    if c == "~":
        return _Mark(c, end - start, left, right) if end - start == 2 else c * (end - start)
    if c == "_":
        return _Mark(c, end - start, left and (not right or _is_mark(before)), right and (not left or _is_mark(after)))
    return _Mark(c, end - start, left, right)


def _closed(text: str, i: int, nodes: list, brackets: list[_Bracket], links: dict[str, tuple[str, str]]) -> int:
    """A closing bracket: a link or picture if an address or a known label follows, else text. Where to read on."""
    if not brackets:
        nodes.append("]")
        return i + 1
    opener = brackets.pop()
    found = None
    if opener.live:
        found = _inline_target(text, i + 1)
        if found is None:
            m = _LABEL.match(text, i + 1)
            label = m[1] if m and m[1].strip() else text[opener.at : i]
            if len(label) <= 999 and (m and m[1].strip() or "[" not in re.sub(r"\\.", "", label)) and (known := links.get(normal_label(label))):
                found = (m.end() if m else i + 1, *known)
    if found is None:
        nodes.append("]")
        return i + 1
    end, target, title = found
    inner = nodes[opener.node + 1 :]
    del nodes[opener.node :]
    shown = f' title="{shown_text(title)}"' if title else ""
    if opener.image:
        nodes.append(f'<img src="{address(target)}" alt="{shown_text(unescape(re.sub(r"<img[^>]*? alt=\"([^\"]*)\"[^>]*>|<[^>]*>", lambda m: m[1] or "", emphasised(inner))))}"{shown}>')
    else:
        nodes.append(f'<a href="{address(target)}"{shown}>{emphasised(inner)}</a>')
        for b in brackets:  # links hold no links
            b.live = b.live and b.image
    return end


def _inline_target(text: str, at: int) -> tuple[int, str, str] | None:
    if text[at : at + 1] != "(":
        return None
    blank = re.compile(r"[ \t]*\n?[ \t]*")
    here = blank.match(text, at + 1).end()
    found = destination(text, here)
    if found is None:
        return None
    end, target = found
    after = blank.match(text, end).end()
    title = ""
    if after > end and (titled := title_at(text, after)):
        after, title = blank.match(text, titled[0]).end(), titled[1]
    return (after + 1, target, title) if text[after : after + 1] == ")" else None


# HTML ---------------------------------------------------------------------------------------------------------------------------


def cells(line: str) -> list[str]:
    line = line.strip().removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def is_loose(block: Block) -> bool:
    """Whether blank lines part a list's items or the blocks in one of them."""
    rows = [block.children, *(item.children for item in block.children)]
    return any(b.first > a.last + 1 for row in rows for a, b in zip(row, row[1:]))


def _leaf(block: Block, links: dict, tight: bool) -> str:
    if block.kind == "paragraph":
        body = inline("\n".join(x.lstrip(" \t") for x in block.lines).rstrip(" \t\n"), links)
        return body if tight else f"<p>{body}</p>"
    if block.kind == "heading":
        level = block.info["level"]
        return f"<h{level}>{inline(chr(10).join(block.lines).strip(), links)}</h{level}>"
    if block.kind == "code":
        lines = list(block.lines)
        while lines and not lines[-1].strip():
            lines.pop()
        return f"<pre><code>{shown_text(chr(10).join(lines))}\n</code></pre>"
    if block.kind == "fence":
        language = plain(block.info["words"].split()[0]) if block.info["words"] else ""
        kind = f' class="language-{escape(language)}"' if language else ""
        return f"<pre><code{kind}>{''.join(shown_text(x) + chr(10) for x in block.lines) or chr(10)}</code></pre>"
    if block.kind == "html":
        return "\n".join(block.lines).rstrip("\n")
    if block.kind == "table":
        head, *rows = map(cells, block.lines)
        top = "".join(f'<th scope="col">{inline(c, links)}</th>' for c in head)
        body = "".join("<tr>" + "".join(f"<td>{inline(c, links)}</td>" for c in (r + [""] * len(head))[: len(head)]) + "</tr>" for r in rows)
        return f"<table><thead><tr>{top}</tr></thead><tbody>{body}</tbody></table>"
    return "<hr>"


def render(text: str) -> str:
    reader = _Reader()
    reader.read(text)
    out: list[str] = []
    stack: list = [(reader.root, False)]
    while stack:
        block, tight = stack.pop()
        if isinstance(block, str):
            out.append(block)
        elif block.kind in reader.HOLDERS:
            if block.kind == "list":
                tag, start = ("ul", None) if block.info["start"] is None else ("ol", block.info["start"])
                out.append(f"<{tag}>" if start in (None, 1) else f'<{tag} start="{start}">')
                tight = not is_loose(block)
            else:
                tag = {"document": None, "quote": "blockquote", "item": "li"}[block.kind]
                tight = tight and block.kind == "item"
                if tag:
                    out.append(f"<{tag}>")
            if tag:
                stack.append((f"</{tag}>", False))
            stack.extend((c, tight) for c in reversed(block.children))
        else:
            out.append(_leaf(block, reader.links, tight))
    return "".join(out)


def first_heading(text: str) -> str | None:
    """The text of the first heading of level 1."""
    m = re.search(r"<h1\b[^>]*>(.*?)</h1>", render(text), re.S)
    return unescape(re.sub(r"<[^>]*>", "", m[1])).strip() if m else None


def document(text: str, fallback: str, label: str, base: str = "") -> str:
    """A whole page of a Markdown text: its first h1 is the title, else the fallback, which is then shown."""
    title = first_heading(text)
    body = sanitise(parse(render(text)))
    shown = "" if title else f"<h1>{escape(fallback)}</h1>"
    link = f'<base href="{escape(base)}">' if base else ""
    return f'<!doctype html><html><head><meta charset="utf-8">{link}<title>{escape(title or fallback)}</title></head><body data-source="{escape(label)}">{shown}{body}</body></html>'
