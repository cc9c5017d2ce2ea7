"""A small HTML tree on the standard library's tokenizer, and what is read from it.

Approximations, as no layout exists here: an element is hidden if it or an ancestor
has `hidden`, aria-hidden="true" or an inline display:none / visibility:hidden.
"""

from __future__ import annotations

import re
from html import escape, unescape
from html.parser import HTMLParser

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style template noscript head title".split())
CLOSES_P = BLOCK - frozenset("body html td th li dd dt summary".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CHROME_TAGS = ("header", "nav", "footer", "aside")
CHROME_ROLES = ("banner", "navigation", "contentinfo", "complementary")
REDACTED = "[REDACTED PASSWORD]"
#: Allow-list of the sanitiser: tags, attributes of any tag, attributes of a tag, URL schemes.
TAGS = frozenset("a abbr article aside b blockquote br caption cite code col colgroup dd del details div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 header hr i img ins kbd li main mark nav ol p pre q s section small span strong sub summary sup table tbody td tfoot th thead time tr u ul var".split())
ANY_ATTRIBUTES = frozenset("id title lang dir role".split())
ATTRIBUTES = {"a": {"href"}, "img": {"src", "alt", "width", "height"}, "ol": {"start"}, "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan", "scope"}, "time": {"datetime"}, "code": {"class"}}
SCHEMES = frozenset(("http", "https", "mailto", "data"))
URL_ATTRIBUTES = ("href", "src")

_SPACE = re.compile(r"[ \t\r\n\f\x0b\u00a0]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.children, self.parent = tag, {k: v or "" for k, v in reversed(list(attrs))} if attrs else {}, [], parent

    def walk(self):
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def up(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def inside(self, *tags) -> bool:
        return any(n.tag in tags for n in self.up())


class _Builder(HTMLParser):
    # An opening tag (left) ends open elements of these kinds, up to the given ancestors.
    ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
            "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead"}, {"table"})}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def _end(self, kinds, stops):
        found, node = None, self.at
        while node is not None and node.tag not in stops:
            if node.tag in kinds:
                found = node
            node = node.parent
        if found is not None:
            self.at = found.parent

    def handle_starttag(self, tag, attrs):
        if tag in self.ENDS:
            self._end(*self.ENDS[tag])
        if tag in CLOSES_P:
            self._end({"p"}, {"td", "th", "li", "dd", "button", "object"})
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def collapse(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def hidden(node: Node) -> bool:
    for n in (node, *node.up()):
        style = n.attrs.get("style", "").replace(" ", "").lower()
        if "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
            return True
    return False


def _pieces(node: Node, out: list, skip=()) -> None:
    """Without recursion, as pages may nest thousands of elements; None on the stack ends a block."""
    stack: list = list(reversed(node.children))
    while stack:
        c = stack.pop()
        if c is None:
            out.append("\n")
        elif isinstance(c, str):
            out.append(_SPACE.sub(" ", c))
        elif c.tag == "br":
            out.append("\n")
        elif c.tag not in SILENT and c.tag not in skip:
            if c.tag in BLOCK:
                out.append("\n")
                stack.append(None)
            stack.extend(reversed(c.children))


def text_of(node: Node, skip=(), lines: bool = False) -> str:
    """Text with inline tags joined and block tags apart; one line unless lines are asked for."""
    if len(node.children) == 1 and isinstance(node.children[0], str):
        return collapse(node.children[0])
    out: list[str] = []
    _pieces(node, out, skip)
    parts = [collapse(x) for x in "".join(out).split("\n")]
    return ("\n" if lines else " ").join(x for x in parts if x)


def raw_text(node: Node) -> str:
    out: list[str] = []
    stack: list = list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append("\n")
        else:
            stack.extend(reversed(c.children))
    return "".join(out)


def locator(node: Node) -> str:
    parts = []
    while node.parent is not None:
        if node.attrs.get("id"):
            parts.append(f"#{node.attrs['id']}")
            break
        same = [c for c in node.parent.children if isinstance(c, Node) and c.tag == node.tag]
        parts.append(node.tag if len(same) == 1 else f"{node.tag}:nth-of-type({same.index(node) + 1})")
        node = node.parent
    return " > ".join(p for p in reversed(parts) if p != "html")


def is_chrome(node: Node) -> bool:
    return any(n.tag in CHROME_TAGS or (n.attrs.get("role", "").lower().split() or [""])[0] in CHROME_ROLES for n in (node, *node.up()))


#: Texts and tables alone, of bare tags: every row is ended, every cell holds one text and is ended by its own tag or the next one.
_PLAIN = re.compile("[^<]*+(?:<table>[^<]*+(?:</?(?:thead|tbody|tfoot)>[^<]*+|<tr>[^<]*+(?:<td>[^<]*+(?:</td>[^<]*+)?+|<th>[^<]*+(?:</th>[^<]*+)?+)*+</tr>[^<]*+)*+</table>[^<]*+)*+")
_PLAIN_CELL = re.compile("<(table|tr|td|th)>([^<]*+)")


def tables(html: str) -> list[list[list[dict]]]:
    """The rows of each table that blocks(parse(html)) has; of plain tables by pattern, without a tree."""
    if not _PLAIN.fullmatch(html):
        return [table_rows(n) for n in parse(html).walk() if n.tag == "table" and not n.inside("table", "script", "style", "template", "noscript") and not hidden(n)]
    out: list[list[list[dict]]] = []
    for tag, text in _PLAIN_CELL.findall(html):
        if tag == "table":
            out.append([])
        elif tag == "tr":
            out[-1].append([])
        else:
            out[-1][-1].append({"text": collapse(unescape(text)), "header": tag == "th", "colspan": 1, "rowspan": 1})
    return out


def table_rows(table: Node) -> list[list[dict]]:
    rows = []
    for tr in table.walk():
        if tr.tag == "tr" and next((n for n in tr.up() if n.tag == "table"), None) is table:
            cells = [c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")]
            rows.append([{"text": text_of(c), "header": c.tag == "th", "colspan": _span(c, "colspan"), "rowspan": _span(c, "rowspan")} for c in cells])
    return rows


def _span(cell: Node, name: str) -> int:
    if name not in cell.attrs:
        return 1
    found = re.match(r"\s*(\d+)", cell.attrs.get(name, ""))
    return min(max(int(found[1]) if found else 1, 1), 1000)


def grid(rows: list[list[dict]]) -> list[list[str]]:
    """Cell text of every grid place that a cell covers; linear in the places."""
    out: list[list[str]] = []
    taken: dict[int, tuple[int, str]] = {}  # column -> rows left, text
    for row in rows:
        line: list[str] = []
        col = 0

        def carried():
            nonlocal col
            while col in taken:
                left, text = taken[col]
                line.append(text)
                taken[col] = (left - 1, text)
                if left == 1:
                    del taken[col]
                col += 1

        for cell in row:
            carried()
            for _ in range(cell["colspan"]):
                line.append(cell["text"])
                if cell["rowspan"] > 1:
                    taken[col] = (cell["rowspan"] - 1, cell["text"])
                col += 1
        carried()
        out.append(line)
    return out


def list_items(node: Node) -> list[str]:
    return [text_of(c, skip=("ul", "ol")) for c in node.children if isinstance(c, Node) and c.tag == "li"]


def definitions(dl: Node) -> list[dict]:
    """dt/dd pairs, also inside div groups; a later dd of a term takes the earlier one's place."""
    out: list[dict] = []
    nodes = []
    for c in dl.children:
        if isinstance(c, Node):
            nodes += [x for x in c.children if isinstance(x, Node)] if c.tag == "div" else [c]
    for c in nodes:
        if hidden(c):
            continue
        if c.tag == "dt":
            out.append({"term": text_of(c), "definition": ""})
        elif c.tag == "dd" and out:
            out[-1]["definition"] = text_of(c)
    return out


def math_text(node: Node) -> str:
    tex = next((n for n in node.walk() if n.tag == "annotation" and "tex" in n.attrs.get("encoding", "").lower()), None)
    return collapse(raw_text(tex)) if tex else node.attrs.get("alttext") or text_of(node)


def _field(node: Node) -> tuple[str, str]:
    kind = node.attrs.get("type", node.tag).lower() if node.tag == "input" else node.tag
    name = node.attrs.get("name") or node.attrs.get("aria-label") or kind
    if kind == "password":
        return name, REDACTED
    if kind in ("checkbox", "radio"):
        return name, "true" if "checked" in node.attrs else "false"
    if node.tag == "select":
        chosen = [n for n in node.walk() if n.tag == "option" and "selected" in n.attrs]
        return name, ", ".join(text_of(n) for n in chosen)
    return name, raw_text(node) if node.tag == "textarea" else node.attrs.get("value", "")


EMPTY_BLOCK = {"level": None, "language": None, "items": None, "rows": None, "terms": None, "name": None, "value": None, "src": None, "tracks": None}


def blocks(root: Node, chrome: bool = True, keep_hidden: bool = False) -> list[dict]:
    """Typed blocks in reading order: heading, paragraph, list, table, code, quote, definitions, figure, form_field, media."""
    out: list[dict] = []

    def put(kind, node, text, **more):
        out.append({"type": kind, "id": f"block-{len(out) + 1:05d}", "locator": locator(node), "text": text, "chrome": is_chrome(node), **EMPTY_BLOCK, **more})

    for n in root.walk():
        t = n.tag
        if t in ("video", "audio"):
            tracks = [{"kind": x.attrs.get("kind") or "subtitles", "lang": x.attrs.get("srclang", ""), "label": x.attrs.get("label", ""), "src": x.attrs.get("src", "")} for x in n.walk() if x.tag == "track"]
            source = n.attrs.get("src") or next((x.attrs.get("src", "") for x in n.walk() if x.tag == "source"), "")
            put("media", n, n.attrs.get("title", ""), name=t, src=source, tracks=tracks)
            continue
        if t not in _KINDS or n.inside("script", "style", "template", "noscript") or (not keep_hidden and hidden(n)) or (not chrome and is_chrome(n)):
            continue
        if t in HEADINGS:
            if x := text_of(n):
                put("heading", n, x, level=int(t[1]))
        elif t == "p":
            if not n.inside("li", "table", "blockquote", "figure", "dl") and (x := text_of(n, lines=True)):
                put("paragraph", n, x)
        elif t in ("ul", "ol"):
            if not n.inside("ul", "ol", "table") and (items := list_items(n)):
                put("list", n, "\n".join(items), items=items, name=t)
        elif t == "table":
            if not n.inside("table"):
                rows = table_rows(n)
                put("table", n, "\n".join(" ".join(c["text"] for c in r) for r in rows), rows=rows)
        elif t == "pre":
            code = next((c for c in n.children if isinstance(c, Node) and c.tag == "code"), n)
            language = re.search(r"(?:language|lang)-([\w+#-]+)", code.attrs.get("class", "") + " " + n.attrs.get("class", ""))
            put("code", n, strip_line_numbers(raw_text(n).strip("\n")), language=language[1] if language else None)
        elif t == "blockquote":
            if not n.inside("blockquote"):
                put("quote", n, text_of(n, lines=True))
        elif t == "dl":
            if not n.inside("dl") and (terms := definitions(n)):
                put("definitions", n, "\n".join(f"{x['term']}: {x['definition']}" for x in terms), terms=terms)
        elif t == "figure":
            image = next((x for x in n.walk() if x.tag == "img"), None)
            if image is not None:
                caption = next((text_of(x) for x in n.walk() if x.tag == "figcaption"), "")
                put("figure", n, caption or image.attrs.get("alt", ""), src=image.attrs.get("src", ""), name=image.attrs.get("alt", ""))
            elif x := text_of(n):
                put("paragraph", n, x)
        elif t in ("input", "select", "textarea") and n.attrs.get("type", "").lower() not in ("hidden", "submit", "button", "reset", "image"):
            name, value = _field(n)
            put("form_field", n, f"{name}: {value}", name=name, value=value)
    return out


_KINDS = frozenset((*HEADINGS, "p", "ul", "ol", "table", "pre", "blockquote", "dl", "figure", "input", "select", "textarea"))


def strip_line_numbers(code: str) -> str:
    """Leading 1, 2, 3... of every line go if something is left on some line."""
    lines = code.split("\n")
    found = [re.match(r"\s*(\d+)(?:[ \t]|$)(.*)", x) for x in lines]
    if len(lines) > 1 and all(f and int(f[1]) == i + int(found[0][1]) for i, f in enumerate(found)) and any(f[2].strip() for f in found):
        return "\n".join(f[2] for f in found)
    return code


def links(root: Node) -> list[dict]:
    return [{"text": text_of(n) or n.attrs.get("aria-label", ""), "url": n.attrs["href"]} for n in root.walk() if n.tag == "a" and n.attrs.get("href") and not hidden(n)]


def visuals(root: Node) -> list[dict]:
    out = []
    for n in root.walk():
        kind = n.tag if n.tag in ("img", "svg", "canvas", "video", "iframe") else "image" if n.attrs.get("role") == "img" else None
        if kind is None and (m := re.search(r"background(?:-image)?\s*:[^;]*url\(['\"]?([^'\")]+)", n.attrs.get("style", ""))):
            out.append({"kind": "background", "src": m[1], "alt": "", "locator": locator(n)})
        elif kind and not n.inside("svg"):
            out.append({"kind": kind, "src": n.attrs.get("src", ""), "alt": n.attrs.get("alt") or n.attrs.get("aria-label", ""), "locator": locator(n)})
    return out


def sanitise(root: Node, tags=TAGS) -> str:
    """Markup by the allow-list: other tags are dropped with their content kept, scripts and styles with theirs."""
    out: list[str] = []

    stack: list = list(reversed(root.children))
    while stack:
        c = stack.pop()
        if isinstance(c, tuple):  # the end of an element
            out.append(f"</{c[0]}>")
        elif isinstance(c, str):
            out.append(escape(c, quote=False))
        elif c.tag in ("script", "style", "template", "noscript", "title"):
            continue
        else:
            if c.tag in tags:
                out.append(f"<{c.tag}{_kept_attributes(c)}>")
                if c.tag in VOID:
                    continue
                stack.append((c.tag,))
            stack.extend(reversed(c.children))
    return "".join(out)


def _kept_attributes(node: Node) -> str:
    kept = []
    for k, v in node.attrs.items():
        if k not in ANY_ATTRIBUTES and k not in ATTRIBUTES.get(node.tag, ()):
            continue
        if k in URL_ATTRIBUTES and (s := re.match(r"\s*([A-Za-z][A-Za-z0-9+.-]*):", v)) and s[1].lower() not in SCHEMES:
            continue
        if node.tag == "ol" and k == "start":
            number = re.match(r"[ \t\n\f\r]*([+-]?\d+)", v)
            if not number or abs(int(number[1])) >= 1 << 31:
                continue
            v = str(int(number[1]))
        kept.append(f' {k}="{escape(v)}"')
    return "".join(kept)


def markdown(root: Node) -> str:
    """A Markdown writer for blocks: nested lists at four spaces, definitions as `: x`, tables as pipes.

    Of a page that nests deeper than Python's stack, the text of its lines.
    """
    try:
        return _markdown(root)
    except RecursionError:
        return "\n\n".join(re.sub(r"([\\`*_\[\]<>])", r"\\\1", x) for x in text_of(root, lines=True).split("\n") if x)


def _markdown(root: Node) -> str:
    def inline(n: Node) -> str:
        out = []
        for c in n.children:
            if isinstance(c, str):
                out.append(re.sub(r"([\\`*_\[\]<>])", r"\\\1", _SPACE.sub(" ", c)))
            elif c.tag == "br":
                out.append("  \n")
            elif c.tag in SILENT or c.tag in ("ul", "ol", "table", "pre", "blockquote", "dl"):
                continue
            elif c.tag in ("b", "strong", "em", "i", "code", "del", "s"):
                body = raw_text(c) if c.tag == "code" else inline(c).strip()
                mark = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`"}.get(c.tag, "~~")
                out.append(f"{mark}{body}{mark}" if body else "")
            elif c.tag == "a" and c.attrs.get("href"):
                out.append(f"[{inline(c).strip()}]({c.attrs['href'].replace(' ', '%20').replace(')', '%29')})")
            elif c.tag == "img":
                out.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})")
            else:
                out.append(inline(c))
        return "".join(out)

    def listing(n: Node, depth: int) -> list[str]:
        out, number = [], int(re.match(r"\d+", n.attrs.get("start", "1") or "1")[0]) if re.match(r"\d+", n.attrs.get("start", "1") or "1") else 1
        for c in n.children:
            if isinstance(c, Node) and c.tag == "li":
                mark = f"{number}." if n.tag == "ol" else "-"
                out.append(("    " * depth + f"{mark} " + collapse(inline(c))).rstrip())
                for x in c.children:
                    if isinstance(x, Node) and x.tag in ("ul", "ol"):
                        out += listing(x, depth + 1)
                number += 1
        return out

    parts: list[str] = []

    def visit(n: Node):
        run: list = []

        def close():
            holder = Node("span")
            holder.children = list(run)
            run.clear()
            if x := "\n".join(s.strip() for s in inline(holder).split("\n") if s.strip()):
                parts.append(x)

        for c in n.children:
            if isinstance(c, str) or (c.tag not in BLOCK and c.tag not in SILENT and not any(d.tag in BLOCK for d in c.walk())):
                run.append(c)
                continue
            close()
            if c.tag in SILENT or hidden(c):
                continue
            if c.tag in HEADINGS:
                parts.append("#" * int(c.tag[1]) + " " + collapse(inline(c)))
            elif c.tag in ("ul", "ol"):
                parts.append("\n".join(listing(c, 0)))
            elif c.tag == "table":
                parts.append(pipe_table([[x["text"] for x in r] for r in table_rows(c)]))
            elif c.tag == "pre":
                body = raw_text(c).strip("\n")
                ticks = "`" * max(3, 1 + max((len(m) for m in re.findall("`+", body)), default=0))
                parts.append(f"{ticks}\n{body}\n{ticks}")
            elif c.tag == "blockquote":
                inner = _markdown(c)
                parts.append("\n".join(f"> {x}".rstrip() for x in inner.split("\n")))
            elif c.tag == "dl":
                parts.append("\n\n".join(f"{x['term']}\n: {x['definition']}" for x in definitions(c)))
            elif c.tag == "hr":
                parts.append("---")
            else:
                visit(c)
        close()

    visit(root)
    return "\n\n".join(p for p in parts if p)


def pipe_table(rows: list[list[str]]) -> str:
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    full = [[c.replace("|", "\\|").replace("\n", " ") for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in full]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])

