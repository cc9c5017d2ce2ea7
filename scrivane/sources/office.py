"""Office files, books and archives to Markdown, on zip members and the standard library's XML reader."""

from __future__ import annotations

import csv
import datetime
import io
import posixpath
import re
import struct
import zipfile
import zlib
from functools import wraps
from xml.etree import ElementTree

import pyarrow as pa

from scrivane.functions import markup as M
from scrivane.functions.arrow import arrow_function
from scrivane.sources.encoding import decode
from scrivane.sources.members import PlainZip, plain_zip, stored_zip

MAX_BYTES, MAX_MEMBERS, MAX_DEPTH = 100 << 20, 20_000, 3
csv.field_size_limit(MAX_BYTES)  # a cell may be as long as a file
TEXTS = ("txt", "log", "json", "jsonl", "yaml", "yml", "xml", "md", "markdown")


#: A name with a root, a drive or a step up.
_OUTSIDE = re.compile(r"\A(?:[/\\]|[A-Za-z]:)|(?:\A|[/\\])\.\.(?:[/\\]|\Z)")


class Refused(ValueError):
    pass


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attr(node, name: str, default=None):
    return next((v for k, v in node.attrib.items() if _local(k) == name), default)


def _xml(data: bytes):
    if b"<!" in data and re.search(rb"<!ENTITY|<!DOCTYPE[^>\[]*\b(SYSTEM|PUBLIC)\b", data, re.I):
        raise Refused("XML with entities or external references")
    return ElementTree.fromstring(data)


def _kept(function):
    """What small parts say that the files of one program share is kept for the next files, of 64 parts at most; a larger part is read anew."""
    said: dict = {}

    @wraps(function)
    def read(data: bytes, *more):
        if len(data) > 4096:
            return function(data, *more)
        if (found := said.get((data, *more))) is None:
            if len(said) >= 64:
                said.clear()
            found = said[data, *more] = function(data, *more)
        return found

    return read


def open_archive(data: bytes, depth: int = 1, budget: list[int] | None = None) -> zipfile.ZipFile | PlainZip:
    """A zip whose members are within the shared budgets and inside its root."""
    budget = budget if budget is not None else [MAX_BYTES, MAX_MEMBERS]
    if depth > MAX_DEPTH:
        raise Refused("archives nested too deep")
    try:
        z = plain_zip(data) or zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Refused("no archive") from e
    for info in z.infolist():
        budget[0] -= info.file_size
        budget[1] -= 1
        if _OUTSIDE.search(info.filename) or (info.external_attr >> 28) == 0xA:
            raise Refused("member outside the archive")
    if min(budget) < 0:
        raise Refused("archive too large")
    return z


class Counter:
    """Numbers of multi-level lists: a level counts on, deeper ones start again."""

    def __init__(self, starts: dict[int, int] | None = None):
        self.starts, self.now = starts or {}, {}

    def next(self, level: int) -> str:
        for deeper in [k for k in self.now if k > level]:
            del self.now[deeper]
        self.now[level] = self.now.get(level, self.starts.get(level, 1) - 1) + 1
        return ".".join(str(self.now.get(k, self.starts.get(k, 1))) for k in range(level + 1))


def _kids(node, name: str):
    return (k for k in node if _local(k.tag) == name)


def _find(node, *path: str):
    """The first element down a path of local names, or None."""
    for name in path:
        node = next(_kids(node, name), None) if node is not None else None
    return node


def _val(node, *path: str):
    found = _find(node, *path)
    return None if found is None else _attr(found, "val", "")


def _on(node, name: str) -> bool:
    """Whether a switch property stands and is not turned off."""
    found = _find(node, name)
    return found is not None and _attr(found, "val", "1") not in ("0", "false", "off", "none")


def _part(z: zipfile.ZipFile, name: str):
    return _xml(z.read(name)) if name in z.namelist() else None


def _resolved(node):
    """The children of an element, alternate content by one branch: the first choice with text, else the fallback, else the first."""
    for k in node:
        if _local(k.tag) != "AlternateContent":
            yield k
            continue
        branches = [b for b in k if _local(b.tag) in ("Choice", "Fallback")]
        chosen = next((b for b in branches if _run_text(b).strip()), branches[0] if branches else None)
        if chosen is not None:
            yield from _resolved(chosen)


def _styles(z: zipfile.ZipFile) -> dict[str, tuple[str, str | None, object]]:
    """styleId -> (name, the style it is based on, its numPr)."""
    root = _part(z, "word/styles.xml")
    return {} if root is None else {_attr(s, "styleId", ""): (_val(s, "name") or "", _val(s, "basedOn"), _find(s, "pPr", "numPr")) for s in _kids(root, "style")}


def _lineage(styles, style: str | None):
    """A style and those it is based on; a cycle ends after 32."""
    for _ in range(32):
        if style not in styles:
            return
        yield styles[style]
        style = styles[style][1]


def _levels(node) -> dict[int, tuple[str, int]]:
    return {int(_attr(lvl, "ilvl", 0)): (_val(lvl, "numFmt") or "decimal", int(_val(lvl, "start") or 1)) for lvl in _kids(node, "lvl")}


def _numbering(z: zipfile.ZipFile, styles=None) -> dict[str, dict[int, tuple[str, int]]]:
    """numId -> level -> (format, start), with overrides and lists that a numbering style links to."""
    root = _part(z, "word/numbering.xml")
    if root is None:
        return {}
    abstract = {_attr(a, "abstractNumId"): a for a in _kids(root, "abstractNum")}
    nums = {_attr(n, "numId"): n for n in _kids(root, "num")}
    out = {}
    for number, num in nums.items():
        found, seen = abstract.get(_val(num, "abstractNumId")), 0
        while found is not None and (link := _val(found, "numStyleLink")) and seen < 32:
            target = (styles or {}).get(link)
            linked = nums.get(_val(target[2], "numId")) if target and target[2] is not None else None
            found, seen = abstract.get(_val(linked, "abstractNumId")) if linked is not None else None, seen + 1
        levels = _levels(found) if found is not None else {}
        for o in _kids(num, "lvlOverride"):
            at = int(_attr(o, "ilvl", 0))
            levels |= {k: v for k, v in _levels(o).items()}
            if (start := _val(o, "startOverride")) is not None:
                levels[at] = (levels.get(at, ("decimal", 1))[0], int(start or 1))
        out[number] = levels
    return out


def _run_text(node) -> str:
    """The text below an element, without deleted or phonetic text."""
    out = []

    def walk(x):
        for k in x:
            tag = _local(k.tag)
            if tag == "t":
                out.append(k.text or "")
            elif tag in ("br", "cr"):
                out.append("\n")
            elif tag == "tab":
                out.append("\t")
            elif tag not in ("rPh", "moveFrom", "del"):
                walk(k)

    walk(node)
    return "".join(out)


def _latex(node) -> str:
    """An equation's tree as LaTeX; what has no rule of its own is read through."""
    tag = _local(node.tag)
    inner = lambda name: "".join(_latex(k) for x in _kids(node, name) for k in x)
    if tag == "t":
        return node.text or ""
    if tag == "f":
        return f"\\frac{{{inner('num')}}}{{{inner('den')}}}"
    if tag in ("sSup", "sSub", "sSubSup", "nary"):
        sub, sup = inner("sub"), inner("sup")
        mark = (_val(node, "naryPr", "chr") or "\u222b") if tag == "nary" else ""
        return mark + ("" if tag == "nary" else inner("e")) + (f"_{{{sub}}}" if sub else "") + (f"^{{{sup}}}" if sup else "") + (inner("e") if tag == "nary" else "")
    if tag == "rad":
        return "\\sqrt" + (f"[{inner('deg')}]" if inner("deg") else "") + f"{{{inner('e')}}}"
    if tag == "d":
        opening, closing = _val(node, "dPr", "begChr"), _val(node, "dPr", "endChr")
        return ("(" if opening is None else opening) + ",".join("".join(_latex(k) for k in e) for e in _kids(node, "e")) + (")" if closing is None else closing)
    return "".join(_latex(k) for k in node)


def _emphasis(text: str, mark: str) -> str:
    """Marks around a run's text, inside its outer blanks."""
    body = text.strip()
    if not mark or not body:
        return text
    start = len(text) - len(text.lstrip())
    return text[:start] + mark + body + mark + text[start + len(body) :]


class _Word:
    """A Word document's parts and what its paragraphs refer to."""

    #: Wrappers that stand around blocks or runs and add nothing.
    THROUGH = ("sdt", "sdtContent", "ins", "moveTo", "smartTag", "customXml", "fldSimple", "dir", "bdo")

    def __init__(self, data: bytes):
        self.z = open_archive(data)
        self.main = _main_part(self.z, "word/document.xml")
        self.styles = _styles(self.z)
        self.numbers, self.counters = _numbering(self.z, self.styles), {}
        self.rels = _relations(self.z, self.main)
        self.used: list[tuple[str, str]] = []

    def inline(self, node, boxes: list) -> str:
        """The text of a paragraph or a part of one; runs of equal emphasis stand as one. Text boxes go to boxes."""
        runs: list[list[str]] = []

        def add(mark: str, text: str) -> None:
            if runs and runs[-1][0] == mark:
                runs[-1][1] += text
            elif text:
                runs.append([mark, text])

        def walk(x) -> None:
            for k in _resolved(x):
                tag = _local(k.tag)
                if tag == "r":
                    properties = _find(k, "rPr")
                    add("" if properties is None else "**" * _on(properties, "b") + "*" * _on(properties, "i"), self.run(k, boxes))
                elif tag == "hyperlink":
                    said, target = self.inline(k, boxes), self.rels.get(_attr_ns(k) or "")
                    add("", f"[{said}]({target})" if said.strip() and target else said)
                elif tag in ("oMath", "oMathPara"):
                    add("", f"${_latex(k)}$")
                elif tag in self.THROUGH:
                    walk(k)
                elif tag == "t":
                    add("", k.text or "")

        walk(node)
        return "".join(_emphasis(text, mark) for mark, text in runs)

    def run(self, node, boxes: list) -> str:
        out = []
        for k in _resolved(node):
            tag = _local(k.tag)
            if tag == "t":
                out.append(k.text or "")
            elif tag in ("br", "cr"):
                out.append("\n")
            elif tag == "tab":
                out.append("\t")
            elif tag == "noBreakHyphen":
                out.append("-")
            elif tag in ("footnoteReference", "endnoteReference"):
                self.used.append((tag[: tag.index("Ref")] + "s", _attr(k, "id", "")))
                out.append(f"[^{len(self.used)}]")
            elif tag in ("drawing", "pict", "object"):
                out.append(self.drawing(k, boxes))
        return "".join(out)

    def drawing(self, node, boxes: list) -> str:
        """A picture by its part's name; the outermost text boxes are kept for after the paragraph."""
        name, said, stack = None, "", [node]
        while stack:
            x = stack.pop()
            tag = _local(x.tag)
            if tag == "txbxContent":
                boxes.append(x)
                continue
            if tag in ("blip", "imagedata") and name is None:
                name = next((self.rels[v] for a, v in x.attrib.items() if _local(a) in ("embed", "id") and v in self.rels), None)
            elif tag == "docPr":
                said = said or _attr(x, "descr", "")
            stack += reversed(list(_resolved(x)))
        return f"![{said}]({name})" if name else ""

    def blocks(self, node) -> list[str]:
        parts: list[str] = []
        for k in _resolved(node):
            tag = _local(k.tag)
            if tag == "p":
                self.paragraph(k, parts)
            elif tag == "tbl":
                parts.append(M.pipe_table(self.table(k)))
            elif tag in self.THROUGH:
                parts += self.blocks(k)
        return parts

    def table(self, node) -> list[list[str]]:
        """Cells by row; one that spans is followed by empty ones, one that goes on from above is empty."""
        rows = []
        for r in self.through(node, "tr"):
            line: list[str] = []
            for c in self.through(r, "tc"):
                span = int(_val(c, "tcPr", "gridSpan") or 1)
                merged = _find(c, "tcPr", "vMerge")
                goes_on = merged is not None and _attr(merged, "val", "continue") == "continue"
                line += ["" if goes_on else "\n".join(self.blocks(c))] + [""] * (span - 1)
            rows.append(line)
        return rows

    def through(self, node, name: str):
        for k in node:
            if _local(k.tag) == name:
                yield k
            elif _local(k.tag) in self.THROUGH:
                yield from self.through(k, name)

    def paragraph(self, node, parts: list[str]) -> None:
        boxes: list = []
        text = self.inline(node, boxes).strip()
        style = _val(node, "pPr", "pStyle")
        line = list(_lineage(self.styles, style))
        names = [style or "", *(n for n, _, _ in line)]
        heading = next((m for n in names if (m := re.fullmatch(r"[Hh]eading ?([1-6])", n))), None)
        num = _find(node, "pPr", "numPr")
        num = num if num is not None else next((n for _, _, n in line if n is not None), None)
        number = None if num is None else _val(num, "numId")
        if text and heading:
            parts.append("#" * int(heading[1]) + " " + text)
        elif text and number not in (None, "0"):
            level, levels = int(_val(num, "ilvl") or 0), self.numbers.get(number, {})
            if levels.get(level, ("bullet", 1))[0] == "bullet":
                mark = "-"
            else:
                counter = self.counters.setdefault(number, Counter({k: s for k, (_, s) in levels.items()}))
                mark = counter.next(level) + "."
            item = "    " * level + f"{mark} {text}"
            if parts and re.match(r"\s*([-]|[\d.]+\.) ", parts[-1].split("\n")[-1]):
                parts[-1] += "\n" + item
            else:
                parts.append(item)
        elif text:
            parts.append(text)
        for box in boxes:
            parts += self.blocks(box)

    def notes(self) -> list[str]:
        """The texts of the notes referred to, in order; notes of notes follow."""
        out, at, read = [], 0, {}
        while at < len(self.used):
            kind, key = self.used[at]
            at += 1
            if kind not in read:
                root = _part(self.z, posixpath.join(posixpath.dirname(self.main), f"{kind}.xml"))
                read[kind] = {} if root is None else {_attr(n, "id", ""): n for n in root}
            found = read[kind].get(key)
            out.append(f"[^{at}]: " + ("" if found is None else " ".join(self.blocks(found))))
        return out


def docx(data: bytes) -> str:
    """Body blocks in order, then the notes they refer to.

    Content controls and inserted text are read, deleted text is not; links, emphasis,
    pictures by their part's name, equations as LaTeX, text boxes after their paragraph.
    """
    w = _Word(data)
    return "\n\n".join(w.blocks(_xml(w.z.read(w.main))[0]) + w.notes())


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Id -> member name; targets outside the package stay as they are."""
    return {key: target for key, _, target in _links(z, part)}


def _links(z: zipfile.ZipFile, part: str) -> list[tuple[str, str, str]]:
    """(id, last word of the kind, target) of a part's relationships."""
    name = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    return list(_targets(z.read(name), part)) if name in z.namelist() else []


@_kept
def _targets(data: bytes, part: str) -> tuple[tuple[str, str, str], ...]:
    out = []
    for r in _xml(data):
        target = _attr(r, "Target", "")
        if _attr(r, "TargetMode") != "External":
            target = posixpath.normpath(posixpath.join("/" + posixpath.dirname(part), target)).lstrip("/")
        out.append((_attr(r, "Id"), _attr(r, "Type", "").rpartition("/")[2], target))
    return tuple(out)


def _main_part(z: zipfile.ZipFile, usual: str) -> str:
    """The part that the package names as its document, else the usual one."""
    return next((t for _, kind, t in _links(z, "") if kind == "officeDocument" and t in z.namelist()), usual)


def part_types(z: zipfile.ZipFile) -> dict[str, str]:
    """Member -> content type: by its own name, else by its suffix."""
    root = _part(z, "[Content_Types].xml")
    if root is None:
        return {}
    named = {_attr(x, "PartName", "").lstrip("/").lower(): _attr(x, "ContentType", "") for x in _kids(root, "Override")}
    suffixes = {_attr(x, "Extension", "").lower(): _attr(x, "ContentType", "") for x in _kids(root, "Default")}
    kinds = {n: named.get(n.lower()) or suffixes.get(n.lower().rpartition(".")[2]) for n in z.namelist()}
    return {n: k for n, k in kinds.items() if k}


def rewrite_parts(data: bytes, rewrites: dict) -> bytes:
    """The package with the parts of some content types edited in place.

    A rewrite takes the part's root and says whether it changed it; every other
    member keeps its bytes, and a package without a change is returned as it is.
    """
    z = open_archive(data)
    changed = {}
    for name, kind in part_types(z).items():
        if kind in rewrites:
            root = _xml(z.read(name))
            if rewrites[kind](root):
                changed[name] = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
    return zipped({i.filename: changed.get(i.filename) or z.read(i) for i in z.infolist()}) if changed else data


def _series(node, name: str) -> list[str]:
    """The cached values of a chart's categories or numbers, by their index."""
    found = _find(node, name)
    points = {} if found is None else {int(_attr(p, "idx", 0)): next((v.text or "" for v in _kids(p, "v")), "") for p in found.iter() if _local(p.tag) == "pt"}
    return [points.get(i, "") for i in range(max(points) + 1)] if points else []


def _chart(root) -> str:
    """A chart as its title and a table: a row for each category, a column for each series."""
    title = next((t for x in root.iter() if _local(x.tag) == "title" and (t := _run_text(x).strip())), "")
    series = [x for x in root.iter() if _local(x.tag) == "ser"]
    names = ["".join(v.text or "" for v in t.iter() if _local(v.tag) == "v") if (t := _find(s, "tx")) is not None else f"Series {i}" for i, s in enumerate(series, 1)]
    labels = next((c for s in series if (c := _series(s, "cat") or _series(s, "xVal"))), [])
    values = [_series(s, "val") or _series(s, "yVal") for s in series]
    n = max([len(labels), *map(len, values)], default=0)
    cell = lambda row, i: row[i] if i < len(row) else ""
    table = M.pipe_table([["Category", *names], *([cell(labels, i), *(cell(v, i) for v in values)] for i in range(n))]) if series else ""
    return "\n\n".join(x for x in ("### Chart" + (f": {title}" if title else ""), table) if x)


class _Slide:
    def __init__(self, z: zipfile.ZipFile, part: str):
        self.z, self.title, self.rels = z, "", _relations(z, part)
        self.root = _xml(z.read(part))

    def paragraphs(self, node) -> list[str]:
        out = []
        for p in node.iter():
            if _local(p.tag) == "p" and (text := self.line(p).strip()):
                out.append(text)
        return out

    def line(self, node) -> str:
        out = []
        for k in _resolved(node):
            tag = _local(k.tag)
            if tag == "t":
                out.append(k.text or "")
            elif tag == "br":
                out.append("\n")
            elif tag == "tab":
                out.append("\t")
            elif tag in ("oMath", "oMathPara"):
                out.append(f"${_latex(k)}$")
            elif tag not in ("pPr", "rPr", "endParaRPr"):
                out.append(self.line(k))
        return "".join(out)

    def shapes(self, node) -> list[str]:
        out: list[str] = []
        for k in _resolved(node):
            tag = _local(k.tag)
            if tag in ("grpSp", "spTree", "cSld"):
                out += self.shapes(k)
            elif tag == "p":
                out += [t] if (t := self.line(k).strip()) else []
            elif tag in ("sp", "cxnSp"):
                said = self.paragraphs(k)
                kind = next((_attr(x, "type", "") for x in k.iter() if _local(x.tag) == "ph"), "")
                if kind in ("title", "ctrTitle") and said and not self.title:
                    self.title = " ".join(said)
                else:
                    out += said
            elif tag == "pic":
                said = next((_attr(x, "descr", "") or _attr(x, "name", "") for x in k.iter() if _local(x.tag) == "cNvPr"), "")
                name = next((self.rels.get(_attr(x, "embed", "")) for x in k.iter() if _local(x.tag) == "blip"), None)
                out.append(f"![{said}]({name or ''})")
            elif tag == "graphicFrame":
                out += self.frame(k)
        return out

    def frame(self, node) -> list[str]:
        for x in node.iter():
            tag = _local(x.tag)
            if tag == "tbl":
                return [M.pipe_table([["\n".join(self.paragraphs(c)) for c in _kids(r, "tc")] for r in _kids(x, "tr")])]
            if tag == "chart" and (part := self.rels.get(_attr_ns(x) or "")) in self.z.namelist():
                return [_chart(_xml(self.z.read(part)))]
            if tag == "relIds" and (part := self.rels.get(_attr(x, "dm", ""))) in self.z.namelist():
                return self.diagram(_xml(self.z.read(part)))
        return self.paragraphs(node)

    def diagram(self, model) -> list[str]:
        """A diagram's texts as a list, each below the point that it hangs on."""
        said = {p.get("modelId"): " ".join(self.paragraphs(p)) for p in model.iter() if _local(p.tag) == "pt"}
        below: dict[str, list] = {}
        for c in model.iter():
            if _local(c.tag) == "cxn" and c.get("type", "parOf") == "parOf":
                below.setdefault(c.get("srcId"), []).append((int(c.get("srcOrd") or 0), c.get("destId")))
        heads = set(said) - {d for kids in below.values() for _, d in kids}
        lines, seen = [], set()
        stack = [(0, p) for p in reversed(said) if p in heads]
        while stack:
            depth, point = stack.pop()
            if point in seen:
                continue
            seen.add(point)
            if said.get(point):
                lines.append("    " * depth + "- " + said[point])
            stack += [(depth + bool(said.get(point)), d) for _, d in sorted(below.get(point, ()), reverse=True)]
        lines += ["- " + t for p, t in said.items() if t and p not in seen]
        return ["\n".join(lines)] if lines else []


def pptx(data: bytes) -> str:
    """Slides in presentation order, with their notes: texts, tables, charts, diagrams, pictures and equations in the order of the file."""
    z = open_archive(data)
    main = _main_part(z, "ppt/presentation.xml")
    rels = _relations(z, main)
    order = [rels[_attr_ns(x)] for x in _xml(z.read(main)).iter() if _local(x.tag) == "sldId" and _attr_ns(x) in rels]
    parts = []
    for n, part in enumerate(order, 1):
        slide = _Slide(z, part)
        said = slide.shapes(slide.root)
        if not slide.title and said and not re.match(r"[|!#-]", said[0]):
            slide.title = said.pop(0)
        parts.append("\n\n".join([f"## Slide {n}" + (f": {slide.title}" if slide.title else ""), *said]))
        notes = next((t for _, kind, t in _links(z, part) if kind == "notesSlide" or "notesSlide" in t), None)
        if notes in z.namelist():
            page = _Slide(z, notes)
            if said := page.shapes(page.root):
                parts.append("### Notes\n\n" + "\n\n".join(said))
    return "\n\n".join(parts)


def _attr_ns(node) -> str | None:
    """The relationship id of an element, which has a plain id beside it."""
    return next((v for k, v in node.attrib.items() if k.endswith("}id")), None)


_LETTERS = re.compile("[A-Z]+")


def _column(ref: str) -> int:
    n = 0
    for c in _LETTERS.match(ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


# Built-in number formats that are dates or times.
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47)


def _dated(z: zipfile.ZipFile, part: str) -> tuple[bool, ...]:
    """For each cell format, whether it shows a date or a time."""
    return _dated_formats(z.read(part)) if part in z.namelist() else ()


@_kept
def _dated_formats(data: bytes) -> tuple[bool, ...]:
    root = _xml(data)
    codes = {int(_attr(f, "numFmtId", 0)): _attr(f, "formatCode", "") for f in root.iter() if _local(f.tag) == "numFmt"}
    plain = {k: re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?![hms]+\])[^\]]*\]', "", c).split(";")[0].lower() for k, c in codes.items()}
    dated = lambda k: bool(re.search("[dmyhs]", plain[k])) and "general" not in plain[k] if k in plain else k in DATE_FORMATS
    formats = _find(root, "cellXfs")
    return () if formats is None else tuple(dated(int(_attr(x, "numFmtId", 0))) for x in _kids(formats, "xf"))


def _moment(serial: str, from_1904: bool) -> str:
    """A serial number as a date, a time of day or both; one that is none stays as it is."""
    try:
        days = float(serial)
        whole = days >= 1 or from_1904
        if days < 0:
            return serial
        # Serial 60 is a day that never was; those before it count from a day later.
        start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 31 if days < 60 else 30)
        at = start + datetime.timedelta(seconds=round(days * 86400, 3))
    except (ValueError, OverflowError):
        return serial
    if at.microsecond:
        at += datetime.timedelta(microseconds=500_000)
        at = at.replace(microsecond=0)
    return str(at) if whole else str(at.time())


@_kept
def _strings(data: bytes) -> tuple[str, ...]:
    return tuple(_run_text(si) for si in _kids(_xml(data), "si"))


@_kept
def _book(data: bytes) -> tuple[bool, tuple[tuple[str | None, str], ...]]:
    """Whether a workbook counts its days from 1904, and its sheets (relationship id, name)."""
    book = _xml(data)
    properties = _find(book, "workbookPr")
    from_1904 = properties is not None and _attr(properties, "date1904") in ("1", "true")
    return from_1904, tuple((_attr_ns(x), _attr(x, "name", "")) for x in book.iter() if _local(x.tag) == "sheet")


def xlsx(data: bytes) -> str:
    """A section and a table for each sheet; dates and truth values are spelled out, whatever their cells show."""
    z = open_archive(data)
    main = _main_part(z, "xl/workbook.xml")
    folder = posixpath.dirname(main)
    strings = posixpath.join(folder, "sharedStrings.xml")
    shared = _strings(z.read(strings)) if strings in z.namelist() else ()
    dated = _dated(z, posixpath.join(folder, "styles.xml"))
    rels, parts, missing = _relations(z, main), [], []
    from_1904, sheets = _book(z.read(main))

    def value(c) -> str:
        kind, v = c.get("t", "n"), ""
        for x in c:
            if _local(x.tag) == "v":
                v = x.text or ""
                break
        if kind == "s" and v:
            return shared[int(v)]
        if kind == "inlineStr":
            return _run_text(c)
        if kind == "b":
            return {"1": "True", "0": "False"}.get(v, v)
        style = int(c.get("s") or 0)
        return _moment(v, from_1904) if kind == "n" and v and style < len(dated) and dated[style] else v.replace("T", " ") if kind == "d" else v

    for key, name in sheets:
        if rels.get(key) not in z.namelist():
            missing.append(name)
            continue
        rows = []
        for r in _xml(z.read(rels[key])).iter():
            if _local(r.tag) != "row":
                continue
            line: list[str] = []
            for c in _kids(r, "c"):
                at = _column(c.get("r")) if c.get("r") else len(line)
                line += [""] * (at - len(line)) + [value(c)]
            rows.append(line)
        parts.append(f"## {name}\n\n{M.pipe_table(rows)}".rstrip())
    if not parts:
        raise Refused("workbook without a sheet that can be read")
    if missing:
        parts.append(f"Left out (no part of that sheet): {', '.join(missing)}")
    return "\n\n".join(parts)


def epub(data: bytes) -> str:
    """Title and creators, then the chapters of the spine."""
    z = open_archive(data)
    opf = next(_attr(x, "full-path") for x in _xml(z.read("META-INF/container.xml")).iter() if _local(x.tag) == "rootfile")
    package = _xml(z.read(opf))
    items = {x.get("id"): x.get("href") for x in package.iter() if _local(x.tag) == "item"}
    meta = [(t, (x.text or "").strip()) for x in package.iter() if (t := _local(x.tag)) in ("title", "creator", "language") and (x.text or "").strip()]
    parts = ["\n".join(f"{k.capitalize()}: {v}" for k, v in meta)] if meta else []
    for ref in package.iter():
        if _local(ref.tag) == "itemref" and ref.get("idref") in items:
            name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[ref.get("idref")]))
            if name in z.namelist():
                parts.append(M.markdown(M.parse(decode(z.read(name), html=True)["text"])))
    return "\n\n".join(p for p in parts if p)


def member(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes:
    try:
        return z.read(info)
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError) as e:
        raise Refused("damaged member") from e
    except RuntimeError as e:
        raise Refused("encrypted member") from e


def archive(data: bytes, depth: int = 1, budget: list[int] | None = None) -> str:
    """Members in order under their names; the unreadable ones are named by reason."""
    budget = budget if budget is not None else [MAX_BYTES, MAX_MEMBERS]
    z, parts, left = open_archive(data, depth, budget), [], {}
    for info in z.infolist():
        if info.is_dir():
            continue
        try:
            parts.append(f"## {info.filename}\n\n" + convert(info.filename.rpartition(".")[2], member(z, info), depth + 1, budget))
        except Refused as e:
            left.setdefault(str(e), []).append(info.filename)
    for why, names in sorted(left.items()):
        more = f" and {len(names) - 3} more" if len(names) > 3 else ""
        parts.append(f"Left out ({why}): {', '.join(sorted(names)[:3])}{more}")
    return "\n\n".join(parts)


def convert(kind: str, data: bytes, depth: int = 1, budget: list[int] | None = None) -> str:
    kind = kind.lower()
    try:
        if kind in ("html", "htm"):
            return M.markdown(M.parse(decode(data, html=True)["text"]))
        if kind in ("csv", "tsv"):
            return M.pipe_table(list(csv.reader(io.StringIO(decode(data)["text"]), delimiter="\t" if kind == "tsv" else ",")))
        if kind in ("md", "markdown"):
            return decode(data)["text"]
        if kind in TEXTS:
            body = decode(data)["text"].rstrip("\n")
            if kind == "xml":
                _xml_guard(data)
            ticks = "`" * max(3, 1 + max((len(m) for m in re.findall("`+", body)), default=0))
            return f"{ticks}\n{body}\n{ticks}"
        if kind == "zip":
            return archive(data, depth, budget)
        if kind in READERS:
            return READERS[kind](data)
    except (ElementTree.ParseError, KeyError, IndexError, StopIteration, ValueError, TypeError, AttributeError) as e:
        raise e if isinstance(e, Refused) else Refused(f"unreadable {kind}") from e
    except (csv.Error, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, struct.error) as e:
        raise Refused(f"unreadable {kind}") from e
    except RecursionError as e:
        raise Refused(f"{kind} nested too deeply") from e
    except RuntimeError as e:  # what the archive reader says of a member under a password
        raise Refused(f"encrypted {kind}" if "password" in str(e) or "encrypted" in str(e) else f"unreadable {kind}") from e
    raise Refused("unknown kind")


def _xml_guard(data: bytes) -> None:
    if re.search(rb"<!ENTITY|<!DOCTYPE[^>\[]*\b(SYSTEM|PUBLIC)\b", data, re.I):
        raise Refused("XML with entities or external references")


READERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "epub": epub}


_CONVERTED = "struct<kind: string, markdown: string, error: string>"


def _converted(kinds: list[str | None], contents: pa.Array) -> pa.Array:
    rows = []
    for kind, data in zip(kinds, contents.to_pylist()):
        try:
            rows.append((kind, convert(kind or "", data or b""), None))
        except Refused as e:
            rows.append((kind, None, str(e)))
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["kind", "markdown", "error"])


@arrow_function(_CONVERTED)
def converted(kinds: pa.Array, contents: pa.Array) -> pa.Array:
    return _converted(kinds.to_pylist(), contents)


def converted_from(kind: str):
    """converted() of files of one kind; of one column, so that Spark runs it in one pass with the function that makes the files."""

    @arrow_function(_CONVERTED)
    def read(contents: pa.Array) -> pa.Array:
        return _converted([kind] * len(contents), contents)

    return read


def zipped(members: dict[str, str | bytes]) -> bytes:
    """A zip of stored members."""
    members = {k: v.encode() if isinstance(v, str) else v for k, v in members.items()}
    if (plain := stored_zip(members)) is not None:
        return plain
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def sample(kind: str, words: list[str]) -> bytes:
    """A minimal file of a kind holding the words, for round trips."""
    from xml.sax.saxutils import escape as x

    a, b, c = (x(w) for w in words)
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="{}"/></Relationships>'
    if kind == "docx":
        item = lambda t: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
        return zipped({
            "word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>{a}</w:t></w:r></w:p>{item(b)}{item(c)}</w:body></w:document>',
            "word/numbering.xml": f'<w:numbering {w}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
        })
    if kind == "pptx":
        p = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
        return zipped({
            "ppt/presentation.xml": f'<p xmlns:p="p" {r}><p:sldId id="256" r:id="r1"/></p>', "ppt/_rels/presentation.xml.rels": rel.format("slides/slide1.xml"),
            "ppt/slides/slide1.xml": f"<s {p}>" + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in (a, b)) + "</s>", "ppt/slides/_rels/slide1.xml.rels": rel.format("../notesSlides/notesSlide1.xml"),
            "ppt/notesSlides/notesSlide1.xml": f"<s {p}><a:p><a:r><a:t>{c}</a:t></a:r></a:p></s>",
        })
    if kind == "xlsx":
        return zipped({
            "xl/workbook.xml": f'<workbook {r}><sheets><sheet name="{a}" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rel.format("worksheets/sheet1.xml"), "xl/sharedStrings.xml": f"<sst><si><t>{b}</t></si></sst>",
            "xl/worksheets/sheet1.xml": f'<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>{c}</t></is></c></row></sheetData></worksheet>',
        })
    return zipped({
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>',
        "o/p.opf": f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{a}</dc:title></metadata><manifest><item id="i" href="c.xhtml"/></manifest><spine><itemref idref="i"/></spine></package>',
        "o/c.xhtml": f"<html><body><h1>{b}</h1><p>{c}</p></body></html>",
    })


@arrow_function("binary")
def sample_file(kinds: pa.Array, words: pa.Array) -> pa.Array:
    return pa.array([sample(k, w) for k, w in zip(kinds.to_pylist(), words.to_pylist())], pa.binary())
