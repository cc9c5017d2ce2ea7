"""Bytes to text: byte-order mark, UTF-8, the declared label, then a guess."""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivane.functions.arrow import arrow_function

# Marks, and labels that pages read as another encoding.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
HTML_LABELS = {"iso-8859-1": "windows-1252", "latin-1": "windows-1252", "latin1": "windows-1252", "ascii": "windows-1252", "us-ascii": "windows-1252"}
WINDOWS_1252 = "".join(bytes([i]).decode("cp1252") if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(i) for i in range(256))
DECODED = "struct<text: string, encoding: string, warning: string>"


def windows_1252(data: bytes) -> str:
    """Every byte has a character; the five that Windows leaves free are the control characters of that number."""
    return codecs.charmap_decode(data, "strict", WINDOWS_1252)[0]


def codec(label: str | None, html: bool = False) -> str | None:
    label = (label or "").strip().lower()
    if html:
        label = HTML_LABELS.get(label, label)
    try:
        return codecs.lookup(label).name if label else None
    except LookupError:
        return None


def decode(data: bytes, declared: str | None = None, html: bool = False) -> dict:
    for mark, name in MARKS:
        if data.startswith(mark):
            return {"text": data[len(mark) :].decode(name, "replace"), "encoding": name, "warning": None}
    try:
        return {"text": data.decode("utf-8"), "encoding": "utf-8", "warning": None}
    except UnicodeDecodeError:
        pass
    name = codec(declared, html)
    if name == "cp1252":
        return {"text": windows_1252(data), "encoding": "windows-1252", "warning": None}
    if name:
        try:
            return {"text": data.decode(name), "encoding": name, "warning": None}
        except (UnicodeDecodeError, LookupError):
            pass
    if data.count(0) * 4 > len(data):
        name = "utf-16-le" if data[1::2].count(0) >= data[::2].count(0) else "utf-16-be"
        return {"text": data.decode(name, "replace"), "encoding": name, "warning": "encoding guessed"}
    return {"text": windows_1252(data), "encoding": "windows-1252", "warning": "encoding guessed"}


@arrow_function(DECODED)
def decode_text(data: pa.Array, declared: pa.Array) -> pa.Array:
    rows = [None if b is None else decode(b, d) for b, d in zip(data.to_pylist(), declared.to_pylist())]
    return pa.array(rows, pa.struct([("text", pa.string()), ("encoding", pa.string()), ("warning", pa.string())]))


def non_ascii_lines(text: Column) -> Column:
    """Lines that say something about an encoding."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x00-\x7f]|\x1b")), "\n")
