"""Page operators: HTML columns to metadata, blocks, links, Markdown and text.

The HTML work is one Arrow function per operator, a batch at a time; everything after
it (explodes, windows, joins) is DataFrame code.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivane.functions import declared as D
from scrivane.functions import markup as M
from scrivane.functions import regions as R
from scrivane.functions.arrow import arrow_function

CELL = pa.struct([("text", pa.string()), ("header", pa.bool_()), ("colspan", pa.int32()), ("rowspan", pa.int32())])
TRACK = pa.struct([("kind", pa.string()), ("lang", pa.string()), ("label", pa.string()), ("src", pa.string())])
TERM = pa.struct([("term", pa.string()), ("definition", pa.string())])
BLOCK = pa.struct([
    ("type", pa.string()), ("id", pa.string()), ("locator", pa.string()), ("text", pa.string()), ("chrome", pa.bool_()), ("level", pa.int32()), ("language", pa.string()),
    ("items", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(CELL))), ("terms", pa.list_(TERM)), ("name", pa.string()), ("value", pa.string()), ("src", pa.string()), ("tracks", pa.list_(TRACK)),
])
_CELL_DDL = "struct<text: string, header: boolean, colspan: int, rowspan: int>"
BLOCK_DDL = (f"struct<type: string, id: string, locator: string, text: string, chrome: boolean, level: int, language: string, items: array<string>, rows: array<array<{_CELL_DDL}>>, "
             "terms: array<struct<term: string, definition: string>>, name: string, value: string, src: string, tracks: array<struct<kind: string, lang: string, label: string, src: string>>>")
_META = ("title", "author", "date", "site", "byline", "declared_author", "language", "description", "keywords", "canonical")


def _each(values: pa.Array, function, kind: pa.DataType) -> pa.Array:
    return pa.array([None if v is None else function(v) for v in values.to_pylist()], kind)


@arrow_function("struct<" + ", ".join(f"{n}: string" for n in _META) + ">")
def metadata(html: pa.Array) -> pa.Array:
    return _each(html, lambda h: D.Declarations(h).record(), pa.struct([(n, pa.string()) for n in _META]))


@arrow_function(f"array<{BLOCK_DDL}>")
def blocks(html: pa.Array) -> pa.Array:
    return _each(html, lambda h: M.blocks(M.parse(h)), pa.list_(BLOCK))


@arrow_function(f"array<array<array<{_CELL_DDL}>>>")
def tables(html: pa.Array) -> pa.Array:
    """The rows of a page's tables alone, those of its blocks."""
    return _each(html, M.tables, pa.list_(pa.list_(pa.list_(CELL))))


@arrow_function("array<struct<text: string, url: string>>")
def links(html: pa.Array) -> pa.Array:
    return _each(html, lambda h: M.links(M.parse(h)), pa.list_(pa.struct([("text", pa.string()), ("url", pa.string())])))


@arrow_function("array<struct<kind: string, src: string, alt: string, locator: string>>")
def visuals(html: pa.Array) -> pa.Array:
    return _each(html, lambda h: M.visuals(M.parse(h)), pa.list_(pa.struct([(n, pa.string()) for n in ("kind", "src", "alt", "locator")])))


@arrow_function("string")
def sanitised(html: pa.Array) -> pa.Array:
    return _each(html, lambda h: M.sanitise(M.parse(h)), pa.string())


@arrow_function("string")
def markdown(html: pa.Array) -> pa.Array:
    return _each(html, lambda h: M.markdown(M.parse(h)), pa.string())


@arrow_function("string")
def article_text(html: pa.Array) -> pa.Array:
    """The article of a page: the segment of its blocks in which text most outweighs links and chrome."""
    return _each(html, lambda h: R.article(M.parse(h)), pa.string())


_SHARE_DDL = "struct<pre: int, post: int, depth: int, step: string, chars: bigint, distinct_words: int, occurrences: int>"
_SHARE = pa.struct([("pre", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()), ("step", pa.string()), ("chars", pa.int64()), ("distinct_words", pa.int32()), ("occurrences", pa.int32())])


@arrow_function(f"struct<article: string, wanted: int, wanted_all: int, elements: array<{_SHARE_DDL}>>")
def article_elements(html: pa.Array) -> pa.Array:
    """The article's text, its different words and all its words, and each element's own part of them."""
    def of(h):
        root = M.parse(h)
        text = R.article(root)
        words = R.words_of(text or "")
        return {"article": text, "wanted": len(set(words)), "wanted_all": len(words), "elements": [dict(zip(R.ELEMENT, r)) for r in R.element_shares(root, text)] if text else []}

    return _each(html, of, pa.struct([("article", pa.string()), ("wanted", pa.int32()), ("wanted_all", pa.int32()), ("elements", pa.list_(_SHARE))]))


@arrow_function("array<array<string>>")
def table_grid(rows: pa.Array) -> pa.Array:
    return _each(rows, M.grid, pa.list_(pa.list_(pa.string())))


@arrow_function("string")
def math(markup: pa.Array) -> pa.Array:
    """Text of the first formula: its TeX annotation, its alttext, or its characters."""
    def of(h):
        node = next((n for n in M.parse(h).walk() if n.tag == "math"), None)
        return None if node is None else M.math_text(node)

    return _each(markup, of, pa.string())


@arrow_function("array<string>")
def byline_names(text: pa.Array) -> pa.Array:
    return _each(text, D.byline_names, pa.list_(pa.string()))


def block_rows(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per block: (id, pos, block fields)."""
    return pages.select(id, F.posexplode(blocks(F.col(html))).alias("pos", "block")).select(id, "pos", "block.*")


def terminated(html: Column) -> Column:
    """Markup whose character references all end in a semicolon: any other `&` stands for itself, where the HTML reader would take `&amp` and its like for references too."""
    return F.regexp_replace(html, r"&(?!(?:[A-Za-z][A-Za-z0-9]{0,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});)", "&amp;")


# Native forms where a pattern says the same.
def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def link_rows(pages: DataFrame, id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Every a[href] with its absolute address, by pattern: (id, pos, href, url)."""
    found = pages.select(id, url, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    origin = F.regexp_extract(F.col(url), r"^(https?://[^/]*)", 1)
    base = F.regexp_extract(F.col(url), r"^(.*/)", 1)
    absolute = F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("href")).when(F.startswith("href", F.lit("/")), F.concat(origin, "href")).otherwise(F.concat(base, "href"))
    return found.select(id, "pos", "href", absolute.alias("url"))


def plain_text(html: Column) -> Column:
    """Tags, comments, scripts and styles away, entities of the common kind resolved, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n\f]+", " "))
