"""Page rules on the tree (noise, consent, walls, collapsed text, headings), and small native rules of capture, print and access."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivane.functions import commonmark, declared, selectors
from scrivane.functions import markup as M
from scrivane.functions.arrow import arrow_function

# Fixed values of the rules.
LIGATURES = "\ufb00-\ufb06"
TABLE_BUDGET, PIECE_BUDGET, CELL_COST, PIECE_ROWS = 512 << 20, 32 << 20, 64, 1000
PRINT_PPI, POINTS = 300, 72
ADMINS = ("S-1-5-18", "S-1-5-32-544")


def _each(values: pa.Array, function, kind: pa.DataType) -> pa.Array:
    return pa.array([None if v is None else function(v) for v in values.to_pylist()], kind)


@arrow_function("struct<text: string, removed: int>")
def cleaned(html: pa.Array) -> pa.Array:
    return _each(html, lambda h: dict(zip(("text", "removed"), selectors.clean_text(h))), pa.struct([("text", pa.string()), ("removed", pa.int32())]))


@arrow_function("array<string>")
def consent_managers(html: pa.Array) -> pa.Array:
    return _each(html, lambda h: selectors.vendors(M.parse(h), selectors.CONSENT), pa.list_(pa.string()))


@arrow_function("array<string>")
def robot_checks(html: pa.Array) -> pa.Array:
    return _each(html, lambda h: selectors.vendors(root := M.parse(h), selectors.ROBOT_CHECKS) + selectors.refusals(root), pa.list_(pa.string()))


@arrow_function("array<string>")
def access_walls(html: pa.Array) -> pa.Array:
    return _each(html, lambda h: selectors.vendors(M.parse(h), selectors.WALLS), pa.list_(pa.string()))


@arrow_function("array<struct<selector: string, text: int, link: int, ord: int>>")
def content_candidates(html: pa.Array) -> pa.Array:
    def of(h):
        root, out = M.parse(h), []
        for i, s in enumerate(selectors.CONTENT):
            for n in selectors.select(root, s):
                out.append({"selector": s, "text": len(M.text_of(n)), "link": sum(len(M.text_of(a)) for a in n.walk() if a.tag == "a"), "ord": len(out) + 1000 * i})
        return out

    return _each(html, of, pa.list_(pa.struct([("selector", pa.string()), ("text", pa.int32()), ("link", pa.int32()), ("ord", pa.int32())])))


@arrow_function("string")
def isolated_text(html: pa.Array, selector: pa.Array) -> pa.Array:
    """Text of the first match; null if nothing matches."""
    def of(h, s):
        try:
            return M.text_of(selectors.isolate(M.parse(h), s), lines=True)
        except LookupError:
            return None

    return pa.array([None if h is None else of(h, s) for h, s in zip(html.to_pylist(), selector.to_pylist())], pa.string())


@arrow_function("array<struct<name: string, text: string>>")
def collapsed(html: pa.Array) -> pa.Array:
    return _each(html, lambda h: selectors.collapsed_regions(M.parse(h)), pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())])))


@arrow_function("array<string>")
def css_imports(css: pa.Array) -> pa.Array:
    return _each(css, selectors.css_imports, pa.list_(pa.string()))


@arrow_function("array<string>")
def json_ld(html: pa.Array) -> pa.Array:
    """Every ld+json block as it parses, else with its error and its raw text."""
    import json

    def of(h):
        out = []
        for n in M.parse(h).walk():
            if n.tag == "script" and n.attrs.get("type", "").split(";")[0].strip().lower() == "application/ld+json":
                raw = M.raw_text(n)
                try:
                    out.append(json.dumps(json.loads(raw, strict=False), ensure_ascii=False))
                except ValueError as e:
                    out.append(json.dumps({"parseError": str(e).split(":")[0], "raw": raw}, ensure_ascii=False))
        return out

    return _each(html, of, pa.list_(pa.string()))


@arrow_function("boolean")
def holds(haystack: pa.Array, needle: pa.Array) -> pa.Array:
    return pa.array([None if a is None or b is None else selectors.words_in_order(a, b) for a, b in zip(haystack.to_pylist(), needle.to_pylist())], pa.bool_())


@arrow_function("string")
def markdown_html(text: pa.Array) -> pa.Array:
    return _each(text, lambda t: M.sanitise(M.parse(commonmark.render(t))).replace("<th>", '<th scope="col">'), pa.string())


@arrow_function("string")
def markdown_document(text: pa.Array, fallback: pa.Array, label: pa.Array) -> pa.Array:
    return pa.array([None if t is None else commonmark.document(t, f or "", k or "") for t, f, k in zip(text.to_pylist(), fallback.to_pylist(), label.to_pylist())], pa.string())


@arrow_function("boolean")
def same_people(one: pa.Array, other: pa.Array) -> pa.Array:
    return pa.array([None if a is None or b is None else declared.same_people(a, b) for a, b in zip(one.to_pylist(), other.to_pylist())], pa.bool_())


def missing_headings(headings: DataFrame, texts: DataFrame, id: str = "page_id") -> DataFrame:
    """(id, heading, state) of rows (id, heading) against (id, printed, bundle), arrays of words: lost (in neither), unprinted, hidden (in print alone); one row per wording."""
    from scrivane.functions.text import tokens

    words = headings.withColumn("words", tokens(F.col("heading"))).groupBy(id, "words").agg(F.min("heading").alias("heading"))
    both = words.join(texts, id).withColumn("p", holds(F.col("printed"), F.col("words"))).withColumn("b", holds(F.col("bundle"), F.col("words")))
    state = F.when(~F.col("p") & ~F.col("b"), "lost").when(~F.col("p"), "unprinted").when(~F.col("b"), "hidden")
    return both.select(id, "heading", state.alias("state")).where("state is not null")


def overprinted(boxes: DataFrame, page: str = "page", cell: float = 24.0) -> DataFrame:
    """Pairs of glyph boxes (id, line, x0, y0, x1, y1) of different lines that overlap: an equi-join on grid cells, each pair taken in the cell of its overlap's corner."""
    spread = boxes.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    a, b = spread.alias("a"), spread.alias("b")
    meet = (F.col("a.id") < F.col("b.id")) & (F.col("a.line") != F.col("b.line")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    corner = (F.col("a.cx") == F.floor(F.greatest("a.x0", "b.x0") / cell)) & (F.col("a.cy") == F.floor(F.greatest("a.y0", "b.y0") / cell))
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (page, "cx", "cy")]
    return a.join(b, [*keys, meet, corner]).select(F.col(f"a.{page}").alias(page), F.col("a.id").alias("first"), F.col("b.id").alias("second"))


def covered(glyphs: DataFrame, painted: DataFrame, page: str = "page", cell: float = 24.0) -> DataFrame:
    """Glyph boxes that a box painted later covers whole, by the grid cell of their corner."""
    g = glyphs.withColumn("cx", F.floor(F.col("x0") / cell)).withColumn("cy", F.floor(F.col("y0") / cell)).alias("g")
    p = painted.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell)))).alias("p")
    over = (F.col("p.ord") > F.col("g.ord")) & (F.col("p.x0") <= F.col("g.x0")) & (F.col("p.x1") >= F.col("g.x1")) & (F.col("p.y0") <= F.col("g.y0")) & (F.col("p.y1") >= F.col("g.y1"))
    return g.join(p, [*[F.col(f"g.{k}") == F.col(f"p.{k}") for k in (page, "cx", "cy")], over], "left_semi").select(page, "id")


def split_plan(tables: DataFrame) -> DataFrame:
    """Rows per piece of tables (id, n_rows, n_cells, n_pages) whose printing costs too much; null where it does not."""
    cost = (F.col("n_rows") + F.col("n_cells")) * F.col("n_pages") * CELL_COST
    per_row = (1 + F.col("n_cells") / F.col("n_rows")) * F.col("n_pages") * CELL_COST
    rows = F.greatest(F.least(F.floor(PIECE_BUDGET / per_row), F.lit(PIECE_ROWS)), F.lit(1))
    return tables.withColumn("piece_rows", F.when(cost > TABLE_BUDGET, rows)).withColumn("pieces", F.when(F.col("piece_rows").isNotNull(), F.ceil(F.col("n_rows") / F.col("piece_rows"))).otherwise(1))


def image_target(pixels: Column, drawn_points: Column) -> Column:
    """Pixels that a picture needs for print; never more than it has."""
    return F.least(pixels, F.ceil(drawn_points / POINTS * PRINT_PPI)).cast("bigint")


def wall_phrase(text: Column, phrases: list[str]) -> Column:
    """struct<phrase, at>: the last wall phrase of a text that has more letters before it than after."""
    letters = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    found = F.array(*[F.struct(F.when(F.contains(F.lower(text), F.lit(p.lower())), F.length(text) - F.locate(p.lower()[::-1], F.reverse(F.lower(text))) - len(p) + 2).alias("at"), F.lit(p).alias("phrase")) for p in phrases])
    fit = F.filter(found, lambda x: x["at"].isNotNull() & (letters(F.substring(text, F.lit(1), (x["at"] - 1).cast("int"))) > letters(F.substring(text, (x["at"] + F.length(x["phrase"])).cast("int"), F.length(text)))))
    best = F.array_max(fit)
    return F.struct(best["phrase"].alias("phrase"), best["at"].cast("bigint").alias("at"))


@arrow_function("string")
def wall_words(text: pa.Array) -> pa.Array:
    """As wall_phrase, with the reference's own list of words."""
    return _each(text, selectors.wall_words, pa.string())


def has_ligatures(text: Column) -> Column:
    return text.rlike(f"[{LIGATURES}]")


def lost_cut(cut: Column, printed: Column, least: int = 16) -> Column:
    """A cut text whose squeezed form of some length the print does not hold."""
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    return (F.length(squeeze(cut)) >= least) & ~F.contains(squeeze(printed), squeeze(cut))


def sign_in_wall(html: Column, asked: Column, landed: Column) -> Column:
    from scrivane.functions.url import crossed_origin

    return html.rlike(r"(?i)<input[^>]*type=[\"']?password") & crossed_origin(asked, landed)


def is_pdf(content: Column) -> Column:
    return F.startswith(F.hex(F.substring(content, F.lit(1), F.lit(5))), F.lit("255044462D"))


def pdfa_flavour(content: Column) -> Column:
    """Part and conformance as the metadata state them, like 2b; null if they do not."""
    text = F.decode(content, "ISO-8859-1")
    part = F.regexp_extract(text, r"pdfaid:part(?:>|=[\"'])\s*(\d)", 1)
    level = F.lower(F.regexp_extract(text, r"pdfaid:conformance(?:>|=[\"'])\s*([A-Za-z])", 1))
    return F.when(part != "", F.concat(part, level))


def back_link(url: Column, marker: str = "https://appendix.invalid/step/") -> Column:
    return F.regexp_extract(url, "^" + marker.replace(".", r"\.") + "([0-9]+)$", 1).try_cast("int")


def acl_exposed(owner: Column, dacl: Column, user: Column) -> Column:
    """Whether others can read: no list at all, a foreign owner, or an allowing entry for somebody else. dacl: array<struct<allow, sid, inherit_only>>."""
    trusted = F.array(user, *map(F.lit, ADMINS))
    foreign = F.exists(dacl, lambda e: e["allow"] & ~e["inherit_only"] & ~F.array_contains(trusted, e["sid"]))
    return F.when(dacl.isNull(), True).otherwise(~F.array_contains(trusted, owner) | foreign)


def payload_files(files: DataFrame, assets: bool) -> DataFrame:
    """Bundle files that go into a print, with what they are."""
    kind = F.when(F.col("path") == "manifest.json", "manifest").when(F.col("path").rlike(r"^content\."), "content").when(F.col("path").rlike(r"chunks\.jsonl$"), "chunks").when(F.startswith("path", F.lit("tables/")), "table").when(F.startswith("path", F.lit("assets/")), "asset")
    return files.withColumn("description", kind).where(F.col("description").isNotNull() & (F.lit(assets) | (F.col("description") != "asset")))


def drawable(src: Column) -> Column:
    """Whether a data URL's picture can be drawn as it stands; TIFF is to be converted."""
    mime = F.lower(F.regexp_extract(src, "^data:([^;,]+)", 1))
    return F.when(mime == "image/tiff", "convert").when(mime.isin("image/png", "image/jpeg", "image/gif", "image/webp", "image/svg+xml", "image/bmp"), "draw").when(mime != "", "refuse").otherwise("link")


def declared_charset(data: Column) -> Column:
    """A label that spares the guess: none for ASCII or bytes with NUL, utf-8-sig with a mark, utf-8 if valid."""
    h = F.hex(data)
    ascii_ = h.rlike("^([0-7][0-9A-F])*$")
    nul = h.rlike("^([0-9A-F]{2})*?00")
    return F.when(ascii_ | nul, None).when(F.startswith(h, F.lit("EFBBBF")), "utf-8-sig").when(F.is_valid_utf8(data.cast("string")), "utf-8")


def in_chrome(text: Column, regions: Column) -> Column:
    """A text that one of the chrome regions holds, both with white space collapsed."""
    from scrivane.functions.text import normalised

    return F.exists(regions, lambda r: F.contains(normalised(r), normalised(text)))


def refiled(items: DataFrame, id: str = "page_id") -> DataFrame:
    """Items before the first heading go back to the body unless they are chrome, of rows (id, pos, type, layer, chrome)."""
    first = F.min(F.when(F.col("type") == "heading", F.col("pos"))).over(Window.partitionBy(id))
    return items.withColumn("layer", F.when((F.col("pos") < F.coalesce(first, F.lit(-1))) & ~F.col("chrome"), "body").otherwise(F.col("layer")))


def captions_missing(wanted: DataFrame, carried: DataFrame) -> DataFrame:
    return wanted.exceptAll(carried)


def outside_chrome(items: Column, flags: Column) -> Column:
    """Items outside chrome where both lists are as long; else all if none is chrome, none if all are, and null if that cannot be told."""
    kept = F.transform(F.filter(F.arrays_zip(items.alias("i"), flags.alias("f")), lambda x: ~x["f"]), lambda x: x["i"])
    empty = F.slice(items, 1, 0)
    return F.when(F.size(items) == F.size(flags), kept).when(F.forall(flags, lambda f: ~f), items).when(F.forall(flags, lambda f: f), empty)


def write_empty_items(markdown: Column) -> Column:
    """An item that holds a list alone stands on the line of its first entry."""
    return F.regexp_replace(markdown, r"(?m)^( *)-[ ]*\n\1    - ", "$1-   - ")


def frame_content(assets: DataFrame, read: DataFrame, id: str = "page_id") -> DataFrame:
    """Frames whose text was read are marked dom, others screenshot."""
    seen = read.select(id, "locator", F.lit(True).alias("_read"))
    return assets.join(seen, [id, "locator"], "left").withColumn("frame_content", F.when(F.col("kind") == "iframe", F.when(F.col("_read"), "dom").otherwise("screenshot"))).drop("_read")


def unread_frames(assets: DataFrame, read: DataFrame, id: str = "page_id") -> DataFrame:
    return assets.where("kind = 'iframe'").join(read, [id, "locator"], "left_anti")


def residue(files: DataFrame, directory: str) -> DataFrame:
    """Files that still name the directory, as a URL or with either slash."""
    names = [f"file://{directory}", directory, directory.replace("/", "\\")]
    hit = F.lit(False)
    for n in names:
        hit = hit | F.contains("text", F.lit(n))
    return files.where(hit)


def redact_paths(message: Column, paths: list[str], mark: str = "[credentials]") -> Column:
    for p in sorted(paths, key=len, reverse=True):
        message = F.replace(F.replace(message, F.lit(p), F.lit(mark)), F.lit(p.replace("/", "\\")), F.lit(mark))
    return message


def watch_note(published: Column, author: Column) -> Column:
    said = F.concat_ws(" ", F.when(F.coalesce(published, F.lit("")) != "", F.concat(F.lit("Published "), published)), F.when(F.coalesce(author, F.lit("")) != "", F.concat(F.lit("by "), author)))
    return F.when(said == "", "").otherwise(F.concat(F.upper(F.substring(said, 1, 1)), F.substring(said, F.lit(2), F.length(said)), F.lit(".")))


def collapsed_warning(found: Column, bundle: Column, named: int = 5) -> Column:
    """Names of collapsed regions whose first eight words the bundle lacks."""
    lacking = F.filter(found, lambda r: ~F.contains(bundle, F.array_join(F.slice(F.split(F.trim(r["text"]), r"\s+"), 1, 8), " ")))
    return F.array_join(F.slice(F.transform(lacking, lambda r: r["name"]), 1, named), ", ")


def check_source(source: Column, roots: list[str], allow_private: bool = False) -> Column:
    """Why a source is refused, or null: scheme, user information, roots for files, and the network rule for literal addresses."""
    from scrivane.functions.url import LOCAL_NAMES, host, is_internal_ipv4, scheme, within_roots

    s, h = scheme(source), host(source)
    path = F.when(s == "file", F.url_decode(F.regexp_extract(source, r"^file://([^?#]*)", 1))).when(s == "", source)
    dots = F.exists(F.split(path, "/"), lambda x: x == "..")
    inside = within_roots(path, F.array(*map(F.lit, roots))) if roots else F.lit(False)
    private = F.lit(not allow_private) & (h.isin(LOCAL_NAMES) | F.endswith(h, F.lit(".localhost")) | F.coalesce(is_internal_ipv4(h), F.lit(False)))
    return (
        F.when(F.trim(source) == "", "empty").when(path.isNotNull(), F.when(dots | ~inside, "outside the roots")).when(~s.isin("http", "https"), "scheme")
        .when(source.rlike(r"^[a-zA-Z]+://[^/?#]*@"), "user information").when(h == "", "no host").when(private, "internal address")
    )
