"""Records of bundles and reports: chunks of media, walkthrough texts, places, counts, gates and schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivane.functions.text import citation_time

# Fields of a step's picture in order; lesson types that open, and the one that never does.
PICTURES = ("screenshot", "thumbnail", "gif")
OPENABLE, NEVER = ("article",), "assessment"


def media_records(media: DataFrame, start: int, id: str = "conv_id") -> DataFrame:
    """A transcript record or a gap record for each medium, with ids that go on from start within each page."""
    n = F.row_number().over(Window.partitionBy(id).orderBy("at", "text"))
    text = F.when(F.col("transcribed"), F.col("text")).otherwise("No transcript")
    return media.select(id, F.format_string("ch_%06d", n + start).alias("chunk_id"), F.when(F.col("transcribed"), "transcript").otherwise("gap").alias("kind"), text.alias("text"))


def walkthrough(steps: DataFrame, key: str) -> DataFrame:
    """(key, markdown, transcript, steps as JSON) of rows (key, n, start, title, said)."""
    whole = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "start", "title", "said"))).alias("s"))
    section = lambda x, i: F.concat(F.lit("## "), (i + 1).cast("string"), F.lit(". "), x.title, F.lit(" ("), citation_time(x.start), F.lit(")\n\n"), x.said)
    line = lambda x: F.concat(F.lit("["), citation_time(x.start), F.lit("] "), x.said)
    payload = F.to_json(F.transform("s", lambda x, i: F.struct((i + 1).alias("step"), x.start.alias("start"), x.title.alias("title"), x.said.alias("instruction"))))
    return whole.select(key, F.concat(F.lit("# Walkthrough\n\n"), F.array_join(F.transform("s", section), "\n\n")).alias("markdown"), F.array_join(F.transform("s", line), "\n").alias("transcript"), payload.alias("steps"))


def screenshot(*fields: Column) -> Column:
    """struct<url, kind>: the first picture field that says something."""
    out = F.struct(F.lit("").alias("url"), F.lit("").alias("kind"))
    for name, f in reversed(list(zip(PICTURES, fields))):
        out = F.when(F.coalesce(f, F.lit("")) != "", F.struct(f.alias("url"), F.lit(name).alias("kind"))).otherwise(out)
    return out


def asset_urls(steps: DataFrame, key: str, clips: bool) -> DataFrame:
    """(key, kind, url) per step of rows (key, picture, clip)."""
    kinds = F.array(F.struct(F.lit("picture").alias("kind"), F.col("picture").alias("url")), F.struct(F.lit("clip").alias("kind"), F.when(F.lit(clips), F.col("clip")).alias("url")))
    return steps.select(key, F.explode(kinds).alias("a")).select(key, "a.*").where("url <> ''")


def _words(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")


def ordinal_slug(text: Column, ordinal: Column) -> Column:
    """NN-words-of-the-title: two digits at least; the number alone where the title has no word."""
    return F.concat_ws("-", F.format_string("%02d", ordinal), F.nullif(F.trim(_words(text), F.lit("-")), F.lit("")))


def module_directory(root: str, trail: Column) -> Column:
    return F.concat(F.lit(root + "/"), F.array_join(F.transform(trail, _words), "/"))


def openable(kind: Column, also: tuple[str, ...] = ()) -> Column:
    if NEVER in also:
        raise ValueError(f"{NEVER} is never opened")
    return kind.isin(*OPENABLE, *also)


def report(documents: DataFrame, key: str) -> DataFrame:
    """Counts and gates by key; what was not measured stays null and is never 0."""
    measured = F.bool_and("measured")
    return documents.groupBy(key).agg(
        F.count(F.lit(1)).alias("documents"), F.when(measured, F.count_if(F.col("n_chars") > 1000)).alias("long_ones"), F.when(measured, F.sum("n_chars")).alias("characters"),
        F.bool_and(F.col("n_chars") > 0).alias("all_text"), F.bool_and(F.col("doc_id") >= 0).alias("ids_ok"),
    )


def chunk_traceability(chunks: DataFrame) -> DataFrame:
    """Share of chunks (refs, known) all of whose references are known; without chunks 0."""
    good = F.size(F.array_except("refs", "known")) == 0
    return chunks.agg(F.when(F.count(F.lit(1)) == 0, 0.0).otherwise(F.count_if(good) / F.count(F.lit(1))).alias("score"))


def judged(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(metric, passed) of rows (metric, score)."""
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair]), F.col("metric"))
    return metrics.select("metric", (F.col("score") >= limit).alias("passed"))


def definitions(wanted: DataFrame, have: DataFrame, texts: DataFrame, id: str) -> DataFrame:
    """How each wanted definition is held: as a record, by both texts, or not."""
    exact = have.select(id, "term", "definition", F.lit(True).alias("_exact"))
    rows = wanted.join(exact, [id, "term", "definition"], "left").join(texts, id, "left")
    loose = F.contains("text", F.col("term")) & F.contains("text", F.col("definition"))
    return rows.withColumn("held", F.when(F.col("_exact"), "record").when(loose, "texts").otherwise("missing")).drop("_exact", "text")


def damaged(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files (path, stated) that are missing or have another digest."""
    real = files.select("path", F.sha2("content", 256).alias("_real"))
    return listed.join(real, "path", "left").where(~F.col("stated").eqNullSafe(F.col("_real"))).drop("_real")


def sparse_json(record: Column) -> Column:
    """JSON in which absent fields are left out."""
    return F.to_json(record, {"ignoreNullFields": "true"})


def provenance(manifest: DataFrame) -> DataFrame:
    return manifest.select("page_id", F.to_json(F.struct("page_id", "url", "sha256")).alias("provenance"))


def tool_versions() -> Column:
    import sys

    import pyarrow
    import pyspark

    found = {"python": ".".join(map(str, sys.version_info[:3])), "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "browser": None}
    return F.create_map(*[F.lit(x).cast("string") for pair in found.items() for x in pair])


def schemas(spark: SparkSession) -> DataFrame:
    """The record contracts as JSON: (name, fields, schema)."""
    from pyspark.sql.types import StructType

    from scrivane.operators.pages import BLOCK_DDL

    ddl = {
        "block": BLOCK_DDL.removeprefix("struct<")[:-1],
        "chunk": "id string, text string, meta struct<doc_items: array<string>, headings: array<string>, kind: string, locator: string, sha256: string>",
        "manifest": "page_id bigint, url string, metadata struct<title: string, author: string, date: string, site: string>, chunks bigint, sha256 string, untrusted boolean",
    }
    rows = [(n, len(s.fields), json.dumps(s.jsonValue())) for n, t in ddl.items() for s in [StructType.fromDDL(t)]]
    return spark.createDataFrame(rows, "name string, fields int, schema string")


def figure_seed(caption: Column, alt: Column, title: Column, reading: Column) -> Column:
    """Text of a figure's chunk: the distinct things said about it."""
    from scrivane.operators.chunks import visual_text

    return visual_text(caption, alt, title, reading)


def step_records(steps: DataFrame, key: str, start: int = 0) -> DataFrame:
    """One chunk per step of rows (key, n, start, duration, title, said) with where it comes from."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("n"))
    where = F.struct(F.col("n").cast("int").alias("step"), F.col("start").alias("start"), (F.col("start") + F.col("duration")).alias("end"), citation_time(F.col("start")).alias("at"))
    return steps.select(key, F.format_string("ch_%06d", n + start).alias("chunk_id"), F.concat_ws("\n", "title", "said").alias("text"), where.alias("video"))


def legacy_bundle(pages: DataFrame, blocks: DataFrame, links: DataFrame, id: str = "page_id") -> DataFrame:
    """(id, bundle): one JSON record of a page's source, blocks and links, in order."""
    b = blocks.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("id", "type", "text").alias("b")))), lambda x: x.b).alias("blocks"))
    k = links.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("url").alias("k")))), lambda x: x.k).alias("links"))
    joined = pages.join(b, id, "left").join(k, id, "left")
    return joined.select(id, F.to_json(F.struct(F.lit("1.0").alias("version"), F.col("url").alias("source"), "blocks", "links"), {"ignoreNullFields": "true"}).alias("bundle"))


def doctags(blocks: DataFrame, id: str = "page_id") -> DataFrame:
    """(id, doctags): blocks as tagged text in order."""
    from scrivane.functions.text import escape_html

    tag = F.when(F.col("type") == "heading", F.concat(F.lit("section_header_level_"), F.col("level").cast("string"))).when(F.col("type") == "paragraph", "text").otherwise(F.col("type"))
    line = F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.col("text")), F.lit("</"), tag, F.lit(">"))
    return blocks.groupBy(id).agg(F.concat(F.lit("<doctag>\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x.l), "\n"), F.lit("\n</doctag>")).alias("doctags"))


def track_vtt(cues: DataFrame, tracks: DataFrame, key: str) -> DataFrame:
    """(key, vtt): notes on a track (title, source, truncated), then its cues (start, end, text)."""
    from scrivane.operators.media import vtt

    note = F.concat(F.lit("NOTE "), F.col("title"), F.lit("\n"), F.col("source"), F.when(F.col("truncated"), "\nPARTIAL: the track was cut").otherwise(""))
    return vtt(cues, key).join(tracks, key).select(key, F.concat(F.lit("WEBVTT\n\n"), note, F.lit("\n\n"), F.substring("vtt", F.lit(9), F.length("vtt"))).alias("vtt"))


def undocumented_media(found: DataFrame, documented: DataFrame, id: str = "page_id") -> DataFrame:
    """Media whose address no walkthrough documents."""
    return found.join(documented.select(id, "src"), [id, "src"], "left_anti")


def line_breaks(text: Column, lines: bool) -> Column:
    """A break is a newline where the surface has lines, else a space; lone breaks at the ends say nothing."""
    bare = F.regexp_replace(text, r"(?i)^(\s*<br\s*/?>)+|(<br\s*/?>\s*)+$", "")
    return F.regexp_replace(bare, r"(?i)[ \t]*<br\s*/?>[ \t]*", "\n" if lines else " ")


def appendix_html(steps: DataFrame, key: str) -> DataFrame:
    """(key, html): a heading and a paragraph for each step, escaped, in order."""
    from scrivane.functions.text import escape_html

    part = F.concat(F.lit("<h2>"), escape_html(F.col("title")), F.lit("</h2><p>"), escape_html(F.col("said")), F.lit("</p>"))
    return steps.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))), lambda x: x.p), "").alias("html"))


def readme_text(title: Column, source: Column, files: Column) -> Column:
    """What a print carries, for those who open it: files array<struct<path, description>>."""
    listed = F.array_join(F.transform(files, lambda f: F.concat(F.lit("- "), f["path"], F.lit(": "), f["description"])), "\n")
    return F.concat(title, F.lit("\n"), source, F.lit("\n\nAttached files:\n"), listed)


def without_secrets(settings: Column, secret: tuple[str, ...] = ("password", "token", "profile", "storage_state")) -> Column:
    """Settings of a run less what must not be written down."""
    return F.map_filter(settings, lambda k, _: ~F.exists(F.split(k, r"\."), lambda part: part.isin(*secret)))
