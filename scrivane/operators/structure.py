"""Block rows to records, Markdown and regions; native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivane.functions.text import fence

# Fixed values of the content rules.
COVERAGE, LEAST_WORDS, LEAST_TEXT, LEAST_CHARACTERS = 0.9, 20, 300, 200


def pipe_table(rows: Column) -> Column:
    """GFM table of text cells: ragged rows padded, pipes escaped, a rule after the first row."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))), "\n")


def csv_table(rows: Column) -> Column:
    """CSV lines of text cells, quoted where needed."""
    cell = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, cell), ",")), "\n")


def block_markdown() -> Column:
    """Markdown of a block row (columns as block_rows has them)."""
    t = F.col("type")
    quote = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
    numbered = F.array_join(F.transform("items", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    dashed = F.array_join(F.transform("items", lambda x: F.concat(F.lit("- "), x)), "\n")
    code = F.regexp_replace(fence(F.col("text")), r"^(`+)", F.concat(F.lit("$1"), F.coalesce("language", F.lit(""))))
    terms = F.array_join(F.transform("terms", lambda x: F.concat(x.term, F.lit("\n: "), x.definition)), "\n\n")
    return (
        F.when(t == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text")))
        .when(t == "list", F.when(F.col("name") == "ol", numbered).otherwise(dashed)).when(t == "quote", quote).when(t == "code", code)
        .when(t == "table", pipe_table(F.transform("rows", lambda r: F.transform(r, lambda c: c.text)))).when(t == "definitions", terms)
        .when(t == "figure", F.concat(F.lit("!["), F.coalesce("name", F.lit("")), F.lit("]("), F.coalesce("src", F.lit("")), F.lit(")"), F.when(F.col("text") != "", F.concat(F.lit("\n\n"), F.col("text"))).otherwise("")))
        .when(t == "form_field", F.concat(F.lit("- "), F.col("text"))).when(t == "media", F.concat(F.lit("["), F.col("name"), F.lit("]("), F.col("src"), F.lit(")"))).otherwise(F.col("text"))
    )


def form_fields(blocks: DataFrame) -> DataFrame:
    return blocks.where("type = 'form_field'")


def embedded_media(blocks: DataFrame) -> DataFrame:
    """One row per track of a media block; media without tracks have one with a null track."""
    return blocks.where("type = 'media'").withColumn("track", F.explode_outer("tracks"))


def capped_visuals(pages: DataFrame, id: str = "page_id", html: str = "html", most: int = 200) -> DataFrame:
    """The first visuals of each page, with their number and how many were left out."""
    from scrivane.operators.pages import visuals

    found = pages.select(id, visuals(F.col(html)).alias("v"))
    dropped = F.greatest(F.size("v") - most, F.lit(0)).alias("dropped")
    return found.select(id, dropped, F.posexplode(F.slice("v", 1, most)).alias("n", "v")).select(id, (F.col("n") + 1).alias("n"), "v.*", "dropped")


def best_region(regions: DataFrame, id: str = "page_id") -> DataFrame:
    """Of rows (id, selector, ord, text, link): text less link text, long enough, the first of the best."""
    scored = regions.where(F.col("text") >= LEAST_TEXT).withColumn("score", F.col("text") - F.least(0.35 * F.col("link"), 0.5 * F.col("text")))
    best = scored.groupBy(id).agg(F.max_by(F.struct("selector", "score"), F.struct(F.col("score"), (-F.col("ord")).alias("o"))).alias("b"))
    return best.select(id, "b.selector", "b.score")


def element_coverage(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, pre, post, depth, step, wanted, wanted_all, chars, held, occurrences): what each element of a page holds of the page's article.

    The DOM stands as rows with pre- and post-order intervals, each with its own part of
    the sums; an element's sums are the running sums at its interval's end less those
    before its start.
    """
    from scrivane.operators.pages import article_elements

    rows = pages.select(id, article_elements(F.col(html)).alias("a")).select(id, "a.wanted", "a.wanted_all", F.explode("a.elements").alias("e")).select(id, "wanted", "wanted_all", "e.*")
    upto = Window.partitionBy(id).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)  # a page's elements
    sums = ("chars", "distinct_words", "occurrences")
    run = rows.withColumns({f"{c}_upto": F.sum(c).over(upto) for c in sums})
    ends = run.select(id, F.col("pre").alias("post"), *(F.col(f"{c}_upto").alias(f"{c}_end") for c in sums))
    held = {c: F.col(f"{c}_end") - F.col(f"{c}_upto") + F.col(c) for c in sums}
    return run.join(ends, [id, "post"]).select(id, "pre", "post", "depth", "step", "wanted", "wanted_all", held["chars"].alias("chars"), held["distinct_words"].alias("held"), held["occurrences"].alias("occurrences"))


def covering_element(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, locator, chars, held, wanted, occurrences, wanted_all): the smallest element that holds the article, of equal ones the deepest.

    It holds COVERAGE of the article's different words, and COVERAGE of all its words,
    none counted oftener than the article has it. Pages without an article of LEAST_WORDS
    different words, or without such an element, have no row.
    """
    found = element_coverage(pages, id, html)
    need = F.ceil(F.lit(COVERAGE) * F.col("wanted"))
    fit = found.where((F.col("wanted") >= LEAST_WORDS) & (F.col("chars") >= F.greatest(F.lit(LEAST_CHARACTERS), 2 * need - 1)) & (F.col("held") >= COVERAGE * F.col("wanted")) & (F.col("occurrences") >= COVERAGE * F.col("wanted_all")))
    best = fit.groupBy(id).agg(F.max_by(F.struct("pre", "chars", "held", "wanted", "occurrences", "wanted_all"), F.struct(-F.col("chars"), "pre")).alias("b")).select(id, "b.*")
    # Its ancestors' steps, by the intervals; from the last id on, as a locator needs no more.
    above = found.select(id, F.col("pre").alias("p"), "post", "step").join(best, id).where((F.col("p") <= F.col("pre")) & (F.col("post") >= F.col("pre")))
    steps = above.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "step"))), lambda x: x.step).alias("steps"))
    last = F.greatest(F.lit(1), F.size("steps") - F.array_position(F.reverse(F.transform("steps", lambda s: F.startswith(s, F.lit("#")))), True).cast("int") + 1)
    used = F.when(F.exists("steps", lambda s: F.startswith(s, F.lit("#"))), F.slice("steps", last, F.size("steps"))).otherwise(F.filter("steps", lambda s: s != "html"))
    return best.join(steps, id).select(id, F.array_join(used, " > ").alias("locator"), "chars", "held", "wanted", "occurrences", "wanted_all")


def selection(explicit: Column, article: Column, static: Column) -> Column:
    """struct<strategy, root>: the first way that found a root."""
    way = lambda name, c: F.when(c.isNotNull(), F.struct(F.lit(name).alias("strategy"), c.alias("root")))
    return F.coalesce(way("explicit", explicit), way("article", article), way("static", static), F.struct(F.lit("full-page").alias("strategy"), F.lit(None).cast("string").alias("root")))


def zipped(a: Column, b: Column) -> Column:
    """Two document-order lists together if they are as long; else null."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a, b))


def cells_over(tables: DataFrame, limit: int, id: str = "page_id") -> DataFrame:
    """Pages whose tables have more grid places than the limit, of rows (id, n_rows, n_cols)."""
    return tables.groupBy(id).agg(F.sum(F.col("n_rows") * F.col("n_cols")).alias("cells")).where(F.col("cells") > limit)


def renumbered(items: DataFrame, refs: DataFrame, id: str = "page_id") -> DataFrame:
    """Items less the refs, with numbers made gapless again."""
    kept = items.join(refs, [id, "ref"], "left_anti")
    return kept.withColumn("number", F.row_number().over(Window.partitionBy(id).orderBy("ref")) - 1)


def ocr_marker(text: Column, asset: Column, engine: Column, confidence: Column) -> Column:
    return F.concat(F.format_string("[reading of %s by %s, %s%%]\n", asset, engine, F.coalesce(F.round(confidence).cast("int").cast("string"), F.lit("?"))), text, F.lit("\n[end of reading]"))
