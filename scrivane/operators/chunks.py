"""Chunk records: retrieval units with ids, checksums and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivane.functions import packing as K


def legacy_records(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, chunk_id, text, sha256) of plain texts."""
    rows = documents.select(id, F.posexplode(K.legacy_chunks(F.col(text))).alias("n", "chunk"))
    return rows.select(id, F.format_string("chunk-%05d", F.col("n") + 1).alias("chunk_id"), F.col("chunk").alias("text"), F.sha2("chunk", 256).alias("sha256"))


def section_seeds(blocks: DataFrame, id: str = "page_id") -> DataFrame:
    """Body blocks gathered under their heading path: (id, pos, headings, body, refs); a heading without body has an empty one."""
    from scrivane.operators.sections import with_heading_paths
    from scrivane.operators.structure import block_markdown

    body = blocks.where("not chrome").withColumn("heading_text", F.col("text")).withColumn("rendered", block_markdown())
    paths = with_heading_paths(body.select(id, "pos", F.when(F.col("type") == "heading", F.col("level")).alias("level"), "text", "type", "id", "rendered"), id)
    section = F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(Window.partitionBy(id).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    ordered = F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("pos", "rendered", "id"))))
    return paths.withColumn("section", section).groupBy(id, "section").agg(
        F.min("pos").alias("pos"), F.min_by("path", "pos").alias("headings"), ordered.alias("parts"), F.min_by("id", "pos").alias("first_ref"),
    ).select(id, "pos", "headings", F.array_join(F.transform("parts", lambda p: p.rendered), "\n\n").alias("body"), F.when(F.size("parts") > 0, F.transform("parts", lambda p: p["id"])).otherwise(F.array("first_ref")).alias("refs"))


def contextual_records(seeds: DataFrame, id: str = "page_id", kind: str = "text") -> DataFrame:
    """Chunks of seeds (id, pos, headings, body, refs): the heading path, then a part; numbered over the whole document."""
    parts = seeds.select(id, "pos", "headings", "refs", F.posexplode(F.when(F.col("body") == "", F.array(F.lit(""))).otherwise(K.split_parts(F.col("body")))).alias("part", "body"))
    context = F.array_join("headings", "\n")
    text = F.when(F.size("headings") == 0, F.col("body")).when(F.col("body") == "", context).otherwise(F.concat(context, F.lit("\n"), F.col("body")))
    numbered = parts.withColumn("text", text).where("text <> ''").withColumn("n", F.row_number().over(Window.partitionBy(id).orderBy("pos", "part")))
    return numbered.select(id, F.format_string("ch_%06d", "n").alias("chunk_id"), "text", F.struct(F.col("refs").alias("doc_items"), "headings", F.lit(kind).alias("kind"), F.get("refs", 0).alias("locator"), F.sha2("text", 256).alias("sha256")).alias("meta"))


def viewer_records(pages: DataFrame, id: str = "doc_id", page: str = "page", text: str = "text", reading: str = "primary") -> DataFrame:
    name = "" if reading == "primary" else "alternate-"
    rows = pages.select(id, page, F.posexplode(K.viewer_chunks(F.col(text))).alias("n", "text"))
    return rows.select(id, page, F.format_string(f"page-%03d-{name}chunk-%03d", page, F.col("n") + 1).alias("chunk_id"), "text")


def visual_text(*parts: Column) -> Column:
    """Distinct non-empty parts joined by blank lines."""
    return F.array_join(F.array_distinct(F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda x: x != "")), "\n\n")


def transcript_records(cues: DataFrame, id: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Groups of whole cues: (id, part, parts, first, last, text)."""
    whole = cues.groupBy(id).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("cues"))
    groups = K.cue_groups(F.transform("cues", lambda c: F.length(c.text)))
    rows = whole.select(id, F.posexplode(F.arrays_zip("cues", groups.alias("part"))).alias("n", "x")).select(id, "n", "x.cues", "x.part")
    parts = rows.groupBy(id, "part").agg(
        F.min("cues.at").alias("first"), F.max("cues.at").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "cues"))), lambda s: s.cues.text), "\n").alias("text"),
    )
    return parts.select(id, (F.col("part") + 1).alias("part"), (F.max("part").over(Window.partitionBy(id)) + 1).alias("parts"), "first", "last", "text")


def gap_records(media: DataFrame, transcripts: DataFrame, id: str) -> DataFrame:
    """One record for each medium that has no transcript."""
    return media.join(transcripts.select(id).distinct(), id, "left_anti").withColumn("text", F.concat(F.lit("No transcript: "), F.coalesce("title", F.lit(""))))


def appended(records: DataFrame, more: DataFrame, start: int, order: str) -> DataFrame:
    """More records with ids that go on from start."""
    from scrivane.operators.numbering import numbered

    rows = numbered(more, [order], "_number").withColumn("chunk_id", F.format_string("ch_%06d", F.col("_number") + start + 1)).drop("_number")
    return records.unionByName(rows, allowMissingColumns=True)


def stamped(chunks: DataFrame, outline: DataFrame, on: str = "node_id") -> DataFrame:
    """Chunks with their place in an outline."""
    return chunks.join(outline.select(on, F.struct(*[c for c in outline.columns if c != on]).alias("journey")), on, "left")
