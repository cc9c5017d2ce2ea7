"""Headings and sections as windows and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivane.functions.text import normalised


def with_heading_paths(blocks: DataFrame, id: str, pos: str = "pos") -> DataFrame:
    """Adds `path` (texts of the open headings, outermost first) and `nearest` to rows (id, pos, level, text); level is null for bodies.

    A heading of level L closes all of level L and below: the open one of level k is
    the last heading with level k after which none of a higher rank came.
    """
    w = Window.partitionBy(id).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.withColumn("nearest", F.last(F.when(F.col("level").isNotNull(), F.col("text")), ignorenulls=True).over(w))
    for k in range(1, 7):
        out = out.withColumn(f"_p{k}", F.last(F.when(F.col("level") == k, F.col(pos)), ignorenulls=True).over(w)).withColumn(f"_t{k}", F.last(F.when(F.col("level") == k, F.col("text")), ignorenulls=True).over(w))
    open_ = []
    for k in range(1, 7):
        above = [F.coalesce(F.col(f"_p{j}") < F.col(f"_p{k}"), F.lit(True)) for j in range(1, k)]
        cond = F.col(f"_p{k}").isNotNull()
        for a in above:
            cond = cond & a
        open_.append(F.when(cond, F.col(f"_t{k}")))
    return out.withColumn("path", F.filter(F.array(*open_), lambda x: x.isNotNull())).drop(*[f"_{c}{k}" for c in "pt" for k in range(1, 7)])


def headings(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, level, text) of `#` lines outside fences."""
    lines = documents.select(id, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    w = Window.partitionBy(id).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.regexp_extract("line", r"^ {0,3}(```|~~~)", 1)
    state = lines.withColumn("fence", fence).withColumn("open", F.sum(F.when(F.col("fence") != "", 1).otherwise(0)).over(w) % 2)
    found = state.where((F.col("open") == 0) & (F.col("fence") == "") & F.col("line").rlike(r"^#{1,6}\s"))
    return found.select(id, "pos", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), normalised(F.regexp_extract("line", r"^#+\s+(.*?)\s*#*\s*$", 1)).alias("text"))


def section_ends(heads: DataFrame, id: str = "doc_id") -> DataFrame:
    """Each heading with its occurrence and `end`: where the next heading of its level or a higher rank stands, null at the document's end.

    One window per level instead of a self-join: the nearest following heading of each level.
    """
    after = Window.partitionBy(id).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    nth = Window.partitionBy(id, "text").orderBy("pos")
    out = heads
    for k in range(1, 7):
        out = out.withColumn(f"_n{k}", F.first(F.when(F.col("level") == k, F.col("pos")), ignorenulls=True).over(after))
    end = F.least(*[F.when(F.col("level") >= k, F.col(f"_n{k}")) for k in range(1, 7)])
    return out.withColumn("end", end).withColumn("occurrence", F.row_number().over(nth)).drop(*[f"_n{k}" for k in range(1, 7)])


def spliced(lines: DataFrame, sections: DataFrame, inserts: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, text): inserts (id, text of heading, block), the k-th of a heading put at the end of that heading's k-th section, the rest at the document's end."""
    numbered = inserts.withColumn("occurrence", F.row_number().over(Window.partitionBy(id, "text").orderBy("block")))
    placed = numbered.join(sections.select(id, "text", "occurrence", "end", F.lit(True).alias("known")), [id, "text", "occurrence"], "left")
    rows = lines.select(id, F.col("pos").cast("double").alias("at"), F.lit(0).alias("k"), "line").unionByName(
        placed.select(id, F.when(F.col("end").isNotNull(), F.col("end") - 0.5).otherwise(float("inf")).alias("at"), F.col("occurrence").alias("k"), F.col("block").alias("line")))
    return rows.groupBy(id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "k", "line"))), lambda s: s.line), "\n").alias("text"))
