"""Archive members: guards, tallies and an XML guard, as aggregates and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES, MAX_MEMBERS, MAX_DEPTH = 100 << 20, 20_000, 3


def escapes_root(member: Column) -> Column:
    """Absolute, on a drive, or with a parent segment."""
    return member.rlike(r"^([/\\]|[A-Za-z]:)") | F.array_contains(F.split(member, r"[/\\]"), "..")


def guard(members: DataFrame, max_bytes: int = MAX_BYTES, max_members: int = MAX_MEMBERS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per archive of rows (archive, member, size, depth): totals and whether it is refused."""
    totals = members.groupBy("archive").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("members"), F.max("depth").cast("bigint").alias("depth"), F.bool_or(escapes_root(F.col("member"))).alias("escapes"))
    return totals.withColumn("refused", (F.col("bytes") > max_bytes) | (F.col("members") > max_members) | (F.col("depth") > max_depth) | F.col("escapes"))


def left_out(skipped: DataFrame, named: int = 3) -> DataFrame:
    """Skipped members by reason: the first names and how many more; only the least names are held."""
    from pyspark.sql import Window

    ranked = skipped.withColumn("n", F.row_number().over(Window.partitionBy("reason").orderBy("name")))
    return ranked.groupBy("reason").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= named, F.struct("n", "name")))), lambda s: s["name"]), ", ").alias("first"),
        F.greatest(F.count(F.lit(1)) - named, F.lit(0)).alias("more"),
    )


def xml_refused(text: Column) -> Column:
    """Entity declarations and external references; malformed XML passes."""
    return text.rlike(r"(?is)<!ENTITY|<!DOCTYPE[^>\[]*\b(SYSTEM|PUBLIC)\b")
