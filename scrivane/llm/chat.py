"""Relational chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted by turn (ties by role and
text), adjacent turns of one role are merged into a block by array aggregation, and
the blocks are concatenated:

    <s>[ROLE]user[/ROLE]text[NEXT]text</s>...

[NEXT] parts the turns of a block. Inside roles and texts every `<` and `[` gets a
`~` after it, so no control string can stand there, and taking the `~` away gives the
text back. The loss mask is the spans of assistant texts in the formatted string.

Nulls and the like: a null role or text is an empty one, a null turn sorts first;
rows that repeat are turns of their own; rows with a null conv_id are one
conversation; a very long one, being the unit of the result, is put together in one
row of at most 2 GB; an empty table gives none; other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template.
OPEN, ROLE_END, NEXT, CLOSE = "<s>[ROLE]", "[/ROLE]", "[NEXT]", "</s>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<"), F.lit("<~")), F.lit("["), F.lit("[~"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("[~"), F.lit("[")), F.lit("<~"), F.lit("<"))


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, loss array<struct<start, length>>): start counts code points from 0."""
    said = turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("turn"), escaped(F.col(role).cast("string")).alias("role"), escaped(F.col(text)).alias("text"))
    order = Window.partitionBy("_conv").orderBy("turn", "role", "text")
    opens = F.lag("role").over(order).eqNullSafe(F.col("role")) == F.lit(False)
    closes = F.lead("role").over(order).eqNullSafe(F.col("role")) == F.lit(False)
    placed = said.select(
        "*", F.row_number().over(order).alias("n"), F.length("text").alias("length"),
        F.when(opens, F.lit(len(OPEN) + len(ROLE_END)) + F.length("role")).otherwise(F.lit(len(NEXT))).alias("before"),
        F.when(closes, F.lit(len(CLOSE))).otherwise(F.lit(0)).alias("after"),
    )
    so_far = F.sum((F.col("before") + F.col("length") + F.col("after")).cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    started = placed.withColumn("start", so_far - F.col("after") - F.col("length"))
    # A conversation is the unit of the result, so its turns have to meet; window and group share one shuffle.
    sorted_ = started.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text", "start", F.col("length").cast("bigint").alias("length")))).alias("turns"))
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i).role != F.get("turns", F.greatest(i - 1, F.lit(0))).role))
    with_starts = sorted_.withColumn("starts", starts)
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(F.get("turns", s).role.alias("role"), F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s), lambda t: t.text).alias("texts")),
    )
    merged = with_starts.withColumn("blocks", blocks)
    texts = F.transform("blocks", lambda b: F.concat(F.lit(OPEN), b.role, F.lit(ROLE_END), F.array_join(b.texts, NEXT), F.lit(CLOSE)))
    loss = F.transform(F.filter("turns", lambda t: t.role == F.lit(TRAINED)), lambda t: F.struct(t.start.alias("start"), t.length.alias("length")))
    return merged.select(F.col("_conv").alias(conv), F.array_join(texts, "").alias("formatted"), loss.alias("loss"))


def read_back(done: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turns array<struct<role, text>>, loss_text, formatted_chars) from the formatted strings and masks alone."""
    blocks = F.filter(F.split("formatted", r"<s>\[ROLE\]"), lambda b: b != "")
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.regexp_replace(F.element_at(F.split(b, r"\[/ROLE\]"), 2), "</s>$", ""), r"\[NEXT\]"),
        lambda x: F.struct(unescaped(F.element_at(F.split(b, r"\[/ROLE\]"), 1)).alias("role"), unescaped(x).alias("text")),
    )))
    loss = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")))), "")
    return done.select(conv, turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation: counts and digests of what is read back."""
    back = read_back(formatted(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )
