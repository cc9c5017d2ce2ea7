"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; a source's documents then all have the
same expected copies, target / source size. Within the source, ordered by size and
a seeded hash, the expected copies are prefix-summed from one random offset, and a
document is emitted once for each integer boundary its interval crosses. Ordering
by size keeps the taken words within about one document's words of the target.

Nulls and the like: a null source is a source of its own, after all others; a null or
empty text has size 0, a very long one counts whole; rows that repeat are sampled one by
one; an empty table gives an empty mix; a source of size 0 has target 0 and no copies;
columns of clashing names keep their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivane.llm.common import free_name, numbered_rows, ranked, row_hash, words_of, write_table

#: The weights of the sources in order, repeating; copies of a source at most.
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"


def seeded(seed: str, value: Column) -> Column:
    """A hash text of a value that every engine with MD5 computes alike."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(value.cast("string"), F.lit(""))).cast("binary"))


def source_key(source: Column) -> Column:
    """Sorts by code point, null last; never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, n, source_size, target) from one row per source (key, n, source_size).

    The level L with sum(min(weight * L, most * size)) = total is found by sorting
    sources by most * size / weight: the first ones stand at their limit, and L is
    what is left by weight. The windows run over one row per source.
    """
    every = Window.orderBy("key")
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("bigint"))
    by_limit = Window.orderBy((F.col("source_size") / F.col("w")), "key")
    all_rows = Window.partitionBy(F.lit(0))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - most * F.col("full")) / F.col("left")
    stepped = weighed.select(
        "*", F.sum("source_size").over(all_rows).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full"),
        (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left"),
    ).withColumn("level", level)
    # The level of the first source that stays under its limit; all at the limit cannot be, as most > 1, unless all sizes are 0.
    found = stepped.withColumn("under", F.col("w") * F.col("level") <= most * F.col("source_size")).withColumn(
        "l", F.min(F.when(F.col("under"), F.struct((F.col("source_size") / F.col("w")).alias("a"), F.col("key").alias("b"), F.col("level").alias("level")))).over(all_rows)["level"]
    )
    return found.select("key", "n", "source_size", F.least((most * F.col("source_size")).cast("double"), F.col("w") * F.col("l")).alias("target"))


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """(id, size, source_size, target, copies, taken, and the columns of `keep`) for every row."""
    kept = [f"_keep{i}" for i in range(len(keep or []))]
    rows = docs.select(
        F.col(id).alias("_id"), *(F.col(c).alias(k) for c, k in zip(keep or [], kept)),
        source_key(F.col(source)).alias("key"), F.size(words_of(F.col(text))).cast("bigint").alias("size"), seeded(seed, F.col(id)).alias("_order"),
    )
    rows = write_table(rows, "sizes")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    goal = targets(sizes).select("key", "source_size", "target")
    placed = ranked(rows, ["key"], ["size", "_order", "_id", *kept], "_rank", "_n")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.col("key")).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(u + (F.col("_rank") + 1) * each) - F.floor(u + F.col("_rank") * each)
    out = placed.join(goal, "key").withColumn("copies", copies.cast("bigint"))
    return out.select(F.col("_id").alias(id), *(F.col(k).alias(c) for c, k in zip(keep or [], kept)), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emitted(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """docs with every row as often as the mix takes it, possibly never; all columns as they were.

    Rows are told apart by their places in the files that are read, or by numbers they
    are written with, never by a hash; equal places in the order of sizes and ids fall
    to the hash of all columns first, so that reruns agree but for rows alike in them.
    """
    key, copies, copy, tie = (free_name(docs, n) for n in ("_row_key", "_copies", "_copy", "_tie"))
    keyed = numbered_rows(docs, key)
    taken = mixed(keyed.withColumn(tie, row_hash(docs)), id, text, source, seed, keep=[tie, key])
    counts = write_table(taken.where(F.col("copies") > 0).select(key, F.col("copies").alias(copies)), "copies")
    # A merge join at every size, as counts grow with the rows.
    joined = keyed.join(counts.hint("merge"), key)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(docs.columns)
