"""Proportional stratified interleaving.

Within each source the rows are ranked in a seeded shuffle; rank r of n stands at the
fraction (2r + 1) / 2n. Sorting all rows by that fraction spreads every source evenly
over the whole, so cutting the order into equal counts gives each shard the mixture.

Nulls and the like: a null source is a source of its own; a null or empty text has size
8 and the checksum of no bytes, a very long one counts whole; rows that repeat are placed
one by one; with fewer rows than shards the last ones stay empty; an empty table gives
an empty one; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm.common import ranked, write_table
from scrivane.llm.mixing import seeded, source_key

SHARDS = 24
SEED = "shards-1"


def interleaved(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(id, size, text_crc32, source_rows, position, shard, slot) for every row; shard counts differ by one at most."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id), source_key(F.col(source)).alias("key"), seeded(seed, F.col(id)).alias("_order"),
        (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    rows = write_table(rows, "sharding")
    inner = ranked(rows, ["key"], ["_order", id, "text_crc32"], "_rank", "source_rows")
    placed = inner.withColumn("_at", (2 * F.col("_rank") + 1) / (2 * F.col("source_rows")))
    whole = ranked(write_table(placed, "fractions"), [], ["_at", "key", "_rank"], "position", "_all")
    # The first (all mod shards) shards hold one row more.
    small, more = F.floor(F.col("_all") / shards), F.col("_all") % shards
    in_larger = F.col("position") < more * (small + 1)
    shard = F.when(in_larger, F.floor(F.col("position") / (small + 1))).otherwise(more + F.floor((F.col("position") - more * (small + 1)) / F.greatest(small, F.lit(1))))
    slot = F.col("position") - F.least(F.col("shard"), more) * (small + 1) - F.greatest(F.col("shard") - more, F.lit(0)) * small
    return whole.withColumn("shard", shard.cast("bigint")).withColumn("slot", slot.cast("bigint")).select(id, "size", "text_crc32", "source_rows", "position", F.col("shard").cast("int").alias("shard"), "slot")
