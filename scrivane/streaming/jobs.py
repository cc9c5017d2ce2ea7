"""Structured Streaming forms: incremental bundles, windows with late data, deduplication and carried state.

Each job runs to the end of what is there (availableNow) with its checkpoint in the
shared folder, so a second run goes on where the first stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.functions.text import clock_seconds
from scrivane.sources.shared import new_path


def source(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream; the schema is the table's own.

    The path is given as a pattern that matches it alone: a table can be one file, which
    a stream does not take as its base folder.
    """
    parent, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{parent}/[{name[0]}]{name[1:]}")


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def to_table(stream: DataFrame, name: str, out: str | None = None, checkpoint: str | None = None) -> str:
    """Append a stream's rows to a Parquet folder, exactly once by the sink's log."""
    spark = stream.sparkSession
    out, checkpoint = out or new_path(spark, name), checkpoint or new_path(spark, f"{name}-checkpoint")
    _finish(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    return out


def batches(stream: DataFrame, name: str, mode: str = "update", checkpoint: str | None = None) -> DataFrame:
    """Each micro-batch as one folder (rewritten if the batch is tried again); rows get the batch they came in."""
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, name), checkpoint or new_path(spark, f"{name}-checkpoint")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    _finish(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start())
    return spark.read.parquet(out)


def page_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Pages as they arrive to titles, link counts and text digests."""
    from scrivane.operators import pages as P

    s = source(spark, path).select("page_id", P.title(F.col("html")).alias("title"), F.size(P.links(F.col("html"))).alias("links"), F.sha2(P.plain_text(F.col("html")), 256).alias("text_sha"))
    return spark.read.parquet(to_table(s, "bundle"))


def windowed(spark: SparkSession, path: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by window and type behind a watermark; a window's row of the last batch stands."""
    e = source(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("value"))
    rows = batches(counts.select(clock_seconds(F.col("w.start")).alias("start"), "event_type", "events", "value"), "windows")
    return rows.groupBy("start", "event_type").agg(F.max_by("events", "batch").alias("events"), F.max_by("value", "batch").alias("value"))


def deduplicated(spark: SparkSession, path: str, keys: list[str], late: str = "1 day") -> DataFrame:
    e = source(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return spark.read.parquet(to_table(e.dropDuplicatesWithinWatermark(keys).select(*keys), "deduplicated"))


def budgets(spark: SparkSession, path: str, key: str = "user_id", value: str = "value") -> DataFrame:
    """What each key has used so far, as state carried over batches."""
    def spend(k, frames: Iterator[pd.DataFrame], state):
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "events": [n], "spent": [total]})

    s = source(spark, path).select(key, value).groupBy(key).applyInPandasWithState(spend, f"{key} bigint, events bigint, spent double", "n bigint, total double", "update", "NoTimeout")
    rows = batches(s, "budgets")
    return rows.groupBy(key).agg(F.max_by("events", "batch").alias("events"), F.max_by("spent", "batch").alias("spent"))
