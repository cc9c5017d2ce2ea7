"""Queries by name, each with the SQL that an independent engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLES[key] = sql
        return function

    return add


#: Tables whose rows cost much work each.
HEAVY = ("pages", "documents")


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A table's scan. One of few files would keep most cores idle while texts are
    parsed, so a heavy table (one of HEAVY, or any whose rows a query builds files or
    pages from) with fewer scan tasks than cores is dealt over them; a table of a
    cluster's size has more tasks than cores and is read as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if (heavy or name in HEAVY) and df.rdd.getNumPartitions() < cores else df


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """df with equal keys together, over a few tasks for each core; Spark would join small groups into few tasks, however much work each of them is."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
