"""Readings of pictures: tables of words to lines, confidence and choice. No engine is bundled; register one as an Arrow function."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivane.functions.arrow import arrow_function

# Fixed values of the choice between two readings.
RETRY_BELOW, ALIKE, LONGEST_TOKEN, LEAST_LENGTH, LENGTH_FACTOR = 80.0, 0.92, 40, 500, 2.5
_WORDS = "page bigint, block int, par int, line int, word string, conf double"

ENGINES: dict = {}


def register_engine(name: str, function) -> None:
    """An engine is a function of (binary column) to struct<text, confidence>."""
    ENGINES[name] = function


def resolve_engine(name: str):
    if name not in ENGINES:
        raise LookupError(f"no reading engine {name!r} is registered")
    return ENGINES[name]


def parse_tsv(rows: DataFrame, column: str = "line") -> DataFrame:
    return rows.select(F.from_csv(F.col(column), _WORDS, {"sep": "\t"}).alias("w")).select("w.*")


def lines(words: DataFrame, order: str = "n") -> DataFrame:
    """(page, block, par, line, text, confidence): confidence is the mean of what is not negative."""
    return words.where(F.trim("word") != "").groupBy("page", "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "word"))), lambda w: w.word), " ").alias("text"),
        F.round(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), 2).alias("confidence"),
    )


@arrow_function("double")
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def keeps_second(first: Column, other: Column, confidence: Column) -> Column:
    """A poor first reading keeps an alternate that differs and is no noise."""
    tokens = F.filter(F.split(F.trim(other), r"\s+"), lambda t: t != "")
    mean = F.length(F.array_join(tokens, "")) / F.greatest(F.size(tokens), F.lit(1))
    sized = F.length(other) <= F.greatest(F.lit(LEAST_LENGTH), LENGTH_FACTOR * F.length(first))
    retried = confidence.isNull() | (confidence < RETRY_BELOW)
    return retried & (F.trim(other) != "") & (similarity(first, other) < ALIKE) & (mean <= LONGEST_TOKEN) & sized


def complete_text(first: Column, second: Column) -> Column:
    return F.concat_ws("\n\n", F.when(F.trim(first) != "", first).otherwise("[nothing could be read]"), F.when(F.trim(F.coalesce(second, F.lit(""))) != "", F.concat(F.lit("[another reading]\n"), second)))


def requested_languages(specification: Column) -> Column:
    return F.filter(F.split(specification, r"\+"), lambda x: x != "")


def missing_languages(specification: Column, installed: Column) -> Column:
    return F.array_except(requested_languages(specification), installed)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")).cast("bigint")


def scaled(pages: DataFrame, a4: float = 595.0) -> DataFrame:
    """Widths in points on the scale of the most frequent width (the least of equally frequent ones)."""
    usual = pages.groupBy("width").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("width", F.struct((-F.col("n")).alias("n"), "width")).alias("usual"))
    return pages.join(F.broadcast(usual)).withColumn("points", F.col("width") * a4 / F.col("usual"))  # one row
