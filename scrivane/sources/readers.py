"""Table and file readers and sinks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE = 100 << 20


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (), limit: int = MAX_FILE) -> DataFrame:
    """(path, modificationTime, length, content) of files up to the size limit."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= limit)
    return df.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes)) if suffixes else df


def text_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines framing: rows end at \\n only."""
    return spark.read.option("lineSep", "\n").text(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Files of every registered kind as (path, kind, markdown, error)."""
    from scrivane.sources.office import converted

    return files(spark, path, suffixes).select("path", converted(F.regexp_extract("path", r"\.([^./]*)$", 1), F.col("content")).alias("c")).select("path", "c.*")


def write_bundle(pages: DataFrame, chunks: DataFrame, path: str, id: str = "page_id") -> None:
    """Markdown as text and chunks as JSON Lines by page, committed by Spark's writers."""
    pages.select(id, F.col("markdown").alias("value")).write.mode("overwrite").partitionBy(id).text(f"{path}/markdown")
    chunks.write.mode("overwrite").option("ignoreNullFields", True).partitionBy(id).json(f"{path}/chunks")


def publish(df: DataFrame, path: str, version: str) -> str:
    """A versioned output directory: readers take the newest that has Spark's success mark, so a failed run leaves the old one in force."""
    target = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def pretty_json(value: Column) -> Column:
    return F.concat(F.to_json(value, {"pretty": "true", "ignoreNullFields": "true"}), F.lit("\n"))


def register_functions(spark: SparkSession) -> None:
    """The Arrow functions and a table function, for SQL."""
    from pyspark.sql.functions import udtf

    from scrivane.functions import markup as M
    from scrivane.functions import packing
    from scrivane.operators import pages as P
    from scrivane.operators import policy

    for name, function in {"page_metadata": P.metadata, "page_blocks": P.blocks, "page_links": P.links, "page_markdown": P.markdown, "page_sanitised": P.sanitised, "legacy_chunks": packing.legacy_chunks, "split_parts": packing.split_parts, "is_internal": policy.is_internal}.items():
        spark.udf.register(name, function.udf())

    @udtf(returnType="text: string, url: string")
    class LinkTable:
        def eval(self, html: str):
            for link in M.links(M.parse(html or "")):
                yield link["text"], link["url"]

    spark.udtf.register("link_table", LinkTable)
    spark.udtf.register("with_gaps", _gap_table())
    spark.udf.register("count_entropy", F.arrow_udf(count_entropy, "double"))


def count_entropy(counts: pa.Array, of_each: pa.Array) -> float:
    """An aggregate: the entropy in bits of a group's counts, of rows (count, how many have it). Different counts are few, whatever the group's size."""
    n = counts.to_numpy(zero_copy_only=False).astype(float)
    m = of_each.to_numpy(zero_copy_only=False).astype(float)
    use = (n > 0) & (m > 0)
    total = float((n * m)[use].sum())
    return float(np.log2(total) - (m * n * np.log2(np.where(use, n, 1)))[use].sum() / total) if total else 0.0


def _gap_table():
    """A polymorphic table function: its argument's rows, in order within each partition, with their number and the distance of a column to the row before."""
    from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
    from pyspark.sql.types import DoubleType, LongType, StructType

    @udtf
    class WithGaps:
        def __init__(self):
            self.n, self.before = 0, None

        @staticmethod
        def analyze(rows: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or column.value not in rows.dataType.names:
                raise Exception("with_gaps(TABLE(...) PARTITION BY (...) ORDER BY (...), 'column of the table')")
            schema = StructType(list(rows.dataType.fields))
            return AnalyzeResult(schema.add("n", LongType()).add("gap", DoubleType()))

        def eval(self, row, column):
            value = row[column]
            gap = None if self.before is None or value is None else float(value - self.before)
            self.n += 1
            self.before = value
            yield *row, self.n, gap

    return WithGaps
