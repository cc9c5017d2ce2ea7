"""Delimited text: native CSV parsing of files and of lines in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.functions.text import escape_cell

OPTIONS = {"quote": '"', "escape": '"'}


def read(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None, header: bool = True) -> DataFrame:
    reader = spark.read.option("sep", sep).option("multiLine", True).option("header", header).options(**OPTIONS)
    return (reader.schema(schema) if schema else reader).csv(path)


def parse_lines(lines: DataFrame, column: str, schema: str, sep: str = ",") -> DataFrame:
    return lines.select(F.from_csv(F.col(column), schema, {**OPTIONS, "sep": sep}).alias("row")).select("row.*")


def escaped_row(cells: Column, sep: str = ",") -> Column:
    """A CSV line of escaped cells."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.lit('"'), F.replace(escape_cell(c), F.lit('"'), F.lit('""')), F.lit('"'))), sep)
