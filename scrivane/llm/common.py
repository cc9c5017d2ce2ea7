"""Shared plumbing: written tables, global ranks, and Arrow helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivane.sources.shared import new_path, shared_folder  # noqa: F401

#: Words are runs of anything but these (a Java and RE2 pattern).
SPACES = r"[\x20\x09-\x0D]+"
POSITION_BITS = (1 << 33) - 1


def write_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scrivane_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table that write_table made and that nothing reads any more."""
    path = getattr(df, "_scrivane_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def new_column(df: DataFrame, name: str) -> None:
    """A column that is to be added must not replace one of the table's."""
    if free_name(df, name) != name:
        raise ValueError(f"the table has a column {name} already; give another name for the result")


def row_hash(df: DataFrame) -> Column:
    """128 bits of all columns of a row, as hex digits; columns may be of any type that JSON can say, times to the microsecond."""
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), exact)
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), row)), 16, "0") for seed in (1, 2)])


def _is_scan(df: DataFrame) -> bool:
    """Whether df is a file scan under nothing but projections and filters, so that a file's row is one row at most."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation" and not any(c.lower() == "_metadata" for c in df.columns)


def numbered_rows(df: DataFrame, key: str) -> DataFrame:
    """df with a key that no two rows share and that stays whenever it is read again.

    Rows of a Parquet scan are known by their file and place in it. Anything else is
    written with numbers first.
    """
    if _is_scan(df):
        try:
            return df.withColumn(key, F.concat_ws("#", "_metadata.file_path", "_metadata.row_index"))
        except AnalysisException:  # a format whose rows have no places
            pass
    return write_table(df.withColumn(key, F.monotonically_increasing_id().cast("string")), "numbered")


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str, total: str) -> DataFrame:
    """Add each row's rank (from 0) within its group in the given order, and the group's row count.

    No group is ever gathered: rows are range-partitioned by (group, order) so a
    hot group spreads over many partitions, the sorted partitions are written
    with their row positions, and only one row per (partition, group) is
    prefix-summed. Group columns must not be null.
    """
    keys = [*group, *order]
    spread = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(POSITION_BITS)))
    )
    table = write_table(spread, "ranked")
    runs = table.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *group, "_part", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.sum("_n").over(whole).alias(total),
    )
    joined = table.join(runs, [*group, "_part"])
    return joined.withColumn(rank, F.col("_base") + F.col("_row") - F.col("_first")).drop("_base", "_row", "_first", "_part")


#: A key is heavy with more rows than this and than one in HEAVY_SHARE of all, so at most HEAVY_SHARE keys are.
HEAVY_LEAST, HEAVY_SHARE = 1000, 10_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """left joined to right, which has one row for each key, without gathering the rows of a heavy key.

    Keys that hold more than a ten-thousandth of the rows of `counted` (left by default;
    a written table with the same keys) are at most HEAVY_SHARE, so right's rows of
    them are broadcast; all others meet in a merge join of small groups. Rows of a
    null key find nothing and stay where they are.
    """
    counted = left if counted is None else counted
    known = counted.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    limit = max(HEAVY_LEAST, counted.count() // HEAVY_SHARE)
    heavy = write_table(known.groupBy(*keys).count().where(F.col("count") > limit).select(*keys, F.lit(True).alias("_heavy")), "heavy")
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    marked = left.join(F.broadcast(heavy), keys, "left")
    few = right.join(F.broadcast(heavy), keys, "left_semi")
    hot = marked.where(F.col("_heavy").isNotNull() | null).drop("_heavy").join(F.broadcast(few), keys, how)
    cold = marked.where(F.col("_heavy").isNull() & ~null).drop("_heavy").join(right.hint("merge"), keys, how)
    return hot.unionByName(cold)


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def each_bytes(column: pa.Array):
    """Yield every value of a string column as a uint8 array, nulls as empty."""
    data, offsets = byte_views(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b]
