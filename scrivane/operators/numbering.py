"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivane.sources.shared import new_path

ROW_BITS = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """Add numbers from 0 in the given order.

    The sorted partitions are written with their row positions, so that sampling and
    counting see the same rows; only one count per partition is summed up in one task.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)))
    path = new_path(spark, "numbered")
    placed.write.parquet(path)
    table = spark.read.schema(placed.schema).parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return table.join(bases, "_part").withColumn(out, F.col("_base") + F.col("_row")).drop("_part", "_row", "_base")
