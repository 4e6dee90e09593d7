"""Ordered scans without a global window: dense positions and running totals over range partitions.

The rows are range-partitioned and sorted by the wanted order and written once, each with its partition and its place there.
Then two levels suffice: totals of the partitions (one row a partition, so their number is bounded by the number of
partitions and not by the data), and places or sums within a partition. No window or sort spans the table.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.session import scratch_path

PART, PLACE = "_part", "_place"


def ranged(df: DataFrame, by: list[str], parts: int | None = None) -> DataFrame:
    """The rows with `_part` and `_place`: place by place within each part, part after part, they are in the order of ``by``.

    Rows that tie in ``by`` keep whatever order they were written in. The copy lies in the shared folder, so every later
    read sees the same order, also after a lost executor.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the row in the lower 33
    path = scratch_path(spark, "ranged")
    df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(PART, at).write.parquet(path)
    rows = spark.read.parquet(path)
    return rows.select(*df.columns, F.shiftright(PART, 33).cast("int").alias(PART),
                       F.col(PART).bitwiseAND((1 << 33) - 1).alias(PLACE))


def before_parts(rows: DataFrame, total: Column, name: str) -> DataFrame:
    """(_part, name): what ``total`` is over all parts before each part. The totals go through the driver: one number a part."""
    each = sorted((r[0], r[1] or 0) for r in rows.groupBy(PART).agg(total).collect())
    sums = accumulate((v for _, v in each), initial=0)
    pairs = [(p, s) for (p, _), s in zip(each, sums)]
    return rows.sparkSession.createDataFrame(pairs, f"{PART} int, {name} long")


def numbered(df: DataFrame, by: list[str], out: str = "pos", parts: int | None = None) -> DataFrame:
    """The rows with their dense 0-based position in the order of ``by``."""
    rows = ranged(df, by, parts)
    starts = before_parts(rows, F.count(F.lit(1)), "_start")
    return rows.join(starts, PART).select(*df.columns, (F.col("_start") + F.col(PLACE)).alias(out))


def numbered_within(df: DataFrame, keys: list[str], by: list[str], out: str = "pos", parts: int | None = None) -> DataFrame:
    """The rows with their 0-based position within their key and `n`, the rows of the key. A key may span many partitions: the
    first position of each key comes from a partially aggregated minimum."""
    rows = numbered(df, keys + by, "_all", parts)
    first = rows.groupBy(*keys).agg(F.min("_all").alias("_first"), F.count(F.lit(1)).alias("n"))
    return rows.join(first, keys).select(*df.columns, (F.col("_all") - F.col("_first")).alias(out), "n")


def running_total(df: DataFrame, by: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """The rows with the sum of ``value`` over all rows before them in the order of ``by``."""
    rows = ranged(df, by, parts)
    starts = before_parts(rows, F.sum(value), "_start")
    w = Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_sum", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return local.join(starts, PART).select(*df.columns, (F.col("_start") + F.col("_sum")).alias(out))
