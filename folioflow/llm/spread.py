"""Ranks and running sums over groups of any size.

A group's rows are dealt over many small hash buckets; rows are ordered inside a
bucket by a window, and only one summary row per bucket crosses bucket borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_PER_BUCKET = 1024


def ranked(df: DataFrame, group: str, hashed: str, order: list[str], weight: str, rows: int) -> DataFrame:
    """Add ``pos`` (0-based rank inside the group) and ``before`` (weight of the rows ahead).

    ``hashed`` is a long that spreads the rows evenly and is a function of the row;
    the order inside a group is (bucket, hashed, *order), the same in every run.
    ``rows`` is the row count, which sets the number of buckets.
    """
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    df = df.withColumn("_bucket", F.pmod(F.col(hashed), F.lit(buckets)))
    sums = df.groupBy(group, "_bucket").agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col(group).alias("_g"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_w0"),
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(hashed, *order)
    running = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("pos", F.row_number().over(inside) - 1).withColumn("before", running - F.col(weight))
    joined = df.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumns(
        {"pos": (F.col("pos") + F.col("_n0")).cast("bigint"), "before": F.col("before") + F.col("_w0")}
    ).drop("_bucket", "_g", "_b", "_w0", "_n0")


def running_sorted(df: DataFrame, order: list[Column], weight: str, rows: int, stage) -> DataFrame:
    """Add ``cum``: the weight of all rows up to this one in the global order.

    Rows are range-partitioned and staged, each range is summed, and the sums of
    the ranges ahead are added; ``stage`` fixes the ranges for both passes.
    """
    parts = max(1, -(-rows // (32 * ROWS_PER_BUCKET)))
    dealt = stage(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum(weight).alias("_w"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_w0"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        dealt.withColumn("cum", F.sum(weight).over(inside))
        .join(sums, F.col("_range") == F.col("_r"))
        .withColumn("cum", F.col("cum") + F.col("_w0"))
        .drop("_range", "_r", "_w0")
    )
