"""Segments of the integers as rows, and running totals over them without a global window of values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Integers in a segment: a bitmap of this many bytes fits a core's cache.
SEGMENT = 1 << 20


def segments(spark: SparkSession, lo: int, hi: int, width: int = SEGMENT) -> DataFrame:
    """Rows (segment, lo, hi) that cut [lo, hi) at multiples of ``width``."""
    if hi <= lo:
        return spark.range(0).selectExpr("id as segment", "id as lo", "id as hi")
    first, last = lo // width, (hi - 1) // width
    ids = spark.range(first, last + 1, numPartitions=max(1, min(last - first + 1, 4 * spark.sparkContext.defaultParallelism)))
    return ids.select(F.col("id").alias("segment"), F.greatest(F.col("id") * width, F.lit(lo)).alias("lo"), F.least((F.col("id") + 1) * width, F.lit(hi)).alias("hi"))


def with_offsets(counts: DataFrame, group: str, n: str, offset: str = "offset") -> DataFrame:
    """Adds to a row for each group the sum of ``n`` over all groups before it.

    Groups are first summed in blocks of a thousand, so that the one window
    without a key has a row for each block.
    """
    blocks = counts.withColumn("__block", F.expr(f"{group} div 1000"))
    within = Window.partitionBy("__block").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("__block").agg(F.sum(n).alias("__n"))
    before = totals.select("__block", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inner = blocks.withColumn("__own", F.coalesce(F.sum(n).over(within), F.lit(0)))
    return inner.join(before, "__block").withColumn(offset, F.col("__own") + F.col("__before")).drop("__block", "__own", "__before")


def ranked(values: DataFrame, value: str, group: str, rank: str = "rank") -> DataFrame:
    """Adds the rank from 1 of each value; ``group`` must not decrease with the value."""
    offsets = with_offsets(values.groupBy(group).agg(F.count("*").alias("__n")), group, "__n", "__offset").select(group, "__offset")
    local = F.row_number().over(Window.partitionBy(group).orderBy(value))
    return values.join(offsets, group).withColumn(rank, (local + F.col("__offset")).cast("long")).drop("__offset")


def base_limit(hi: int) -> int:
    """Primes up to this number strike every composite below ``hi``."""
    return math.isqrt(max(0, hi - 1))
