"""Strict successor joins without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from numera.functions.integers import div

#: Numbers in a bucket.
WIDTH = 4096


def successors(keys: DataFrame, points: DataFrame, key: str = "n", point: str = "p", width: int = WIDTH) -> DataFrame:
    """(key, point): for each distinct non-null key the smallest point above it, null without one.

    Both sides are dealt out by bucket. A key takes the least later point of
    its bucket, else the first point of the next bucket that has any; that is
    looked up in a table with a row for each bucket, itself cut into blocks.
    """
    k = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__b", div(F.col(key), width))
    p = points.select(point).distinct().withColumn("__b", div(F.col(point), width))
    firsts = p.groupBy("__b").agg(F.min(point).alias("__first"))
    buckets = k.select("__b").distinct().join(firsts, "__b", "full").withColumn("__block", div(F.col("__b"), width))
    later = Window.partitionBy("__block").orderBy("__b").rowsBetween(1, Window.unboundedFollowing)
    blocks = buckets.groupBy("__block").agg(F.min("__first").alias("__least"))
    behind = Window.orderBy("__block").rowsBetween(1, Window.unboundedFollowing)
    blocks = blocks.select("__block", F.min("__least").over(behind).alias("__next_block"))
    ahead = buckets.withColumn("__next", F.min("__first").over(later)).join(blocks, "__block").select("__b", F.coalesce("__next", "__next_block").alias("__next"))
    inside = k.join(p, "__b").where(F.col(point) > F.col(key)).groupBy(key).agg(F.min(point).alias("__inside"))
    return k.join(inside, key, "left").join(ahead, "__b").select(key, F.coalesce("__inside", "__next").alias(point))
