"""Lookups of facts by a key of which a few values may have a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which on a key is looked up apart, and how many such keys there are at most.
HOT_ROWS = 10_000
MOST_HOT = 100_000


def looked_up(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row a key; null keys meet nothing.

    Keys with many rows are found by a count that merges where rows are read.
    Their facts go to all executors, at most ``MOST_HOT`` of them however the
    rows are spread; all others meet by a shuffle in which no key is large.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("__rows"))
    total = rows.count()
    hot = counts.where(F.col("__rows") > max(HOT_ROWS, total // MOST_HOT)).select(key)
    many = facts.join(F.broadcast(hot), key, "left_semi")
    few = facts.join(F.broadcast(hot), key, "left_anti")
    met = rows.join(F.broadcast(many), key)
    return met.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(few, key))
