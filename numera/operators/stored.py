"""Questions to a stored archive: answered from its index and bitmap, of which only the asked parts are read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from numera.operators import archive
from numera.sources import store


def is_prime(keys: DataFrame, path: str, column: str = "n") -> DataFrame:
    """(n, is_prime, source, status), as ``archive.answer_is_prime``."""
    spark = keys.sparkSession
    return archive.stored_is_prime(keys, store.read_index(spark, path), store.read_bitmap(spark, path, archive.asked_ranges(keys, column)), column)


def next_prime(keys: DataFrame, path: str, column: str = "n") -> DataFrame:
    """(n, next_prime, status), as ``archive.answer_next_prime``."""
    spark = keys.sparkSession
    return archive.stored_next_prime(keys, store.read_index(spark, path), store.read_bitmap(spark, path, archive.asked_ranges(keys, column)), column)
