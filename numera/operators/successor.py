"""Successors of the numbers in a column."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numera.operators.primality import next_prime_int
from numera.operators.sieve import base_primes, window_primes

#: No two primes below 2^64 are further apart.
LARGEST_GAP = 1552
#: Numbers that are sieved in one window.
WIDTH = 1 << 22


def next_primes(values: np.ndarray) -> np.ndarray:
    """For sorted longs: windows that are densely asked for are sieved, other values searched one by one."""
    out, start = np.zeros(len(values), np.int64), 0
    while start < len(values):
        lo = max(0, int(values[start]))
        stop = max(start + 1, int(np.searchsorted(values, min(lo + WIDTH, 2**63 - 1))))
        hi = int(values[stop - 1]) + LARGEST_GAP + 1
        if 2 < hi < 10**13 and (stop - start) * 2000 > hi - lo:
            found = window_primes(lo, hi + 1, base_primes(math.isqrt(hi)))
            out[start:stop] = found[np.searchsorted(found, values[start:stop], "right")]
        else:
            out[start:stop] = [next_prime_int(int(n)) for n in values[start:stop]]
        start = stop
    return out


def _answered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame = frame.sort_values("n", ignore_index=True)
        yield frame.assign(next_prime=next_primes(frame["n"].to_numpy(np.int64)))


def next_prime(numbers: DataFrame, column: str = "n") -> DataFrame:
    """(n, next_prime) for the distinct non-null longs of a column below 2^63 - 26.

    Numbers are dealt out by range, so that dense ones share a sieve; what lies
    between them is never looked at.
    """
    distinct = numbers.select(F.col(column).cast("long").alias("n")).where("n is not null").distinct()
    return distinct.repartitionByRange("n").mapInPandas(_answered, "n long, next_prime long")
