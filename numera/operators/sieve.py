"""Primes of a range: in bulk with numpy by segment, and as a relation by anti join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numera.functions.integers import nth_prime_bound
from numera.plans.segments import SEGMENT, base_limit, ranked, segments, with_offsets


#: Numbers up to which ranges are sieved.
MOST_SIEVED = 10**18


def base_primes(limit: int) -> np.ndarray:
    """All primes up to ``limit``."""
    if limit < 2:
        return np.zeros(0, np.int64)
    alive = np.ones(limit + 1, bool)
    alive[:2] = False
    for p in range(2, math.isqrt(limit) + 1):
        if alive[p]:
            alive[p * p :: p] = False
    return np.flatnonzero(alive).astype(np.int64)


def window_primes(lo: int, hi: int, base: np.ndarray) -> np.ndarray:
    """Primes in [lo, hi); ``base`` has all primes up to the root of hi - 1 at least."""
    lo = max(lo, 2)
    if hi <= lo:
        return np.zeros(0, np.int64)
    alive = np.ones(hi - lo, bool)
    for p in base.tolist():
        if p * p >= hi:
            break
        alive[max(p * p, -(-lo // p) * p) - lo :: p] = False
    return np.flatnonzero(alive) + lo


def _sieve(shared: Broadcast, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        for batch in batches:
            for s, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("segment", "lo", "hi"))):
                found = window_primes(lo, hi, base)
                if counts_only:
                    yield pa.RecordBatch.from_pydict({"segment": pa.array([s]), "n": pa.array([len(found)]), "last": pa.array([int(found[-1]) if len(found) else None], pa.int64())})
                else:
                    yield pa.RecordBatch.from_pydict({"segment": pa.array(np.full(len(found), s)), "p": pa.array(found)})

    return run


def shared_base(spark: SparkSession, hi: int) -> Broadcast:
    """The primes that strike every composite below ``hi``: 5 MB for 10^14, 400 MB for 10^18, where sieving ends."""
    if hi > MOST_SIEVED:
        raise ValueError(f"beyond {MOST_SIEVED} numbers are tested one by one, not sieved")
    return spark.sparkContext.broadcast(base_primes(base_limit(hi)))


def primes(spark: SparkSession, lo: int, hi: int, width: int = SEGMENT) -> DataFrame:
    """(segment, p) for the primes in [lo, hi). Base primes, up to the root of hi, reach each executor once."""
    return segments(spark, lo, hi, width).mapInArrow(_sieve(shared_base(spark, hi), False), "segment long, p long")


def segment_counts(spark: SparkSession, lo: int, hi: int, width: int = SEGMENT) -> DataFrame:
    """(segment, n, last): how many primes each segment of [lo, hi) has, and its last one."""
    return segments(spark, lo, hi, width).mapInArrow(_sieve(shared_base(spark, hi), True), "segment long, n long, last long")


def prime_count(spark: SparkSession, x: int) -> int:
    """How many primes do not exceed x."""
    return segment_counts(spark, 0, x + 1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def first_n_primes(spark: SparkSession, n: int, width: int = SEGMENT) -> DataFrame:
    """(rank, p) of the first n primes."""
    found = primes(spark, 0, nth_prime_bound(n) + 1, width) if n > 0 else primes(spark, 0, 0)
    return ranked(found, "p", "segment").where(F.col("rank") <= n).select("rank", "p")


def nth_prime(spark: SparkSession, n: int, width: int = SEGMENT) -> DataFrame:
    """One row (n, p); none for n < 1. Counts segments, then sieves the one that holds the answer."""
    if n < 1:
        return spark.range(0).selectExpr("id as n", "id as p")
    hi = nth_prime_bound(n) + 1
    offsets = with_offsets(segment_counts(spark, 0, hi, width), "segment", "n")
    target = offsets.where((F.col("offset") < n) & (F.col("offset") + F.col("n") >= n)).first()
    own = primes(spark, max(0, target["segment"] * width), min(hi, (target["segment"] + 1) * width), width)
    local = ranked(own, "p", "segment").where(F.col("rank") == n - target["offset"])
    return local.select(F.lit(n).cast("long").alias("n"), "p")


def primes_relational(spark: SparkSession, hi: int, width: int = SEGMENT) -> DataFrame:
    """Primes below ``hi``: integers anti-joined to the multiples of base primes from their squares on.

    A base prime is spread over the segments that its multiples reach, so that
    no task has all multiples of a small one. Both sides are sorted: the multiples
    outnumber the integers, but seem few to the planner, which would broadcast them.
    """
    base = primes(spark, 0, base_limit(hi) + 1).select(F.col("p").alias("b"))
    parts = base.select("b", F.explode(F.expr(f"sequence(b * b div {width}, {max(hi, 1) - 1} div {width})")).alias("s")).repartition("b", "s")
    lo, end = F.col("s") * width, F.least((F.col("s") + 1) * width, F.lit(hi))
    parts = parts.select("b", F.greatest(F.col("b") * F.col("b"), F.call_function("div", lo + F.col("b") - 1, F.col("b")) * F.col("b")).alias("first"), end.alias("end"))
    multiples = parts.where("first < end").select(F.explode(F.expr("sequence(first, end - 1, b)")).alias("p"))
    return spark.range(2, max(hi, 2)).select(F.col("id").alias("p")).join(multiples.hint("merge"), "p", "left_anti")


def candidates(spark: SparkSession, lo_q: int, hi_q: int) -> DataFrame:
    """(q, d, n): the integers 10q + d with d in 1, 3, 7, 9 for q in [lo_q, hi_q)."""
    rows = spark.range(lo_q, hi_q).select(F.col("id").alias("q"), F.explode(F.array(*(F.lit(d).cast("long") for d in (1, 3, 7, 9)))).alias("d"))
    return rows.withColumn("n", F.col("q") * 10 + F.col("d"))
