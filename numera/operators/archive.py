"""Chunks of equal counts, their index and codings, and questions that know what is covered."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from numera.functions.integers import DIRECT_PRIMES, WHEEL, WHEEL_UNITS, coprime_to_wheel, div, long_array, lowest_bit, wheel_bit, wheel_unit
from numera.operators.sieve import primes
from numera.plans.segments import SEGMENT, ranked
from numera.plans.successor import successors

CHUNK_PRIMES = 16_000_000
#: Cycles behind its own in which a number's next prime lies: gaps below 2^64 are under 1552.
LATER_CYCLES = 8
#: Ranges of cycles that a question names one by one, and cycles that it takes together.
MOST_RANGES = 200
COARSE = 1 << 12


def chunked(spark: SparkSession, hi: int, chunk_primes: int = CHUNK_PRIMES, width: int = SEGMENT) -> DataFrame:
    """(chunk_id, p): primes up to ``hi`` numbered by rank, the direct primes counted."""
    rows = ranked(primes(spark, 0, hi + 1, width), "p", "segment")
    return rows.select(F.expr(f"(rank - 1) div {chunk_primes}").alias("chunk_id"), "p")


def index(chunks: DataFrame) -> DataFrame:
    """A row for each chunk: prime_count (all), first and last covered prime, wheel cycles.

    Covered are the primes from 11 on; a chunk without one counts but covers nothing.
    """
    stored = F.when((F.col("p") >= 11) & coprime_to_wheel(F.col("p")), F.col("p"))
    return with_cycles(chunks.groupBy("chunk_id").agg(F.count("*").alias("prime_count"), F.min(stored).alias("first_prime"), F.max(stored).alias("last_prime")))


def with_cycles(rows: DataFrame) -> DataFrame:
    """Adds cycle_start, cycles and raw_bytes to rows with first_prime and last_prime."""
    start = div(F.col("first_prime"), WHEEL)
    rows = rows.withColumn("cycle_start", start).withColumn("cycles", div(F.col("last_prime"), WHEEL) - start + 1)
    return rows.withColumn("raw_bytes", F.col("cycles") * (len(WHEEL_UNITS) // 8))


def answer_is_prime(keys: DataFrame, chunks: DataFrame, column: str = "n") -> DataFrame:
    """(n, is_prime, source, status) for the distinct non-null longs of a column.

    Small numbers and multiples of the direct primes need no archive (source
    rule); others are looked up in the chunk that spans them (source archive);
    where no chunk does, is_prime is null and status uncovered.
    """
    spans = index(chunks).where("first_prime is not null").select("chunk_id", "first_prime", "last_prime")
    hits = chunks.select(F.col("p").alias("n"), F.lit(True).alias("hit")).where("n >= 11")
    return _answers(keys, spans, lambda home: home.join(hits, "n", "left"), column)


def stored_is_prime(keys: DataFrame, spans: DataFrame, bitmap: DataFrame, column: str = "n") -> DataFrame:
    """``answer_is_prime`` from a stored index and the packed bitmap: one bit is read for each key, nothing is unpacked."""
    def look(home: DataFrame) -> DataFrame:
        home = home.withColumn("cycle", div(F.col("n"), WHEEL))
        # only asked cycles are merged; one that two chunks share has a row in each
        asked = bitmap.join(home.select("cycle").distinct(), "cycle", "left_semi")
        rows = home.join(asked.groupBy("cycle").agg(F.bit_or("bits").alias("bits")), "cycle", "left")
        return rows.withColumn("hit", F.call_function("getbit", "bits", wheel_bit(F.col("n"))) == 1)

    return _answers(keys, spans.where("first_prime is not null").select("chunk_id", "first_prime", "last_prime"), look, column)


def _answers(keys: DataFrame, spans: DataFrame, look: Callable[[DataFrame], DataFrame], column: str) -> DataFrame:
    n = keys.select(F.col(column).cast("long").alias("n")).where("n is not null").distinct()
    rule = F.when(F.col("n") < 2, F.lit(False)).when(F.col("n").isin(*DIRECT_PRIMES), F.lit(True)).when(~coprime_to_wheel(F.col("n")), F.lit(False))
    n = n.withColumn("rule", rule)
    # the chunk that may span n is the last one that begins at or before it
    member = look(_bracket(n.where("rule is null").select("n"), spans))
    looked = member.select("n", F.when(F.col("covered"), F.coalesce("hit", F.lit(False))).alias("is_prime"), F.lit("archive").alias("source"), F.when(F.col("covered"), "ok").otherwise("uncovered").alias("status"))
    settled = n.where("rule is not null").select("n", F.col("rule").alias("is_prime"), F.lit("rule").alias("source"), F.lit("ok").alias("status"))
    return settled.unionByName(looked)


def gaps(keys: DataFrame, spans: DataFrame, column: str = "n") -> DataFrame:
    """(n, previous_last, next_first) for the distinct non-null longs that no chunk spans: the ends of the gap, null where it is open."""
    n = keys.select(F.col(column).cast("long").alias("n")).where("n is not null").distinct()
    spans = spans.where("first_prime is not null")
    free = _bracket(n, spans).where(~F.col("covered")).select("n")
    above = successors(free, spans.select(F.col("first_prime").alias("p"))).withColumnRenamed("p", "next_first")
    # the end below n is the successor of -n among the ends with their sign turned
    below = successors(free.select((-F.col("n")).alias("n")), spans.select((-F.col("last_prime")).alias("p"))).select((-F.col("n")).alias("n"), (-F.col("p")).alias("previous_last"))
    return free.join(below, "n", "left").join(above, "n", "left").select("n", "previous_last", "next_first")


def _bracket(keys: DataFrame, spans: DataFrame) -> DataFrame:
    """(n, covered): whether a chunk spans n. Chunks follow one another, so the one with the
    nearest end at or above n is the only one that can."""
    ends = spans.select(F.col("last_prime").alias("p"), "first_prime")
    near = successors(keys.select((F.col("n") - 1).alias("n")), ends.select("p"))
    joined = near.join(ends, "p", "left").select((F.col("n") + 1).alias("n"), F.coalesce(F.col("first_prime") <= F.col("n") + 1, F.lit(False)).alias("covered"))
    return joined


def answer_next_prime(keys: DataFrame, chunks: DataFrame, column: str = "n") -> DataFrame:
    """(n, next_prime, status): strict successor in the archive.

    Uncovered where n is at or behind the last prime, or where the primes
    between n and the next archived one may be missing: their chunk is absent.
    """
    n = keys.select(F.col(column).cast("long").alias("n")).where("n is not null").distinct()
    spans = index(chunks).where("first_prime is not null").select("chunk_id", "first_prime", "last_prime")
    follows = Window.orderBy("chunk_id")
    whole = spans.withColumn("joined", (F.col("chunk_id") == 0) | F.coalesce(F.lag("chunk_id").over(follows) == F.col("chunk_id") - 1, F.lit(False)))
    stored = chunks.where("p >= 11")
    small = F.coalesce(*(F.when(F.col("n") < p, F.lit(p).cast("long")) for p in DIRECT_PRIMES))
    n = n.withColumn("small", small)
    near = successors(n.where("small is null").select("n"), stored.select("p"))
    near = near.join(stored, "p", "left").join(whole, "chunk_id", "left")
    fine = F.col("p").isNotNull() & ((F.col("n") >= F.col("first_prime")) | F.col("joined"))
    looked = near.select("n", F.when(fine, F.col("p")).alias("next_prime"), F.when(fine, "ok").otherwise("uncovered").alias("status"))
    settled = n.where("small is not null").select("n", F.col("small").alias("next_prime"), F.lit("ok").alias("status"))
    return settled.unionByName(looked)


def stored_next_prime(keys: DataFrame, spans: DataFrame, bitmap: DataFrame, column: str = "n") -> DataFrame:
    """``answer_next_prime`` from a stored index and the packed bitmap; nothing is unpacked.

    The next prime is the lowest bit above n in the word of n's cycle, else the
    lowest one of the cycles that follow. Where the archive has no hole that is
    at most ``LATER_CYCLES`` on, as no primes below 2^64 are further apart; where
    it has one, n is uncovered.
    """
    small = F.coalesce(*(F.when(F.col("n") < p, F.lit(p).cast("long")) for p in DIRECT_PRIMES))
    n = keys.select(F.col(column).cast("long").alias("n")).where("n is not null").distinct().withColumn("small", small)
    spans = spans.where("first_prime is not null").select("chunk_id", "first_prime")
    joined = spans.join(spans.select((F.col("chunk_id") + 1).alias("chunk_id")), "chunk_id", "left_semi").select("chunk_id").unionByName(spans.where("chunk_id = 0").select("chunk_id"))
    whole = spans.join(joined.distinct().withColumn("joined", F.lit(True)), "chunk_id", "left")
    asked = n.where("small is null").select("n", div(F.col("n"), WHEEL).alias("cycle"))

    def least(rows: DataFrame, bits: Column) -> DataFrame:
        own = rows.withColumn("left", bits).where("left <> 0")
        p = F.col("cycle") * WHEEL + wheel_unit(lowest_bit(F.col("left")))
        # the chunk of the least prime; of two chunks that share a word one has it
        return own.groupBy("n").agg(F.min(F.struct(p.alias("p"), "chunk_id")).alias("r")).select("n", "r.p", "r.chunk_id")

    # of the word of n's own cycle the bits of units up to n are left out
    below = F.element_at(long_array([sum(1 << k for k, u in enumerate(WHEEL_UNITS) if u <= r) for r in range(WHEEL)]), (F.pmod("n", F.lit(WHEEL)) + 1).cast("int"))
    inside = least(asked.join(bitmap, "cycle"), F.col("bits").bitwiseAND(F.bitwise_not(below)))
    rest = asked.join(inside, "n", "left_anti").select("n", F.explode(F.sequence(F.col("cycle") + 1, F.col("cycle") + LATER_CYCLES)).alias("cycle"))
    found = inside.unionByName(least(rest.join(bitmap, "cycle"), F.col("bits"))).join(whole, "chunk_id", "left")
    fine = F.col("p").isNotNull() & ((F.col("n") >= F.col("first_prime")) | F.coalesce("joined", F.lit(False)))
    looked = asked.join(found.drop("cycle"), "n", "left").select("n", F.when(fine, F.col("p")).alias("next_prime"), F.when(fine, "ok").otherwise("uncovered").alias("status"))
    return n.where("small is not null").select("n", F.col("small").alias("next_prime"), F.lit("ok").alias("status")).unionByName(looked)


def asked_ranges(keys: DataFrame, column: str = "n") -> list[tuple[int, int]]:
    """Ranges of cycles, both ends included, that hold the cycles of a column's longs and those behind them.

    At most ``MOST_RANGES``; keys that lie in more places get one range from the first to the last.
    """
    cycle = div(F.col(column).cast("long"), WHEEL)
    coarse = keys.where(F.col(column) >= 0).select(div(cycle, COARSE).alias("c")).distinct()
    rows = sorted(r[0] for r in coarse.limit(MOST_RANGES + 1).collect())
    if len(rows) > MOST_RANGES:
        lo, hi = coarse.agg(F.min("c"), F.max("c")).first()
        return [(lo * COARSE, (hi + 1) * COARSE + LATER_CYCLES)]
    out: list[tuple[int, int]] = []
    for c in rows:
        lo, hi = c * COARSE, (c + 1) * COARSE - 1 + LATER_CYCLES
        if out and lo <= out[-1][1] + 1:
            lo = out.pop()[0]
        out.append((lo, hi))
    return out


def deltas(values: DataFrame, value: str = "p", group: str = "chunk_id") -> DataFrame:
    """(group, i, first, delta): position, first value and difference to the one before, for each group."""
    w = Window.partitionBy(group).orderBy(value)
    return values.select(group, (F.row_number().over(w) - 1).cast("long").alias("i"), F.min(value).over(Window.partitionBy(group)).alias("first"), F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0).cast("long")).alias("delta"))


def undeltas(encoded: DataFrame, group: str = "chunk_id") -> DataFrame:
    """(group, i, p): the values that ``deltas`` encoded."""
    w = Window.partitionBy(group).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return encoded.select(group, "i", (F.col("first") + F.sum("delta").over(w)).alias("p"))


def packed(chunks: DataFrame) -> DataFrame:
    """(chunk_id, cycle, bits): the wheel bitmap, 48 bits of a cycle in a long. An aggregate, so it merges map side."""
    stored = chunks.where((F.col("p") >= 11) & coprime_to_wheel(F.col("p")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), wheel_bit(F.col("p")))
    return stored.groupBy("chunk_id", div(F.col("p"), WHEEL).alias("cycle")).agg(F.bit_or(bit).alias("bits"))


def coded(chunks: DataFrame) -> DataFrame:
    """``packed`` with a column ``direct``: bits of the direct primes, which the wheel leaves out, in cycle 0."""
    p = F.col("p")
    place = F.array_position(long_array(DIRECT_PRIMES), p)
    shift = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), by.cast("int"))
    wheel = F.when((p >= 11) & coprime_to_wheel(p), shift(wheel_bit(p))).otherwise(F.lit(0).cast("long"))
    direct = F.when(place > 0, shift(place - 1)).otherwise(F.lit(0).cast("long"))
    rows = chunks.where(((p >= 11) & coprime_to_wheel(p)) | p.isin(*DIRECT_PRIMES))
    return rows.groupBy("chunk_id", div(p, WHEEL).alias("cycle")).agg(F.bit_or(wheel).alias("bits"), F.bit_or(direct).cast("int").alias("direct"))


def unpacked(bitmap: DataFrame) -> DataFrame:
    """(chunk_id, p) of a wheel bitmap."""
    units = F.array(*(F.lit(u).cast("long") for u in WHEEL_UNITS))
    rows = bitmap.select("chunk_id", "cycle", "bits", F.posexplode(units).alias("bit", "unit"))
    return rows.where(F.call_function("getbit", "bits", F.col("bit")) == 1).select("chunk_id", (F.col("cycle") * WHEEL + F.col("unit")).alias("p"))


def delta_bytes(deltas: np.ndarray) -> bytes:
    """Differences >= 0 in seven bits a byte, low first, the eighth set in all but a number's last byte."""
    left, columns = deltas.astype(np.uint64), []
    sizes = np.ones(len(left), np.int64)
    while len(columns) == 0 or left.any():
        columns.append((left & 0x7F).astype(np.uint8))
        left = left >> np.uint64(7)
        sizes += left > 0
    used = np.arange(len(columns)) < sizes[:, None]
    more = np.arange(len(columns)) < sizes[:, None] - 1
    return (np.stack(columns, axis=1) | np.where(more, 0x80, 0).astype(np.uint8))[used].tobytes()


def delta_values(payload: bytes) -> np.ndarray:
    """The differences that ``delta_bytes`` coded; an error if the last one is cut short."""
    raw = np.frombuffer(payload, np.uint8)
    last = np.flatnonzero(raw < 0x80)
    if len(raw) and (not len(last) or last[-1] != len(raw) - 1):
        raise ValueError("differences are cut short")
    starts = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    place = np.arange(len(raw)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((raw & 0x7F).astype(np.int64) << 7 * place, starts) if len(last) else np.zeros(0, np.int64)


def exact_bytes(values: list[int]) -> bytes:
    """The delta coding of one chunk: count, first value, then the differences."""
    head = len(values).to_bytes(8, "little") + (values[0] if values else 0).to_bytes(8, "little")
    return head + (delta_bytes(np.diff(np.array(values, np.int64))) if len(values) > 1 else b"")


def encoded_sizes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, exact_bytes): bytes of each chunk's delta coding, 16 for the head and 7 bits of a difference in a byte."""
    delta = F.col("p") - F.lag("p").over(Window.partitionBy("chunk_id").orderBy("p"))
    size = sum((F.when(F.col("delta") >= 1 << 7 * k, 1).otherwise(0) for k in range(1, 9)), F.lit(1))
    rows = chunks.select("chunk_id", delta.alias("delta"))
    return rows.groupBy("chunk_id").agg((F.lit(16) + F.coalesce(F.sum(F.when(F.col("delta").isNotNull(), size)), F.lit(0))).cast("long").alias("exact_bytes"))


