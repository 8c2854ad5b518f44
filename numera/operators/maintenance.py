"""Upkeep of chunks: missing ones, islands, repair, committed counts, status."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from numera.operators.archive import index
from numera.operators.sieve import shared_base, window_primes
from numera.plans.segments import SEGMENT, ranked


def missing(expected: DataFrame, present: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Expected ids that are not present."""
    return expected.select(key).distinct().join(present.select(key), key, "left_anti")


def twins(ids: DataFrame, other: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Ids whose other form exists as well, so that one may be pruned."""
    return ids.select(key).distinct().join(other.select(key), key, "left_semi")


def backfill(committed: DataFrame, wheel: DataFrame, exact: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Committed ids without a wheel chunk whose exact chunk can be encoded again."""
    return twins(missing(committed, wheel, key), exact, key)


def islands(ids: DataFrame, key: str = "id", width: int = 1 << 16) -> DataFrame:
    """(first, last, n): maximal runs of consecutive ids.

    A run begins where the id before is absent and ends where the next is, found
    by anti joins; the k-th beginning and the k-th end belong together.
    """
    own = ids.select(F.col(key).cast("long").alias("id")).where("id is not null").distinct()
    starts = own.join(own.select((F.col("id") + 1).alias("id")), "id", "left_anti").withColumn("g", F.expr(f"id div {width}"))
    ends = own.join(own.select((F.col("id") - 1).alias("id")), "id", "left_anti").withColumn("g", F.expr(f"id div {width}"))
    pairs = ranked(starts, "id", "g").select("rank", F.col("id").alias("first")).join(ranked(ends, "id", "g").select("rank", F.col("id").alias("last")), "rank")
    return pairs.select("first", "last", (F.col("last") - F.col("first") + 1).alias("n"))


def first_ranges(runs: DataFrame, most: int = 6) -> DataFrame:
    """One row (ranges, more): the first ``most`` runs as text, and how many follow them."""
    text = ranges_text(runs.orderBy("first").limit(most))
    return text.crossJoin(runs.agg(F.greatest(F.count("*") - most, F.lit(0).cast("long")).alias("more")))


def ranges_text(runs: DataFrame) -> DataFrame:
    """One row (ranges): runs as a-b or a, joined by commas in order. One row in all, so for reports."""
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    items = F.array_sort(F.collect_list(F.struct("first", text.alias("t"))))
    return runs.agg(F.array_join(F.transform(items, lambda x: x["t"]), ",").alias("ranges"))


def even_split(ids: DataFrame, shards: int, key: str = "id", width: int = 1 << 16) -> DataFrame:
    """(id, shard): sorted ids cut where ids before are i * len div shards."""
    own = ids.select(F.col(key).cast("long").alias("id")).where("id is not null").distinct().withColumn("g", F.expr(f"id div {width}"))
    n = own.agg(F.count("*").alias("n"))
    rows = ranked(own, "id", "g").crossJoin(F.broadcast(n))  # one row
    return rows.select("id", F.expr(f"(rank * {shards} - 1) div n").alias("shard"))


def committed_counts(chunks_on_disk: DataFrame, exact_index: DataFrame) -> DataFrame:
    """(chunk_id, primes) for chunks on disk, 0 where the exact index has no row."""
    return chunks_on_disk.select("chunk_id").distinct().join(exact_index.select("chunk_id", "prime_count"), "chunk_id", "left").select("chunk_id", F.coalesce("prime_count", F.lit(0)).cast("long").alias("primes"))


def repair_check(rebuilt: DataFrame, expected: DataFrame) -> DataFrame:
    """(chunk_id, fine): whether rebuilt chunks have the count and bounds of the index."""
    own = index(rebuilt).select("chunk_id", F.col("prime_count").alias("n"), F.col("first_prime").alias("a"), F.col("last_prime").alias("b"))
    fine = F.col("n").eqNullSafe(F.col("prime_count")) & F.col("a").eqNullSafe(F.col("first_prime")) & F.col("b").eqNullSafe(F.col("last_prime"))
    return expected.join(own, "chunk_id", "left").select("chunk_id", F.coalesce(fine, F.lit(False)).alias("fine"))


def rebuild(ranges: DataFrame, width: int = SEGMENT) -> DataFrame:
    """(chunk_id, p) of lost chunks, sieved anew from rows (chunk_id, first_prime, last_prime).

    Ranges are cut into segments that are dealt out evenly; one row with the
    highest bound reaches the driver.
    """
    highest = ranges.agg(F.max("last_prime")).first()[0]
    shared = shared_base(ranges.sparkSession, (highest or 0) + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = shared.value
        for frame in frames:
            for chunk, lo, hi in frame.itertuples(index=False):
                found = window_primes(int(lo), int(hi), base)
                yield pd.DataFrame({"chunk_id": [chunk] * len(found), "p": found}).astype("int64")

    parts = ranges.where("first_prime is not null").select("chunk_id", "first_prime", "last_prime", F.explode(F.expr(f"sequence(first_prime div {width}, last_prime div {width})")).alias("s"))
    parts = parts.select("chunk_id", F.greatest("first_prime", F.col("s") * width).alias("lo"), (F.least("last_prime", (F.col("s") + 1) * width - 1) + 1).alias("hi"))
    return parts.repartition("chunk_id", "lo").mapInPandas(run, "chunk_id long, p long")


def coverage(wheel: DataFrame, expected_chunks: int) -> DataFrame:
    """One row: chunks on disk, missing ids of 0 to expected - 1, whether all is there."""
    spark = wheel.sparkSession
    gaps = missing(spark.range(expected_chunks).select(F.col("id").alias("chunk_id")), wheel)
    have = wheel.select("chunk_id").distinct().agg(F.count("*").alias("chunks"))
    return have.crossJoin(gaps.agg(F.count("*").alias("missing"))).select("chunks", "missing", ((F.col("missing") == 0) & (F.col("chunks") == expected_chunks)).alias("healthy"))


def status(progress: DataFrame, checkpoint: DataFrame, manifest: DataFrame, wheel: DataFrame, exact_index: DataFrame, alive: bool) -> DataFrame:
    """One row with the three layers of truth: what is claimed, what is durable, what is in memory only.

    durable comes from the manifest, else the checkpoint, else the progress
    report; buffered is what the progress report says or claims beyond durable,
    and 0 if the process is gone; queryable leaves out the primes of missing
    chunks. Single-row inputs, each may be empty.
    """
    def one(df: DataFrame, **columns: str) -> DataFrame:
        return df.agg(*(F.max(F.col(c).cast("long")).alias(alias) for alias, c in columns.items()))

    facts = one(progress, claimed="found_count", target="target_count", told="archive_buffered_primes", last_prime="last_prime")
    facts = facts.crossJoin(one(checkpoint, checkpointed="archive_committed_primes")).crossJoin(one(manifest, committed="committed_primes", committed_chunks="committed_chunks"))
    have = wheel.select("chunk_id").distinct().agg(F.count("*").alias("chunks"))
    lost = missing(exact_index, wheel).join(exact_index, "chunk_id").agg(F.coalesce(F.sum("prime_count"), F.lit(0)).alias("missing_primes"), F.count("*").alias("missing_chunks"))
    row = facts.crossJoin(have).crossJoin(lost).withColumn("durable", F.coalesce("committed", "checkpointed", "claimed", F.lit(0).cast("long")))
    buffered = F.coalesce("told", F.greatest(F.lit(0).cast("long"), F.col("claimed") - F.col("durable")), F.lit(0).cast("long")) if alive else F.lit(0).cast("long")
    state = F.lit("running") if alive else F.when((F.col("target") > 0) & (F.col("durable") >= F.col("target")), "done").otherwise("stale")
    return row.select(
        F.coalesce("claimed", F.lit(0).cast("long")).alias("claimed"),
        "target",
        "last_prime",
        "durable",
        buffered.alias("buffered"),
        (F.col("durable") - F.col("missing_primes")).alias("queryable"),
        "missing_chunks",
        ((F.col("missing_chunks") == 0) & F.col("chunks").eqNullSafe(F.coalesce("committed_chunks", "chunks"))).alias("healthy"),
        state.alias("run_state"),
    )


def throughput(reports: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, time, value, delta, seconds, per_second) against the report before, for each key."""
    w = Window.partitionBy(key).orderBy(time)
    seconds = F.col(time).cast("double") - F.lag(F.col(time).cast("double")).over(w)
    rows = reports.select(key, time, value, (F.col(value) - F.lag(value).over(w)).alias("delta"), seconds.alias("seconds"))
    return rows.withColumn("per_second", F.try_divide("delta", "seconds"))
