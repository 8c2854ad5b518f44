"""Counting up to a rank in batches of segments, with durable state, progress and resumption.

A batch writes its primes to a folder of its own and is committed by the state
row that follows; readers look at committed batches only. A batch that fails is
written again under the same number, so every prime counts once. Each commit
also appends a row to the progress table. Batches grow and shrink so that a
commit comes about every so many seconds.
"""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numera.functions.integers import DIRECT_PRIMES, nth_prime_bound
from numera.operators.sieve import nth_prime, primes
from numera.plans.segments import SEGMENT, ranked
from numera.sources.store import archive_seed

STATE = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("target", T.LongType()),
        T.StructField("found", T.LongType()),
        T.StructField("last_prime", T.LongType()),
        T.StructField("next_n", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("format", T.LongType()),
    ]
)
#: The format of the state that this module writes; rows without one are of the first.
FORMAT = 1
PROGRESS = "version long, target long, found long, last_prime long, segments long, batch_found long, batch_seconds double, seconds double, per_second double, percent double, eta double"
#: Segments in a batch at most, however fast they are.
MOST_SEGMENTS = 1 << 16


class ResumeError(ValueError):
    """Resuming was demanded, but there is nothing to resume from."""


def load_state(spark: SparkSession, path: str) -> dict | None:
    """The newest committed state row, None without one; one of an unknown format, or that contradicts itself, is an error."""
    try:
        rows = spark.read.schema(STATE).parquet(f"{path}/state")
    except AnalysisException:
        return None
    newest = rows.orderBy(F.desc("version")).limit(1).collect()
    if not newest:
        return None
    state = newest[0].asDict()
    if (state.pop("format") or FORMAT) != FORMAT:
        raise ResumeError(f"state of another format: {path}")
    if any(state[k] is None or state[k] < 0 for k in ("target", "found", "next_n")) or (state["found"] > 0) != (state["last_prime"] is not None):
        raise ResumeError(f"state that contradicts itself: {path}")
    return state


def decide(state: dict | None, resume: str, target: int) -> tuple[dict | None, str]:
    """What a run begins from, and why. resume: never, auto or always.

    never is a fresh start whatever is there; auto resumes if it can; always
    demands it. A state that found more than the target is cut at the target.
    """
    if resume not in ("never", "auto", "always"):
        raise ValueError(f"resume: {resume}")
    if resume == "never":
        return None, "fresh: resuming is off"
    if state is None:
        if resume == "always":
            raise ResumeError("no committed state")
        return None, "fresh: no committed state"
    if state["found"] >= target:
        return state, "resumed: already complete"
    return state, "resumed"


def newer(state: dict | None, seed: dict | None, target: int) -> dict | None:
    """The state a run continues from: the archive's, if it found more than the committed one and not more than asked."""
    if seed is None or seed["found"] > target or (state and state["found"] >= seed["found"]):
        return state
    base = state or {"version": 0, "seconds": 0.0}
    return {**base, "target": target, "found": seed["found"], "last_prime": seed["last_prime"], "next_n": seed["last_prime"] + 1}


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(rank, p) of all primes that batches committed; those a run took from an archive are there."""
    state = load_state(spark, path)
    if state is None:
        return spark.range(0).selectExpr("id as rank", "id as p")
    return spark.read.parquet(*[f"{path}/primes/batch={v}" for v in range(1, state["version"] + 1)]).select("rank", "p")


def progress(spark: SparkSession, path: str) -> DataFrame:
    """A row for each commit: what was found so far and by the batch, its segments and seconds, the rate, percent and seconds to go."""
    try:
        return spark.read.schema(PROGRESS).parquet(f"{path}/progress")
    except AnalysisException:
        return spark.createDataFrame([], PROGRESS)


@contextmanager
def stop_on_signals(*signals: signal.Signals) -> Iterator[Callable[[], bool]]:
    """Gives a ``stop`` that turns true at the first of the signals (by default SIGINT and SIGTERM): the batch that runs is still
    committed. A second signal acts as it did before; so do all when the block ends. In the main thread only."""
    flag, before = threading.Event(), {}

    def caught(number: int, frame: object) -> None:
        flag.set()
        signal.signal(number, before[number])

    for s in signals or (signal.SIGINT, signal.SIGTERM):
        before[s] = signal.signal(s, caught)
    try:
        yield flag.is_set
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)


def _next_size(segments: int, took: float, every: float | None) -> int:
    """Segments of the next batch: as many as take ``every`` seconds at the last one's rate, a quarter to four times as many."""
    if not every:
        return segments
    wanted = int(segments * every / took) if took > 0 else 4 * segments
    return max(1, segments // 4, min(wanted, 4 * segments, MOST_SEGMENTS))


def first_n(spark: SparkSession, target: int, path: str, resume: str = "auto", width: int = SEGMENT, batch_segments: int = 256, stop: Callable[[], bool] = lambda: False, archive: str | None = None, every: float | None = None, report: Callable[[dict], None] = lambda row: None) -> DataFrame:
    """One row: target, found, last_prime, batches, complete, resumed, reason, seconds, per_second.

    ``stop`` is asked after each batch. Batches are bounded, so nothing grows
    with the target but the files; with ``every`` their size follows the seconds
    between commits. ``report`` gets each row of the progress table. With
    ``archive`` a run that may resume continues from that archive where it found
    more than the committed state.
    """
    stored = load_state(spark, path) if resume != "never" else None
    seeded = newer(stored, archive_seed(spark, archive), target) if archive and resume != "never" else stored
    before, reason = decide(seeded, resume, target)
    if seeded is not stored:
        reason += " from the archive"
    version = (load_state(spark, path) or {"version": 0})["version"] if before or resume != "never" else 0
    state = before or {"version": 0, "target": target, "found": 0, "last_prime": None, "next_n": 0, "seconds": 0.0}
    if not before and version == 0:
        _clear(spark, path)
    began, hi, batches = time.monotonic(), nth_prime_bound(target) + 1, 0
    while state["found"] < target and state["next_n"] < hi:
        end = min(hi, (state["next_n"] // width + batch_segments) * width)
        number = state["version"] + 1
        rows = ranked(primes(spark, state["next_n"], end, width), "p", "segment").select((F.col("rank") + state["found"]).alias("rank"), "p").where(F.col("rank") <= target)
        begun, from_n = time.monotonic(), state["next_n"]
        rows.write.mode("overwrite").parquet(f"{path}/primes/batch={number}")
        got = spark.read.parquet(f"{path}/primes/batch={number}").agg(F.count("*").alias("n"), F.max("p").alias("p")).first()
        last = got["p"] if got["p"] is not None else state["last_prime"]
        found = state["found"] + got["n"]
        state = {"version": number, "target": target, "found": found, "last_prime": last, "next_n": last + 1 if found >= target else end, "seconds": state["seconds"] + time.monotonic() - began}
        began = time.monotonic()
        spark.createDataFrame([tuple((state | {"format": FORMAT})[f.name] for f in STATE)], STATE).coalesce(1).write.mode("append").parquet(f"{path}/state")
        batches += 1
        row = _progress_row(state, -(-(end - from_n) // width), got["n"], time.monotonic() - begun)
        spark.createDataFrame([tuple(row.values())], PROGRESS).coalesce(1).write.mode("append").parquet(f"{path}/progress")
        report(row)
        batch_segments = _next_size(batch_segments, row["batch_seconds"], every)
        if stop():
            break
    found = min(state["found"], target)
    last = state["last_prime"]
    if state["found"] > target:
        # ranks that a run took from an archive were not written, and are counted anew
        row = (committed(spark, path).where(F.col("rank") == target).first() or nth_prime(spark, target, width).first()) if target > 0 else None
        last = row["p"] if row else None
    row = (target, found, last, batches, found >= target, before is not None, reason, state["seconds"], found / state["seconds"] if state["seconds"] else None)
    return spark.createDataFrame([row], "target long, found long, last_prime long, batches int, complete boolean, resumed boolean, reason string, seconds double, per_second double")


def _progress_row(state: dict, segments: int, found: int, seconds: float) -> dict:
    total = state["found"] / state["seconds"] if state["seconds"] else None
    # of the last batch, else of the whole run
    rate = found / seconds if found and seconds else total
    left = max(0, state["target"] - state["found"])
    percent = min(100.0, 100.0 * state["found"] / state["target"]) if state["target"] else 0.0
    row = {k: state[k] for k in ("version", "target", "found", "last_prime")} | {"segments": segments, "batch_found": found, "batch_seconds": seconds}
    return row | {"seconds": state["seconds"], "per_second": rate, "percent": percent, "eta": 0.0 if not left else left / rate if rate else None}


def _clear(spark: SparkSession, path: str) -> None:
    """Forget an earlier run's folders, for a fresh start."""
    jvm = spark.sparkContext._jvm
    for part in ("state", "primes", "progress"):
        own = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def eta(reports: DataFrame) -> DataFrame:
    """(found, target, last_prime, seconds, eta): seconds to go by the first rule that applies:
    nothing left; primes left at the rate so far; null where there is no rate."""
    left = F.col("target") - F.col("found")
    rate = F.try_divide(F.col("found").cast("double"), F.col("seconds"))
    return reports.select("found", "target", "last_prime", "seconds", F.when(left <= 0, 0.0).otherwise(F.try_divide(left.cast("double"), rate)).alias("eta"))


def seconds_to_go(found: Column, target: Column, last_prime: Column, primes_per_second: Column, positions_per_second: Column) -> Column:
    """Nothing left: 0; else what is left at the steady rate of primes; else at the rate of candidate positions, of which a
    share is prime that follows from the density so far, four in ten numbers being candidates; else null."""
    left = (target - found).cast("double")
    share = found.cast("double") / last_prime / 0.4
    known = (positions_per_second > 0) & (last_prime > 0) & (found > len(DIRECT_PRIMES))
    return F.when(left <= 0, 0.0).when(primes_per_second > 0, left / primes_per_second).when(known, left / share / positions_per_second)


def percent(found: Column, target: Column) -> Column:
    """Percent of the target, 0 to 100; 0 for a target of 0."""
    return F.when(target == 0, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), found.cast("double") * 100 / F.when(target != 0, target))))


def gib(size: Column) -> Column:
    return size.cast("double") / 1024 / 1024 / 1024


def segment_stream(spark: SparkSession, path: str, width: int = SEGMENT, rows_per_batch: int = 16):
    """A streaming query that sieves segment after segment into ``path``/stream, one micro-batch after the other.

    Its checkpoint makes each segment's primes appear once.
    """
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", 1).load()

    def sieve(batch: DataFrame, number: int) -> None:
        lo, hi = number * rows_per_batch * width, (number + 1) * rows_per_batch * width
        primes(spark, lo, hi, width).write.mode("overwrite").parquet(f"{path}/stream/batch={number}")

    return source.writeStream.foreachBatch(sieve).option("checkpointLocation", f"{path}/stream-checkpoint").start()
