"""Answers about numbers as they arrive: is it prime, its smallest divisor, the next prime.

    python -m jobs.answer_stream --tables TABLES --output OUT

A file stream takes the files of the input tables that no run before has seen; its
checkpoint is OUT/checkpoint. Each micro-batch answers the numbers that no batch
before has answered, and replaces its own folder when it is tried again, so that
every number has one answer however often the job runs or breaks off:

    OUT/answers/batch=B/part=P    n, is_prime, divisor, next_prime
    OUT/progress/batch=B          read, answered, largest

part is n div ``numbers_per_folder``: only parts in which a batch has numbers are
looked at for earlier answers. Null and negative keys are left out; numbers below 2
are not prime and have no divisor; a number behind the last prime of a long has no next
one. A batch's row in progress is written when its answers are.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main
from numera.operators.primality import is_prime, smallest_divisor
from numera.operators.successor import next_prime

ANSWERS = "n long, is_prime boolean, divisor long, next_prime long, batch long, part long"
#: Parts that a batch names one by one; of more it takes the range.
MOST_PARTS = 1000
#: The last prime below 2^63.
LAST_PRIME = 2**63 - 25
PROGRESS = "read long, answered long, largest long"


def arriving(spark: SparkSession, config: dict) -> DataFrame:
    """The keys of all input tables as one stream (n)."""
    streams = []
    for source in config["inputs"]:
        path = f"{config['tables']}/{source['table']}.parquet"
        # as a pattern the path may be a file or a folder
        pattern = f"{path[:-1]}[{path[-1]}]"
        rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", config["max_files_per_batch"]).parquet(pattern)
        streams.append(rows.select(F.col(source["key"]).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, streams)


def stored(spark: SparkSession, config: dict) -> DataFrame:
    return spark.read.schema(ANSWERS).parquet(f"{config['output']}/answers")


def unanswered(numbers: DataFrame, before: DataFrame, size: int) -> DataFrame:
    """The distinct numbers (n, part) that ``before`` has no answer for."""
    own = numbers.where(F.col("n") >= 0).distinct().withColumn("part", F.expr(f"n div {size}"))
    parts = [r[0] for r in own.select("part").distinct().limit(MOST_PARTS + 1).collect()]
    if len(parts) > MOST_PARTS:
        lo, hi = own.agg(F.min("part"), F.max("part")).first()
        before = before.where(F.col("part").between(lo, hi))
    else:
        before = before.where(F.col("part").isin(parts))
    return own.join(before.select("n"), "n", "left_anti")


def answered(numbers: DataFrame) -> DataFrame:
    """(n, is_prime, divisor, next_prime, part) for rows (n, part)."""
    prime = is_prime(numbers)
    # a prime has no divisor, so only the others are divided
    others = smallest_divisor(prime.where(~F.col("is_prime") & (F.col("n") >= 2)))
    following = next_prime(numbers.where(F.col("n") < LAST_PRIME))
    return numbers.join(prime, "n").join(others, "n", "left").join(following, "n", "left").select("n", "is_prime", "divisor", "next_prime", "part")


def run(spark: SparkSession, config: dict) -> dict:
    """Takes what is new and waits until it is answered; returns what it read and wrote, which it logs as well."""
    out, done = config["output"], {"batches": 0, "read": 0, "answered": 0}

    def answer(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(ANSWERS).parquet(f"{out}/answers").where(F.col("batch") < number) if number else session.createDataFrame([], ANSWERS)
        fresh = unanswered(batch, before, config["numbers_per_folder"]).persist()
        try:
            own = f"{out}/answers/batch={number}"
            answered(fresh).write.mode("overwrite").partitionBy("part").parquet(own)
            row = fresh.agg(F.lit(batch.count()).alias("read"), F.count("*").alias("answered"), F.max("n").alias("largest"))
            row.coalesce(1).write.mode("overwrite").parquet(f"{out}/progress/batch={number}")
        finally:
            fresh.unpersist()
        row = session.read.schema(PROGRESS).parquet(f"{out}/progress/batch={number}").first()
        counts = {"batches": 1, "read": row["read"], "answered": row["answered"]}
        for k, v in counts.items():
            done[k] += v
        log.info("answer_stream batch %d read %d keys, wrote %d answers to %s", number, counts["read"], counts["answered"], own)

    query = arriving(spark, config).writeStream.foreachBatch(answer).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("answer_stream: %s", done)
    return done


def output(spark: SparkSession, config: dict) -> DataFrame:
    """The answers of all batches."""
    return stored(spark, config).drop("batch", "part")


if __name__ == "__main__":
    sys.exit(main("answer_stream", run))
