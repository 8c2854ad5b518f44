"""Audit of the numbers in texts: where each stands, and whether it is prime.

    python -m jobs.number_audit --tables TABLES --output OUT

Every stretch of ASCII digits in the texts of the configured sources is a number;
leading zeros don't count. Three steps, each written with Spark and read again, so
that a lost executor, or a run that is broken off, costs one step at most:

    OUT/occurrences/source=S    id, number, occurrences
    OUT/answers/digits=D        number, status, divisor, witness
    OUT/numbers/source=S/status=T   all of these, a row for each source, id and number

status: prime, probable_prime (above 3.3 * 10^24, where the strong tests are no
proof), composite, neither (0 and 1) or too_long (more than ``max_digits``).
divisor: the smallest prime one up to a million; witness: else the base that shows
a composite. Rows whose id is null keep it; null texts have no numbers.

Every run replaces what the run before wrote, so a rerun gives the same result.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main
from numera.operators.primality import is_prime_big
from numera.plans.lookups import looked_up

#: Below this the strong tests decide.
PROVEN_BELOW = "3317044064679887385961981"

OCCURRENCES = "id long, number string, occurrences long"
ANSWERS = "number string, status string, divisor string, witness long, digits int"
NUMBERS = "id long, number string, occurrences long, divisor string, witness long, source string, status string"


def numbers_of(text: Column) -> Column:
    """The numbers in a text, in order, as strings without leading zeros."""
    return F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda n: F.regexp_replace(n, "^0+(?=[0-9])", ""))


def occurrences(texts: DataFrame) -> DataFrame:
    """(id, number, occurrences) of rows (id, text); counted where the text is read before anything moves."""
    rows = texts.select("id", F.explode(numbers_of(F.col("text"))).alias("number"))
    return rows.groupBy("id", "number").agg(F.count("*").alias("occurrences"))


def answers(numbers: DataFrame, max_digits: int) -> DataFrame:
    """A row for each distinct number."""
    told = is_prime_big(numbers.select("number").distinct(), "number", max_digits)
    small = (F.length("text") < len(PROVEN_BELOW)) | ((F.length("text") == len(PROVEN_BELOW)) & (F.col("text") < PROVEN_BELOW))
    status = (
        F.when(~F.col("ok"), F.col("error"))
        .when(F.col("text").isin("0", "1"), "neither")
        .when(F.col("status") == "composite", "composite")
        .otherwise(F.when(small, "prime").otherwise("probable_prime"))
    )
    divisor = F.when(~F.col("text").isin("0", "1"), F.col("divisor"))
    return told.select(F.col("text").alias("number"), status.alias("status"), divisor.alias("divisor"), "witness", F.length("text").alias("digits"))


def run(spark: SparkSession, config: dict) -> dict:
    """Does all three steps; returns what was read and written, which it logs as well."""
    out, done = config["output"], {}
    for source in config["sources"]:
        name = source["table"]
        table = spark.read.parquet(f"{config['tables']}/{name}.parquet")
        texts = table.select(F.col(source["id"]).cast("long").alias("id"), F.col(source["text"]).cast("string").alias("text"))
        occurrences(texts).write.mode("overwrite").parquet(f"{out}/occurrences/source={name}")
        # the counts come from the files' own statistics
        done[name] = {"read": table.count(), "found": spark.read.schema(OCCURRENCES).parquet(f"{out}/occurrences/source={name}").count()}
        log.info("number_audit %s: %s", name, done[name])
    places = [f"{out}/occurrences/source={s['table']}" for s in config["sources"]]
    found = spark.read.schema(f"{OCCURRENCES}, source string").option("basePath", f"{out}/occurrences").parquet(*places)

    answers(found, config["max_digits"]).write.mode("overwrite").partitionBy("digits").parquet(f"{out}/answers")
    told = spark.read.schema(ANSWERS).parquet(f"{out}/answers").drop("digits")
    done["answers"] = {r["status"]: r["count"] for r in told.groupBy("status").count().collect()}
    log.info("number_audit answered: %s", done["answers"])

    for source in config["sources"]:
        name = source["table"]
        # a number that stands in a third of all texts is looked up apart
        rows = looked_up(found.where(F.col("source") == name).drop("source"), told, "number")
        rows.write.mode("overwrite").partitionBy("status").parquet(f"{out}/numbers/source={name}")
        done[name]["wrote"] = output(spark, config).where(F.col("source") == name).count()
        log.info("number_audit wrote numbers/source=%s: %d", name, done[name]["wrote"])
    return done


def output(spark: SparkSession, config: dict) -> DataFrame:
    """The rows of OUT/numbers."""
    return spark.read.schema(NUMBERS).parquet(f"{config['output']}/numbers")


if __name__ == "__main__":
    sys.exit(main("number_audit", run))
