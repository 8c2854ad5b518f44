"""JSON requests about numbers as rows, and their JSON responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numera.operators import stored
from numera.operators.primality import NullProver, Prover, is_prime_big, next_prime_big, parsed_long, preview, prove, validated_request
from numera.operators.proofs import next_prime_proven
from numera.plans.lookups import looked_up

#: What can be asked: longs from the archive, numbers of any size by computing.
LONG_KINDS = ("is-prime", "next-prime")
BIG_KINDS = ("is-prime-big", "next-prime-big", "is-prime-big-proven", "next-prime-big-proven")
MOST_DIGITS = 100_000
SNIPPET = 200


def _number(body: Column) -> Column:
    """The string in the field n of a JSON object; null where there is none."""
    own = F.try_variant_get(F.try_parse_json(body), "$.n", "variant")
    return F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(own, "$", "string"))


def _failed(rows: DataFrame) -> DataFrame:
    return rows.select("id", "kind", F.lit(400).alias("status"), F.to_json(F.struct("error")).alias("response"))


def _responses(rows: DataFrame, *fields: str | Column) -> DataFrame:
    """200 with the fields, those that are null left out; 400 where ``error`` is set."""
    body = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(F.to_json(F.struct(*fields)))
    return rows.select("id", "kind", F.when(F.col("error").isNotNull(), 400).otherwise(200).alias("status"), body.alias("response"))


def answered(requests: DataFrame, archive: str | None = None, prover: Prover | None = None, max_digits: int = MOST_DIGITS) -> DataFrame:
    """(id, kind, status, response) of requests (id, kind, body): 200 and an answer, 400 and an error, 404 for an unknown kind.

    The body is a JSON object with the number as a string n. is-prime and
    next-prime are answered from the archive at ``archive``, an error where it
    does not cover the number; the other kinds are computed, the proven ones
    with ``prover``. Each number is answered once, however often it is asked.
    A null body or kind is answered like a wrong one; repeated requests are
    answered each.
    """
    prover = prover or NullProver()
    asked = requests.select("id", "kind", _number(F.col("body")).alias("n"))
    known = F.coalesce(F.col("kind").isin(*LONG_KINDS, *BIG_KINDS), F.lit(False))
    out = asked.where(~known).select("id", "kind", F.lit(404).alias("status"), F.to_json(F.struct(F.lit("not found").alias("error"))).alias("response"))
    out = out.unionByName(_failed(asked.where(known & F.col("n").isNull()).withColumn("error", F.lit("invalid JSON request"))))
    asked = asked.where(known & F.col("n").isNotNull())
    # only kinds that occur get a plan; there are six
    occurring = {r[0] for r in requests.where(F.col("kind").isin(*LONG_KINDS, *BIG_KINDS)).select("kind").distinct().collect()}

    longs = asked.where(F.col("kind").isin(*LONG_KINDS)).select("id", "kind", F.col("n").alias("text"), parsed_long(F.col("n")).alias("v")).select("id", "kind", "text", "v.error", F.col("v.value").alias("n"))
    out = out.unionByName(_failed(longs.where(F.col("error").isNotNull())))
    longs = longs.where(F.col("error").isNull()).drop("error")
    uncovered = F.when(F.col("state") != "ok", "uncovered").alias("error")
    for kind, field in zip(LONG_KINDS, ("is_prime", "next_prime")):
        if kind not in occurring:
            continue
        own = longs.where(F.col("kind") == kind)
        if archive is None:
            out = out.unionByName(_failed(own.withColumn("error", F.lit("no archive"))))
            continue
        if kind == "is-prime":
            facts = stored.is_prime(own, archive).withColumnRenamed("status", "state")
        else:
            source = F.when(F.col("n") < 7, "rule").otherwise("archive").alias("source")
            facts = stored.next_prime(own, archive).select("n", F.col("next_prime").cast("string").alias("next_prime"), source, F.col("status").alias("state"))
        rows = looked_up(own, facts, "n").select("id", "kind", F.col("text").alias("n"), field, "source", uncovered)
        out = out.unionByName(_responses(rows, "n", field, "source"))

    bigs = asked.where(F.col("kind").isin(*BIG_KINDS)).select("id", "kind", validated_request(F.col("n"), max_digits).alias("v")).select("id", "kind", "v.error", F.col("v.value").alias("text"))
    out = out.unionByName(_failed(bigs.where(F.col("error").isNotNull())))
    bigs = bigs.where(F.col("error").isNull()).drop("error")
    shown = [preview(F.col("text")).alias("n_preview"), F.length("text").alias("n_digits")]
    proof = F.col("certificate")
    snippet = F.when(F.length(proof) > SNIPPET, F.concat(F.left(proof, F.lit(SNIPPET)), F.lit("…"))).otherwise(proof)
    proven = [proof.isNotNull().alias("certificate_available"), snippet.alias("certificate_snippet")]
    prime = F.col("status") == "probable_prime"
    none = F.lit(None).cast("string")
    for kind in BIG_KINDS:
        if kind not in occurring:
            continue
        own = bigs.where(F.col("kind") == kind)
        numbers = own.select("text").distinct()
        if kind == "is-prime-big":
            facts = is_prime_big(numbers, max_digits=max_digits).select("text", "error", prime.alias("is_prime"), "status")
            fields: list[str | Column] = ["is_prime", F.col("state").alias("status")]
        elif kind == "next-prime-big":
            facts = next_prime_big(numbers, max_digits=max_digits).select("text", "error", F.col("p").alias("next_prime"), none.alias("status"))
            fields = ["next_prime"]
        elif kind == "is-prime-big-proven":
            told = F.when(prime & F.col("proven"), "proven_prime").otherwise(F.col("status"))
            facts = prove(numbers, prover).select("text", "error", prime.alias("is_prime"), told.alias("status"), "certificate")
            fields = ["is_prime", F.col("state").alias("status"), *proven]
        else:
            told = F.when(F.col("proven"), "proven_prime").otherwise("probable_prime")
            facts = next_prime_proven(numbers, prover).select("text", "error", F.col("p").alias("next_prime"), told.alias("status"), "certificate")
            fields = ["next_prime", F.col("state").alias("status"), *proven]
        rows = looked_up(own, facts.withColumnRenamed("status", "state"), "text")
        out = out.unionByName(_responses(rows, *shown, *fields))
    return out
