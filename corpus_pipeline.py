"""A training corpus from ``documents``: toxicity, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``docs``, whatever their names.
Results are written as Parquet between the stages, so a lost executor costs one
stage at most. In every stage an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numera.llm import bpe, exact_dedup, mixing, near_copies, toxicity
from numera.llm.common import free_name, shared_folder, table

#: Scores from which on a document is rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below ``TOXIC``.

    It learns from those of ``docs`` that ``labels`` marks and that are not
    held out. Null and empty texts have no term and get the bias alone, that of
    most documents; very long texts are scored whole; rows that repeat, and
    equal texts, score alike and stay or go together.
    """
    machine, name = toxicity.train(docs, table(spark, sf_dir, "labels")), free_name(docs, "__score")
    return toxicity.score(docs, machine, name=name).where(F.col(name) < TOXIC).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without ASCII white space.

    The row with the most code points in its text stays, then the smallest id,
    null last; of rows equal in both one. Null, empty and blank texts are one
    group; whole texts are compared, however long.
    """
    return exact_dedup.exact_survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of five-word shingles with a similarity of 0.8 or more connect.

    The row with the smallest id stays, null last, then by row key; of rows
    equal in id and text one. Null, empty and blank texts are like no other;
    texts under five words are one shingle; long texts count whole.
    """
    return near_copies.near_survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes their words, three times at most.

    Whole texts only: a part counts as the text if it is half of it or more.
    Texts without a word go; a null source is a source of its own; equal rows
    share what is taken of them.
    """
    return mixing.copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every whole text; a null text counts as empty,
    rows that repeat are encoded each."""
    return bpe.encode(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: Training, SimHash and BPE are beyond SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again.

    The folder is below the session's spark.checkpoint.dir. A stage's result is
    removed when the next one is written; the last one is what is returned.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    before = None
    for k, (name, stage) in enumerate(STAGES):
        own = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(own)
        docs = spark.read.parquet(own)
        if before:
            old = path(before)
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        before = own
    return docs
