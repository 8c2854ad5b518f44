"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"
WHITE_BYTES = WHITE.encode()
#: A word for the JVM's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a key is looked up by a shuffle like any other.
HOT_ROWS = 1000
#: Rows that a table which is sent to all executors has at most.
MOST_BROADCAST = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process (local tests) a
    temporary one is made; on a cluster the setting is needed.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="numera-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, Python gets so many rows at a time: for wide rows, of which a usual batch takes too much memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """True where crc32(doc_id as text) mod ``mod`` is ``rest``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def row_keys(*values: Column) -> list[Column]:
    """128 bits that name a row by some of its columns, nulls told from anything else."""
    parts = [part for v in values for part in (v.isNull(), F.coalesce(v.cast("string"), F.lit("")))]
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if a column of ``df`` has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lookup(rows: DataFrame, partners: DataFrame, keys: list[str], weight: str, total: int | None = None) -> DataFrame:
    """``rows`` joined to ``partners``, which has one narrow row a key, without a task that gets all rows of a key.

    ``weight`` says how many rows each partner meets, ``total`` is the sum of
    it. Partners that meet many are sent to all executors, at most
    ``MOST_BROADCAST`` of them, whatever the weights are; only the others meet
    by a shuffle. Both sides are read twice.
    """
    if total is None:
        total = partners.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = max(HOT_ROWS, total // MOST_BROADCAST)
    many = partners.where(F.col(weight) > hot).drop(weight)
    few = partners.where(F.col(weight) <= hot).drop(weight)
    met = rows.join(F.broadcast(many), keys)
    return met.unionByName(rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(few, keys))


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows of ``docs`` whose two ``keys`` are not in ``gone`` (k1, k2); of those in ``repeated`` one each.

    The texts are shuffled only where ``gone`` or ``repeated`` is too long to be
    sent to all executors, and the repeated ones among each other.
    """
    names = [free_name(docs, "__k1"), free_name(docs, "__k2")]
    keyed = docs.select("*", *(k.alias(n) for k, n in zip(keys, names)))

    def side(found: DataFrame) -> DataFrame:
        own = found.select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1]))
        return F.broadcast(own) if found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else own

    kept = keyed.join(side(gone), names, "left_anti")
    if repeated.limit(1).count():
        again = side(repeated)
        kept = kept.join(again, names, "left_anti").unionByName(kept.join(again, names, "left_semi").dropDuplicates(names))
    return kept.select(*docs.columns)
