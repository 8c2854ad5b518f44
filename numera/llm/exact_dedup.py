"""Exact deduplication by Grace hashing.

Records are dealt out by a hash of their normalised content, first among
Spark's partitions and then, inside a task, among spill files, until the
distinct contents of a bucket fit an open-addressing table that compares
complete contents. Each input partition is deduplicated before the shuffle, so
a group of copies sends one record per input partition, however large it is.

The table of a pass is frozen when it reaches its budget: records that match a
frozen entry are settled in that pass, all others go to spill files by the
next bits of their hash and get a pass of their own. A text with many copies
therefore never has to fit in memory more than once.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numera.llm.common import WHITE, WHITE_BYTES, checkpoint, free_name, lookup, row_keys

#: Bytes that a bucket's table may hold: contents and the rows that stay.
BUDGET = 96 << 20
#: Spill files that one pass deals to.
FAN_OUT = 16
_BATCH_BYTES = 16 << 20


def normalised(text: str | bytes | None) -> bytes:
    """UTF-8 of the text without ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(None, WHITE_BYTES)


class ContentTable:
    """Open addressing with linear probing; equality compares whole contents.

    Beside each entry's content it holds the number of its records and the one
    that stays: most code points in the original text, then smallest id (null
    last). All that it holds counts in ``bytes``.
    """

    def __init__(self) -> None:
        self.mask = 1023
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0
        self.counts: list[int] = []
        self.ranks: list[tuple] = []
        self.rows: list[pa.RecordBatch] = []

    def find(self, h: int, content: bytes, add: bool) -> int:
        """Number of the entry with this content; -1 if there is none and ``add`` is false."""
        at = h & self.mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            at = (at + 1) & self.mask
        if not add:
            return -1
        self.slots[at] = e = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.counts.append(0)
        self.bytes += len(content) + 256
        if 2 * len(self.hashes) > self.mask:
            self._grow()
        return e

    def _grow(self) -> None:
        self.mask = 4 * (self.mask + 1) - 1
        self.slots = [-1] * (self.mask + 1)
        for e, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = e

    def settle(self, e: int, count: int, rank: tuple, batch: pa.RecordBatch, i: int) -> None:
        """Row ``i`` of ``batch`` stands for ``count`` records of entry ``e``."""
        self.counts[e] += count
        if e == len(self.rows):
            self.ranks.append(rank)
            self.rows.append(batch.slice(i, 1))
        elif rank < self.ranks[e]:
            self.ranks[e] = rank
            self.rows[e] = batch.slice(i, 1)

    def own_rows(self, first: int, batch: pa.RecordBatch, changed: set[int]) -> None:
        """Copy the rows that a batch gave to the entries from ``first`` on or ``changed``, so that it can go."""
        mine = sorted(changed | set(range(first, len(self.rows))))
        if not mine:
            return
        taken = pa.concat_batches([self.rows[e] for e in mine])
        for k, e in enumerate(mine):
            self.rows[e] = taken.slice(k, 1)
        self.bytes += taken.nbytes

    def best(self) -> Iterator[tuple[pa.RecordBatch, int, int]]:
        """The rows that stay, in order, in batches of bounded size with the numbers of their entries."""
        at = size = 0
        for e, row in enumerate(self.rows):
            size += row.nbytes
            if size >= _BATCH_BYTES or e - at >= 4095:
                yield pa.concat_batches(self.rows[at : e + 1]), at, e + 1
                at, size = e + 1, 0
        if at < len(self.rows):
            yield pa.concat_batches(self.rows[at:]), at, len(self.rows)


class _Spill:
    """``FAN_OUT`` Arrow files in the task's scratch folder, gone when the task ends."""

    def __init__(self, folder: str, schema: pa.Schema) -> None:
        self.paths = []
        for _ in range(FAN_OUT):
            handle, path = tempfile.mkstemp(dir=folder)
            os.close(handle)
            self.paths.append(path)
        self.writers = [pa.ipc.new_stream(p, schema) for p in self.paths]

    def write(self, batch: pa.RecordBatch, part: np.ndarray) -> None:
        for p in np.unique(part):
            self.writers[p].write_batch(batch.take(pa.array(np.flatnonzero(part == p))))

    def read(self) -> Iterator[Iterator[pa.RecordBatch]]:
        for w in self.writers:
            w.close()
        for p in self.paths:
            with pa.ipc.open_stream(p) as stream:
                yield iter(stream)
            os.unlink(p)


def grace_buckets(batches: Iterable[pa.RecordBatch], id_col: str, text_col: str, count_col: str | None, budget: int, folder: str, level: int = 0) -> Iterator[ContentTable]:
    """Tables that together hold every distinct content once, each within about ``budget`` bytes and one batch.

    ``count_col`` says how many records a row stands for, one without it. A
    table is to be used before the next one is asked for. The hash's 64 bits
    are used four by four, again from the first after 15 levels: by then a
    bucket's contents have one hash and its table takes at least one of them
    at every level, so the recursion ends.
    """
    table, spill = ContentTable(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        contents = [normalised(x) for x in batch.column(text_col).cast(pa.binary()).to_pylist()]
        points = pc.fill_null(pc.utf8_length(batch.column(text_col)), 0).to_pylist()
        ids = batch.column(id_col).to_pylist()
        counts = batch.column(count_col).to_pylist() if count_col else [1] * len(ids)
        first, changed, rest, part = len(table.rows), set(), [], []
        for i, content in enumerate(contents):
            h = xxhash.xxh3_64_intdigest(content)
            e = table.find(h, content, add=table.bytes <= budget)
            if e < 0:
                rest.append(i)
                part.append(h >> (60 - 4 * level % 60) & (FAN_OUT - 1))
                continue
            before = table.rows[e] if e < len(table.rows) else None
            table.settle(e, counts[i], (-points[i], ids[i] is None, ids[i] or 0), batch, i)
            if before is not None and e < first and table.rows[e] is not before:
                changed.add(e)
        if rest:
            spill = spill or _Spill(folder, batch.schema)
            spill.write(batch.take(pa.array(rest)), np.array(part))
        table.own_rows(first, batch, changed)
    yield table
    del table
    if spill:
        for own in spill.read():
            yield from grace_buckets(own, id_col, text_col, count_col, budget, folder, level + 1)


class _Scratch:
    """A task's own folder for spill files: they live no longer than the task, which a lost executor runs again."""

    def __enter__(self) -> str:
        self.folder = tempfile.mkdtemp(prefix="numera-grace-")
        return self.folder

    def __exit__(self, *_: object) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def _local_pass(id_col: str, text_col: str, hash_col: str, count_col: str, budget: int):
    """Of the equal texts of one input partition the row that stays, with hash and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Scratch() as folder:
            for table in grace_buckets(batches, id_col, text_col, None, budget, folder):
                signed = np.array(table.hashes, np.uint64).view(np.int64)
                for rows, a, b in table.best():
                    yield rows.append_column(hash_col, pa.array(signed[a:b])).append_column(count_col, pa.array(table.counts[a:b], pa.int64()))

    return run


def _global_pass(id_col: str, text_col: str, hash_col: str, count_col: str, budget: int, survivors: bool):
    """Merge the local rows of one hash bucket; survivors: whole winning rows, else their keys with size and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Scratch() as folder:
            for table in grace_buckets(batches, id_col, text_col, count_col, budget, folder):
                for rows, a, b in table.best():
                    if survivors:
                        yield rows.drop_columns([hash_col, count_col])
                    else:
                        sha = [hashlib.sha256(c).hexdigest() for c in table.contents[a:b]]
                        yield pa.RecordBatch.from_arrays([pa.array(sha), rows.column(id_col), rows.column("k1"), rows.column("k2"), pa.array(table.counts[a:b], pa.int64())], ["text_sha256", "keep_id", "keep1", "keep2", "group_size"])

    return run


def _merged(docs: DataFrame, id_col: str, text_col: str, budget: int, survivors: bool) -> DataFrame:
    hash_col, count_col = free_name(docs, "__hash"), free_name(docs, "__count")
    schema = T.StructType([*docs.schema.fields, T.StructField(hash_col, T.LongType()), T.StructField(count_col, T.LongType())])
    records = docs.mapInArrow(_local_pass(id_col, text_col, hash_col, count_col, budget), schema).repartition(F.col(hash_col))
    result = docs.schema if survivors else "text_sha256 string, keep_id long, keep1 long, keep2 long, group_size long"
    return records.mapInArrow(_global_pass(id_col, text_col, hash_col, count_col, budget, survivors), result)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of texts that are equal without white space the row with the most code
    points in its original text stays, then the smallest id; of rows that are
    equal in id and text one. Null and empty texts are one group. A null id
    comes after all others. An empty table gives an empty result; other
    columns are not looked at.

    Rows find their group by the content's digest and the row that stays by its
    keys, not by their places in the input, so a task that runs again changes nothing.
    """
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), k1.alias("k1"), k2.alias("k2"))
    groups = checkpoint(_merged(rows, "doc_id", "text", budget, False))
    digest = F.sha2(F.translate(F.coalesce("text", F.lit("")), WHITE, "").cast("binary"), 256)
    # numbers are given to rows that are files already
    members = checkpoint(rows.select("doc_id", "k1", "k2", digest.alias("text_sha256"))).withColumn("number", F.monotonically_increasing_id())
    first = members.groupBy("k1", "k2").agg(F.min("number").alias("number"))
    groups = groups.join(first.select(F.col("k1").alias("keep1"), F.col("k2").alias("keep2"), F.col("number").alias("winner")), ["keep1", "keep2"])
    groups = checkpoint(groups.select("text_sha256", "keep_id", "group_size", "winner", F.col("group_size").alias("meets")))
    met = lookup(members, groups, ["text_sha256"], "meets")
    return met.select("doc_id", "keep_id", "group_size", (F.col("number") == F.col("winner")).alias("kept"), "text_sha256")


def exact_survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns.

    One scan and one shuffle of the records that outlive their input partition.
    """
    return _merged(docs, id_col, text_col, budget, True)
