"""Older binary chunk files as a data source and sink: heads by range, payloads only where they are asked for.

    spark.dataSource.register(ChunkFiles)
    spark.read.format("chunk_files").option("content", "heads").load(folder)

A head is 55 bytes, and a scan of heads opens nothing else; a scan of primes reads the
heads first and the payloads only of chunks that reach into the asked bounds. File
names tell the chunk ids, so that other ids are never opened. Paths are what
pyarrow's file systems open: local, HDFS, S3, GCS.

The sink writes rows (chunk_id, content), a file each, under a name of the task's own
first; the driver renames them when all tasks are done.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from numera.functions.integers import WHEEL, WHEEL_UNITS
from numera.operators.archive import packed
from numera.sources.store import HEAD_BYTES, WHEEL_MAGIC, decode_head, wheel_values

#: Heads that a task reads; primes are a chunk a task.
HEADS_A_TASK = 64
HEADS = "chunk_id long, first_prime long, last_prime long, cycle_start long, cycles long, raw_bytes long, packed_bytes long, file_bytes long"
PRIMES = "chunk_id long, p long"
#: Primes in a batch.
_AT_ONCE = 1 << 16


@dataclass
class Chunks(InputPartition):
    """Files of a partition: (chunk id, path, bytes)."""

    files: tuple[tuple[int, str, int], ...]


def _opened(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if re.match(r"\w+:", path) else (LocalFileSystem(), path)


class ChunkFiles(DataSource):
    """Options: path; content (heads or primes); first_id and last_id; lower and upper, bounds that a chunk has to reach into."""

    @classmethod
    def name(cls) -> str:
        return "chunk_files"

    def schema(self) -> str:
        content = self.options.get("content", "primes")
        if content not in ("heads", "primes"):
            raise ValueError(f"content: {content}")
        return HEADS if content == "heads" else PRIMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChunkFilesReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ChunkFilesWriter(self.options["path"], overwrite)


class ChunkFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.heads = options["path"], options.get("content", "primes") == "heads"
        number = lambda name: int(options[name]) if name in options else None
        self.first_id, self.last_id, self.lower, self.upper = map(number, ("first_id", "last_id", "lower", "upper"))

    def partitions(self) -> list[Chunks]:
        from pyarrow.fs import FileSelector, FileType

        system, folder = _opened(self.path)
        files = []
        for info in system.get_file_info(FileSelector(folder, recursive=True, allow_not_found=True)):
            found = re.search(r"chunk_(\d+)\.(?:bin\.)?zst$", info.path)
            if info.type == FileType.File and found:
                number = int(found[1])
                if (self.first_id is None or number >= self.first_id) and (self.last_id is None or number <= self.last_id):
                    files.append((number, info.path, info.size))
        files.sort()
        width = HEADS_A_TASK if self.heads else 1
        return [Chunks(tuple(files[k : k + width])) for k in range(0, len(files), width)]

    def read(self, partition: Chunks | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        system, _ = _opened(self.path)
        rows = []
        for number, path, size in partition.files:
            with system.open_input_file(path) as file:
                head = decode_head(file.read_at(min(size, HEAD_BYTES), 0))
                if (self.lower is not None and head["last_prime"] < self.lower) or (self.upper is not None and head["first_prime"] > self.upper):
                    continue
                if self.heads:
                    rows.append((number, *head.values(), size))
                    continue
                p = np.array(wheel_values(file.read_at(size, 0)), np.int64)
            for at in range(0, len(p), _AT_ONCE):
                part = p[at : at + _AT_ONCE]
                yield pa.RecordBatch.from_pydict({"chunk_id": np.full(len(part), number), "p": part})
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in HEADS.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (name of its own, final name)."""

    files: tuple[tuple[str, str], ...]


class ChunkFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator) -> Written:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        files = []
        for row in iterator:
            final = f"{folder}/chunk_{row['chunk_id']:020d}.zst"
            own = f"{folder}/_{uuid.uuid4().hex}"
            with system.open_output_stream(own) as file:
                file.write(bytes(row["content"]))
            files.append((own, final))
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector

        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        files = [f for m in messages if m for f in m.files]
        if self.overwrite:
            kept = {own for own, _ in files}
            for info in system.get_file_info(FileSelector(folder)):
                if re.search(r"/chunk_\d+\.zst$", info.path) and info.path not in kept:
                    system.delete_file(info.path)
        for own, final in files:
            system.move(own, final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _opened(self.path)
        for own in (own for m in messages if m for own, _ in m.files):
            system.delete_file(own)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (chunk_id, cycle, bits) to a row (chunk_id, content) for each chunk; of one that goes on only its bytes are carried."""
    import zstandard

    chunk, start, raw = None, 0, bytearray()

    def content() -> pa.RecordBatch:
        words = np.frombuffer(bytes(raw), np.uint8)
        set_bits = np.flatnonzero(np.unpackbits(words, bitorder="little"))
        cycle, bit = np.divmod(set_bits[[0, -1]], len(WHEEL_UNITS))
        first, last = ((start + cycle) * WHEEL + np.array(WHEEL_UNITS)[bit]).tolist()
        payload = zstandard.ZstdCompressor(level=9).compress(bytes(raw))
        head = WHEEL_MAGIC + struct.pack("<6Q", first, last, start, len(raw) // 6, len(raw), len(payload))
        return pa.RecordBatch.from_pydict({"chunk_id": pa.array([chunk], pa.int64()), "content": pa.array([head + payload], pa.binary())})

    for batch in batches:
        for number, cycle, bits in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "cycle", "bits"))):
            if number != chunk:
                if chunk is not None:
                    yield content()
                chunk, start, raw = number, cycle, bytearray()
            raw.extend(bytes(6 * (cycle - start) - len(raw)))
            raw.extend(bits.to_bytes(6, "little"))
    if chunk is not None:
        yield content()


def write_chunks(chunks: DataFrame, path: str) -> None:
    """A wheel chunk file for each chunk (chunk_id, p) that has a prime from 11 on; files of the folder that are not among them go."""
    chunks.sparkSession.dataSource.register(ChunkFiles)
    rows = packed(chunks).repartition(F.col("chunk_id")).sortWithinPartitions("chunk_id", "cycle").select("chunk_id", "cycle", "bits")
    rows.mapInArrow(_contents, "chunk_id long, content binary").write.format("chunk_files").mode("overwrite").save(path)


def _read(spark: SparkSession, path: str, content: str, **given: int | None) -> DataFrame:
    spark.dataSource.register(ChunkFiles)
    reader = spark.read.format("chunk_files").option("content", content)
    for name, value in given.items():
        if value is not None:
            reader = reader.option(name, value)
    return reader.load(path)


def read_heads(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None, lower: int | None = None, upper: int | None = None) -> DataFrame:
    """A row for each chunk file below a folder, from its head alone; a file that is no wheel chunk is an error."""
    return _read(spark, path, "heads", first_id=first_id, last_id=last_id, lower=lower, upper=upper)


def read_primes(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None, lower: int | None = None, upper: int | None = None) -> DataFrame:
    """(chunk_id, p) of the chunks that reach into the bounds, whole chunks; a payload that is cut short is an error."""
    return _read(spark, path, "primes", first_id=first_id, last_id=last_id, lower=lower, upper=upper)
