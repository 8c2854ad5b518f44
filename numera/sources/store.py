"""Chunks as Parquet in committed versions, exact chunks, and readers for older files."""

from __future__ import annotations

import io
import itertools
import re
import struct
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from numera.functions.integers import DIRECT_PRIMES, WHEEL, WHEEL_UNITS, div, highest_bit, long_array, lowest_bit, wheel_unit
from numera.operators import maintenance
from numera.operators.archive import coded, delta_bytes, delta_values, unpacked, with_cycles
from numera.plans.segments import with_offsets

# Heads of the older binary files.
WHEEL_MAGIC = b"W210A1\0"
HEAD_BYTES = 55
HEAD = ("first_prime", "last_prime", "cycle_start", "cycles", "raw_bytes", "packed_bytes")
EXACT_MAGIC = b"E8PA1\0"
WHEEL_INDEX = "chunk_id long, first_prime long, last_prime long, cycle_start long, cycles long, raw_bytes long, compressed_bytes long"
EXACT_INDEX = "chunk_id long, prime_count long, first_prime long, last_prime long, bytes long"

#: Cycles in a partition of a stored bitmap, unless a writer says otherwise.
BLOCK_CYCLES = 1 << 20
#: Numbers that a row of exact chunks spans.
EXACT_WIDTH = 1 << 24
BITMAP = "chunk_id long, cycle long, bits long, direct int, block long"
INDEX = "chunk_id long, prime_count long, first_prime long, last_prime long, direct int, cycle_start long, cycles long, raw_bytes long, home long"
EXACT = "chunk_id long, part long, prime_count long, first_prime long, last_prime long, payload binary"
EXACT_NAMES = ("chunk_id", "part", "prime_count", "first_prime", "last_prime", "payload")
EXACT_ARROW = pa.schema([(name, pa.binary() if name == "payload" else pa.int64()) for name in EXACT_NAMES])


def write_archive(chunks: DataFrame, path: str, block_cycles: int = BLOCK_CYCLES) -> int:
    """All ``chunks`` (chunk_id, p) as a new version of the archive, whose number it returns.

    A version is a folder with the wheel bitmap, in partitions of ``block_cycles``
    cycles, and an index with a row for each chunk; its manifest row commits it.
    Readers follow the newest manifest row, so a write that is broken off leaves
    the earlier version as it was. Earlier versions stay. A second writer of the
    same version fails at the manifest.
    """
    return _commit(chunks, path, _committed(chunks.sparkSession, path), False, block_cycles)


def update_archive(chunks: DataFrame, path: str) -> int:
    """A new version in which ``chunks`` replace those of the same ids or join the others, which stay where they are.

    Only ``chunks`` are written, and an index that names for each chunk the
    version that holds it.
    """
    head = _committed(chunks.sparkSession, path)
    return _commit(chunks, path, head, head is not None, head["block_cycles"] if head else BLOCK_CYCLES)


def reindex(spark: SparkSession, path: str) -> int:
    """A new version of the index and the manifest, counted anew from the bitmaps that are there; no bitmap is written."""
    head, rows = _head(spark, path), _bitmap(spark, path)
    fresh = _index(rows).join(read_index(spark, path, True).select("chunk_id", "home"), "chunk_id")
    return _finish(spark, path, head["version"] + 1, fresh, head["block_cycles"])


def _commit(chunks: DataFrame, path: str, head: Row | None, keep: bool, block_cycles: int, expected: DataFrame | None = None) -> int:
    spark, version = chunks.sparkSession, (head["version"] if head else 0) + 1
    wheel = f"{path}/version={version}/wheel"
    rows = coded(chunks).withColumn("block", div(F.col("cycle"), block_cycles)).repartitionByRange("block", "chunk_id", "cycle").sortWithinPartitions("block", "chunk_id", "cycle")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("block").parquet(wheel)
    # from what was written, so that nothing is sieved twice
    fresh = _index(spark.read.schema(BITMAP).parquet(wheel)).withColumn("home", F.lit(version).cast("long"))
    if expected is not None:
        own = fresh.select("chunk_id", F.struct("prime_count", "first_prime", "last_prime").alias("own"))
        told = expected.select("chunk_id", F.struct("prime_count", "first_prime", "last_prime").alias("told"))
        wrong = [r[0] for r in told.join(own, "chunk_id", "full").where(~F.col("own").eqNullSafe(F.col("told"))).select("chunk_id").limit(20).collect()]
        if wrong:
            raise ValueError(f"chunks that are not what the index says: {sorted(wrong)}")
    if keep:
        old = read_index(spark, path, True)
        fresh = fresh.unionByName(old.join(fresh.select("chunk_id"), "chunk_id", "left_anti").select(fresh.columns))
    return _finish(spark, path, version, fresh, block_cycles)


def _finish(spark: SparkSession, path: str, version: int, rows: DataFrame, block_cycles: int) -> int:
    own = f"{path}/version={version}/index"
    rows.write.mode("overwrite").parquet(own)
    total = spark.read.schema(rows.schema).parquet(own).agg(F.count("*").alias("committed_chunks"), F.coalesce(F.sum("prime_count"), F.lit(0)).alias("committed_primes"), F.max("last_prime").alias("last_prime"))
    total = total.select("*", F.lit("wheel-210").alias("encoding"), F.lit(block_cycles).cast("long").alias("block_cycles"))
    total.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={version}")
    return version


def _index(bitmap: DataFrame) -> DataFrame:
    """``archive.index`` of a written bitmap, from its words."""
    used = F.col("bits") != 0
    cycle = F.col("cycle") * WHEEL
    rows = bitmap.groupBy("chunk_id").agg(
        F.sum(F.bit_count("bits") + F.bit_count("direct")).cast("long").alias("prime_count"),
        F.min(F.when(used, cycle + wheel_unit(lowest_bit(F.col("bits"))))).alias("first_prime"),
        F.max(F.when(used, cycle + wheel_unit(highest_bit(F.col("bits"))))).alias("last_prime"),
        F.bit_or("direct").alias("direct"),
    )
    return with_cycles(rows)


def _committed(spark: SparkSession, path: str) -> Row | None:
    """The newest manifest row."""
    try:
        return spark.read.parquet(f"{path}/manifest").orderBy(F.desc("version")).limit(1).first()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _head(spark: SparkSession, path: str) -> Row:
    head = _committed(spark, path)
    if head is None:
        raise FileNotFoundError(f"no committed archive: {path}")
    return head


def _bitmap(spark: SparkSession, path: str, damaged: bool = False) -> DataFrame:
    """The committed rows of all versions that hold a chunk; ``damaged``: of what is still there and readable."""
    size, index = _head(spark, path)["block_cycles"], read_index(spark, path, True)
    start = F.when(F.col("direct") > 0, 0).otherwise(F.col("cycle_start"))
    held = index.select("home", div(start, size).alias("first"), F.coalesce(div(F.col("cycle_start") + F.col("cycles") - 1, size), F.lit(0)).alias("last"))
    blocks: dict[int, list[tuple[int, int]]] = {}
    for home, first, last in sorted(held.distinct().collect()):  # a row a chunk at most
        own = blocks.setdefault(home, [])
        if own and first <= own[-1][1] + 1:
            own[-1] = (own[-1][0], max(last, own[-1][1]))
        else:
            own.append((first, last))
    parts = []
    for home, ranges in blocks.items():
        try:
            rows = spark.read.schema(BITMAP).option("ignoreCorruptFiles", damaged).option("ignoreMissingFiles", damaged).parquet(f"{path}/version={home}/wheel")
        except AnalysisException as error:
            if not damaged or error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        # chunks that a later version replaced or left out are not among those of their home, whose other partitions are not read
        held_here = index.where(F.col("home") == home).select("chunk_id")
        parts.append(rows.where(_in_ranges("block", ranges)).join(held_here, "chunk_id", "left_semi").select(rows.columns))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], BITMAP)


def _in_ranges(column: str, ranges: list[tuple[int, int]]) -> Column:
    return reduce(Column.__or__, (F.col(column).between(a, b) for a, b in ranges), F.lit(False))


def read_bitmap(spark: SparkSession, path: str, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """(chunk_id, cycle, bits) of a committed archive; filters on both ids reach the scan.

    With ``ranges`` of cycles, both ends included, only those cycles: other
    partitions are not listed, other row groups not read.
    """
    rows = _bitmap(spark, path)
    if ranges is not None:
        size = _head(spark, path)["block_cycles"]
        rows = rows.where(_in_ranges("block", [(a // size, b // size) for a, b in ranges]) & _in_ranges("cycle", ranges))
    return rows.where("bits <> 0").select("chunk_id", "cycle", "bits")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, p) of a committed archive; filters on chunk_id reach the scan."""
    return unpacked(read_bitmap(spark, path))


def read_index(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """The index of a committed archive; ``whole`` adds the direct primes of a chunk as bits, and the version that holds it."""
    rows = spark.read.schema(INDEX).parquet(f"{path}/version={_head(spark, path)['version']}/index")
    return rows if whole else rows.drop("direct", "home")


def repair(spark: SparkSession, path: str, expected: DataFrame | None = None, first: int | None = None, last: int | None = None) -> list[int]:
    """Sieves lost chunks anew, writes them, and nothing else, as a new version, and returns their ids; none if nothing is lost.

    ``expected`` is an index (by default the archive's own) of what there should
    be; lost are chunks from ``first`` to ``last`` whose bitmap is gone, cannot be
    read, or has another count. An expected index without a column ``direct``
    has the direct primes in chunk 0. Chunks that come out with another count or
    other bounds than the index says are an error, and nothing is committed.
    """
    expected = read_index(spark, path, True) if expected is None else expected
    there = _index(_bitmap(spark, path, True)).select("chunk_id", F.col("prime_count").alias("there"))
    gone = expected.join(there, "chunk_id", "left").where(~F.col("there").eqNullSafe(F.col("prime_count")))
    if first is not None:
        gone = gone.where(F.col("chunk_id") >= first)
    if last is not None:
        gone = gone.where(F.col("chunk_id") <= last)
    ids = sorted(r[0] for r in gone.select("chunk_id").collect())  # one for each lost chunk
    if not ids:
        return []
    lost = expected.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "chunk_id long")), "chunk_id", "left_semi")
    bits = F.col("direct") if "direct" in expected.columns else F.when(F.col("chunk_id") == 0, (1 << len(DIRECT_PRIMES)) - 1).otherwise(0)
    own = F.filter(long_array(DIRECT_PRIMES), lambda p, k: F.call_function("getbit", bits, k) == 1)
    direct = lost.select("chunk_id", F.explode(own).alias("p"))
    head = _head(spark, path)
    _commit(maintenance.rebuild(lost).unionByName(direct), path, head, True, head["block_cycles"], lost)
    return ids


def reconcile(spark: SparkSession, path: str, committed: int) -> list[int]:
    """Leaves out chunks that reach beyond the first ``committed`` primes, as a new version of the index, and returns their ids.

    That is what a run wrote before it broke off without committing it; no bitmap is written.
    """
    head, rows = _head(spark, path), read_index(spark, path, True)
    offsets = with_offsets(rows.select("chunk_id", "prime_count"), "chunk_id", "prime_count")
    beyond = offsets.where(F.col("offset") + F.col("prime_count") > committed).select("chunk_id")
    ids = sorted(r[0] for r in beyond.collect())  # one for each chunk too many
    if ids:
        _finish(spark, path, head["version"] + 1, rows.where(F.col("chunk_id") < ids[0]), head["block_cycles"])
    return ids


def prune(spark: SparkSession, path: str) -> list[int]:
    """Deletes the folders of versions that no chunk of the newest index lives in, and returns their numbers.

    Readers that began with an earlier version lose it, so nothing may read the archive meanwhile.
    """
    newest = _head(spark, path)["version"]
    used = {r[0] for r in read_index(spark, path, True).select("home").distinct().collect()} | {newest}
    jvm, gone = spark.sparkContext._jvm, []
    for version in range(1, newest):
        own = jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}" + ("/index" if version in used else ""))
        if own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True) and version not in used:
            gone.append(version)
    return gone


def present_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The ids of the index's chunks whose bitmap is there, readable and of the index's count."""
    there = _index(_bitmap(spark, path, True)).select("chunk_id", F.col("prime_count").alias("there"))
    return read_index(spark, path).join(there, "chunk_id").where(F.col("there") == F.col("prime_count")).select("chunk_id")


def write_exact(chunks: DataFrame, path: str, width: int = EXACT_WIDTH) -> None:
    """Exact chunks: a row (chunk_id, part, prime_count, first_prime, last_prime, payload) for each chunk and ``width`` numbers.

    The payload has the differences of the part's primes, seven bits a byte.
    Parts bound what one row holds, whatever the size of a chunk.
    """
    rows = chunks.select("chunk_id", div(F.col("p"), width).alias("part"), "p").repartition("chunk_id", "part").sortWithinPartitions("chunk_id", "part", "p")
    rows.mapInArrow(_encode_parts, EXACT).write.mode("overwrite").parquet(path)


def _encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (chunk_id, part, p) to a row for each part; only the part that a batch ends in is carried on."""
    carried = np.zeros((3, 0), np.int64)

    def coded_parts(rows: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))) if rows.shape[1] else []
        out = [(*rows[:2, a], len(own), own[0], own[-1], delta_bytes(np.diff(own))) for a, b in zip(starts, [*starts[1:], rows.shape[1]]) if len(own := np.unique(rows[2, a:b]))]
        return pa.RecordBatch.from_pylist([dict(zip(EXACT_NAMES, (*map(int, r[:5]), r[5]))) for r in out], schema=EXACT_ARROW)

    for batch in batches:
        rows = np.concatenate([carried, [batch.column(c).to_numpy() for c in ("chunk_id", "part", "p")]], axis=1)
        if rows.shape[1]:
            last = int(np.flatnonzero((rows[:2] != rows[:2, -1:]).any(axis=0))[-1]) + 1 if (rows[:2] != rows[:2, -1:]).any() else 0
            yield coded_parts(rows[:, :last])
            carried = rows[:, last:]
    yield coded_parts(carried)


def read_exact(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, p) of exact chunks; a payload that does not hold its count, or does not end at its last prime, is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, count, first, last, payload in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "prime_count", "first_prime", "last_prime", "payload"))):
                p = first + np.concatenate(([0], np.cumsum(delta_values(payload))))
                if len(p) != count or p[-1] != last:
                    raise ValueError(f"exact chunk {chunk} is not what its head says")
                yield pa.RecordBatch.from_pydict({"chunk_id": np.full(len(p), chunk), "p": p.astype(np.int64)})

    return spark.read.schema(EXACT).parquet(path).mapInArrow(run, "chunk_id long, p long")


def exact_index(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, prime_count, first_prime, last_prime) of exact chunks from the heads of their parts; payloads are not read."""
    return spark.read.schema(EXACT).parquet(path).groupBy("chunk_id").agg(F.sum("prime_count").alias("prime_count"), F.min("first_prime").alias("first_prime"), F.max("last_prime").alias("last_prime"))


def rebuild_archive(spark: SparkSession, exact_path: str, path: str) -> int:
    """A new version of the archive from exact chunks alone; the version before stays until the new one is committed."""
    return write_archive(read_exact(spark, exact_path), path)


def backfill_archive(spark: SparkSession, exact_path: str, path: str) -> list[int]:
    """Encodes the exact chunks that the archive has none of, as a new version, and returns their ids."""
    there = read_index(spark, path).select("chunk_id")
    ids = sorted(r[0] for r in exact_index(spark, exact_path).join(there, "chunk_id", "left_anti").select("chunk_id").collect())
    if ids:
        update_archive(read_exact(spark, exact_path).join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "chunk_id long")), "chunk_id", "left_semi"), path)
    return ids


def archive_seed(spark: SparkSession, path: str) -> dict | None:
    """found and last_prime of a committed archive, from its index.

    None without an archive, if it holds nothing, or if its chunks are not those
    from 0 on without a hole: then its count is not the rank of its last prime.
    """
    if _committed(spark, path) is None:
        return None
    row = read_index(spark, path).agg(F.sum("prime_count").alias("found"), F.max("last_prime").alias("last_prime"), F.count("*").alias("n"), F.max("chunk_id").alias("last_id")).first()
    return {"found": row["found"], "last_prime": row["last_prime"]} if row["last_prime"] and row["n"] == row["last_id"] + 1 else None


def write_tsv_index(rows: DataFrame, path: str, append: bool = False) -> None:
    """An index as tab-separated text with a header, in the order of the chunks; ``append`` adds files to those that are there."""
    rows.orderBy("chunk_id").write.mode("append" if append else "overwrite").option("sep", "\t").option("header", True).csv(path)


def read_tsv_index(spark: SparkSession, path: str, schema: str = WHEEL_INDEX, first: int | None = None, last: int | None = None) -> DataFrame:
    """An older index, its chunks ``first`` to ``last``: tab-separated with a header; lines of another width are left out."""
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED").csv(path)
    # without a look at all columns a count would not see that a line is short
    rows = rows.dropna()
    if first is not None:
        rows = rows.where(F.col("chunk_id") >= first)
    return rows if last is None else rows.where(F.col("chunk_id") <= last)


def last_prime_of_index(rows: DataFrame) -> DataFrame:
    """One row: the last prime of the chunk with the highest id."""
    return rows.agg(F.max_by("last_prime", "chunk_id").alias("last_prime"))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of key=value files; lines without = are left out."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", "=", 2).alias("kv")).where(F.size("kv") == 2)
    return rows.select("file", F.trim(F.col("kv")[0]).alias("key"), F.trim(F.col("kv")[1]).alias("value"))


def chunk_ids(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, bytes) of the files named chunk_<number>.zst below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    found = F.regexp_extract("path", r"chunk_(\d+)\.zst$", 1)
    return files.where(found != "").select(found.cast("long").alias("chunk_id"), F.col("length").alias("bytes"))


def folder_bytes(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """One row: bytes of all files below a folder, leaving out those whose path contains ``without``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return (files.where(~F.col("path").contains(without)) if without else files).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def read_big_integers(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): one number a file, all white space taken out."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\s", "").alias("text"))


def decode_head(blob: bytes) -> dict:
    """The head of an older wheel file: first and last prime, cycle start, cycles, raw and packed length."""
    if len(blob) < HEAD_BYTES or not blob.startswith(WHEEL_MAGIC):
        raise ValueError("not a wheel-210 chunk")
    return dict(zip(HEAD, struct.unpack_from("<6Q", blob, len(WHEEL_MAGIC))))


def decode_wheel(blob: bytes) -> dict:
    """An older wheel file: its head, and its zstd payload."""
    head = decode_head(blob)
    payload = blob[HEAD_BYTES : HEAD_BYTES + head["packed_bytes"]]
    if len(payload) < head["packed_bytes"]:
        raise ValueError("wheel-210 chunk is cut short")
    return head | {"payload": payload}


def wheel_values(blob: bytes) -> list[int]:
    """The primes of an older wheel file, in order."""
    import zstandard

    head = decode_wheel(blob)
    raw = zstandard.ZstdDecompressor().decompress(head["payload"], max_output_size=head["raw_bytes"])
    if len(raw) != head["raw_bytes"] or len(raw) != head["cycles"] * (len(WHEEL_UNITS) // 8):
        raise ValueError("wheel-210 chunk is cut short")
    cycle, bit = np.divmod(np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")), len(WHEEL_UNITS))
    return ((head["cycle_start"] + cycle) * WHEEL + np.array(WHEEL_UNITS)[bit]).tolist()


def exact_values(blob: bytes) -> list[int]:
    """An older exact file: head, count and first prime, then differences of 7 bits a byte."""
    if not blob.startswith(EXACT_MAGIC):
        raise ValueError("not an exact chunk")
    count, first = struct.unpack_from("<2Q", blob, len(EXACT_MAGIC))
    out, at = [first] if count else [], len(EXACT_MAGIC) + 16
    while len(out) < count:
        delta = shift = 0
        while True:
            if at >= len(blob) or shift >= 64:
                raise ValueError("exact chunk is cut short")
            byte = blob[at]
            at += 1
            delta |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                break
        out.append(out[-1] + delta)
    return out


def read_older_chunks(spark: SparkSession, path: str, kind: str = "wheel") -> DataFrame:
    """(chunk_id, p) of older binary files, those named chunk_<number>, a file a row on the executors."""
    values = {"wheel": wheel_values, "exact": exact_values}[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, blob in zip(frame["path"], frame["content"]):
                p = values(bytes(blob))
                yield pd.DataFrame({"chunk_id": int(re.search(r"chunk_(\d+)\.", name)[1]), "p": p}).astype("int64")

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("path").rlike(r"chunk_\d+\.[^/]*$")).select("path", "content")
    return files.mapInPandas(run, "chunk_id long, p long")


SHEET = "row_number int, prime long, cleaned_mask string, full_mask string, symbol_order string"
_SHEET_SPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_SHEET_ROWS = 1000


def _sheet_rows(content: bytes, sheet: int, first_row: int) -> Iterator[tuple]:
    """Rows of a workbook's sheet, read as a stream, that have all four columns."""
    a, text_of = _SHEET_SPACE, lambda node: "".join(t.text or "" for t in node.iter(f"{_SHEET_SPACE}t"))
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [text_of(item) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{a}si")]
        with book.open(f"xl/worksheets/sheet{sheet}.xml") as file:
            for _, row in ElementTree.iterparse(file):
                if row.tag != f"{a}row":
                    continue
                cells = {}
                for cell in row.findall(f"{a}c"):
                    value, inline = cell.find(f"{a}v"), cell.find(f"{a}is")
                    if inline is not None:
                        text = text_of(inline)
                    elif value is None:
                        continue
                    else:
                        text = shared[int(value.text)] if cell.get("t") == "s" else value.text
                    cells[re.match("[A-Z]+", cell.get("r"))[0]] = text
                number = int(row.get("r"))
                row.clear()
                if number >= first_row and all(c in cells for c in "EFGH"):
                    yield number, int(float(cells["F"])), cells["E"], cells["G"], cells["H"]


def read_mask_sheet(spark: SparkSession, path: str, sheet: int = 5, first_row: int = 6) -> DataFrame:
    """(row_number, prime, cleaned_mask, full_mask, symbol_order): columns F, E, G and H of a sheet of the workbooks below a path.

    Workbooks are parsed on the executors, one after the other in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SHEET.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for content in batch.column("content"):
                rows = _sheet_rows(content.as_py(), sheet, first_row)
                while part := list(itertools.islice(rows, _SHEET_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SHEET)
