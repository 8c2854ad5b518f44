"""Chunk files and workbooks as sources."""

import struct
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from numera.functions import masks
from numera.functions.integers import WHEEL_UNITS
from numera.operators import sieve
from numera.sources import chunk_files, store


def chunk(values, payload=None):
    """An older wheel file of some primes from 11 on."""
    start, end = values[0] // 210, values[-1] // 210
    raw = bytearray(6 * (end - start + 1))
    for p in values:
        bit = WHEEL_UNITS.index(p % 210)
        raw[6 * (p // 210 - start) + bit // 8] |= 1 << bit % 8
    packed = zstandard.compress(bytes(raw)) if payload is None else payload
    return store.WHEEL_MAGIC + struct.pack("<6Q", values[0], values[-1], start, end - start + 1, len(raw), len(packed)) + packed


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("chunks")
    own = sorted(r["p"] for r in sieve.primes(spark, 11, 30_000).collect())
    (path / "deep").mkdir()
    for k in range(0, len(own), 300):
        at = path / ("deep" if k else "") / f"chunk_{k // 300:020d}.zst"
        at.write_bytes(chunk(own[k : k + 300]))
    (path / "index.tsv").write_text("chunk_id\n")
    return path, own


def test_heads(spark, folder):
    path, own = folder
    rows = chunk_files.read_heads(spark, str(path)).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["first_prime"], r["last_prime"]) for r in rows] == [(k // 300, own[k], own[min(k + 300, len(own)) - 1]) for k in range(0, len(own), 300)]
    assert all(r["raw_bytes"] == 6 * r["cycles"] and r["file_bytes"] == store.HEAD_BYTES + r["packed_bytes"] for r in rows)
    assert chunk_files.read_heads(spark, path.as_uri(), first_id=2, last_id=4).count() == 3
    assert {r["chunk_id"] for r in chunk_files.read_heads(spark, str(path), lower=own[650], upper=own[900]).collect()} == {2, 3}


def test_primes(spark, folder):
    path, own = folder
    rows = chunk_files.read_primes(spark, str(path))
    assert sorted((r["chunk_id"], r["p"]) for r in rows.collect()) == [(k // 300, p) for k, p in enumerate(own)]
    assert rows.rdd.getNumPartitions() == -(-len(own) // 300)
    assert {r["chunk_id"] for r in chunk_files.read_primes(spark, str(path), lower=own[300], upper=own[301]).select("chunk_id").distinct().collect()} == {1}
    assert store.read_older_chunks(spark, str(path)).exceptAll(rows).count() == 0


def test_heads_and_bounds_open_no_payload(spark, tmp_path):
    (tmp_path / "chunk_1.zst").write_bytes(chunk([11, 13, 17]))
    (tmp_path / "chunk_2.zst").write_bytes(chunk([1009, 1013], payload=b"not zstd at all"))
    (tmp_path / "chunk_3.zst").write_bytes(chunk([2003, 2011])[:-3])
    (tmp_path / "chunk_9.zst").write_bytes(b"no chunk")
    read = lambda f, **given: f(spark, str(tmp_path), last_id=8, **given)
    assert read(chunk_files.read_heads).count() == 3
    assert [r["p"] for r in read(chunk_files.read_primes, upper=1000).orderBy("p").collect()] == [11, 13, 17]
    with pytest.raises(Exception, match="zstd|Zstd"):
        read(chunk_files.read_primes, lower=1009, upper=1013).count()
    with pytest.raises(Exception, match="cut short"):
        read(chunk_files.read_primes, lower=2000).count()
    with pytest.raises(Exception, match="not a wheel-210 chunk"):
        chunk_files.read_heads(spark, str(tmp_path)).count()


def test_empty_folder(spark, tmp_path):
    assert chunk_files.read_heads(spark, str(tmp_path)).count() == 0


def test_chunk_listings(spark, folder):
    path, own = folder
    rows = store.chunk_ids(spark, str(path)).collect()
    assert {r["chunk_id"]: r["bytes"] for r in rows} == {r["chunk_id"]: r["file_bytes"] for r in chunk_files.read_heads(spark, str(path)).collect()}
    whole, deep = (store.folder_bytes(spark, str(path), without).first()[0] for without in (None, "/deep/"))
    assert whole == sum(r["bytes"] for r in rows) + len("chunk_id\n") and deep == next(r["bytes"] for r in rows if r["chunk_id"] == 0) + len("chunk_id\n")


def workbook(path, rows, shared=False):
    """rows: (row number, E, F, G, H)."""
    strings, body = [], ""
    for number, *cells in rows:
        text = ""
        for c, v in zip("EFGH", cells):
            if v is None:
                continue
            if c == "F":
                text += f'<c r="F{number}"><v>{v}</v></c>'
            elif shared:
                strings.append(v)
                text += f'<c r="{c}{number}" t="s"><v>{len(strings) - 1}</v></c>'
            else:
                text += f'<c r="{c}{number}" t="inlineStr"><is><t>{v}</t></is></c>'
        body += f'<row r="{number}">{text}</row>'
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet5.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
        if shared:
            book.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><r><t>{s[:3]}</t></r><r><t>{s[3:]}</t></r></si>" for s in strings) + "</sst>")


def test_workbooks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "_SHEET_ROWS", 7)
    primes = spark.createDataFrame([(p,) for p in (11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47)], "p long")
    own = {r["p"]: (r["cleaned_mask"], r["full_mask"], r["symbol_order"]) for r in masks.mask_strings(primes).collect()}
    sheet = [(6 + k, e, f"{p}.0" if k % 2 else p, g, h) for k, (p, (e, g, h)) in enumerate(own.items())]
    workbook(tmp_path / "a.xlsx", [(1, "head", 2, "x", "y"), *sheet[:5], (100, None, 53, "x", "y")])
    workbook(tmp_path / "b.xlsx", sheet[5:], shared=True)
    rows = store.read_mask_sheet(spark, f"{tmp_path}/*.xlsx")
    assert sorted(map(tuple, rows.collect())) == sorted((n, int(float(p)), e, g, h) for n, e, p, g, h in sheet)
    assert masks.mask_mismatches(rows, primes).count() == 0
    assert "ArrowEvalPython" not in masks.mask_mismatches(rows)._jdf.queryExecution().toString()


def test_mismatches_both_ways(spark):
    primes = spark.createDataFrame([(p,) for p in (11, 13, 17, 19)], "p long")
    rows = masks.mask_strings(spark.createDataFrame([(11,), (13,), (17,), (23,)], "p long")).select(F.col("p").cast("int").alias("row_number"), F.col("p").alias("prime"), "cleaned_mask", "full_mask", "symbol_order")
    rows = rows.withColumn("full_mask", F.when(F.col("prime") == 13, "0").otherwise(F.col("full_mask"))).withColumn("symbol_order", F.when(F.col("prime") == 13, None).otherwise(F.col("symbol_order")))
    rows = rows.unionByName(rows.where("prime = 17").withColumn("row_number", F.lit(40)))
    found = masks.mask_mismatches(rows, primes)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(13, 13, "differs", ["full_mask", "symbol_order"]), (40, 17, "repeated", []), (None, 19, "missing", []), (23, 23, "unexpected", [])], key=repr)
    first = masks.first_mismatches(found, 2).collect()
    assert [(r["row_number"], r["kind"], r["total"]) for r in first] == [(13, "differs", 4), (23, "unexpected", 4)]
    assert masks.first_mismatches(found).count() == 4 and masks.first_mismatches(found.where("false")).count() == 0


def test_written_chunk_files(spark, tmp_path):
    """Files of the sink are those of the format, and are read by all readers."""
    from numera.operators import archive

    path, chunks = f"{tmp_path}/c", archive.chunked(spark, 9000, 77).unionByName(spark.createDataFrame([(500, 2), (600, 1009), (600, 100_003)], "chunk_id long, p long"))
    chunk_files.write_chunks(chunks.repartition(7), path)
    want = sorted(tuple(r) for r in chunks.where("p >= 11").collect())
    assert sorted(tuple(r) for r in chunk_files.read_primes(spark, path).collect()) == want
    assert sorted(tuple(r) for r in store.read_older_chunks(spark, path).collect()) == want
    # a chunk of direct primes alone has no file, and none is left over under another name
    names = sorted(p.name for p in (tmp_path / "c").iterdir())
    assert names == [f"chunk_{c:020d}.zst" for c in sorted({c for c, _ in want})]
    for name in names[:2]:
        blob = (tmp_path / "c" / name).read_bytes()
        own = [p for c, p in want if c == int(name[6:26])]
        assert store.wheel_values(blob) == own and store.decode_head(blob)["last_prime"] == own[-1]
    # written again, chunks that are gone have no file
    chunk_files.write_chunks(chunks.where("chunk_id < 3"), path)
    assert len(list((tmp_path / "c").iterdir())) == 3


def test_a_failed_write_leaves_the_old_files(spark, tmp_path):
    from numera.operators import archive

    path = f"{tmp_path}/c"
    chunk_files.write_chunks(archive.chunked(spark, 500, 20), path)
    before = {p.name: p.read_bytes() for p in (tmp_path / "c").iterdir()}
    spark.dataSource.register(chunk_files.ChunkFiles)
    bad = spark.createDataFrame([(1, b"new"), (2, None)], "chunk_id long, content binary").coalesce(1)
    with pytest.raises(Exception):
        bad.write.format("chunk_files").mode("overwrite").save(path)
    assert {p.name: p.read_bytes() for p in (tmp_path / "c").iterdir() if not p.name.startswith("_")} == before
    assert chunk_files.read_heads(spark, path).count() == len(before)
