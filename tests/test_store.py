"""The stored archive: versions, repair, exact chunks, questions to the bitmap."""

import functools
import random
import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from numera.operators import archive, maintenance, sieve, stored
from numera.sources import store


@functools.lru_cache
def chunked(spark, hi, size):
    """Computed once and kept: what is tested is how chunks are stored."""
    return spark.createDataFrame(archive.chunked(spark, hi, size).toPandas(), "chunk_id long, p long").repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def values(spark, path):
    return rows(store.read_archive(spark, path))


def written(path, version):
    return [p for p in Path(path).rglob("*.parquet") if f"version={version}/wheel" in p.as_posix()]


def test_index_of_the_written_words(spark, tmp_path):
    chunks = chunked(spark, 4000, 37).unionByName(spark.createDataFrame([(900, 2), (900, 3), (901, 7), (901, 2003), (901, 9)], "chunk_id long, p long"))
    path = f"{tmp_path}/a"
    assert store.write_archive(chunks, path, block_cycles=4) == 1
    assert rows(store.read_index(spark, path)) == rows(archive.index(chunks.where("p <> 9")))
    assert values(spark, path) == rows(chunks.where("p >= 11"))
    # 4000 is in cycle 19, so blocks of four cycles make five partitions
    assert len(list((Path(path) / "version=1/wheel").glob("block=*"))) == 5
    assert {r["chunk_id"]: r["direct"] for r in store.read_index(spark, path, True).where("direct > 0").collect()} == {0: 15, 900: 3, 901: 8}


def test_updates_write_their_chunks_only(spark, tmp_path):
    path, whole = f"{tmp_path}/a", chunked(spark, 6000, 50)
    store.update_archive(whole.where("chunk_id < 4"), path)
    assert store.update_archive(whole.where("chunk_id >= 4"), path) == 2
    assert values(spark, path) == rows(whole.where("p >= 11")) and rows(store.read_index(spark, path)) == rows(archive.index(whole))
    # a chunk written again leaves its old rows behind, and readers see the new ones
    other = spark.createDataFrame([(2, 11), (2, 5987)], "chunk_id long, p long")
    assert store.update_archive(other, path) == 3
    assert values(spark, path) == rows(whole.where("p >= 11 and chunk_id <> 2").unionByName(other))
    assert {r["chunk_id"]: r["home"] for r in store.read_index(spark, path, True).collect()} == {0: 1, 1: 1, 3: 1, 2: 3} | {k: 2 for k in range(4, 16)}
    homes = spark.read.parquet(*(str(p) for p in written(path, 3))).select("chunk_id").distinct().collect()
    assert [r[0] for r in homes] == [2]
    head = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
    assert (head["committed_chunks"], head["committed_primes"]) == (16, 783 - 50 + 2)


def test_two_writers_of_a_version(spark, tmp_path, monkeypatch):
    path, chunks = f"{tmp_path}/a", chunked(spark, 500, 50)
    store.write_archive(chunks, path)
    head = store._committed(spark, path)
    store.write_archive(chunks, path)
    # one that read the manifest before the other committed
    monkeypatch.setattr(store, "_committed", lambda *_: head)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.write_archive(chunks, path)


def test_a_write_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path, whole = f"{tmp_path}/a", chunked(spark, 3000, 50)
    store.write_archive(whole.where("chunk_id < 5"), path)
    before = values(spark, path)

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_finish", lost)
    with pytest.raises(RuntimeError):
        store.update_archive(whole, path)
    assert values(spark, path) == before and written(path, 2)
    monkeypatch.undo()
    store.update_archive(whole.where("chunk_id = 5"), path)
    assert values(spark, path) == rows(whole.where("p >= 11 and chunk_id < 6"))


def test_repair_of_lost_files(spark, tmp_path):
    path, whole = f"{tmp_path}/a", chunked(spark, 20_000, 60)
    store.write_archive(whole, path, block_cycles=8)
    assert store.repair(spark, path) == []
    before, spans = values(spark, path), rows(store.read_index(spark, path))
    shutil.rmtree(f"{path}/version=1/wheel/block=0")
    damaged = next(iter((Path(path) / "version=1/wheel/block=5").glob("*.parquet")))
    damaged.write_bytes(b"PAR1 not really")
    (damaged.parent / f".{damaged.name}.crc").unlink(missing_ok=True)
    bounds = {r["chunk_id"]: (r["first_prime"], r["last_prime"]) for r in store.read_index(spark, path).collect()}
    hit = [c for c, (a, b) in bounds.items() if a // 210 <= 7 or a // 210 // 8 <= 5 <= b // 210 // 8]
    assert store.repair(spark, path, first=3, last=1000) == sorted(c for c in hit if c >= 3)
    assert store.repair(spark, path) == sorted(c for c in hit if c < 3)
    assert values(spark, path) == before and rows(store.read_index(spark, path)) == spans
    assert store.repair(spark, path) == []
    # only lost chunks were written
    again = spark.read.parquet(*(str(p) for p in written(path, 2))).select("chunk_id").distinct().collect()
    assert {r[0] for r in again} == {c for c in hit if c >= 3}
    shutil.rmtree(f"{path}/version=1/wheel")
    assert len(store.repair(spark, path)) == len(bounds) - len(hit)
    assert values(spark, path) == before


def test_repair_that_does_not_come_out_is_not_committed(spark, tmp_path):
    path, whole = f"{tmp_path}/a", chunked(spark, 2000, 50)
    store.write_archive(whole.where("chunk_id <> 2"), path)
    wrong = archive.index(whole).withColumn("prime_count", F.when(F.col("chunk_id") == 2, 49).otherwise(F.col("prime_count")))
    with pytest.raises(ValueError, match="2"):
        store.repair(spark, path, wrong)
    assert store.read_index(spark, path).where("chunk_id = 2").count() == 0
    assert store.repair(spark, path, archive.index(whole)) == [2]
    assert values(spark, path) == rows(whole.where("p >= 11"))


def test_index_counted_anew(spark, tmp_path):
    path, whole = f"{tmp_path}/a", chunked(spark, 2000, 50)
    store.write_archive(whole.where("chunk_id < 3"), path)
    store.update_archive(whole.where("chunk_id >= 3"), path)
    spans = rows(store.read_index(spark, path, True))
    assert store.reindex(spark, path) == 3
    assert rows(store.read_index(spark, path, True).select(store.read_index(spark, path, True).columns)) == spans and not written(path, 3)
    assert values(spark, path) == rows(whole.where("p >= 11"))


def test_delta_bytes():
    rnd = random.Random(4)
    for _ in range(200):
        own = np.array([rnd.randrange(1 << rnd.choice([1, 7, 8, 14, 30, 62])) for _ in range(rnd.randrange(30))], np.int64)
        coded, plain = archive.delta_bytes(own), bytearray()
        for d in own.tolist():
            while d >= 0x80:
                plain.append(d & 0x7F | 0x80)
                d >>= 7
            plain.append(d)
        assert coded == bytes(plain) and archive.delta_values(coded).tolist() == own.tolist()
    with pytest.raises(ValueError):
        archive.delta_values(b"\x01\x80")


@pytest.mark.parametrize("width", [100, 1 << 24])
def test_archive_from_exact_chunks(spark, tmp_path, width, monkeypatch):
    exact, path, whole = f"{tmp_path}/e", f"{tmp_path}/a", chunked(spark, 9000, 64)
    monkeypatch.setattr(spark.conf, "get", spark.conf.get)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 17)  # so that parts go over batches
    try:
        store.write_exact(whole.repartition(5), exact, width)
        assert rows(store.read_exact(spark, exact)) == rows(whole)
    finally:
        spark.conf.set(batch, before)
    parts = spark.read.parquet(exact)
    assert parts.count() == whole.selectExpr("chunk_id", f"p div {width}").distinct().count()
    assert rows(store.exact_index(spark, exact)) == rows(whole.groupBy("chunk_id").agg(F.count("*"), F.min("p"), F.max("p")))
    assert store.rebuild_archive(spark, exact, path) == 1
    assert values(spark, path) == rows(whole.where("p >= 11")) and rows(store.read_index(spark, path)) == rows(archive.index(whole))
    # exact chunks that the archive lacks are encoded, the others are not looked at
    store.write_archive(whole.where("chunk_id not in (3, 4)"), f"{tmp_path}/b")
    assert store.backfill_archive(spark, exact, f"{tmp_path}/b") == [3, 4] and store.backfill_archive(spark, exact, f"{tmp_path}/b") == []
    assert values(spark, f"{tmp_path}/b") == rows(whole.where("p >= 11"))


def test_exact_chunks_that_are_not_what_their_heads_say(spark, tmp_path):
    store.write_exact(spark.createDataFrame([(0, 11), (0, 13), (0, 17)], "chunk_id long, p long"), f"{tmp_path}/e")
    spark.read.parquet(f"{tmp_path}/e").withColumn("last_prime", F.lit(19).cast("long")).write.parquet(f"{tmp_path}/f")
    with pytest.raises(Exception, match="not what its head says"):
        store.read_exact(spark, f"{tmp_path}/f").collect()


def test_next_primes_of_the_bitmap(spark, tmp_path):
    path = f"{tmp_path}/a"
    for lost in ([4, 29], [0, 9, 10]):
        chunks = chunked(spark, 8000, 35).where(~F.col("chunk_id").isin(lost))
        store.write_archive(chunks, path, block_cycles=5)
        keys = spark.range(-3, 8200).selectExpr("id as n").unionByName(spark.createDataFrame([(None,), (2**62,), (7,)], "n long"))
        assert rows(stored.next_prime(keys, path)) == rows(archive.answer_next_prime(keys, chunks))
        assert rows(stored.is_prime(keys, path)) == rows(archive.answer_is_prime(keys, chunks))
    assert rows(stored.next_prime(keys.where("false"), path)) == []


def test_a_far_gap_is_carried_over_cycles(spark, tmp_path):
    # 1327 and 1361, and the longest gap below 400 million, over two words
    for a, b in ((1327, 1361), (387096133, 387096383)):
        chunks = sieve.primes(spark, a - 1000, b + 1000).select(F.lit(0).cast("long").alias("chunk_id"), "p")
        store.write_archive(chunks, f"{tmp_path}/a")
        got = stored.next_prime(spark.createDataFrame([(a,), (a + 1,), (b - 1,), (b,)], "n long"), f"{tmp_path}/a").collect()
        assert {r["n"]: r["next_prime"] for r in got if r["n"] < b} == {a: b, a + 1: b, b - 1: b}


def test_questions_read_only_what_they_ask(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "COARSE", 4)
    path = f"{tmp_path}/a"
    store.write_archive(chunked(spark, 100_000, 500), path, block_cycles=16)
    keys = spark.createDataFrame([(50_000,), (50_001,), (90_000,)], "n long")
    assert archive.asked_ranges(keys) == [(236, 247), (428, 439)]
    bitmap = store.read_bitmap(spark, path, archive.asked_ranges(keys))
    plan = bitmap._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "block" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [" in plan and "cycle" in plan.split("PushedFilters: [")[1].split("PartitionFilters")[0]
    # files of other partitions can't be read, and needn't be
    for file in Path(path).glob("version=1/wheel/block=*/*.parquet"):
        if file.parent.name not in ("block=14", "block=15", "block=26", "block=27"):
            file.write_bytes(b"PAR1 not really")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert {r["n"]: r["next_prime"] for r in stored.next_prime(keys, path).collect()} == {50_000: 50_021, 50_001: 50_021, 90_000: 90_001}
    monkeypatch.setattr(archive, "MOST_RANGES", 1)
    assert archive.asked_ranges(keys) == [(236, 440)]
    assert archive.asked_ranges(keys.where("false")) == []


def test_missing_archive(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        stored.next_prime(spark.range(3).selectExpr("id as n"), f"{tmp_path}/none")


def test_empty_archive(spark, tmp_path):
    store.write_archive(spark.createDataFrame([], "chunk_id long, p long"), f"{tmp_path}/a")
    assert values(spark, f"{tmp_path}/a") == [] and store.read_index(spark, f"{tmp_path}/a").count() == 0
    assert rows(stored.next_prime(spark.createDataFrame([(5,), (50,)], "n long"), f"{tmp_path}/a")) == [(5, 7, "ok"), (50, None, "uncovered")]
    assert maintenance.missing(archive.index(chunked(spark, 100, 10)), store.read_index(spark, f"{tmp_path}/a")).count() == 3


def test_reconcile_and_prune(spark, tmp_path):
    path, whole = f"{tmp_path}/a", chunked(spark, 3000, 50)
    store.write_archive(whole.where("chunk_id < 4"), path)
    store.update_archive(whole.where("chunk_id between 2 and 6"), path)
    assert store.reconcile(spark, path, 350) == [] and store.prune(spark, path) == []
    # a run committed 280 primes only
    assert store.reconcile(spark, path, 280) == [5, 6]
    assert values(spark, path) == rows(whole.where("p >= 11 and chunk_id < 5")) and store.archive_seed(spark, path) == {"found": 250, "last_prime": 1583}
    assert store.reconcile(spark, path, 100) == [2, 3, 4]
    assert store.prune(spark, path) == [2, 3] and not (Path(path) / "version=2").exists() and (Path(path) / "version=1/wheel").exists()
    assert values(spark, path) == rows(whole.where("p >= 11 and chunk_id < 2"))
    store.update_archive(whole.where("chunk_id >= 2"), path)
    assert values(spark, path) == rows(whole.where("p >= 11"))
