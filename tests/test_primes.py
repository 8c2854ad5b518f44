import numpy as np
import pytest
from pyspark.sql import functions as F

from numera.functions import integers, masks
from numera.operators import archive, maintenance, primality, selectors, sieve, successor
from numera.plans.successor import successors
from numera.sources import store
from numera.streaming import incremental

NTH = {1: 2, 2: 3, 3: 5, 4: 7, 5: 11, 10: 29, 100: 541, 1000: 7919, 10000: 104729}


def frame(spark, values, name="n"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


@pytest.mark.parametrize("n", [*NTH, 0])
def test_nth_prime(spark, n):
    got = sieve.nth_prime(spark, n, 4096).collect()
    assert [(r["n"], r["p"]) for r in got] == ([(n, NTH[n])] if n else [])
    assert integers.nth_prime_bound(n) >= NTH.get(n, 0)


def test_counts_and_two_formulations(spark):
    assert sieve.prime_count(spark, 120_000) == 11_301
    assert sieve.prime_count(spark, 2_000_000) == 148_933
    bulk = {r.p for r in sieve.primes(spark, 0, 20_000, 1000).collect()}
    assert bulk == {r.p for r in sieve.primes_relational(spark, 20_000).collect()}
    assert [r.p for r in sieve.first_n_primes(spark, 6, 10).orderBy("rank").collect()] == [2, 3, 5, 7, 11, 13]
    assert sieve.first_n_primes(spark, 0).count() == 0


def test_primality_of_known_numbers(spark):
    known = {2: True, 3: True, 5: True, 7: True, 561: False, 1105: False, 7919: True, 15485863: True, 0: False, 1: False, -7: False, 2**61 - 1: True, 2**62: False}
    got = {r.n: r.is_prime for r in primality.is_prime(frame(spark, [*known, None, 2, 2])).collect()}
    assert got == known


def test_big_numbers(spark):
    cases = {str(2**61 - 1): "probable_prime", str(2**89 - 1): "probable_prime", str(2**67 - 1): "composite", "561": "composite", "2": "probable_prime", "5": "probable_prime", "+41": "probable_prime", "0": "composite", "1": "composite"}
    bad = {"": "empty", "  ": "empty", "+": "empty", "123abc": "invalid_char", "123 456": "invalid_char", "-1": "negative", "9" * 1025: "too_long", None: "null"}
    df = spark.createDataFrame([(t,) for t in [*cases, *bad]], "text string")
    got = {r.text: r for r in primality.is_prime_big(df).collect()}
    assert {t: got[t].status for t in cases} == cases
    assert {t: got[t].error for t in bad} == bad
    after = {r.text: r.p for r in primality.next_prime_big(spark.createDataFrame([("18446744073709552359",), ("0",), ("7",)], "text string")).collect()}
    assert after == {"18446744073709552359": "18446744073709552361", "0": "2", "7": "11"}
    assert primality.is_prime_fast(2**15823 - 1, rounds=2).status == "composite"
    proven = primality.prove(spark.createDataFrame([("7",)], "text string"), primality.NullProver()).first()
    assert (proven.proven, proven.prover) == (False, "none")


def test_next_primes(spark):
    table = {0: 2, 1: 2, 2: 3, 3: 5, 4: 5, 5: 7, 6: 7, 7: 11, 10: 11, 11: 13, 28: 29, 29: 31, 30: 31}
    assert {r.n: r.next_prime for r in successor.next_prime(frame(spark, [*table, None, 30])).collect()} == table
    assert successor.next_prime(frame(spark, [])).count() == 0


def test_successors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    keys, points = rng.integers(-50, 3000, 200).tolist(), rng.integers(0, 2500, 40).tolist()
    got = {r.n: r.p for r in successors(frame(spark, keys), frame(spark, points, "p"), width=16).collect()}
    assert got == {k: min((p for p in points if p > k), default=None) for k in keys}


def test_archive_answers(spark):
    chunks = spark.createDataFrame([(0, p) for p in (11, 13, 17, 19)] + [(1, p) for p in (23, 29, 31, 37)] + [(3, p) for p in (59, 61)], "chunk_id long, p long")
    asked = frame(spark, [0, 2, 9, 11, 22, 25, 29, 41, 43, 53, 59, 61, 67, None])
    got = {r.n: (r.is_prime, r.status) for r in archive.answer_is_prime(asked, chunks).collect()}
    assert got[29] == (True, "ok") and got[22] == (False, "ok") and got[2] == (True, "ok") and got[0] == (False, "ok")
    assert got[41] == got[43] == got[53] == got[67] == (None, "uncovered") and got[61] == (True, "ok")
    after = {r.n: (r.next_prime, r.status) for r in archive.answer_next_prime(asked, chunks).collect()}
    assert after[29] == (31, "ok") and after[9] == (11, "ok") and after[22] == (23, "ok")
    assert after[41] == after[53] == after[61] == (None, "uncovered") and after[59] == (61, "ok")
    assert {r.p for r in archive.unpacked(archive.packed(chunks)).collect()} == {r.p for r in chunks.collect()}
    back = archive.undeltas(archive.deltas(chunks))
    assert sorted((r.chunk_id, r.p) for r in back.collect()) == sorted((r.chunk_id, r.p) for r in chunks.collect())


def test_archive_on_disk(spark, tmp_path):
    chunks = archive.chunked(spark, 5000, 100)
    store.write_archive(chunks, f"{tmp_path}/a")
    back = store.read_archive(spark, f"{tmp_path}/a")
    assert {r.p for r in back.collect()} == {r.p for r in chunks.where("p >= 11").collect()}
    head = spark.read.parquet(f"{tmp_path}/a/manifest").first()
    assert head.committed_primes == 669 and head.last_prime == 4999
    assert store.read_index(spark, f"{tmp_path}/a").count() == 7
    assert store.archive_seed(spark, f"{tmp_path}/a") == {"found": 669, "last_prime": 4999}
    assert store.archive_seed(spark, f"{tmp_path}/none") is None


def test_a_broken_write_leaves_the_committed_archive(spark, tmp_path):
    path = f"{tmp_path}/a"
    with pytest.raises(FileNotFoundError):
        store.read_archive(spark, path)
    store.write_archive(archive.chunked(spark, 1000, 50), path)
    # the second version got as far as its bitmap
    archive.packed(archive.chunked(spark, 100, 50)).write.parquet(f"{path}/version=2/wheel")
    assert store.read_archive(spark, path).count() == 164
    store.write_archive(archive.chunked(spark, 2000, 50), path)
    assert store.read_archive(spark, path).count() == 299 and store.read_index(spark, path).count() == 7


def test_stored_answers_are_those_of_the_unpacked_archive(spark, tmp_path):
    chunks = archive.chunked(spark, 3000, 40).where("chunk_id != 4")
    store.write_archive(chunks, f"{tmp_path}/a")
    keys = spark.range(-3, 3100).withColumnRenamed("id", "n")
    spans, bitmap = store.read_index(spark, f"{tmp_path}/a"), store.read_bitmap(spark, f"{tmp_path}/a")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(archive.stored_is_prime(keys, spans, bitmap)) == rows(archive.answer_is_prime(keys, chunks))
    ends = sorted((r.first_prime, r.last_prime) for r in spans.collect())
    own = []
    for n in range(-3, 3100):
        if not any(a <= n <= b for a, b in ends):
            own.append((n, max((b for _, b in ends if b < n), default=None), min((a for a, _ in ends if a > n), default=None)))
    assert sorted(tuple(r) for r in archive.gaps(keys, spans).collect()) == own
    store.write_tsv_index(spans, f"{tmp_path}/i")
    back = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/i")
    assert back.count() == spans.count()


def test_older_files(spark, tmp_path):
    import struct

    import zstandard

    own = [11, 13, 17, 211, 223, 419]
    raw = bytearray(6 * 2)
    for p in own:
        bit = integers.WHEEL_UNITS.index(p % 210)
        raw[6 * (p // 210) + bit // 8] |= 1 << bit % 8
    payload = zstandard.compress(bytes(raw))
    blob = store.WHEEL_MAGIC + struct.pack("<6Q", 11, 419, 0, 2, len(raw), len(payload)) + payload
    (tmp_path / "chunk_7.bin.zst").write_bytes(blob)
    assert store.wheel_values(blob) == own
    exact = store.EXACT_MAGIC + archive.exact_bytes([2, 3, 300, 100_000])
    assert store.exact_values(exact) == [2, 3, 300, 100_000]
    for bad in (blob[:54], b"x" * 80):
        with pytest.raises(ValueError):
            store.decode_wheel(bad)
    with pytest.raises(ValueError):
        store.exact_values(exact[:-1])
    assert [(r.chunk_id, r.p) for r in store.read_older_chunks(spark, str(tmp_path)).orderBy("p").collect()] == [(7, p) for p in own]


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a=1\nnoise\nb = x=y\n")
    assert {(r.key, r.value) for r in store.read_key_values(spark, f"{tmp_path}/m.txt").collect()} == {("a", "1"), ("b", "x=y")}
    (tmp_path / "n.txt").write_text("12 34\n56\n")
    assert store.read_big_integers(spark, f"{tmp_path}/n.txt").first().text == "123456"
    (tmp_path / "i.tsv").write_text("chunk_id\tprime_count\tfirst_prime\tlast_prime\tbytes\n0\t4\t2\t7\t20\nbad\n1\t2\t11\t13\t18\n")
    rows = store.read_tsv_index(spark, f"{tmp_path}/i.tsv", store.EXACT_INDEX)
    assert store.read_tsv_index(spark, f"{tmp_path}/i.tsv", store.EXACT_INDEX, first=1, last=1).first().chunk_id == 1
    assert rows.count() == 2 and store.last_prime_of_index(rows).first().last_prime == 13


def test_masks(spark):
    golden = {11: ("f7fbfffdfef", "fffbfffdfef", "7bde"), 13: ("fbfefffff7fdf", "fffefffff7fdf", "be7d"), 17: ("fdfff7fffffefffbf", "fffff7fffffefffbf", "d7eb"), 19: ("fefffdfffffffbfff7f", "fffffdfffffffbfff7f", "edb7")}
    got = {r.p: (r.full_mask, r.cleaned_mask, r.symbol_order) for r in masks.mask_strings(frame(spark, golden, "p")).collect()}
    assert got == golden
    for r in masks.hit_positions(sieve.primes(spark, 7, 900).select("p")).collect():
        assert r.k1 + r.k9 == r.k3 + r.k7 == r.p - 1 and all((10 * r[f"k{d}"] + d) % r.p == 0 for d in (1, 3, 7, 9))
    units = masks.wheel_840_coordinates(masks.wheel_840_units(spark))
    assert units.agg(F.countDistinct("address")).first()[0] == units.count() == 192
    assert masks.serialised_coordinates(units).where(F.get_json_object("document", "$.vertex_bits").rlike("^[01]{4}$")).count() == 192


def test_integer_columns(spark):
    values = [0, 1, 4, 24, 25, 26, 2**31, 3037000499**2 - 1, 3037000499**2, 2**63 - 1]
    import math

    got = frame(spark, values).select("n", integers.isqrt(F.col("n")).alias("r")).collect()
    assert {r.n: r.r for r in got} == {n: math.isqrt(n) for n in values}
    pairs = spark.createDataFrame([(12, 18), (0, 5), (17, 4), (2**40, 6**20)], "a long, b long")
    assert [r.g for r in pairs.select(integers.gcd(F.col("a"), F.col("b")).alias("g")).collect()] == [6, 5, 1, 2**20]
    steps = {r.n: r.c for r in frame(spark, range(10, 18)).select("n", integers.next_candidate(F.col("n")).alias("c")).collect()}
    assert (steps[11], steps[13], steps[10], steps[12], steps[14]) == (11, 13, 11, 13, 17)
    assert frame(spark, [7]).select(integers.first_congruent(F.col("n"), F.lit(5), F.lit(1))).first()[0] == 11


def test_selectors(spark):
    words = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (2, 2, 1 << 59), (3, 3, selectors.MASK)], "class_index int, block long, selector long")
    rows = selectors.events(words).collect()
    assert len(rows) == 62
    top = next(r for r in rows if r.class_index == 2)
    assert top.period == (2 * 60 + 59) * 10 + 7 and list(top.channel_values) == [top.period * k for k in (1, 3, 9, 7)]
    assert selectors.checksum(selectors.events(words)).first()[0] == sum(20 * r.period for r in rows) % 2**64
    cases = spark.createDataFrame([(0, 0), (10, 2400), (1000, 20_000), (1000, 40_000), (1000, 27_995), (1000, 27_996)], "b long, a long")
    assert [r[0] for r in cases.select(selectors.storage_choice(F.col("b"), F.col("a"))).collect()] == ["implicit_full", "implicit_full", "sparse", "bitmap", "sparse", "bitmap"]
    assert [selectors.synthetic_words(3, 50).tolist() == selectors.synthetic_words(3, 50).tolist(), selectors.memory_partition(10, 40, 2)] == [True, {"host": 0, "device": 320, "staging": 128, "total": 448}]


def test_maintenance(spark):
    ids = frame(spark, [1, 2, 3, 7, 9, 10, 70000, 70001, None, 3], "id")
    assert {(r.first, r.last, r.n) for r in maintenance.islands(ids).collect()} == {(1, 3, 3), (7, 7, 1), (9, 10, 2), (70000, 70001, 2)}
    assert maintenance.ranges_text(maintenance.islands(ids)).first().ranges == "1-3,7,9-10,70000-70001"
    for shards in (1, 3, 8, 20):
        own = list(range(17))
        got = {r.id: r.shard for r in maintenance.even_split(frame(spark, own, "id"), shards).collect()}
        assert got == {x: i for i in range(shards) for x in own[len(own) * i // shards : len(own) * (i + 1) // shards]}
    one = lambda s, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} long" for k in v))
    progress = one(spark, found_count=150, target_count=200, last_prime=863, archive_buffered_primes=17)
    wheel, exact = frame(spark, [0], "chunk_id"), spark.createDataFrame([(0, 100)], "chunk_id long, prime_count long")
    for alive, buffered, state in ((True, 17, "running"), (False, 0, "stale")):
        row = maintenance.status(progress, one(spark, archive_committed_primes=100), one(spark, committed_primes=100, committed_chunks=1), wheel, exact, alive).first()
        assert (row.claimed, row.durable, row.buffered, row.queryable, row.healthy, row.run_state) == (150, 100, buffered, 100, True, state)


def test_incremental(spark, tmp_path):
    path = f"{tmp_path}/run"
    first = incremental.first_n(spark, 5000, path, width=1000, batch_segments=10, stop=lambda: True).first()
    assert not first.complete and first.found == 1229
    done = incremental.first_n(spark, 5000, path, width=1000, batch_segments=10).first()
    assert (done.complete, done.resumed, done.found, done.last_prime) == (True, True, 5000, 48611)
    assert incremental.committed(spark, path).agg(F.count("*"), F.countDistinct("p"), F.max("rank")).first() == (5000, 5000, 5000)
    more = incremental.first_n(spark, 5001, path, width=1000, batch_segments=10).first()
    assert more.last_prime == 48619
    fresh = incremental.first_n(spark, 10, path, resume="never", width=1000).first()
    assert (fresh.resumed, fresh.found, fresh.last_prime) == (False, 10, 29)
    assert incremental.first_n(spark, 0, f"{tmp_path}/none").first().found == 0
    with pytest.raises(incremental.ResumeError):
        incremental.first_n(spark, 10, f"{tmp_path}/absent", resume="always")
    assert incremental.eta(spark.createDataFrame([(10, 20, 29, 5.0), (20, 20, 71, 5.0)], "found long, target long, last_prime long, seconds double")).orderBy("found").collect()[0].eta == 5.0


def test_resuming_from_an_archive(spark, tmp_path):
    whole, holed = f"{tmp_path}/a", f"{tmp_path}/b"
    store.write_archive(archive.chunked(spark, 3000, 40), whole)
    store.write_archive(archive.chunked(spark, 3000, 40).where("chunk_id != 4"), holed)
    assert store.archive_seed(spark, whole) == {"found": 430, "last_prime": 2999} and store.archive_seed(spark, holed) is None
    run = f"{tmp_path}/run"
    done = incremental.first_n(spark, 500, run, width=1000, archive=whole).first()
    assert (done.complete, done.resumed, done.found, done.last_prime) == (True, True, 500, 3571)
    rows = incremental.committed(spark, run)
    assert rows.agg(F.count("*"), F.min("rank"), F.min("p"), F.max("p")).first() == (70, 431, 3001, 3571)
    # the committed state is ahead of the archive now
    assert incremental.first_n(spark, 600, run, width=1000, archive=whole).first().last_prime == 4409
    # an archive that found more than is asked for does not seed a run
    few = incremental.first_n(spark, 100, f"{tmp_path}/few", width=1000, archive=whole).first()
    assert (few.resumed, few.last_prime) == (False, 541)


def test_segment_stream(spark, tmp_path):
    query = incremental.segment_stream(spark, str(tmp_path), width=100, rows_per_batch=5)
    try:
        query.awaitTermination(12)
    finally:
        query.stop()
    got = spark.read.parquet(f"{tmp_path}/stream").where("p < 500")
    assert got.count() == 95 and got.select("p").distinct().count() == 95


def test_workbook_sheet(spark, tmp_path):
    import zipfile

    from numera.sources import store

    cells = {"E": "f00f", "F": "11", "G": "7bdf", "H": "7bd"}
    row = "".join(f'<c r="{c}6" t="inlineStr"><is><t>{v}</t></is></c>' if c != "F" else f'<c r="F6"><v>{v}</v></c>' for c, v in cells.items())
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as book:
        book.writestr("xl/worksheets/sheet5.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"/><row r="6">{row}</row></sheetData></worksheet>')
    assert [tuple(r) for r in store.read_mask_sheet(spark, str(tmp_path / "book.xlsx")).collect()] == [(6, 11, "f00f", "7bdf", "7bd")]


def test_checksum_of_words_is_that_of_their_events(spark):
    from numera.operators import selectors

    words = spark.range(500).selectExpr("cast(id % 4 as int) as class_index", "id * id * 1000003 as block", "xxhash64(id) & (shiftleft(1L, 60) - 1) as selector")
    assert selectors.word_checksum(words).collect() == selectors.checksum(selectors.events(words)).collect()
    assert selectors.word_checksum(words.where("false")).first()[0] == 0


def test_next_primes_of_far_keys_sieve_nothing_between(spark):
    from numera.operators import successor

    keys = [-5, 0, 1, 2, 7, 113, 10**15, 2**62, 1327]
    got = {r.n: r.next_prime for r in successor.next_prime(spark.createDataFrame([(k,) for k in [*keys, None]], "n long")).collect()}
    from numera.operators.primality import next_prime_int

    assert got == {k: next_prime_int(k) for k in keys}


def test_progress_and_batches_by_time(spark, tmp_path):
    path, seen = f"{tmp_path}/run", []
    assert incremental.progress(spark, path).count() == 0
    first = incremental.first_n(spark, 3000, path, width=1000, batch_segments=2, stop=lambda: len(seen) >= 2, report=seen.append, every=1e6).first()
    assert not first.complete and first.batches == 2
    rows = incremental.progress(spark, path).orderBy("version").collect()
    assert [r.asDict() for r in rows] == seen
    assert [(r.found, r.segments, r.batch_found) for r in rows] == [(303, 2, 303), (1229, 8, 926)]
    assert rows[1].percent == 100 * 1229 / 3000 and rows[1].eta == (3000 - 1229) / rows[1].per_second and rows[1].per_second == 926 / rows[1].batch_seconds
    done = incremental.first_n(spark, 3000, path, width=1000, batch_segments=50).first()
    assert done.complete and done.last_prime == 27449
    last = incremental.progress(spark, path).orderBy(F.desc("version")).first()
    assert (last.percent, last.eta) == (100.0, 0.0)
    assert incremental._next_size(8, 2.0, None) == 8 and incremental._next_size(8, 2.0, 1.0) == 4 and incremental._next_size(8, 100.0, 1.0) == 2 and incremental._next_size(8, 0.0, 1.0) == 32 and incremental._next_size(1, 50.0, 1.0) == 1


def test_a_signal_stops_after_the_batch(spark, tmp_path):
    import os
    import signal

    with incremental.stop_on_signals(signal.SIGUSR1) as stop:
        done = incremental.first_n(spark, 5000, f"{tmp_path}/run", width=1000, batch_segments=5, stop=stop, report=lambda row: os.kill(os.getpid(), signal.SIGUSR1)).first()
    assert (done.complete, done.batches, done.found) == (False, 1, 669)
    assert incremental.first_n(spark, 5000, f"{tmp_path}/run", width=1000).first().last_prime == 48611


def test_fewer_primes_than_an_archive_seeded(spark, tmp_path):
    store.write_archive(archive.chunked(spark, 2000, 50), f"{tmp_path}/a")
    run = f"{tmp_path}/run"
    assert incremental.first_n(spark, 400, run, width=1000, archive=f"{tmp_path}/a").first().last_prime == 2741
    few = incremental.first_n(spark, 100, run, width=1000).first()
    assert (few.complete, few.found, few.last_prime) == (True, 100, 541)


def test_states_that_cannot_be_resumed(spark, tmp_path):
    run = f"{tmp_path}/run"
    incremental.first_n(spark, 100, run, width=1000)
    state = spark.read.parquet(f"{run}/state")
    for column, value, told in (("format", 2, "another format"), ("found", -1, "contradicts"), ("last_prime", None, "contradicts")):
        state.withColumn("version", F.lit(9).cast("long")).withColumn(column, F.lit(value).cast("long")).write.mode("overwrite").parquet(f"{tmp_path}/bad/state")
        with pytest.raises(incremental.ResumeError, match=told):
            incremental.first_n(spark, 200, f"{tmp_path}/bad", width=1000)
    # rows of the first format had no column for it
    state.drop("format").write.parquet(f"{tmp_path}/old/state")
    assert incremental.load_state(spark, f"{tmp_path}/old")["found"] >= 100


def test_seconds_to_go(spark):
    rows = spark.createDataFrame([(10, 10, 29, 0.0, 0.0), (5, 10, 11, 2.5, 0.0), (8, 16, 20, 0.0, 4.0), (4, 16, 7, 0.0, 4.0), (8, 16, 20, 0.0, 0.0)], "found long, target long, last long, primes double, positions double")
    got = rows.select(incremental.seconds_to_go(*(F.col(c) for c in rows.columns)).alias("eta"), incremental.percent(F.col("found"), F.col("target")).alias("percent"), incremental.gib(F.lit(3 << 29)).alias("gib")).collect()
    assert [r.eta for r in got] == [0.0, 2.0, 2.0, None, None] and [r.percent for r in got] == [100.0, 50.0, 50.0, 25.0, 50.0] and got[0].gib == 1.5


def test_the_relational_sieve_broadcasts_no_multiples(spark):
    found = sieve.primes_relational(spark, 3 * 4096, 4096)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.p for r in found.collect()) == sieve.base_primes(3 * 4096 - 1).tolist()


def test_gcds_are_taken_a_batch_at_a_time(spark):
    pairs = [(0, 0), (0, 5), (-4, 6), (4, -6), (None, 3), (3, None), (None, None), (2**63 - 1, 2**62), (7919 * 2**20, 7919 * 3**10)]
    rows = spark.createDataFrame(pairs, "a long, b long").select(integers.gcd(F.col("a"), F.col("b")).alias("g"))
    assert [r.g for r in rows.collect()] == [0, 5, 2, 2, None, None, None, 1, 7919]
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString()
