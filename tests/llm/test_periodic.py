import hashlib
import random
import zlib

import numpy as np
import pytest

from numera.llm import periodic, registry


def brute(w, least=12):
    """(start, length, period) of all runs, period by period."""
    found, n = set(), len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if length >= max(2 * p, least) and not any(w[i : i + length - q] == w[i + q : i + length] for q in range(1, p)):
                found.add((i, length, p))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def digested(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (len(runs), *longest, sha(lines.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def words_of(rnd):
    n, k = rnd.randrange(70), rnd.choice([1, 2, 2, 3, 6])
    w = [rnd.randrange(k) for _ in range(n)]
    if n and rnd.random() < 0.4:
        a = rnd.randrange(n)
        p = 1 + (n - a) // rnd.randrange(2, 9)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    return w


@pytest.mark.parametrize("least", [2, 12, 20])
def test_runs_of_many_texts(least):
    rnd = random.Random(least)
    for _ in range(400):
        texts = [words_of(rnd) for _ in range(rnd.randrange(6))]
        got = periodic.word_runs([np.array(t, np.int64) for t in texts], least)
        assert [[tuple(r) for r in own.tolist()] for own in got] == [brute(t, least) for t in texts]


def test_fibonacci_words_have_the_most_runs():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    assert [tuple(r) for r in periodic.word_runs([np.array(b)], 2)[0].tolist()] == brute(b, 2)


def test_range_minima():
    rnd = np.random.default_rng(5)
    for n in (1, 15, 16, 17, 700):
        values = rnd.integers(0, 50, n)
        lo = rnd.integers(0, n, 500)
        hi = np.minimum(lo + rnd.integers(0, n, 500), n - 1)
        assert periodic.RangeMinimum(values).of(lo, hi).tolist() == [values[a : b + 1].min() for a, b in zip(lo, hi)]


def test_texts(spark, docs_of):
    rnd = random.Random(3)
    space = [" ", "\n", "\t ", "\x0b", "\r\n"]
    texts = ["".join(f"{x}ß{rnd.choice(space)}" for x in words_of(rnd)) for _ in range(120)]
    texts += [None, "", " \n", "a a " * 20, "x " * 13, "la la la " * 9 + "end", "la la la " * 9 + "end", " a " * 12]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b c " * 9), (None, None)]
    docs = docs_of(rows).selectExpr("*", "1 as runs", "2 as collapsed", "3 as start")
    found = periodic.periodic_runs(docs.withColumn("text", periodic.tiled("text", "doc_id")))
    assert found.columns[-2:] == ["_runs", "_collapsed"] and found.select("runs").first()[0] == 1
    got = sorted((tuple(r) for r in periodic.summary(found, "_runs", "_collapsed").collect()), key=repr)
    assert got == sorted(((i, *digested(i, t)) for i, t in rows), key=repr)


def test_tiled_texts_occur():
    tiled = [i for i in range(120) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert len(tiled) > 5


def test_a_long_text_next_to_short_ones(spark, docs_of):
    rnd = random.Random(7)
    base = [str(rnd.randrange(3000)) for _ in range(60_000)]
    long = " ".join(base * 4 + ["end"] + ["x"] * 50_000)
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"]) for r in periodic.summary(periodic.periodic_runs(docs_of([(1, long), (2, "a b"), (3, None)]))).collect()}
    assert got == {1: (2, 0, 240_000, 60_000), 2: (0, None, None, None), 3: (0, None, None, None)}


def test_empty_table(spark, docs_of):
    assert periodic.summary(periodic.periodic_runs(docs_of([]))).collect() == []


def test_query_against_brute_force(spark):
    """Of the shorter texts, by brute force; of all, that what stays has no run that was found."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r[0]: tuple(r[1:]) for r in registry.op12_runs(spark, sf).collect()}
    assert got.keys() == docs.keys()
    short = [i for i, t in docs.items() if len((t or "").split()) < 700]
    assert len(short) > 100
    for i in short:
        assert got[i] == digested(i, docs[i]), i
