"""Selector words: scans in all modes, bits, synthetic words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from numera.operators import selectors


def drawn(n, density, seed=0x9E3779B97F4A7C15):
    """Draw by draw."""
    state, out, top = seed, [], 2**64 - 1
    for _ in range(n):
        word = 0
        for bit in range(60):
            state ^= state >> 12
            state = (state ^ state << 25) & top
            state ^= state >> 27
            if ((state * 0x2545F4914F6CDD1D & top) & 0xFFFFFFFF) % 100 < density:
                word |= 1 << bit
        out.append(word)
    return out


@pytest.fixture(scope="module")
def words(spark):
    rows = [(c, b, w) for c in range(4) for b, w in ((0, 0), (3, selectors.MASK), (10**9, 1), (10**9 + 1, 1 << 59))]
    rows += [(k % 4, k, w) for d in (1, 25, 50, 97) for k, w in enumerate(drawn(25, d))]
    # bits above the sixtieth don't count
    rows += [(1, 5, -1), (2, 6, 1 << 60), (3, 7, -(2**63) + 5)]
    return spark.createDataFrame(rows, "class_index int, block long, selector long").cache()


def expected(words):
    out = []
    for r in words.collect():
        for i in range(60):
            if r["selector"] >> i & 1:
                p = 10 * (60 * r["block"] + i) + (1, 3, 7, 9)[r["class_index"]]
                out.append((r["class_index"], r["block"], i, p, [p, 3 * p, 9 * p, 7 * p]))
    return sorted(out)


@pytest.mark.parametrize("mode", ["sparse", "dense", "table", "chosen"])
def test_all_modes_give_the_same_events(words, mode):
    rows = selectors.scanned(words) if mode == "chosen" else selectors.events(words, mode)
    assert sorted(tuple(r) for r in rows.collect()) == expected(words)
    assert "ArrowEvalPython" not in rows._jdf.queryExecution().toString()


def test_unknown_mode(words):
    with pytest.raises(ValueError):
        selectors.events(words, "other")


def test_checksums_and_counts(words):
    want = expected(words)
    total = sum(20 * r[3] for r in want) % 2**64
    assert selectors.word_checksum(words).first()[0] == selectors.checksum(selectors.events(words)).first()[0] == total
    assert {r["class_index"]: (r["words"], r["active_bits"]) for r in selectors.popcount(words).collect()} == {
        c: (words.where(F.col("class_index") == c).count(), sum(r[0] == c for r in want)) for c in range(4)
    }


def test_bits(spark):
    rows = spark.createDataFrame([(0b1011, i) for i in range(60)] + [(selectors.MASK, 59)], "s long, i int")
    for r in rows.select("s", "i", selectors.bit_is_set(F.col("s"), F.col("i")).alias("on"), selectors.clear_bit(F.col("s"), F.col("i")).alias("off")).collect():
        assert r["on"] == bool(r["s"] >> r["i"] & 1) and r["off"] == r["s"] & ~(1 << r["i"])


@pytest.mark.parametrize("density", [0, 1, 25, 99, 100])
def test_synthetic_words_are_those_of_one_stream(spark, density, monkeypatch):
    want = drawn(300, density)
    assert selectors.synthetic_words(300, density).tolist() == want
    for first, n in ((0, 1), (1, 1), (7, 100), (299, 1), (256, 44)):
        assert selectors.synthetic_words(n, density, first=first).tolist() == want[first : first + n]
    monkeypatch.setattr(selectors, "_WORDS", 64)
    got = selectors.synthetic(spark, 300, density).orderBy("block").collect()
    assert [r["selector"] for r in got] == want and [r["block"] for r in got] == list(range(300))


def test_jumps_of_any_length():
    states = np.array([1, 2**63, 0x9E3779B97F4A7C15], np.uint64)
    for steps in (0, 1, 2, 59, 60, 1000):
        own = states
        for _ in range(steps):
            own = selectors._step(own)
        assert selectors._applied(selectors._jumps(steps, 1)[0], states).tolist() == own.tolist()
