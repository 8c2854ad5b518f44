"""Numbers of any size against plain arithmetic."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from numera.operators import bignum, primality
from numera.operators.sieve import base_primes

PRIMES = base_primes(10_000).tolist()


def plain_next(n):
    """Candidate by candidate, plain Miller-Rabin."""
    c = n + 1
    while not primality.is_prime_int(c):
        c += 1
    return c


def numbers(seed, count, digits):
    rnd = random.Random(seed)
    return [rnd.randrange(10 ** (d - 1), 10**d) for d in (rnd.choice(digits) for _ in range(count))]


def test_residues():
    moduli = np.array([2, 3, 7, 9_973, 2**31 - 1], np.int64)
    for n in [0, 1, 2**30, 2**30 - 1, 2**62, *numbers(1, 50, [1, 9, 10, 18, 25, 60, 300])]:
        assert bignum.residues(n, moduli).tolist() == [n % m for m in moduli.tolist()]


@pytest.mark.parametrize("limit", [7, 100, 10_000])
def test_survivors_are_the_candidates_without_a_small_divisor(limit):
    sieve = bignum.WindowSieve(limit)
    small = [p for p in PRIMES if p <= limit]
    for q0 in [0, 1, 60, 997, *numbers(limit, 8, [12, 25, 40, 60])]:
        got = sieve.survivors(q0, 180)
        for c, d in enumerate((1, 3, 7, 9)):
            for k in range(180):
                n = 10 * (q0 + k) + d
                assert got[c, k] == all(n % p or n == p for p in small), n
        words = sieve.words(q0, 3)
        assert [[bool(words[c, k // 60] >> (k % 60) & 1) for k in range(180)] for c in range(4)] == got.tolist()


def test_next_primes_of_any_size():
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 10, 113, 1327, 31397, 2**63 - 1, 2**63 - 25, 2**64 - 60, *numbers(5, 60, [1, 2, 5, 12, 19, 20, 25, 40, 60])]:
        got = primality.next_prime_fast(n)
        assert got.p == plain_next(n) == primality.next_prime_int(n) and got.offset == got.p - n
        if n >= 2**64:
            # every candidate between that no prime up to 10,000 divides was tested
            assert got.checked == sum(all(c % p for p in PRIMES) for c in range(n + 1, got.p + 1)) and got.rounds == 32
        else:
            assert (got.checked, got.rounds) == (1, 32 if n >= 5 else 0)
    # further than one window, whose length goes by the expected gap
    far = math.prod(base_primes(400).tolist())
    assert primality.next_prime_fast(far, rounds=3).offset == plain_next(far) - far > 400


def test_smallest_divisors():
    trees, limit = bignum.DivisorTrees(5000), 5000
    small = [p for p in PRIMES if p <= limit]
    rnd = random.Random(8)
    cases = [2, 4, 4999, 4999**2, 5003, 5003 * 5009, 997 * 1009, 2**521 - 1, 5**40, math.prod(small)] + [rnd.choice(small) * rnd.choice(small) * 10**30 + rnd.randrange(3) for _ in range(200)] + numbers(9, 200, [2, 10, 30])
    for n in cases:
        assert trees.smallest(n) == next((p for p in small if n % p == 0), None), n


def test_many_numbers_are_told_like_each_alone():
    values = [-4, 0, 1, 2, 3, 4, 7, 13, 49, 121, 561, 999983, 999983**2, 1000003**2, 1000003 * 1000033, 2**61 - 1, 2**63 - 25, 2**63 + 9, 2**89 - 1, 10**30 + 57, 999983 * (2**89 - 1), *numbers(3, 300, [3, 8, 14, 18, 25])]
    base = base_primes(1_000_000).tolist()
    for n, told in zip(values, primality.are_prime_fast(values)):
        divisor = 1 if n < 2 else next((p for p in base if n % p == 0 and p != n), None)
        want = "composite" if divisor or not primality.is_prime_int(n) else "probable_prime"
        assert (told.status, told.divisor) == (want, divisor), n
        assert told == primality.is_prime_fast(n)


def test_windows_as_rows(spark):
    texts = [str(n) for n in numbers(4, 20, [25, 40, 60])]
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "text string")
    rows = bignum.sieved_windows(df, words=2, limit=500).collect()
    assert len(rows) == 20 * 4 * 2
    sieve = bignum.WindowSieve(500)
    for r in rows:
        q0 = int(r["text"]) // 10 // 60 * 60
        assert r["selector"] == sieve.words(q0, 2)[r["class_index"], r["block"]]
    assert bignum.sieved_windows(df.where("false")).count() == 0


def test_next_primes_as_rows(spark):
    cases = [*numbers(6, 40, [1, 5, 18, 19, 20, 30, 60]), 2**64 - 1, 0]
    df = spark.createDataFrame([(str(n),) for n in cases] + [("x",), (None,)], "text string")
    got = {r["text"]: r for r in primality.next_prime_big(df).collect()}
    assert all(got[str(n)]["p"] == str(plain_next(n)) for n in cases)
    assert got["x"]["error"] == "invalid_char" and got[None]["error"] == "null"


def test_next_primes_are_dealt_over_more_tasks_than_cores(spark):
    df = spark.createDataFrame([(str(10**k),) for k in range(20, 60)] + [(str(10**30),)] * 40, "text string").coalesce(1)
    rows = primality.next_prime_big(df)
    tasks = [r[0] for r in rows.select("text", F.spark_partition_id().alias("task")).groupBy("task").count().select("count").collect()]
    assert len(tasks) > spark.sparkContext.defaultParallelism and max(tasks) <= 4 and sum(tasks) == 80
