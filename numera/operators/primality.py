"""Primality and successors of single numbers, of any size, as columns."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numera.functions.integers import DIRECT_PRIMES
from numera.operators.bignum import SIEVE_LIMIT, divisor_trees, window_sieve
from numera.operators.sieve import base_primes, window_primes

#: Bases that decide every number below 3.3 * 10^24, longs with room to spare.
LONG_BASES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)
#: The bases of the configurable test: the first 65 primes. More rounds than that are not made.
MOST_ROUNDS = 65
_ROUND_BASES = tuple(base_primes(313).tolist())
ROUNDS = 32
TRIAL_LIMIT = 1_000_000
MAX_DIGITS = 1024
LONGS = 2**63
#: Tasks a core over which costly numbers are dealt: a few bytes each, they would share a task otherwise, and few tasks a core end unevenly.
TASKS = 8


def strong_witness(n: int, a: int) -> bool:
    """Whether base a shows that the odd n > 2 is composite."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    x = pow(a, d, n)
    if x in (1, n - 1):
        return False
    for _ in range(r - 1):
        x = x * x % n
        if x == n - 1:
            return False
    return True


def is_prime_int(n: int) -> bool:
    """Exact below 3.3 * 10^24, a strong probable prime to 13 bases above."""
    if n < 2:
        return False
    for p in LONG_BASES:
        if n % p == 0:
            return n == p
    return not any(strong_witness(n, a) for a in LONG_BASES)


def next_prime_int(n: int) -> int:
    """The smallest prime above n, exact below 3.3 * 10^24."""
    for p in DIRECT_PRIMES:
        if n < p:
            return p
    return next(c for c in window_sieve().candidates(n) if is_prime_int(c))


def prime_flags(values: np.ndarray) -> np.ndarray:
    """For longs: windows that are densely asked for are sieved, other values tested one by one."""
    out = np.zeros(len(values), bool)
    order = np.argsort(values, kind="stable")
    own = values[order]
    start = int(np.searchsorted(own, 2))
    width = 1 << 22
    while start < len(own):
        lo = int(own[start])
        stop = int(np.searchsorted(own, min(lo + width, 2**63 - 1)))
        stop = max(stop, start + 1)
        hi = int(own[stop - 1]) + 1
        if hi < 10**13 and (stop - start) * 2000 > hi - lo:
            found = window_primes(lo, hi, base_primes(math.isqrt(hi)))
            out[order[start:stop]] = np.isin(own[start:stop], found)
        else:
            out[order[start:stop]] = [is_prime_int(int(n)) for n in own[start:stop]]
        start = stop
    return out


def _flagged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.assign(is_prime=prime_flags(frame["n"].to_numpy(np.int64)))


def is_prime(numbers: DataFrame, column: str = "n") -> DataFrame:
    """(n, is_prime) for the distinct non-null longs of a column.

    Numbers are dealt out by range, so that dense ones share a sieve.
    """
    distinct = numbers.select(F.col(column).cast("long").alias("n")).where("n is not null").distinct()
    return distinct.repartitionByRange("n").mapInPandas(_flagged, "n long, is_prime boolean")


def strong_tests(numbers: DataFrame, bases: tuple[int, ...], column: str = "n") -> DataFrame:
    """(n, composite): whether one of the bases is a strong witness, for odd longs above all of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(composite=[any(strong_witness(int(n), a) for a in bases) for n in frame["n"]])

    return numbers.select(F.col(column).cast("long").alias("n")).distinct().mapInPandas(run, "n long, composite boolean")


def small_divisors(n: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For longs the smallest of the base primes that divides each and is not it; 0 without one."""
    found = np.zeros(len(n), np.int64)
    open_ = np.flatnonzero(n > 3)
    for p in base.tolist():
        open_ = open_[p * p <= n[open_]]
        if not len(open_):
            break
        hit = n[open_] % p == 0
        found[open_[hit]] = p
        open_ = open_[~hit]
    return found


def smallest_divisor(numbers: DataFrame, column: str = "n", limit: int = TRIAL_LIMIT) -> DataFrame:
    """(n, divisor): smallest prime divisor up to ``limit`` other than n itself, null without one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = base_primes(limit)
        for frame in frames:
            found = small_divisors(frame["n"].to_numpy(np.int64), base)
            yield frame.assign(divisor=pd.array([int(x) or None for x in found], "Int64"))

    distinct = numbers.select(F.col(column).cast("long").alias("n")).where("n is not null").distinct()
    return distinct.mapInPandas(run, "n long, divisor long")


@dataclass(frozen=True)
class FastResult:
    status: str
    divisor: int | None = None
    witness: int | None = None
    rounds: int | None = None


def strong_rounds(n: int, rounds: int) -> FastResult:
    """Strong tests of an n > 1 to the first bases, as far as one shows it composite or is n itself."""
    bases = _ROUND_BASES[: min(rounds, MOST_ROUNDS)]
    for k, a in enumerate(bases, 1):
        if n == a:
            return FastResult("probable_prime", rounds=k)
        if strong_witness(n, a):
            return FastResult("composite", witness=a)
    return FastResult("probable_prime", rounds=len(bases))


def is_prime_fast(n: int, rounds: int = ROUNDS, limit: int = TRIAL_LIMIT) -> FastResult:
    """Wheel, division by small primes, then strong tests to the first bases.

    status is composite, with the smallest divisor found or the first base that
    shows it, or probable_prime with the rounds made.
    """
    if n < 2:
        return FastResult("composite", divisor=1)
    if n in DIRECT_PRIMES:
        return FastResult("probable_prime", rounds=0)
    divisor = divisor_trees(min(limit, TRIAL_LIMIT)).smallest(n)
    return FastResult("composite", divisor=divisor) if divisor and divisor != n else strong_rounds(n, rounds)


def are_prime_fast(values: list[int], rounds: int = ROUNDS, limit: int = TRIAL_LIMIT) -> list[FastResult]:
    """``is_prime_fast`` of many numbers: longs are divided side by side, larger ones by product trees."""
    longs = [k for k, n in enumerate(values) if n < LONGS]
    n = np.array([values[k] for k in longs], np.int64)
    divisors = dict(zip(longs, small_divisors(n, base_primes(min(limit, TRIAL_LIMIT))).tolist()))
    out = []
    for k, n in enumerate(values):
        divisor = divisors.get(k)
        if divisor is None or n < 2 or n in DIRECT_PRIMES:
            out.append(is_prime_fast(n, rounds, limit))
        else:
            out.append(FastResult("composite", divisor=divisor) if divisor else strong_rounds(n, rounds))
    return out


@dataclass(frozen=True)
class NextPrime:
    p: int
    offset: int
    checked: int
    rounds: int


def next_prime_fast(n: int, rounds: int = ROUNDS, limit: int = SIEVE_LIMIT) -> NextPrime:
    """The smallest (probable) prime above n >= 0: a sieved window behind n, strong tests of what it leaves.

    ``checked`` counts the candidates that were tested, ``rounds`` the tests of
    the last one; below 2^64 one candidate counts, below 5 no test.
    """
    for p in (2, 3, 5):
        if n < p:
            return NextPrime(p, p - n, 1, 0)
    if n < 2**64:
        p = next_prime_int(n)
        return NextPrime(p, p - n, 1, rounds)
    for checked, c in enumerate(window_sieve(limit).candidates(n), 1):
        told = strong_rounds(c, rounds)
        if told.status == "probable_prime":
            return NextPrime(c, c - n, checked, told.rounds)
    raise AssertionError("there is no last prime")


class Prover(Protocol):
    """Turns a probable prime into a proven one; the default cannot."""

    name: str

    def prove(self, n: int) -> str | None:
        """A certificate, or None."""


class NullProver:
    name = "none"

    def prove(self, n: int) -> str | None:
        return None


_FAST = T.StructType([T.StructField("status", T.StringType()), T.StructField("divisor", T.StringType()), T.StructField("witness", T.LongType()), T.StructField("rounds", T.IntegerType())])
_NEXT = T.StructType([T.StructField("p", T.StringType()), T.StructField("offset", T.StringType()), T.StructField("checked", T.LongType()), T.StructField("rounds", T.IntegerType())])


def whole(text: str) -> int:
    """A decimal string of any length as a number."""
    if len(text) > sys.get_int_max_str_digits() > 0:
        sys.set_int_max_str_digits(0)
    return int(text)


def _fast(value: str, rounds: int) -> Column:
    @F.pandas_udf(_FAST)
    def told(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in values:
            got = are_prime_fast([whole(v) for v in series], rounds)
            yield pd.DataFrame({"status": [g.status for g in got], "divisor": [None if g.divisor is None else str(g.divisor) for g in got], "witness": pd.array([g.witness for g in got], "Int64"), "rounds": pd.array([g.rounds for g in got], "Int32")})

    return told(value)


def _next(value: str, rounds: int) -> Column:
    @F.pandas_udf(_NEXT)
    def told(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in values:
            got = [next_prime_fast(whole(v), rounds) for v in series]
            yield pd.DataFrame([(str(g.p), str(g.offset), g.checked, g.rounds) for g in got], columns=["p", "offset", "checked", "rounds"])

    return told(value)


#: White space around a number, by code point.
SPACES = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), then), 1)


def validated(text: Column, max_digits: int = MAX_DIGITS) -> Column:
    """STRUCT<ok, error, value, position, character> of decimal input: trimmed, one leading + dropped, ASCII digits only, bounded length.

    position and character tell the first one that is no digit, counted behind the +.
    """

    def error(body: Column, digits: Column) -> Column:
        return (
            F.when(body.isNull(), "null")
            .when(body.startswith("-"), "negative")
            .when(F.length(digits) == 0, "empty")
            .when(~digits.rlike(r"\A[0-9]*\z"), "invalid_char")
            .when(F.length(digits) > max_digits, "too_long")
        )

    def told(digits: Column, error: Column) -> Column:
        position = F.when(error == "invalid_char", F.length(F.regexp_extract(digits, r"\A([0-9]*)", 1)))
        return F.struct(error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), digits).alias("value"), position.alias("position"), F.substr(digits, position + 1, F.lit(1)).alias("character"))

    return _let(F.btrim(text, F.lit(SPACES)), lambda body: _let(F.regexp_replace(body, r"\A\+", ""), lambda digits: _let(error(body, digits), lambda e: told(digits, e))))


def validated_request(text: Column, max_digits: int = 100_000) -> Column:
    """STRUCT<ok, error, value> of a number in a request: all white space is left out, then digits only, bounded length."""

    def told(digits: Column) -> Column:
        error = F.when(digits.isNull(), "null").when(F.length(digits) == 0, "empty").when(F.length(digits) > max_digits, "too_long").when(~digits.rlike(r"\A[0-9]+\z"), "invalid_char")
        return _let(error, lambda e: F.struct(e.isNull().alias("ok"), e.alias("error"), F.when(e.isNull(), digits).alias("value")))

    return _let(F.regexp_replace(text, f"[{SPACES}]+", ""), told)


def parsed_long(text: Column) -> Column:
    """STRUCT<ok, error, value> of a number >= 0 that fits a long: trimmed, one leading + allowed."""

    def told(body: Column, value: Column) -> Column:
        error = F.when(body.isNull(), "null").when(F.length(body) == 0, "empty").when(~body.rlike(r"\A\+?[0-9]+\z"), "invalid").when(value.isNull(), "out_of_range")
        return F.struct(error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), value).alias("value"))

    return _let(F.btrim(text, F.lit(SPACES)), lambda body: _let(F.regexp_replace(body, r"\A\+?0*(?=[0-9])", "").try_cast("long"), lambda value: told(body, value)))


def preview(text: Column) -> Column:
    """Up to 40 characters as they are; of more the first 20, the last 10 and the number of digits."""
    return F.when(F.length(text) <= 40, text).otherwise(F.concat(F.left(text, F.lit(20)), F.lit("..."), F.right(text, F.lit(10)), F.lit(" ("), F.length(text).cast("string"), F.lit(" digits)")))


def is_prime_big(numbers: DataFrame, column: str = "text", max_digits: int = MAX_DIGITS, rounds: int = ROUNDS) -> DataFrame:
    """(text, ok, error, status, divisor, witness, rounds) for decimal strings of any size.

    Invalid input and numbers that 2, 3 or 5 divides by their digits never
    reach Python.
    """
    rows = numbers.select(F.col(column).alias("text"), validated(F.col(column), max_digits).alias("v")).select("text", "v.ok", "v.error", "v.value")
    # the divisor that the wheel would find first; 7 needs the number itself
    digit_sum = F.aggregate(F.transform(F.split("value", ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))), F.lit(0), lambda a, x: a + x)
    last = F.right("value", F.lit(1))
    small = F.length(F.regexp_replace("value", "^0+", "")) < 2
    cheap = F.when(last.isin(*"02468"), "2").when(F.pmod(digit_sum, F.lit(3)) == 0, "3").when(last == "5", "5")
    rows = rows.withColumn("divisor", F.when(F.col("ok") & ~small, cheap))
    none = F.lit(None)
    invalid = rows.where(~F.col("ok")).select("text", "ok", "error", none.cast("string").alias("status"), none.cast("string").alias("divisor"), none.cast("long").alias("witness"), none.cast("int").alias("rounds"))
    settled = rows.where(F.col("ok") & F.col("divisor").isNotNull()).select("text", "ok", "error", F.lit("composite").alias("status"), "divisor", none.cast("long").alias("witness"), none.cast("int").alias("rounds"))
    tested = rows.where(F.col("ok") & F.col("divisor").isNull()).select("text", "ok", "error", _fast("value", rounds).alias("r")).select("text", "ok", "error", "r.status", "r.divisor", "r.witness", "r.rounds")
    return invalid.unionByName(settled).unionByName(tested)


def next_prime_big(numbers: DataFrame, column: str = "text", max_digits: int = MAX_DIGITS, rounds: int = ROUNDS) -> DataFrame:
    """(text, ok, error, p, offset, checked, rounds): smallest prime above a decimal string, see ``next_prime_fast``.

    Valid numbers are dealt over ``TASKS`` tasks a core.
    """
    rows = numbers.select(F.col(column).alias("text"), validated(F.col(column), max_digits).alias("v")).select("text", "v.ok", "v.error", "v.value")
    none = F.lit(None)
    invalid = rows.where(~F.col("ok")).select("text", "ok", "error", none.cast("string").alias("p"), none.cast("string").alias("offset"), none.cast("long").alias("checked"), none.cast("int").alias("rounds"))
    valid = rows.where("ok").repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    answered = valid.select("text", "ok", "error", _next("value", rounds).alias("r")).select("text", "ok", "error", "r.p", "r.offset", "r.checked", "r.rounds")
    return invalid.unionByName(answered)


def prove(numbers: DataFrame, prover: Prover, column: str = "text") -> DataFrame:
    """``is_prime_big`` plus (proven, certificate, prover); the prover runs once a row on the executors."""
    tested = is_prime_big(numbers, column)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [prover.prove(int(t)) if s == "probable_prime" else None for t, s in zip(frame["text"], frame["status"])]
            yield frame.assign(proven=[c is not None for c in got], certificate=got, prover=prover.name)

    schema = "text string, ok boolean, error string, status string, divisor string, witness long, rounds int, proven boolean, certificate string, prover string"
    return tested.mapInPandas(run, schema)
