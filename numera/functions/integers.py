"""Column functions on integers and bits."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Last digits of a prime above 5, in the order of the candidate classes.
CLASSES = (1, 3, 7, 9)
#: Primes that the candidate space leaves out.
DIRECT_PRIMES = (2, 3, 5, 7)
#: Residues coprime to 210, in order: the bits of a wheel cycle.
WHEEL = 210
WHEEL_UNITS = tuple(r for r in range(WHEEL) if math.gcd(r, WHEEL) == 1)
LONG_MAX = 2**63 - 1


def long_array(values) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def candidates_of(q: Column) -> Column:
    """The four candidates 10q + 1, 3, 7, 9."""
    return F.transform(long_array(CLASSES), lambda d: q * 10 + d)


def class_index(n: Column) -> Column:
    """0 to 3 by the last digit, null outside the candidate classes."""
    place = F.array_position(long_array(CLASSES), F.pmod(n, F.lit(10)).cast("long"))
    return F.when(place > 0, (place - 1).cast("int"))


def quotient(n: Column) -> Column:
    """n div 10, for candidates only."""
    return F.when(class_index(n).isNotNull(), div(n, 10))


def div(n: Column, by: Column | int) -> Column:
    """Exact integer division of longs, rounding down."""
    by = by if isinstance(by, Column) else F.lit(by)
    return F.call_function("div", n - F.pmod(n, by), by)


def isqrt(n: Column) -> Column:
    """Exact floor of the square root of a long >= 0."""
    r = F.floor(F.sqrt(n.cast("double"))).cast("long")
    r = F.least(r, F.lit(3037000499).cast("long"))
    r = F.when(r * r > n, r - 1).otherwise(r)
    return F.when((r < 3037000499) & ((r + 1) * (r + 1) <= n), r + 1).otherwise(r)


def coprime_to_wheel(n: Column) -> Column:
    """Whether none of 2, 3, 5, 7 divides n."""
    return (n % 2 != 0) & (n % 3 != 0) & (n % 5 != 0) & (n % 7 != 0)


def wheel_divisor(n: Column) -> Column:
    """The first of 2, 3, 5, 7 that divides n and is not n."""
    return F.coalesce(*(F.when((n % p == 0) & (n != p), F.lit(p).cast("long")) for p in DIRECT_PRIMES))


def wheel_bit(n: Column) -> Column:
    """Rank of n mod 210 among the wheel's units, null if it is none."""
    place = F.array_position(long_array(WHEEL_UNITS), F.pmod(n, F.lit(WHEEL)).cast("long"))
    return F.when(place > 0, (place - 1).cast("int"))


def wheel_unit(bit: Column) -> Column:
    """The unit that a bit of the wheel stands for."""
    return F.element_at(long_array(WHEEL_UNITS), (bit + 1).cast("int"))


def lowest_bit(bits: Column) -> Column:
    """Number of the lowest set bit of a long that is not 0."""
    return F.bit_count(bits.bitwiseAND(-bits) - 1)


def highest_bit(bits: Column) -> Column:
    """Number of the highest set bit of a long above 0."""
    return F.length(F.bin(bits)) - 1


def next_candidate(n: Column) -> Column:
    """The smallest candidate (last digit 1, 3, 7, 9) that is at least n."""
    step = long_array((1, 0, 1, 0, 3, 2, 1, 0, 1, 0))
    return n + F.element_at(step, (F.pmod(n, F.lit(10)) + 1).cast("int"))


def first_congruent(lower: Column, modulus: Column, residue: Column) -> Column:
    """The smallest number >= lower that is residue modulo modulus."""
    return lower + F.pmod(residue - lower, modulus)


def inverse_of_ten(p: Column) -> Column:
    """10 to the power -1 modulo p (p coprime to 10): the multiple of p that ends in 9, plus 1, over 10."""
    t = F.element_at(long_array((9, 3, 7, 1)), class_index(p) + 1)
    return F.pmod(div(t * p + 1, 10), p)


def hit_position(p: Column, d: int) -> Column:
    """The k in [0, p) with p dividing 10k + d."""
    return F.pmod(-inverse_of_ten(p) * d, p)


def nth_prime_bound(n: int) -> int:
    """A number that the n-th prime does not exceed; 0 for n = 0."""
    if n <= len(DIRECT_PRIMES):
        return (0, *DIRECT_PRIMES)[max(n, 0)]
    return math.ceil(n * (math.log(n) + math.log(math.log(n))) + 3 * n)


def nth_prime_bound_column(n: Column) -> Column:
    x = n.cast("double")
    large = F.ceil(x * (F.log(x) + F.log(F.log(x))) + 3 * x).cast("long")
    return F.when(n <= 4, F.element_at(long_array((0, *DIRECT_PRIMES)), (F.greatest(n, F.lit(0)) + 1).cast("int"))).otherwise(large)


@F.arrow_udf(LongType())
def _gcd(a: pa.Array, b: pa.Array) -> pa.Array:
    # nulls count as 1 here and are put back by the mask
    known = pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False)
    found = np.gcd(*(pc.fill_null(x, 1).to_numpy(zero_copy_only=False) for x in (a, b)))
    return pa.array(found, pa.int64(), mask=~known)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of longs, a batch at a time; null if one is null."""
    return _gcd(F.abs(a.cast("long")), F.abs(b.cast("long")))
