"""Every registered query against its SQL on the smallest tables."""

import pytest

from numera import queries as primes

DATA = "/root/testdata/sf0.001"
SQL = primes.oracle_sql()


@pytest.mark.parametrize("name", sorted(primes.queries()))
def test_query(spark, oracle, rows_of, name):
    names, rows = rows_of(primes.queries()[name](spark, DATA))
    assert rows
    if name in SQL:
        assert (names, rows) == oracle(SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
