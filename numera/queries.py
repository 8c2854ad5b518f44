"""Queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numera.functions import integers, masks
from numera.operators import archive, bignum, groups, maintenance, primality, proofs, requests, selectors, sieve, stored, successor
from numera.plans.segments import ranked
from numera.sources import chunk_files, store
from numera.streaming import incremental

#: Primes in a chunk of the archive that the queries build from the order keys.
CHUNK = 200
#: The chunk that the archive of the gap scenarios lacks.
LOST_CHUNK = 1
MASK_LIMIT = 839

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _found[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _max_order_key(spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0


def _order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n")).distinct()


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.chunked(spark, _max_order_key(spark, sf_dir), CHUNK)


def _gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).where(F.col("chunk_id") != LOST_CHUNK)


def _residues(spark: SparkSession, sf_dir: str, modulus: int) -> DataFrame:
    """The residues (id) that the order keys leave."""
    return _table(spark, sf_dir, "orders").select((F.col("o_orderkey") % modulus).alias("id")).distinct()


def _mask_primes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primes from 11 on among the order keys' residues modulo 840: the periods of the worksheets."""
    found = primality.is_prime(_residues(spark, sf_dir, MASK_LIMIT + 1).where("id >= 11"), "id")
    return found.where("is_prime").select(F.col("n").alias("p"))


_PRIMES = """
mx AS (SELECT max(o_orderkey) AS m FROM orders),
num AS (SELECT unnest(range(2, m + 1)) AS n FROM mx),
primes AS (SELECT n AS p FROM num WHERE NOT EXISTS (SELECT 1 FROM range(2, 1000) d(d) WHERE d.d * d.d <= num.n AND num.n % d.d = 0))"""
_CHUNKS = f"""{_PRIMES},
chunks AS (SELECT (row_number() OVER (ORDER BY p) - 1) // {CHUNK} AS chunk_id, p FROM primes),
gapped AS (SELECT * FROM chunks WHERE chunk_id <> {LOST_CHUNK})"""
_INDEX = """
SELECT chunk_id, count(*) AS prime_count, min(p) FILTER (p >= 11) AS first_prime, max(p) FILTER (p >= 11) AS last_prime,
       min(p) FILTER (p >= 11) // 210 AS cycle_start,
       max(p) FILTER (p >= 11) // 210 - min(p) FILTER (p >= 11) // 210 + 1 AS cycles,
       6 * (max(p) FILTER (p >= 11) // 210 - min(p) FILTER (p >= 11) // 210 + 1) AS raw_bytes
FROM {chunks} GROUP BY chunk_id"""
_MASK_PRIMES = f"""
mask_primes AS (SELECT DISTINCT o_orderkey % {MASK_LIMIT + 1} AS p FROM orders
                WHERE p >= 11 AND NOT EXISTS (SELECT 1 FROM range(2, 30) d(d) WHERE d.d * d.d <= o_orderkey % {MASK_LIMIT + 1} AND o_orderkey % {MASK_LIMIT + 1} % d.d = 0)),
positions AS (
    SELECT p, k.k, [10 * k.k + 1, 10 * k.k + 3, 10 * k.k + 7, 10 * k.k + 9] AS candidates,
           [d FOR d IN [1, 3, 7, 9] IF (10 * k.k + d) % p = 0] AS struck_digits,
           substr('0123456789abcdef', (16 - CASE WHEN (10 * k.k + 1) % p = 0 THEN 8 ELSE 0 END - CASE WHEN (10 * k.k + 3) % p = 0 THEN 4 ELSE 0 END
               - CASE WHEN (10 * k.k + 7) % p = 0 THEN 2 ELSE 0 END - CASE WHEN (10 * k.k + 9) % p = 0 THEN 1 ELSE 0 END)::INT, 1) AS symbol
    FROM mask_primes, LATERAL (SELECT unnest(range(0, p)) AS k) k)"""


@_query(f"WITH {_PRIMES}, q AS (SELECT unnest(range(0, m // 10 + 1)) AS q FROM mx) SELECT q, d, 10 * q + d AS n FROM q, (SELECT unnest([1, 3, 7, 9]::BIGINT[]) AS d)")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sieve.candidates(spark, 0, _max_order_key(spark, sf_dir) // 10 + 1)


@_query(f"WITH {_PRIMES} SELECT p FROM primes")
def primes_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sieve.primes(spark, 0, _max_order_key(spark, sf_dir) + 1).select("p")


@_query(f"WITH {_PRIMES} SELECT p FROM primes")
def primes_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sieve.primes_relational(spark, _max_order_key(spark, sf_dir) + 1)


def _nth(count: str, limit: int) -> str:
    return f"""WITH num AS (SELECT n.n FROM range(2, {limit}) n(n)),
primes AS (SELECT n AS p FROM num WHERE NOT EXISTS (SELECT 1 FROM range(2, 1500) d(d) WHERE d.d * d.d <= num.n AND num.n % d.d = 0)),
r AS (SELECT row_number() OVER (ORDER BY p) AS rank, p FROM primes)
{count}"""


@_query(_nth("SELECT rank AS n, p FROM r WHERE rank = (SELECT count(*) FROM customer)", 200_000))
def nth_prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prime whose rank is the number of customers."""
    return sieve.nth_prime(spark, _table(spark, sf_dir, "customer").count())


@_query(_nth("SELECT rank, p FROM r WHERE rank <= (SELECT count(*) FROM customer)", 200_000))
def first_n_primes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many primes as there are customers, by rank."""
    return sieve.first_n_primes(spark, _table(spark, sf_dir, "customer").count())


@_query(f"WITH {_PRIMES} SELECT n // 1000 AS segment, sum(CASE WHEN p IS NULL THEN 0 ELSE 1 END)::BIGINT AS n, max(p) AS last FROM (SELECT unnest(range(0, m + 1)) AS n FROM mx) LEFT JOIN primes ON p = n GROUP BY 1")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sieve.segment_counts(spark, 0, _max_order_key(spark, sf_dir) + 1, 1000)


@_query("SELECT n, n >= 2 AND NOT EXISTS (SELECT 1 FROM range(2, 1000) d(d) WHERE d.d * d.d <= n AND n % d.d = 0) AS is_prime FROM (SELECT DISTINCT o_orderkey AS n FROM orders)")
def is_prime_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primality.is_prime(_table(spark, sf_dir, "orders"), "o_orderkey")


@_query(f"WITH {_PRIMES}, k AS (SELECT DISTINCT l_partkey AS n FROM lineitem) SELECT n, (SELECT min(p) FROM primes WHERE p > n) AS next_prime FROM k")
def next_prime_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return successor.next_prime(_table(spark, sf_dir, "lineitem"), "l_partkey")


@_query("SELECT n, (SELECT min(d.d) FROM range(2, 1000) d(d) WHERE d.d * d.d <= n AND n % d.d = 0) AS divisor FROM (SELECT DISTINCT o_orderkey AS n FROM orders)")
def smallest_divisor_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primality.smallest_divisor(_table(spark, sf_dir, "orders"), "o_orderkey")


@_query("SELECT DISTINCT o_orderkey AS n, CASE WHEN n % 2 = 0 AND n <> 2 THEN 2 WHEN n % 3 = 0 AND n <> 3 THEN 3 WHEN n % 5 = 0 AND n <> 5 THEN 5 WHEN n % 7 = 0 AND n <> 7 THEN 7 END::BIGINT AS divisor, CASE WHEN n % 10 IN (1, 3, 7, 9) THEN n // 10 END AS q, CASE n % 10 WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 7 THEN 2 WHEN 9 THEN 3 END::INT AS class_index, floor(sqrt(n))::BIGINT AS root, (SELECT min(c.c) FROM range(n, n + 5) c(c) WHERE c.c % 10 IN (1, 3, 7, 9)) AS next_candidate FROM orders")
def key_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wheel divisor, quotient, class, root and next candidate of the order keys."""
    n = F.col("n")
    return _order_keys(spark, sf_dir).select("n", integers.wheel_divisor(n).alias("divisor"), integers.quotient(n).alias("q"), integers.class_index(n).alias("class_index"), integers.isqrt(n).alias("root"), integers.next_candidate(n).alias("next_candidate"))


@_query(f"WITH {_CHUNKS} {_INDEX.format(chunks='chunks')}")
def archive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.index(_chunks(spark, sf_dir))


_IS_PRIME_ROWS = f"""WITH {_CHUNKS}, idx AS ({_INDEX.format(chunks='gapped')}),
k AS (SELECT DISTINCT o_orderkey AS n FROM orders),
j AS (SELECT n, n IN (SELECT p FROM gapped) AS hit, EXISTS (SELECT 1 FROM idx WHERE n BETWEEN first_prime AND last_prime) AS covered,
             CASE WHEN n < 2 THEN FALSE WHEN n IN (2, 3, 5, 7) THEN TRUE WHEN n % 2 = 0 OR n % 3 = 0 OR n % 5 = 0 OR n % 7 = 0 THEN FALSE END AS rule FROM k),
told AS (SELECT n, coalesce(rule, CASE WHEN covered THEN hit END) AS is_prime, CASE WHEN rule IS NULL THEN 'archive' ELSE 'rule' END AS source,
       CASE WHEN rule IS NULL AND NOT covered THEN 'uncovered' ELSE 'ok' END AS status FROM j)"""
_IS_PRIME = f"{_IS_PRIME_ROWS} SELECT * FROM told"


@_query(_IS_PRIME)
def archive_is_prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys looked up in an archive that lacks a chunk."""
    return archive.answer_is_prime(_order_keys(spark, sf_dir), _gapped(spark, sf_dir))


_NEXT_PRIME = f"""WITH {_CHUNKS}, idx AS ({_INDEX.format(chunks='gapped')}),
k AS (SELECT DISTINCT o_orderkey AS n FROM orders),
j AS (SELECT n, CASE WHEN n < 2 THEN 2 WHEN n < 3 THEN 3 WHEN n < 5 THEN 5 WHEN n < 7 THEN 7 END AS small,
             (SELECT min(p) FROM gapped WHERE p > n AND p >= 11) AS p FROM k),
c AS (SELECT j.*, i.first_prime, i.chunk_id = 0 OR EXISTS (SELECT 1 FROM idx x WHERE x.chunk_id = i.chunk_id - 1) AS joined
      FROM j LEFT JOIN gapped g USING (p) LEFT JOIN idx i USING (chunk_id))
SELECT n, CASE WHEN small IS NOT NULL THEN small WHEN p IS NOT NULL AND (n >= first_prime OR joined) THEN p END AS next_prime,
       CASE WHEN small IS NOT NULL OR p IS NOT NULL AND (n >= first_prime OR joined) THEN 'ok' ELSE 'uncovered' END AS status FROM c"""


@_query(_NEXT_PRIME)
def archive_next_prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next primes of the order keys from an archive that lacks a chunk."""
    return archive.answer_next_prime(_order_keys(spark, sf_dir), _gapped(spark, sf_dir))


@_query(f"WITH {_CHUNKS} SELECT DISTINCT chunk_id FROM chunks EXCEPT SELECT chunk_id FROM gapped")
def missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.missing(_chunks(spark, sf_dir), _gapped(spark, sf_dir))


@_query("WITH d AS (SELECT DISTINCT l_partkey * 11 + l_linenumber AS id FROM lineitem), g AS (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM d) SELECT min(id) AS first, max(id) AS last, count(*) AS n FROM g GROUP BY g.g")
def chunk_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive ids."""
    return maintenance.islands(_table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 11 + F.col("l_linenumber")).alias("id")))


@_query(f"WITH {_PRIMES}, g AS (SELECT p, p - row_number() OVER (ORDER BY p) AS g FROM primes), r AS (SELECT min(p) AS a, max(p) AS b FROM g GROUP BY g.g) SELECT string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM r")
def range_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primes up to the largest order key as ranges in one line."""
    return maintenance.ranges_text(maintenance.islands(sieve.primes(spark, 0, _max_order_key(spark, sf_dir) + 1), "p"))


@_query("WITH k AS (SELECT DISTINCT o_custkey AS id FROM orders), r AS (SELECT id, row_number() OVER (ORDER BY id) AS rank, count(*) OVER () AS n FROM k) SELECT id, (rank * 7 - 1) // n AS shard FROM r")
def even_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer keys of orders cut into seven shards."""
    return maintenance.even_split(_table(spark, sf_dir, "orders"), 7, "o_custkey")


@_query(f"WITH {_CHUNKS}, idx AS (SELECT chunk_id, count(*) AS prime_count FROM gapped GROUP BY 1) SELECT chunk_id, coalesce(prime_count, 0)::BIGINT AS primes FROM (SELECT DISTINCT chunk_id FROM chunks) LEFT JOIN idx USING (chunk_id)")
def committed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.committed_counts(_chunks(spark, sf_dir), archive.index(_gapped(spark, sf_dir)))


@_query(f"WITH {_CHUNKS}, w AS (SELECT DISTINCT chunk_id FROM gapped), e AS (SELECT DISTINCT chunk_id FROM chunks) SELECT chunk_id FROM e WHERE chunk_id NOT IN (SELECT chunk_id FROM w)")
def repair_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed chunks without a wheel file whose exact chunk exists."""
    chunks = _chunks(spark, sf_dir)
    return maintenance.backfill(chunks, _gapped(spark, sf_dir), chunks)


@_query(f"WITH {_CHUNKS} SELECT DISTINCT chunk_id FROM gapped")
def prunable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.twins(_chunks(spark, sf_dir), _gapped(spark, sf_dir))


@_query(f"WITH {_CHUNKS} SELECT DISTINCT chunk_id, chunk_id <> {LOST_CHUNK} AS fine FROM chunks")
def repair_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.repair_check(_gapped(spark, sf_dir), archive.index(_chunks(spark, sf_dir)))


@_query(f"WITH {_CHUNKS} SELECT (SELECT count(DISTINCT chunk_id) FROM gapped) AS chunks, count(*) AS missing, count(*) = 0 AS healthy FROM (SELECT DISTINCT chunk_id FROM chunks EXCEPT SELECT chunk_id FROM gapped)")
def archive_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = _chunks(spark, sf_dir).agg(F.max("chunk_id") + 1).first()[0]
    return maintenance.coverage(_gapped(spark, sf_dir), expected)


@_query(f"WITH {_CHUNKS} SELECT chunk_id, row_number() OVER w - 1 AS i, min(p) OVER (PARTITION BY chunk_id) AS first, coalesce(p - lag(p) OVER w, 0) AS delta FROM chunks WINDOW w AS (PARTITION BY chunk_id ORDER BY p)")
def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.deltas(_chunks(spark, sf_dir))


@_query(f"WITH {_CHUNKS} SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY p) - 1 AS i, p FROM chunks")
def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.undeltas(archive.deltas(_chunks(spark, sf_dir)))


_UNITS_210 = "units AS (SELECT row_number() OVER (ORDER BY r.r) - 1 AS bit, r.r AS unit FROM range(0, 210) r(r) WHERE r.r % 2 <> 0 AND r.r % 3 <> 0 AND r.r % 5 <> 0 AND r.r % 7 <> 0)"


@_query(f"WITH {_CHUNKS}, {_UNITS_210} SELECT chunk_id, p // 210 AS cycle, bit_or(1::BIGINT << bit::INT) AS bits FROM chunks JOIN units ON p % 210 = unit WHERE p >= 11 GROUP BY 1, 2")
def wheel_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.packed(_chunks(spark, sf_dir))


@_query(f"WITH {_CHUNKS} SELECT chunk_id, p FROM chunks WHERE p >= 11")
def wheel_unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.unpacked(archive.packed(_chunks(spark, sf_dir)))


@_query(f"WITH {_CHUNKS}, d AS (SELECT chunk_id, p - lag(p) OVER (PARTITION BY chunk_id ORDER BY p) AS d FROM chunks) SELECT chunk_id, (16 + sum(CASE WHEN d IS NULL THEN 0 WHEN d < 128 THEN 1 ELSE 2 END))::BIGINT AS exact_bytes FROM d GROUP BY 1")
def exact_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.encoded_sizes(_chunks(spark, sf_dir))


def _gaps_sql(modulus: int) -> str:
    return f"WITH u AS (SELECT r.r AS unit FROM range(0, {modulus}) r(r) WHERE gcd(r.r, {modulus}) = 1), w AS (SELECT unit, coalesce(lead(unit) OVER (ORDER BY unit), min(unit) OVER () + {modulus}) - unit AS gap FROM u) SELECT unit, gap, count(*) AS keys FROM orders JOIN w ON o_orderkey % {modulus} = unit GROUP BY 1, 2"


def _gaps(spark: SparkSession, sf_dir: str, modulus: int) -> DataFrame:
    """For the units among the order keys' residues: the gap to the wheel's next unit, and the keys at it."""
    units = masks.coprime_units(modulus)
    gap = dict(zip(units, [b - a for a, b in zip(units, [*units[1:], units[0] + modulus])]))
    by_residue = integers.long_array([gap.get(r, 0) for r in range(modulus)])
    keys = _table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % modulus).alias("unit")).agg(F.count("*").alias("keys"))
    return keys.select("unit", F.element_at(by_residue, (F.col("unit") + 1).cast("int")).alias("gap"), "keys").where("gap > 0")


@_query(_gaps_sql(210))
def wheel_gaps_210(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir, 210)


@_query(_gaps_sql(840))
def wheel_gaps_840(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir, 840)


@_query(f"WITH {_MASK_PRIMES}, g AS (SELECT p, string_agg(symbol, '' ORDER BY k) AS full_mask FROM positions GROUP BY p) SELECT p, full_mask, substr(full_mask, 1, (p // 10)::INT) || 'f' || substr(full_mask, (p // 10 + 2)::INT) AS cleaned_mask, replace(full_mask, 'f', '') AS symbol_order FROM g")
def mask_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.mask_strings(_mask_primes(spark, sf_dir))


@_query(f"WITH {_MASK_PRIMES} SELECT p, k, candidates::VARCHAR AS candidates, struck_digits::VARCHAR AS struck_digits, symbol FROM positions")
def mask_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))
    rows = masks.mask_positions(_mask_primes(spark, sf_dir))
    return rows.select("p", "k", text("candidates").alias("candidates"), text("struck_digits").alias("struck_digits"), "symbol")


@_query(f"WITH {_MASK_PRIMES} SELECT p, " + ", ".join(f"(SELECT min(k.k) FROM range(0, p) k(k) WHERE (10 * k.k + {d}) % p = 0) AS k{d}" for d in (1, 3, 7, 9)) + " FROM mask_primes")
def hit_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.hit_positions(_mask_primes(spark, sf_dir))


@_query(f"WITH {_MASK_PRIMES} SELECT p, 840 // p AS quotient, 840 // p * p AS multiple, " + ", ".join(f"{840 * k} % p AS rest_{k}, p - {840 * k} % p AS lack_{k}" for k in range(1, 6)) + " FROM mask_primes")
def worksheet_kx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.worksheet(_mask_primes(spark, sf_dir))


_EVENTS = f"""{_MASK_PRIMES}, ev AS (
    SELECT p, multiplier, p * multiplier AS value, p * multiplier // 10 AS position, p * multiplier % 10 AS channel,
           CASE p * multiplier % 10 WHEN 1 THEN '7' WHEN 3 THEN 'b' WHEN 7 THEN 'd' WHEN 9 THEN 'e' END AS symbol,
           p * multiplier % 8 AS mod_8, p * multiplier % 3 AS mod_3, p * multiplier % 5 AS mod_5, p * multiplier % 7 AS mod_7,
           gcd(p * multiplier, 840) = 1 AS wheel_eligible
    FROM mask_primes, (SELECT unnest([1, 3, 9, 7]::BIGINT[]) AS multiplier))"""


@_query(f"WITH {_EVENTS} SELECT * FROM ev")
def mask_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.mask_events(_mask_primes(spark, sf_dir))


@_query(f"WITH {_EVENTS} SELECT a.p, a.multiplier, b.multiplier AS mirror, a.position, b.position AS mirror_position, a.position + b.position = a.p - 1 AND a.channel + b.channel = 10 AS holds FROM ev a JOIN ev b ON a.p = b.p AND b.multiplier = CASE a.multiplier WHEN 1 THEN 9 WHEN 9 THEN 1 WHEN 3 THEN 7 ELSE 3 END")
def mirror_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.mirror_pairs(masks.mask_events(_mask_primes(spark, sf_dir)))


@_query("SELECT DISTINCT o_orderkey % 6 AS mask_index, mask_index % 2 AS layer_2, mask_index % 3 AS layer_3, mask_index AS back FROM orders")
def coord24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residues(spark, sf_dir, 6).select(F.col("id").alias("mask_index"), *masks.batch_coordinate(F.col("id")))


@_query("SELECT DISTINCT o_orderkey % 60 AS mask_index, mask_index // 30 AS golden_layer, mask_index % 30 // 6 AS cell_layer, mask_index % 6 AS mask_layer, mask_index AS back FROM orders")
def coord240(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residues(spark, sf_dir, 60).select(F.col("id").alias("mask_index"), *masks.block_coordinate(F.col("id")))


_COORDINATES = """
u AS (SELECT DISTINCT o_orderkey % 840 AS residue FROM orders WHERE gcd(o_orderkey, 840) = 1),
f AS (SELECT residue,
    CASE WHEN residue % 8 IN (7, 5) THEN 1 ELSE 0 END AS i1, CASE WHEN residue % 8 IN (3, 5) THEN 1 ELSE 0 END AS i2,
    CASE WHEN residue % 3 = 1 THEN 0 ELSE 1 END AS s3, CASE WHEN residue % 7 IN (6, 5, 3) THEN 1 ELSE 0 END AS s7,
    CASE residue % 7 WHEN 1 THEN 0 WHEN 6 THEN 0 WHEN 2 THEN 1 WHEN 5 THEN 1 ELSE 2 END AS layer,
    CASE residue % 5 WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS phase FROM u),
g AS (SELECT *, xor(i1, s3) AS e1, xor(i1, s7) AS e2, xor(xor([0, 4, 12, 8][phase + 1], 13 * i1), 14 * i2) AS vertex FROM f),
wheel AS (SELECT residue, layer, e1 AS external_bit_1, e2 AS external_bit_2, 4 * layer + 2 * e1 + e2 AS tesseract_index, phase AS channel_phase,
    i1 AS internal_bit_1, i2 AS internal_bit_2, vertex, 16 * (4 * layer + 2 * e1 + e2) + vertex AS address,
    (16 * (4 * layer + 2 * e1 + e2) + vertex) // 64 AS word, (16 * (4 * layer + 2 * e1 + e2) + vertex) % 64 AS bit FROM g)"""


def _wheel_840(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of the units among the order keys' residues."""
    units = masks.wheel_840_units(spark).join(_residues(spark, sf_dir, 840).withColumnRenamed("id", "residue"), "residue", "left_semi")
    return masks.wheel_840_coordinates(units)


@_query(f"WITH {_COORDINATES} SELECT * FROM wheel")
def wheel840_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wheel_840(spark, sf_dir)


@_query(f"WITH {_COORDINATES} SELECT count(*) AS units, count(DISTINCT address) AS addresses, min(address)::BIGINT AS lowest, max(address)::BIGINT AS highest FROM wheel")
def wheel840_bijection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wheel_840(spark, sf_dir)
    return rows.agg(F.count("*").alias("units"), F.countDistinct("address").alias("addresses"), F.min("address").cast("long").alias("lowest"), F.max("address").cast("long").alias("highest"))


@_query(
    f"""WITH {_COORDINATES}
SELECT count(*) AS units,
       count(*) FILTER (t.tesseract_index <> w.tesseract_index OR t.channel_phase <> (w.channel_phase + 1) % 4 OR t.vertex <> xor((w.vertex & 3) | ((w.vertex & 4) << 1) | ((w.vertex & 8) >> 1), 4)) AS bad_turns,
       count(*) FILTER (m.tesseract_index <> w.tesseract_index OR m.vertex <> xor(w.vertex, 1)) AS bad_mirrors
FROM wheel w JOIN wheel t ON t.residue = w.residue * 673 % 840 JOIN wheel m ON m.residue = (840 - w.residue) % 840"""
)
def wheel840_symmetries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.wheel_840_symmetries(_wheel_840(spark, sf_dir))


@_query(f"WITH {_MASK_PRIMES}, u AS (SELECT r.r AS unit, row_number() OVER (ORDER BY r.r) - 1 AS phase FROM range(0, 840) r(r) WHERE gcd(r.r, 840) = 1) SELECT p, p * p AS first_composite, p * p // 840 AS block_index, p * p % 840 AS residue, p % 840 AS quotient_residue, phase AS wheel_phase FROM mask_primes JOIN u ON p % 840 = unit")
def sieve_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.sieve_seeds(_mask_primes(spark, sf_dir))


@_query("SELECT 1152::BIGINT AS group_order, 12::BIGINT AS coxeter_order, 2::BIGINT AS coxeter_orbits, 96::BIGINT AS order_twelve_elements, 12::BIGINT AS least_centralizer, 12::BIGINT AS largest_centralizer, 0::BIGINT AS foreign_involutions, 4::BIGINT AS twisted_generators, 1152::BIGINT AS duality_frames, 2::BIGINT AS dual_square_roots")
def reflection_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.summary(spark)


@_query(f"WITH {_CHUNKS} SELECT chunk_id, p FROM chunks WHERE chunk_id = {LOST_CHUNK}")
def repair_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lost chunk sieved anew from its row of the index."""
    whole = archive.index(_chunks(spark, sf_dir))
    lost = maintenance.missing(whole, _gapped(spark, sf_dir))
    return maintenance.rebuild(whole.join(lost, "chunk_id"))


@_query()
def research_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.research_documents(_mask_primes(spark, sf_dir))


_PACKED = "SELECT CASE o_orderkey % 10 WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 3 END AS class_index, o_orderkey // 600 AS block, bit_or(1::BIGINT << (o_orderkey // 10 % 60)::INT) AS selector FROM orders WHERE o_orderkey % 10 IN (1, 3, 7, 9) GROUP BY 1, 2"


@_query(_PACKED)
def selector_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.pack(_table(spark, sf_dir, "orders"), "o_orderkey")


@_query("WITH k AS (SELECT DISTINCT o_orderkey AS n FROM orders WHERE o_orderkey % 10 IN (1, 3, 7, 9)) SELECT CASE n % 10 WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 3 END AS class_index, n // 600 AS block, n // 10 % 60 AS mask_index, n AS period, n AS value_1, 3 * n AS value_3, 9 * n AS value_9, 7 * n AS value_7 FROM k")
def selector_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selectors.events(selectors.pack(_table(spark, sf_dir, "orders"), "o_orderkey"))
    return rows.select("class_index", "block", "mask_index", "period", *(F.col("channel_values")[k].alias(f"value_{m}") for k, m in enumerate((1, 3, 9, 7))))


@_query(f"SELECT class_index, count(*) AS words, sum(bit_count(selector))::BIGINT AS active_bits FROM ({_PACKED}) GROUP BY 1")
def selector_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.popcount(selectors.pack(_table(spark, sf_dir, "orders"), "o_orderkey"))


@_query("SELECT (sum(20 * o_orderkey) % 18446744073709551616)::BIGINT AS checksum FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 10 IN (1, 3, 7, 9))")
def selector_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selectors.word_checksum(selectors.pack(_table(spark, sf_dir, "orders"), "o_orderkey"))
    return rows.select(F.col("checksum").cast("long").alias("checksum"))


@_query("SELECT (sum(20 * o_orderkey) % 18446744073709551616)::BIGINT AS checksum FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 10 IN (1, 3, 7, 9))")
def event_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a row for each event."""
    rows = selectors.checksum(selectors.events(selectors.pack(_table(spark, sf_dir, "orders"), "o_orderkey")))
    return rows.select(F.col("checksum").cast("long").alias("checksum"))


_DENSITY = "SELECT l_orderkey // 100 AS bucket, count(DISTINCT l_orderkey % 25 + 1)::BIGINT AS blocks, count(*) AS active FROM lineitem GROUP BY 1"


def _density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 100").alias("bucket"), F.expr("l_orderkey % 25 + 1").alias("b"))
    return rows.groupBy("bucket").agg(F.countDistinct("b").alias("blocks"), F.count("*").alias("active"))


@_query(f"SELECT bucket, blocks, active, CASE WHEN blocks = 0 OR active = 240 * blocks THEN 'implicit_full' WHEN 4 * (blocks + 1) + active < 32 * blocks THEN 'sparse' ELSE 'bitmap' END AS kind, 4 * (blocks + 1) + active AS sparse_bytes, 32 * blocks AS bitmap_bytes, 40 * blocks AS cell24_bytes, 30 * blocks AS bit_packed_bytes FROM ({_DENSITY})")
def storage_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, a = F.col("blocks"), F.col("active")
    sizes = [selectors.storage_bytes(k, b, a).alias(f"{k}_bytes") for k in ("sparse", "bitmap", "cell24", "bit_packed")]
    return _density(spark, sf_dir).select("bucket", "blocks", "active", selectors.storage_choice(b, a).alias("kind"), *sizes)


@_query(f"SELECT CASE WHEN 2 * active <= 240 * blocks THEN 'sparse' ELSE 'dense' END AS mode, count(*) AS buckets FROM ({_DENSITY}) GROUP BY 1")
def scan_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _density(spark, sf_dir).groupBy(selectors.scan_mode(F.col("active"), F.col("blocks") * selectors.PERIODS_PER_BLOCK).alias("mode")).agg(F.count("*").alias("buckets"))


@_query("WITH h AS (SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS found FROM events GROUP BY 1, 2), w AS (SELECT event_type, hour, found, found - lag(found) OVER p AS delta, (hour - lag(hour) OVER p)::DOUBLE AS seconds FROM h WINDOW p AS (PARTITION BY event_type ORDER BY hour)) SELECT *, delta / seconds AS per_second FROM w")
def throughput_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events an hour as progress reports, against the report before."""
    hours = _table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp").cast("long").alias("hour")).agg(F.count("*").alias("found"))
    return maintenance.throughput(hours, "event_type", "hour", "found")


_VALIDATE = r"""
v AS (SELECT *, trim(text, '{spaces}') AS body FROM src),
w AS (SELECT *, regexp_replace(body, '^\+', '') AS digits FROM v),
e AS (SELECT *, CASE WHEN text IS NULL THEN 'null' WHEN starts_with(body, '-') THEN 'negative' WHEN length(digits) = 0 THEN 'empty' WHEN NOT regexp_full_match(digits, '[0-9]+') THEN 'invalid_char' WHEN length(digits) > 1024 THEN 'too_long' END AS error FROM w),
f AS (SELECT *, CASE WHEN error = 'invalid_char' THEN length(regexp_extract(digits, '^[0-9]*'))::INT END AS position FROM e)
SELECT id, error IS NULL AS ok, error, CASE WHEN error IS NULL THEN digits END AS value, position, CASE WHEN position IS NOT NULL THEN substr(digits, position + 1, 1) END AS character FROM f"""


@_query("WITH src AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT o_orderkey AS id, ' +' || o_orderkey || ' ' AS text FROM orders), " + _VALIDATE.replace("{spaces}", primality.SPACES))
def validate_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts and order keys as decimal input."""
    texts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    keys = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.format_string(" +%d ", "o_orderkey").alias("text"))
    return texts.unionByName(keys).select("id", primality.validated(F.col("text")).alias("v")).select("id", "v.ok", "v.error", "v.value", "v.position", "v.character")


@_query("SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE left(text, 20) || '...' || right(text, 10) || ' (' || length(text) || ' digits)' END AS preview FROM documents")
def preview_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", primality.preview(F.col("text")).alias("preview"))


@_query(
    "WITH k AS (SELECT DISTINCT o_orderkey AS n FROM orders), d AS (SELECT n, (SELECT min(d.d) FROM range(2, 1000) d(d) WHERE d.d * d.d <= n AND n % d.d = 0) AS divisor FROM k),"
    " small AS (SELECT row_number() OVER (ORDER BY b.b) AS i, b.b FROM range(2, 314) b(b) WHERE NOT EXISTS (SELECT 1 FROM range(2, 20) x(x) WHERE x.x * x.x <= b.b AND b.b % x.x = 0))"
    " SELECT n::VARCHAR AS text, TRUE AS ok, NULL::VARCHAR AS error, CASE WHEN n < 2 OR divisor IS NOT NULL THEN 'composite' ELSE 'probable_prime' END AS status,"
    " CASE WHEN n < 2 THEN '1' ELSE divisor::VARCHAR END AS divisor, NULL::BIGINT AS witness,"
    " CASE WHEN n < 2 OR divisor IS NOT NULL THEN NULL WHEN n IN (2, 3, 5, 7) THEN 0 ELSE least(coalesce((SELECT i FROM small WHERE b = n), 32), 32) END::INT AS rounds FROM d"
)
def is_prime_fast_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline for numbers of any size, on order keys as text."""
    return primality.is_prime_big(_order_keys(spark, sf_dir).select(F.col("n").cast("string").alias("text")))


def _big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal strings of 20 to 60 digits (text) from customer keys: digits of the key and of its CRC-32, repeated and cut."""
    return _table(spark, sf_dir, "customer").select(F.expr(_BIG_TEXT).alias("text")).distinct()


_BIG_TEXT = "left(repeat(concat(cast(c_custkey as string), '7', cast(crc32(cast(cast(c_custkey as string) as binary)) as string)), 8), cast(20 + c_custkey % 41 as int))"


@_query()
def is_prime_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primality.is_prime_big(_big(spark, sf_dir))


@_query()
def next_prime_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primality.next_prime_big(_big(spark, sf_dir))


@_query(f"WITH {_PRIMES} SELECT row_number() OVER (ORDER BY p) AS rank, p FROM primes")
def prime_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks without a window over all primes."""
    return ranked(sieve.primes(spark, 0, _max_order_key(spark, sf_dir) + 1, 1000), "p", "segment").select("rank", "p")


@_query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN blocks = 0 OR active = 240 * blocks THEN 'implicit_full' WHEN 4 * (blocks + 1) + active < 32 * blocks THEN 'sparse' ELSE 'bitmap' END AS kind FROM (" + _DENSITY + ")) GROUP BY 1")
def storage_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.kind_counts(_density(spark, sf_dir).select(selectors.storage_choice(F.col("blocks"), F.col("active")).alias("kind")))


@_query("SELECT a, b, gcd(a, b)::BIGINT AS gcd, a + (((3 - a) % b) + b) % b AS first_congruent FROM (SELECT DISTINCT l_partkey AS a, l_suppkey + 1 AS b FROM lineitem)")
def gcd_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest common divisors, and the first number from a on that is 3 modulo b."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1).alias("b")).distinct()
    return rows.select("a", "b", integers.gcd(F.col("a"), F.col("b")).alias("gcd"), integers.first_congruent(F.col("a"), F.col("b"), F.lit(3)).alias("first_congruent"))


@_query("SELECT DISTINCT o_orderkey AS n, EXISTS (SELECT 1 FROM range(2, 1000) d(d) WHERE d.d * d.d <= o_orderkey AND o_orderkey % d.d = 0) AS composite FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey > 7")
def mr_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd order keys of which one of the bases 2, 3, 5 and 7, exact below 3.2 * 10^9, is a strong witness."""
    return primality.strong_tests(_order_keys(spark, sf_dir).where("n % 2 = 1 and n > 7"), (2, 3, 5, 7))


@_query("SELECT o_orderkey AS found, 60000 AS target, NULL::BIGINT AS last_prime, (o_custkey % 7)::DOUBLE AS seconds, CASE WHEN o_orderkey >= 60000 THEN 0.0 WHEN o_custkey % 7 > 0 THEN (60000 - o_orderkey) / nullif(o_orderkey / (o_custkey % 7)::DOUBLE, 0) END AS eta FROM orders")
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as progress reports."""
    reports = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("found"), F.lit(60000).alias("target"), F.lit(None).cast("long").alias("last_prime"), (F.col("o_custkey") % 7).cast("double").alias("seconds"))
    return incremental.eta(reports)


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='numera-')}/primes-{uuid.uuid4().hex}"


@_query(f"WITH {_CHUNKS} SELECT chunk_id, p FROM chunks WHERE p >= 11")
def archive_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written with index and commit row, and read again."""
    path = _folder(spark)
    store.write_archive(_chunks(spark, sf_dir), path)
    return store.read_archive(spark, path)


@_query(_IS_PRIME)
def archive_stored_is_prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions, answered from the written index and bitmap."""
    path = _folder(spark)
    store.write_archive(_gapped(spark, sf_dir), path)
    return stored.is_prime(_order_keys(spark, sf_dir), path)


@_query(
    f"""WITH {_CHUNKS}, idx AS ({_INDEX.format(chunks='gapped')}),
k AS (SELECT DISTINCT o_orderkey AS n FROM orders)
SELECT n, (SELECT max(last_prime) FROM idx WHERE last_prime < n) AS previous_last, (SELECT min(first_prime) FROM idx WHERE first_prime > n) AS next_first
FROM k WHERE NOT EXISTS (SELECT 1 FROM idx WHERE n BETWEEN first_prime AND last_prime)"""
)
def archive_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys that no chunk spans, with the ends of the gap they lie in."""
    return archive.gaps(_order_keys(spark, sf_dir), archive.index(_gapped(spark, sf_dir)))


@_query(f"WITH {_CHUNKS} SELECT max(p) AS last_prime FROM chunks")
def stored_last_prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    store.write_archive(_chunks(spark, sf_dir), path)
    return store.last_prime_of_index(store.read_index(spark, path))


@_query(_nth("SELECT rank, p FROM r WHERE rank <= (SELECT count(*) FROM customer)", 200_000))
def first_n_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many primes as there are customers, counted in batches, stopped after the first and resumed."""
    path, n = _folder(spark), _table(spark, sf_dir, "customer").count()
    incremental.first_n(spark, n, path, width=1 << 12, batch_segments=2, stop=lambda: True)
    incremental.first_n(spark, n, path, width=1 << 14)
    return incremental.committed(spark, path)


@_query(f"WITH {_PRIMES}, g AS (SELECT p, p - row_number() OVER (ORDER BY p) AS g FROM primes), r AS (SELECT min(p) AS a, max(p) AS b, row_number() OVER (ORDER BY min(p)) AS k FROM g GROUP BY g.g) SELECT string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) FILTER (k <= 6) AS ranges, greatest(count(*) - 6, 0) AS more FROM r")
def first_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.first_ranges(maintenance.islands(sieve.primes(spark, 0, _max_order_key(spark, sf_dir) + 1), "p"))


#: Words behind a number, and the primes whose multiples its window loses, in ``window_survivors``.
WINDOW_WORDS, WINDOW_LIMIT = 2, 100
# Strings of 25 to 60 digits.
_LONG_TEXT = "left(repeat(concat(c_custkey, '1', c_nationkey, '3'), 30), 25 + c_custkey % 36)"


@_query(
    f"""WITH k AS (SELECT DISTINCT left(repeat(c_custkey || '1' || c_nationkey || '3', 30), (25 + c_custkey % 36)::INT) AS text FROM customer),
base AS (SELECT b.b FROM range(3, {WINDOW_LIMIT + 1}) b(b) WHERE b.b <> 5 AND NOT EXISTS (SELECT 1 FROM range(2, 11) d(d) WHERE d.d * d.d <= b.b AND b.b % d.d = 0)),
rest AS (SELECT text, b, list_reduce(list_transform(range(1, length(text)::BIGINT + 1), lambda i: substr(text, i, 1)::BIGINT), lambda r, x: (10 * r + x) % b, 0::BIGINT) AS r FROM k, base),
word AS (SELECT text, left(text, -1) AS q FROM k),
place AS (SELECT text, list_reduce(list_transform(range(1, length(q)::BIGINT + 1), lambda i: substr(q, i, 1)::BIGINT), lambda r, x: (10 * r + x) % 60, 0::BIGINT) AS inner_place, right(text, 1)::BIGINT AS last FROM word),
struck AS (SELECT DISTINCT text, c.c, d.d FROM rest JOIN place USING (text), range(0, {60 * WINDOW_WORDS}) c(c), (SELECT unnest([1, 3, 7, 9]::BIGINT[]) AS d) d WHERE (r - last - 10 * inner_place + 10 * c.c + d.d) % b = 0)
SELECT text, CASE d.d WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 3 END::INT AS class_index, c.c // 60 AS block,
       coalesce(bit_or(1::BIGINT << (c.c % 60)::INT) FILTER (s.text IS NULL), 0) AS selector
FROM k CROSS JOIN range(0, {60 * WINDOW_WORDS}) c(c) CROSS JOIN (SELECT unnest([1, 3, 7, 9]::BIGINT[]) AS d) d LEFT JOIN struck s USING (text, c, d) GROUP BY 1, 2, 3"""
)
def window_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates behind numbers of 25 to 60 digits that no small prime divides, as selector words."""
    texts = _table(spark, sf_dir, "customer").select(F.expr(_LONG_TEXT.replace("25 + c_custkey % 36", "cast(25 + c_custkey % 36 as int)")).alias("text"))
    return bignum.sieved_windows(texts, words=WINDOW_WORDS, limit=WINDOW_LIMIT)


@_query(_NEXT_PRIME)
def archive_stored_next_prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next primes of the order keys from the written index and bitmap of an archive that lacks a chunk."""
    path = _folder(spark)
    store.write_archive(_gapped(spark, sf_dir), path)
    return stored.next_prime(_order_keys(spark, sf_dir), path)


@_query(f"WITH {_CHUNKS} SELECT chunk_id, p, CASE WHEN chunk_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS version FROM chunks WHERE p >= 11")
def archive_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other chunk in a first version, the rest in a second one that leaves them where they are."""
    path, chunks = _folder(spark), _chunks(spark, sf_dir)
    store.write_archive(chunks.where("chunk_id % 2 = 0"), path)
    store.update_archive(chunks.where("chunk_id % 2 = 1"), path)
    return store.read_archive(spark, path).join(store.read_index(spark, path, True).select("chunk_id", F.col("home").alias("version")), "chunk_id")


@_query(f"WITH {_CHUNKS} SELECT i.*, CASE WHEN chunk_id = {LOST_CHUNK} THEN 2 ELSE 1 END::BIGINT AS version FROM ({_INDEX.format(chunks='chunks')}) i")
def archive_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of an archive that lacked a chunk, after its repair: only the lost chunk was written."""
    path = _folder(spark)
    store.write_archive(_gapped(spark, sf_dir), path)
    store.repair(spark, path, archive.index(_chunks(spark, sf_dir)))
    return store.read_index(spark, path, True).withColumnRenamed("home", "version").drop("direct")


@_query(f"WITH {_CHUNKS} SELECT chunk_id, p FROM chunks WHERE p >= 11")
def archive_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive made from exact chunks alone."""
    exact, path = _folder(spark), _folder(spark)
    store.write_exact(_chunks(spark, sf_dir), exact)
    store.rebuild_archive(spark, exact, path)
    return store.read_archive(spark, path)


@_query(f"WITH {_CHUNKS} SELECT chunk_id, count(*) AS prime_count, min(p) AS first_prime, max(p) AS last_prime FROM chunks GROUP BY 1")
def exact_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of written exact chunks, from their heads alone."""
    exact = _folder(spark)
    store.write_exact(_chunks(spark, sf_dir), exact, 4096)
    return store.exact_index(spark, exact)


@_query()
def proven_next_primes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next primes of strings of 20 to 60 digits, with certificates and what an independent check says of each."""
    return proofs.verified(proofs.next_prime_proven(_big(spark, sf_dir), proofs.FactorProver()))


_SHEET_SQL = f"""{_MASK_PRIMES},
g AS (SELECT p, string_agg(symbol, '' ORDER BY k) AS full_mask FROM positions GROUP BY p),
m AS (SELECT p, full_mask, substr(full_mask, 1, (p // 10)::INT) || 'f' || substr(full_mask, (p // 10 + 2)::INT) AS cleaned_mask, replace(full_mask, 'f', '') AS symbol_order FROM g)"""


@_query(
    f"""WITH {_SHEET_SQL},
r AS (SELECT p::INT AS row_number, p AS prime, 'differs' AS kind,
             concat_ws(',', CASE WHEN p % 5 = 1 THEN 'cleaned_mask' END, CASE WHEN p % 5 = 1 THEN 'full_mask' END, CASE WHEN p % 3 = 2 AND symbol_order <> reverse(symbol_order) THEN 'symbol_order' END) AS differing FROM m WHERE p % 11 <> 2
      UNION ALL SELECT NULL, p, 'missing', '' FROM m WHERE p % 11 = 2
      UNION ALL SELECT (p + 1)::INT, p + 1, 'unexpected', '' FROM m WHERE p % 13 = 1
      UNION ALL SELECT (p + 5000)::INT, p, 'repeated', '' FROM m WHERE p % 11 <> 2 AND p % 17 = 3
      UNION ALL SELECT (p + 5000)::INT, p, 'differs', concat_ws(',', CASE WHEN p % 5 = 1 THEN 'cleaned_mask' END, CASE WHEN p % 5 = 1 THEN 'full_mask' END, CASE WHEN p % 3 = 2 AND symbol_order <> reverse(symbol_order) THEN 'symbol_order' END) FROM m WHERE p % 11 <> 2 AND p % 17 = 3)
SELECT * FROM r WHERE kind <> 'differs' OR differing <> ''"""
)
def mask_sheet_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of the order keys' mask primes, altered, with rows too many and too few, against the primes."""
    primes = _mask_primes(spark, sf_dir)
    p = F.col("p")
    altered = lambda c: F.when(p % 5 == 1, F.concat(F.lit("0"), c)).otherwise(c)
    own = masks.mask_strings(primes).select(p.cast("int").alias("row_number"), p.alias("prime"), altered(F.col("cleaned_mask")).alias("cleaned_mask"), altered(F.col("full_mask")).alias("full_mask"), F.when(p % 3 == 2, F.reverse("symbol_order")).otherwise(F.col("symbol_order")).alias("symbol_order"))
    own = own.where("prime % 11 <> 2")
    again = own.where("prime % 17 = 3").withColumn("row_number", F.col("row_number") + 5000)
    more = masks.mask_strings(primes.where("p % 13 = 1").select((p + 1).alias("p"))).select(p.cast("int").alias("row_number"), p.alias("prime"), "cleaned_mask", "full_mask", "symbol_order")
    found = masks.mask_mismatches(own.unionByName(again).unionByName(more), primes)
    return found.select("row_number", "prime", "kind", F.array_join("differing", ",").alias("differing"))


@_query(f"SELECT class_index, block, selector, bit_count(selector)::INT AS active_bits, CASE WHEN 2 * bit_count(selector) <= 60 THEN 'sparse' ELSE 'dense' END AS mode FROM ({_PACKED})")
def selector_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each word of the order keys would be scanned, counted from what the scan by table finds in it."""
    words = selectors.pack(_table(spark, sf_dir, "orders"), "o_orderkey")
    n = selectors.events(words, "table").groupBy("class_index", "block").agg(F.count("*").cast("int").alias("active_bits"))
    return words.join(n, ["class_index", "block"]).select("class_index", "block", "selector", "active_bits", selectors.scan_mode(F.col("active_bits"), F.lit(selectors.BITS)).alias("mode"))


@_query("SELECT CASE o_orderkey % 10 WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 3 END AS class_index, o_orderkey // 600 AS block, (o_orderkey // 10 % 60)::INT AS mask_index, o_orderkey AS period FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 10 IN (1, 3, 7, 9))")
def selector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the order keys' words, each word scanned in the mode chosen for it."""
    return selectors.scanned(selectors.pack(_table(spark, sf_dir, "orders"), "o_orderkey")).select("class_index", "block", "mask_index", "period")


@_query("WITH t AS (SELECT DISTINCT o_orderkey AS n, o_orderkey >= 2 AND NOT EXISTS (SELECT 1 FROM range(2, 1000) d(d) WHERE d.d * d.d <= o_orderkey AND o_orderkey % d.d = 0) AS is_prime FROM orders WHERE o_orderkey % 2 = 1) SELECT n, is_prime, CASE WHEN is_prime THEN 13 END::INT AS bases FROM t")
def mr_thirteen_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd order keys by strong tests to the thirteen bases alone."""
    odd = _order_keys(spark, sf_dir).where("n % 2 = 1")
    small = odd.where(F.col("n") <= max(primality.LONG_BASES)).select("n", F.col("n").isin(*primality.LONG_BASES).alias("is_prime"))
    tested = primality.strong_tests(odd.where(F.col("n") > max(primality.LONG_BASES)), primality.LONG_BASES).select("n", (~F.col("composite")).alias("is_prime"))
    return small.unionByName(tested).select("n", "is_prime", F.when(F.col("is_prime"), len(primality.LONG_BASES)).alias("bases"))


# Requests from order keys: the kind, the spelling of the number and what is wrong with it go by the key.
_BODY = """CASE o_orderkey % 13 WHEN 0 THEN '{"n": ' || o_orderkey || '}' WHEN 1 THEN 'no json' WHEN 2 THEN '{"n": "x"}' WHEN 3 THEN '{"n": " "}'
    WHEN 4 THEN '{"n": " +' || o_orderkey || ' "}' WHEN 5 THEN '{"m": 1}' ELSE '{"n": "' || o_orderkey || '", "more": 1}' END"""


@_query(
    f"""{_IS_PRIME_ROWS},
r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'is-prime' ELSE 'is-prime-big' END AS kind, o_orderkey % 13 AS way, CASE WHEN o_orderkey % 13 = 4 THEN ' +' || o_orderkey || ' ' ELSE o_orderkey::VARCHAR END AS n FROM orders),
e AS (SELECT r.*, t.is_prime, t.source, CASE WHEN way IN (0, 1, 5) THEN 'invalid JSON request' WHEN way = 2 AND kind = 'is-prime' THEN 'invalid' WHEN way = 2 THEN 'invalid_char' WHEN way = 3 THEN 'empty'
             WHEN way = 4 AND kind = 'is-prime-big' THEN 'invalid_char' WHEN kind = 'is-prime' AND t.status <> 'ok' THEN 'uncovered' END AS error
      FROM r LEFT JOIN told t ON t.n = r.id),
d AS (SELECT e.*, id IN (SELECT p FROM primes) AS prime FROM e)
SELECT id, kind, CASE WHEN error IS NULL THEN 200 ELSE 400 END::INT AS status,
       CASE WHEN error IS NOT NULL THEN '{{"error":"' || error || '"}}'
            WHEN kind = 'is-prime' THEN '{{"n":"' || n || '","is_prime":' || is_prime || ',"source":"' || source || '"}}'
            ELSE '{{"n_preview":"' || n || '","n_digits":' || length(n) || ',"is_prime":' || prime || ',"status":"' || CASE WHEN prime THEN 'probable_prime' ELSE 'composite' END || '"}}' END AS response
FROM d"""
)
def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON requests made of order keys, some of them faulty, answered from an archive that lacks a chunk and by the big pipeline."""
    path = _folder(spark)
    store.write_archive(_gapped(spark, sf_dir), path)
    asked = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "is-prime").otherwise("is-prime-big").alias("kind"), F.expr(_BODY).alias("body"))
    return requests.answered(asked, path)


@_query(
    "WITH r AS (SELECT o_orderkey AS found, 60000 AS target, o_orderkey * 12 AS last_prime, (o_custkey % 3)::DOUBLE AS primes_per_second, (o_custkey % 7 * 1000)::DOUBLE AS positions_per_second FROM orders)"
    " SELECT *, CASE WHEN found >= 60000 THEN 0.0 WHEN primes_per_second > 0 THEN (60000 - found) / primes_per_second WHEN positions_per_second > 0 AND last_prime > 0 AND found > 4 THEN (60000 - found) / (found / last_prime::DOUBLE / 0.4) / positions_per_second END AS eta,"
    " CASE WHEN found >= 60000 THEN 100.0 ELSE found * 100.0::DOUBLE / 60000 END AS percent FROM r"
)
def eta_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as progress reports whose seconds to go follow each of the rules."""
    n = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(n.alias("found"), F.lit(60000).alias("target"), (n * 12).alias("last_prime"), (F.col("o_custkey") % 3).cast("double").alias("primes_per_second"), (F.col("o_custkey") % 7 * 1000).cast("double").alias("positions_per_second"))
    own = [F.col(c) for c in rows.columns]
    return rows.select("*", incremental.seconds_to_go(*own).alias("eta"), incremental.percent(own[0], own[1]).alias("percent"))


_COVERED = "SELECT chunk_id, min(p) AS first_prime, max(p) AS last_prime, min(p) // 210 AS cycle_start, max(p) // 210 - min(p) // 210 + 1 AS cycles, 6 * (max(p) // 210 - min(p) // 210 + 1) AS raw_bytes FROM chunks WHERE p >= 11 GROUP BY 1"


@_query(f"WITH {_CHUNKS} {_COVERED}")
def chunk_file_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of written chunk files; payloads are not opened."""
    path = _folder(spark)
    chunk_files.write_chunks(_chunks(spark, sf_dir), path)
    return chunk_files.read_heads(spark, path).drop("packed_bytes", "file_bytes")


@_query(f"WITH {_CHUNKS} SELECT chunk_id, p FROM chunks WHERE p >= 11 AND chunk_id IN (SELECT chunk_id FROM chunks GROUP BY 1 HAVING max(p) >= 1000)")
def chunk_file_primes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primes of written chunk files that reach to 1000 or beyond; the payloads of the others are not opened."""
    path = _folder(spark)
    chunk_files.write_chunks(_chunks(spark, sf_dir), path)
    return chunk_files.read_primes(spark, path, lower=1000)


@_query(f"WITH {_CHUNKS}, d AS (SELECT chunk_id, p // 4096 AS part, p, p - lag(p) OVER (PARTITION BY chunk_id, p // 4096 ORDER BY p) AS d FROM chunks) SELECT chunk_id, part, coalesce(string_agg(CASE WHEN d < 128 THEN printf('%02X', d) ELSE printf('%02X%02X', d % 128 + 128, d // 128) END, '' ORDER BY p) FILTER (d IS NOT NULL), '') AS payload FROM d GROUP BY 1, 2")
def exact_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of the differences of exact chunks, in hexadecimal."""
    path = _folder(spark)
    store.write_exact(_chunks(spark, sf_dir), path, 4096)
    return spark.read.parquet(path).select("chunk_id", "part", F.hex("payload").alias("payload"))


@_query(f"WITH {_CHUNKS} SELECT chunk_id, p FROM chunks WHERE chunk_id <> {LOST_CHUNK} UNION ALL SELECT chunk_id, p FROM chunks WHERE chunk_id = {LOST_CHUNK} AND p >= 11")
def exact_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact chunks, and beside them the one that an archive lacked, encoded from its exact chunk."""
    exact, path, whole = _folder(spark), _folder(spark), _chunks(spark, sf_dir)
    store.write_exact(whole, exact)
    store.write_archive(_gapped(spark, sf_dir), path)
    found = store.backfill_archive(spark, exact, path)
    return store.read_exact(spark, exact).where(F.col("chunk_id") != LOST_CHUNK).unionByName(store.read_archive(spark, path).where(F.col("chunk_id").isin(found)))


@_query(f"WITH {_CHUNKS}, i AS ({_INDEX.format(chunks='chunks')}) SELECT chunk_id, first_prime, last_prime, cycle_start, cycles, raw_bytes, 2 * raw_bytes AS compressed_bytes FROM i WHERE chunk_id >= 1")
def tsv_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written as tab-separated text in two parts, and read from chunk 1 on."""
    path, spans = _folder(spark), archive.index(_chunks(spark, sf_dir))
    rows = spans.select("chunk_id", "first_prime", "last_prime", "cycle_start", "cycles", "raw_bytes", (2 * F.col("raw_bytes")).alias("compressed_bytes"))
    store.write_tsv_index(rows.where("chunk_id < 2"), path)
    store.write_tsv_index(rows.where("chunk_id >= 2"), path, append=True)
    return store.read_tsv_index(spark, path, first=1)


@_query("SELECT 'c' || c_custkey AS key, c_nationkey || '=' || c_custkey % 7 AS value FROM customer WHERE c_custkey % 3 <> 0")
def key_value_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as key=value lines among lines that are none."""
    path, n = _folder(spark), F.col("c_custkey")
    line = F.when(n % 3 != 0, F.concat(F.lit(" c"), n, F.lit(" = "), F.col("c_nationkey"), F.lit("="), n % 7)).otherwise("no pair")
    _table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return store.read_key_values(spark, path).select("key", "value")


@_query("SELECT repeat(n_nationkey::VARCHAR || '7', 3 + n_nationkey::INT) AS text FROM nation")
def big_integer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation, its number spread over lines."""
    path, n = _folder(spark), F.col("n_nationkey")
    lines = F.explode(F.array_repeat(F.concat(F.lit(" "), n, F.lit(" 7")), (3 + n).cast("int"))).alias("value")
    _table(spark, sf_dir, "nation").select("n_nationkey", lines).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    return store.read_big_integers(spark, f"{path}/*/*.txt").select("text")


@_query(f"WITH {_EVENTS} SELECT p, multiplier, position + 3 * multiplier AS later, (10 * (position + 3 * multiplier) + channel) % 10 AS channel FROM ev")
def affine_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the events of the mask primes are three masks later."""
    events = masks.mask_events(_mask_primes(spark, sf_dir))
    later = masks.advance(F.col("position"), F.col("multiplier"), F.lit(3))
    return events.select("p", "multiplier", later.alias("later"), F.pmod(later * 10 + F.col("channel"), F.lit(10)).alias("channel"))


@_query(
    f"""WITH {_COORDINATES} SELECT residue, '{{"residue":' || residue || ',"layer":' || layer || ',"external_bits":"' || external_bit_1 || external_bit_2 || '","tesseract_index":' || tesseract_index || ',"channel_phase":' || channel_phase
    || ',"internal_bits":"' || internal_bit_1 || internal_bit_2 || '","vertex":' || vertex || ',"vertex_bits":"' || lpad(bin(vertex), 4, '0') || '","address":' || address || ',"word":' || word || ',"bit":' || bit || '}}' AS document FROM wheel"""
)
def serialised_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.serialised_coordinates(_wheel_840(spark, sf_dir))


@_query("SELECT o_orderkey AS n, 32 * (o_orderkey - least(o_custkey, o_orderkey)) AS host, 32 * least(o_custkey, o_orderkey) AS device, 64 * (o_orderkey % 100) AS staging, 32 * o_orderkey + 64 * (o_orderkey % 100) AS total FROM orders")
def memory_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of as many blocks as an order's key on host and device."""
    n = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(n.alias("n"), *selectors.memory_columns(n, F.col("o_custkey"), n % 100))


@_query(
    f"""WITH {_CHUNKS}, i AS ({_INDEX.format(chunks='chunks')}), lost AS (SELECT coalesce(sum(prime_count), 0)::BIGINT AS n, count(*) AS chunks FROM i WHERE chunk_id = {LOST_CHUNK})
SELECT count(*) + 17 AS claimed, count(*) + 100 AS target, max(p) AS last_prime, count(*)::BIGINT AS durable, 0::BIGINT AS buffered, count(*)::BIGINT - any_value(lost.n) AS queryable, any_value(lost.chunks) AS missing_chunks, any_value(lost.chunks) = 0 AS healthy, 'stale' AS run_state FROM chunks, lost"""
)
def archive_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a broken-off run claims, what its manifest has made durable, and what an archive without a chunk can answer."""
    whole = _chunks(spark, sf_dir)
    spans = archive.index(whole)
    manifest = spans.agg(F.sum("prime_count").alias("committed_primes"), F.count("*").alias("committed_chunks"))
    progress = whole.agg((F.count("*") + 17).alias("found_count"), (F.count("*") + 100).alias("target_count"), F.lit(None).cast("long").alias("archive_buffered_primes"), F.max("p").alias("last_prime"))
    checkpoint = manifest.select(F.col("committed_primes").alias("archive_committed_primes"))
    return maintenance.status(progress, checkpoint, manifest, _gapped(spark, sf_dir), spans, alive=False)


@_query(f"WITH {_CHUNKS}, i AS ({_INDEX.format(chunks='chunks')}) SELECT chunk_id, prime_count FROM i WHERE (chunk_id + 1) * {CHUNK} <= (SELECT count(*) FROM chunks) - 1")
def archive_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of an archive after chunks beyond the committed count, all primes but one, were left out and old versions pruned."""
    path, chunks = _folder(spark), _chunks(spark, sf_dir)
    store.write_archive(chunks.where("chunk_id < 1"), path)
    store.write_archive(chunks, path)
    store.reconcile(spark, path, chunks.count() - 1)
    store.prune(spark, path)
    return store.read_index(spark, path).select("chunk_id", "prime_count")


@_query("WITH k AS (SELECT DISTINCT o_orderkey AS n FROM orders WHERE o_orderkey > 100), d AS (SELECT n, (SELECT min(d.d) FROM range(2, 1000) d(d) WHERE d.d * d.d <= n AND n % d.d = 0) AS divisor FROM k) SELECT n::VARCHAR AS text, CASE WHEN divisor IS NULL THEN 'probable_prime' ELSE 'composite' END AS status, divisor::VARCHAR AS divisor, CASE WHEN divisor IS NULL THEN 5 END::INT AS rounds FROM d")
def is_prime_five_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys above 100 by five strong tests at most."""
    texts = _order_keys(spark, sf_dir).where("n > 100").select(F.col("n").cast("string").alias("text"))
    return primality.is_prime_big(texts, rounds=5).select("text", "status", "divisor", "rounds")
