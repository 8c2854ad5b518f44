"""The jobs as queries: each runs twice into one new folder and returns what it wrote."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import answer_stream, number_audit
from jobs.common import settings


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='jobs-')}/{name}-{uuid.uuid4().hex}"


def job1_number_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = settings("number_audit", tables=sf_dir, output=_folder(spark, "job1"), max_digits=18)
    for _ in range(2):
        number_audit.run(spark, config)
    return number_audit.output(spark, config)


def job2_answer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = settings("answer_stream", tables=sf_dir, output=_folder(spark, "job2"))
    for _ in range(2):
        answer_stream.run(spark, config)
    return answer_stream.output(spark, config)


# A base a shows that n is composite unless a^d is 1 or one of a^(d 2^i), i < s, is -1, where n - 1 = d 2^s;
# the first twelve primes decide below 3.18 * 10^23.
JOB1_SQL = r"""
WITH texts AS (SELECT 'documents' AS source, doc_id AS id, text FROM documents
               UNION ALL SELECT 'pages', page_id, html FROM pages
               UNION ALL SELECT 'conversations', conv_id, text FROM conversations),
stood AS (SELECT source, id, regexp_replace(unnest(regexp_extract_all(text, '[0-9]+')), '^0+([0-9])', '\1') AS number FROM texts),
counted AS (SELECT source, id, number, count(*) AS occurrences FROM stood GROUP BY ALL),
known AS (SELECT DISTINCT number, number::HUGEINT AS n FROM counted WHERE length(number) <= 18),
sieved AS (SELECT d.d FROM range(2, 1000001) d(d) WHERE d.d IN (2, 3, 5, 7, 11, 13) OR d.d % 2 <> 0 AND d.d % 3 <> 0 AND d.d % 5 <> 0 AND d.d % 7 <> 0 AND d.d % 11 <> 0 AND d.d % 13 <> 0),
divided AS (SELECT number, n, (SELECT min(d) FROM sieved WHERE d < n AND d::HUGEINT * d <= n AND n % d = 0) AS divisor FROM known),
bases AS (SELECT unnest([2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37]::HUGEINT[]) AS a),
steps AS (SELECT number, n, i.i, (n - 1) // (1::HUGEINT << i.i::INT) AS e FROM divided, range(1, 60) i(i)
          WHERE divisor IS NULL AND n > 1000000000000 AND (n - 1) % (1::HUGEINT << i.i::INT) = 0),
powers AS (SELECT number, n, i, a, (n - 1) // e AS two, i = max(i) OVER (PARTITION BY number) AS odd,
                  list_reduce(list_reverse(range(0, 60)), lambda x, b: x * x % n * (CASE WHEN (e // (1::HUGEINT << b::INT)) % 2 = 1 THEN a ELSE 1 END) % n, 1::HUGEINT) AS x
           FROM steps, bases),
tested AS (SELECT number, a, bool_or(x = n - 1 OR odd AND x = 1) AS passed FROM powers GROUP BY 1, 2),
failed AS (SELECT number, min(a) AS witness FROM tested WHERE NOT passed GROUP BY 1),
told AS (SELECT number, divisor::VARCHAR AS divisor, witness::BIGINT AS witness,
                CASE WHEN n < 2 THEN 'neither' WHEN divisor IS NOT NULL OR witness IS NOT NULL THEN 'composite' ELSE 'prime' END AS status
         FROM divided LEFT JOIN failed USING (number))
SELECT source, id, number, occurrences, divisor, witness, coalesce(status, 'too_long') AS status FROM counted LEFT JOIN told USING (number)
"""

JOB2_SQL = """
WITH k AS (SELECT o_orderkey AS n FROM orders UNION SELECT l_partkey FROM lineitem),
mx AS (SELECT max(n) + 2000 AS m FROM k),
num AS (SELECT unnest(range(2, m)) AS n FROM mx),
primes AS (SELECT n AS p FROM num WHERE NOT EXISTS (SELECT 1 FROM range(2, 1000) d(d) WHERE d.d * d.d <= num.n AND num.n % d.d = 0))
SELECT k.n, k.n IN (SELECT p FROM primes) AS is_prime, (SELECT min(d.d) FROM range(2, 1000) d(d) WHERE d.d * d.d <= k.n AND k.n % d.d = 0) AS divisor, p.p AS next_prime
FROM k ASOF JOIN primes p ON k.n < p.p WHERE k.n >= 0
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_number_audit, job2_answer_stream)}


def oracle_sql() -> dict[str, str]:
    return {"job1_number_audit": JOB1_SQL, "job2_answer_stream": JOB2_SQL}
