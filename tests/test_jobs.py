"""The two jobs on small tables of their own and on copies of the given ones."""

import json
import logging
import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import answer_stream, number_audit, registry
from jobs.common import settings
from numera.operators.primality import is_prime_int, next_prime_int
from numera.plans.lookups import looked_up

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def files(folder):
    return sorted(p.relative_to(folder).as_posix() for p in Path(folder).rglob("*.parquet"))


def divisor(n):
    return next((d for d in range(2, 1000) if d * d <= n and n % d == 0), None)


# number_audit


TEXTS = [
    (1, "7 and 007, 10; 1 0 00 x2y2"),
    (2, None),
    (3, ""),
    (4, "no numbers, but ٣ and ²"),
    (None, "11"),
    (5, "1000003 * 1000033 = 1000036000099, and 18446744073709551557 is prime; 9" + "9" * 1500),
    (6, f"{2**89 - 1} {2**127 - 1} 3317044064679887385961981 3317044064679887385961980"),
    (7, "4 " * 50_000),
    (7, "4"),
]


def audit_tables(spark, folder, texts=TEXTS):
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'x' as id", "1 as number", "'y' as source").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "<p>97</p>")], "page_id long, html string").write.mode("overwrite").parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "conv_id long, text string").write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    return settings("number_audit", tables=str(folder), output=f"{folder}/out")


def audited(spark, config):
    return {(r["source"], r["id"], r["number"]): (r["occurrences"], r["status"], r["divisor"], r["witness"]) for r in number_audit.output(spark, config).collect()}


def test_number_audit(spark, tmp_path, caplog):
    config = audit_tables(spark, tmp_path)
    with caplog.at_level(logging.INFO, "jobs"):
        done = number_audit.run(spark, config)
    assert done["documents"] == {"read": 9, "found": 16, "wrote": 16} and done["conversations"] == {"read": 0, "found": 0, "wrote": 0}
    assert sum("number_audit" in r.message for r in caplog.records) == 7
    got = audited(spark, config)
    assert got["documents", 1, "7"] == (2, "prime", None, None) and got["documents", 1, "10"] == (1, "composite", "2", None)
    assert got["documents", 1, "0"] == (2, "neither", None, None) and got["documents", 1, "1"][1] == "neither" and got["documents", 1, "2"][0] == 2
    assert got["documents", None, "11"][1] == "prime" and got["pages", 1, "97"] == (1, "prime", None, None)
    assert got["documents", 5, "1000036000099"] == (1, "composite", None, 2) and got["documents", 5, "18446744073709551557"][1] == "prime"
    assert got["documents", 5, "9" * 1501][1] == "too_long"
    assert [got["documents", 6, str(n)][1] for n in (2**89 - 1, 2**127 - 1, 3317044064679887385961981)] == ["probable_prime", "probable_prime", "composite"]
    # rows of one id count together
    assert got["documents", 7, "4"] == (50_001, "composite", "2", None)
    assert {k[1] for k in got} == {None, 1, 5, 6, 7} and len(got) == 17


def test_number_audit_again_and_on_other_texts(spark, tmp_path):
    config = audit_tables(spark, tmp_path)
    number_audit.run(spark, config)
    first = audited(spark, config)
    number_audit.run(spark, config)
    assert audited(spark, config) == first
    # a run that broke off behind the second step left the rest as it was; the next one replaces all
    (tmp_path / "out/answers/digits=3").mkdir(exist_ok=True)
    shutil.rmtree(tmp_path / "out/numbers/source=documents")
    config = audit_tables(spark, tmp_path, [(9, "13 15")])
    number_audit.run(spark, config)
    assert audited(spark, config) == {("documents", 9, "13"): (1, "prime", None, None), ("documents", 9, "15"): (1, "composite", "3", None), ("pages", 1, "97"): (1, "prime", None, None)}
    # partitions by status exist, and one of them is read alone
    plan = number_audit.output(spark, config).where("status = 'prime' and source = 'documents'")
    assert [r["number"] for r in plan.collect()] == ["13"] and len(plan.inputFiles()) >= 1


def test_number_audit_of_nothing(spark, tmp_path):
    config = audit_tables(spark, tmp_path, [])
    spark.createDataFrame([], "page_id long, html string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    number_audit.run(spark, config)
    assert audited(spark, config) == {}


def test_number_audit_against_brute_force(spark, tmp_path):
    config = settings("number_audit", tables=DATA, output=f"{tmp_path}/out", sources=[{"table": "documents", "id": "doc_id", "text": "text"}])
    number_audit.run(spark, config)
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        for number in re.findall("[0-9]+", r["text"] or ""):
            key = ("documents", r["doc_id"], str(int(number)))
            want[key] = want.get(key, 0) + 1
    got = audited(spark, config)
    assert {k: v[0] for k, v in got.items()} == want
    assert all((v[1] == "prime") == is_prime_int(int(k[2])) for k, v in got.items())


def test_hot_keys_are_looked_up_apart(spark):
    rows = spark.range(60_000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then null else cast(id % 500 as string) end as k")
    facts = spark.createDataFrame([("hot", 1), ("2", 2), ("other", 3)], "k string, v long")
    got = looked_up(rows, facts, "k")
    assert {(r["k"], r["v"]): r["count"] for r in got.groupBy("k", "v").count().collect()} == {("hot", 1): 20_000, ("2", 2): rows.where("k = '2'").count()}


# answer_stream


def stream_config(folder, **given):
    return settings("answer_stream", tables=str(folder), output=f"{folder}/out", numbers_per_folder=1000, **given)


def append(spark, folder, orders=(), parts=()):
    """More files of the two tables."""
    spark.createDataFrame([(k,) for k in orders], "o_orderkey long").coalesce(1).write.mode("append").parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k,) for k in parts], "l_partkey long").coalesce(1).write.mode("append").parquet(f"{folder}/lineitem.parquet")


def all_answers(spark, config):
    rows = [tuple(r) for r in answer_stream.output(spark, config).select("n", "is_prime", "divisor", "next_prime").collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def expected(keys):
    return {n: (is_prime_int(n), None if is_prime_int(n) or n < 2 else divisor(n), next_prime_int(n) if n < answer_stream.LAST_PRIME else None) for n in keys}


def test_answer_stream_over_growing_input(spark, tmp_path, caplog):
    config = stream_config(tmp_path)
    append(spark, tmp_path, [0, 1, 2, 9, 9, None, -3], [2, 997])
    with caplog.at_level(logging.INFO, "jobs"):
        assert answer_stream.run(spark, config) == {"batches": 1, "read": 9, "answered": 5}
    assert "batch 0 read 9 keys, wrote 5 answers" in caplog.text
    assert all_answers(spark, config) == expected([0, 1, 2, 9, 997])
    before = files(tmp_path / "out/answers")
    # nothing new
    assert answer_stream.run(spark, config) == {"batches": 0, "read": 0, "answered": 0}
    assert files(tmp_path / "out/answers") == before
    # known keys, new ones, and keys at the end of the longs
    far = [2**63 - 1, 2**63 - 25, 2**63 - 26, 10**15]
    append(spark, tmp_path, [9, 10, 997, *far], [10, 4321])
    assert answer_stream.run(spark, config) == {"batches": 1, "read": 9, "answered": 6}
    assert set(before) <= set(files(tmp_path / "out/answers"))
    got = all_answers(spark, config)
    want = expected([0, 1, 2, 9, 997, 10, 4321, *far])
    assert {n: (v[0], v[2]) for n, v in got.items()} == {n: (v[0], v[2]) for n, v in want.items()}
    assert {n: v for n, v in got.items() if n < 10**6} == {n: v for n, v in want.items() if n < 10**6}
    progress = spark.read.schema("read long, answered long, largest long, batch int").parquet(f"{tmp_path}/out/progress").orderBy("batch").collect()
    assert [(r["batch"], r["read"], r["answered"], r["largest"]) for r in progress] == [(0, 9, 5, 997), (1, 9, 6, 2**63 - 1)]


def test_answer_stream_survives_a_broken_batch(spark, tmp_path, monkeypatch):
    config = stream_config(tmp_path)
    append(spark, tmp_path, [5, 6], [7])
    answer_stream.run(spark, config)
    append(spark, tmp_path, range(100, 200), [3])
    whole = answer_stream.answered

    def half(numbers):
        # some of the batch's files are there when it fails
        whole(numbers.where("n < 150")).write.mode("overwrite").partitionBy("part").parquet(f"{tmp_path}/out/answers/batch=1")
        raise RuntimeError("lost")

    monkeypatch.setattr(answer_stream, "answered", half)
    with pytest.raises(Exception, match="lost"):
        answer_stream.run(spark, config)
    monkeypatch.setattr(answer_stream, "answered", whole)
    assert answer_stream.run(spark, config)["answered"] == 101
    assert all_answers(spark, config) == expected([3, 5, 6, 7, *range(100, 200)])


def test_answer_stream_takes_files_in_several_batches(spark, tmp_path):
    config = stream_config(tmp_path, max_files_per_batch=1)
    for k in range(3):
        append(spark, tmp_path, range(k * 50, k * 50 + 80), [k])
    done = answer_stream.run(spark, config)
    assert done["batches"] >= 3 and done["answered"] == 180
    assert all_answers(spark, config) == expected(range(180))


def test_answer_stream_of_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(answer_stream, "MOST_PARTS", 2)
    config = stream_config(tmp_path)
    append(spark, tmp_path, [1, 5000, 9000, 70_000])
    answer_stream.run(spark, config)
    append(spark, tmp_path, [2, 5000, 9001, 70_000])
    assert answer_stream.run(spark, config)["answered"] == 2
    assert all_answers(spark, config) == expected([1, 2, 5000, 9000, 9001, 70_000])


def test_answer_stream_on_copies_of_the_tables(spark, tmp_path):
    """A third of each table first, then the rest: the same answers as all at once."""
    orders, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("orders", "lineitem"))
    orders.where("o_orderkey % 3 = 0").write.parquet(f"{tmp_path}/orders.parquet")
    items.where("l_partkey % 3 = 0").write.parquet(f"{tmp_path}/lineitem.parquet")
    config = stream_config(tmp_path)
    answer_stream.run(spark, config)
    some = all_answers(spark, config)
    orders.where("o_orderkey % 3 <> 0").write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    items.where("l_partkey % 3 <> 0").write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    answer_stream.run(spark, config)
    got = all_answers(spark, config)
    assert some.items() <= got.items() and len(some) < len(got)
    assert sorted((n, *v) for n, v in got.items()) == sorted((r["n"], r["is_prime"], r["divisor"], r["next_prime"]) for r in registry.job2_answer_stream(spark, DATA).collect())


# both


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_against_sql(spark, oracle, rows_of, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    assert rows_of(registry.queries()[name](spark, DATA)) == oracle(registry.oracle_sql()[name])
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_settings():
    with pytest.raises(ValueError, match="unknown"):
        settings("answer_stream", tables="a", output="b", nonsense=1)
    with pytest.raises(ValueError, match="without a value"):
        settings("answer_stream", tables="a")


def test_command_line(tmp_path):
    (tmp_path / "own.json").write_text(json.dumps({"sources": [{"table": "benchmark", "id": "item_id", "text": "text"}]}))
    args = [sys.executable, "-m", "jobs.number_audit", "--tables", DATA, "--output", f"{tmp_path}/out", "--config", f"{tmp_path}/own.json", "--set", "max_digits=5"]
    told = subprocess.run(args, cwd=ROOT, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert told.returncode == 0, told.stderr[-2000:]
    assert json.loads(told.stdout.splitlines()[-1])["benchmark"]["read"] > 0
    assert "number_audit wrote numbers/source=benchmark" in told.stderr


def test_jobs_import_nothing_of_the_corpus_operators():
    for path in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        found = re.findall(r"^\s*(?:from|import)\s+(\S+)", path.read_text(), re.M)
        assert not any("llm" in m or m == "corpus_pipeline" for m in found)
