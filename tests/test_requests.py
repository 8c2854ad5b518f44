"""JSON requests and validation of numbers."""

import json

import pytest
from pyspark.sql import functions as F

from numera.operators import archive, primality, proofs, requests
from numera.sources import store

SCHEMA = "id long, kind string, body string"


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    own = str(tmp_path_factory.mktemp("archive"))
    store.write_archive(archive.chunked(spark, 2000, 40).where("chunk_id <> 3"), own)
    return own


def answers(spark, rows, *args, **given):
    return {r["id"]: (r["kind"], r["status"], json.loads(r["response"])) for r in requests.answered(spark.createDataFrame(rows, SCHEMA), *args, **given).collect()}


def test_longs_from_the_archive(spark, path):
    rows = [
        (1, "is-prime", '{"n": "997"}'),
        (2, "is-prime", '{"n": " +0997 "}'),
        (3, "is-prime", '{"n": "4"}'),
        (4, "next-prime", '{"n": "997", "other": [1]}'),
        (5, "next-prime", '{"n": "2"}'),
        (6, "is-prime", '{"n": "701"}'),
        (7, "next-prime", '{"n": "1999"}'),
        (8, "is-prime", '{"n": "99999999999999999999"}'),
        (9, "is-prime", '{"n": "-5"}'),
        (10, "is-prime", '{"n": ""}'),
        (11, "is-prime", '{"n": 5}'),
        (12, "is-prime", '{"m": "5"}'),
        (13, "is-prime", "nothing"),
        (14, "next-prime", None),
        (15, "other", '{"n": "5"}'),
        (16, None, '{"n": "5"}'),
        (17, "is-prime", '{"n": "997"}'),
        (18, "is-prime", '["5"]'),
        (19, "is-prime", '{"n": null}'),
    ]
    got = answers(spark, rows, path)
    assert len(got) == 19
    assert got[1] == got[17] == ("is-prime", 200, {"n": "997", "is_prime": True, "source": "archive"})
    assert got[2] == ("is-prime", 200, {"n": " +0997 ", "is_prime": True, "source": "archive"})
    assert got[3][2] == {"n": "4", "is_prime": False, "source": "rule"}
    assert got[4] == ("next-prime", 200, {"n": "997", "next_prime": "1009", "source": "archive"})
    assert got[5][2] == {"n": "2", "next_prime": "3", "source": "rule"}
    # 701 is a prime of the chunk that the archive lacks
    assert got[6][1:] == got[7][1:] == (400, {"error": "uncovered"})
    assert [got[k][2]["error"] for k in (8, 9, 10)] == ["out_of_range", "invalid", "empty"]
    assert all(got[k][1:] == (400, {"error": "invalid JSON request"}) for k in (11, 12, 13, 14, 18, 19))
    assert got[15][1:] == got[16][1:] == (404, {"error": "not found"})
    assert answers(spark, rows[:1])[1][1:] == (400, {"error": "no archive"})


def test_numbers_of_any_size(spark):
    big = 2**89 - 1
    rows = [
        (1, "is-prime-big", json.dumps({"n": f" {str(big)[:9]} \n{str(big)[9:]}"})),
        (2, "next-prime-big", json.dumps({"n": str(big)})),
        (3, "is-prime-big-proven", json.dumps({"n": str(big)})),
        (4, "is-prime-big-proven", '{"n": "15"}'),
        (5, "next-prime-big-proven", '{"n": "15"}'),
        (6, "is-prime-big", '{"n": "+15"}'),
        (7, "is-prime-big", json.dumps({"n": "1" * 50 + "x"})),
        (8, "is-prime-big", json.dumps({"n": "2" * 61})),
        (9, "is-prime-big", json.dumps({"n": "2" * 101})),
        (10, "is-prime-big", '{"n": " "}'),
    ]
    got = answers(spark, rows, prover=proofs.FactorProver(), max_digits=100)
    assert got[1][2] == {"n_preview": str(big), "n_digits": 27, "is_prime": True, "status": "probable_prime"}
    assert got[2][2]["next_prime"] == str(primality.next_prime_int(big))
    assert got[3][2]["status"] == "proven_prime" and got[3][2]["certificate_available"] and got[3][2]["certificate_snippet"].startswith('{"n":"' + str(big))
    assert got[4][2] == {"n_preview": "15", "n_digits": 2, "is_prime": False, "status": "composite", "certificate_available": False}
    assert got[5][2]["next_prime"] == "17" and got[5][2]["status"] == "proven_prime"
    assert [got[k][1] for k in (6, 7, 9, 10)] == [400] * 4
    assert [got[k][2]["error"] for k in (6, 7, 9, 10)] == ["invalid_char", "invalid_char", "too_long", "empty"]
    assert got[8][2]["n_preview"] == "2" * 20 + "..." + "2" * 10 + " (61 digits)" and got[8][2]["status"] == "composite"
    assert answers(spark, rows[2:3])[3][2]["status"] == "probable_prime"


def test_no_requests(spark, path):
    assert answers(spark, [], path) == {}


def test_positions_of_bad_characters(spark):
    cases = {"12x4": (2, "x"), " +x": (0, "x"), "1 2": (1, " "), "１２": (0, "１"), "7" * 1030 + "é": (1030, "é"), " 7 ": None, "+7": None, "++7": (0, "+"), "7\n": None, "-x": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", primality.validated(F.col("t")).alias("v")).select("t", "v.*")
    for r in df.collect():
        want = cases[r["t"]]
        assert (r["error"] == "invalid_char") == (want is not None)
        assert (r["position"], r["character"]) == (want or (None, None))
    assert {r["t"]: r["value"] for r in df.where("ok").collect()} == {" 7 ": "7", "+7": "7", "7\n": "7"}


def test_numbers_of_very_many_digits(spark):
    text = "1" + "0" * 5000
    row = primality.is_prime_big(spark.createDataFrame([(text + "7",)], "text string"), max_digits=10_000).first()
    assert row["status"] == "composite" and int(row["divisor"]) > 5
