import json

import pytest

from numera import cli
from numera.operators import archive
from numera.sources import store


def said(capsys, *args):
    code = cli.main(["--json", *args])
    return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_answers(spark, capsys, tmp_path):
    assert said(capsys, "is-prime", "97")[1]["status"] == "probable_prime"
    assert said(capsys, "next-prime", "7")[1]["p"] == "11"
    code, row = said(capsys, "is-prime", "12x")
    assert code == 1 and row["error"] == "invalid_char"
    (tmp_path / "n.txt").write_text("1 0\n1\n")
    assert said(capsys, "is-prime", "--file", f"{tmp_path}/n.txt")[1]["text"] == "101"
    assert said(capsys, "count-first-n", "1000")[1]["last_prime"] == 7919
    row = said(capsys, "count-first-n", "100", "--path", f"{tmp_path}/run")[1]
    assert row["complete"] and row["last_prime"] == 541
    with pytest.raises(SystemExit):
        cli.main(["is-prime"])


def test_archive_answers(spark, capsys, tmp_path):
    store.write_archive(archive.chunked(spark, 1000, 50), f"{tmp_path}/a")
    assert said(capsys, "is-prime", "29", "--archive", f"{tmp_path}/a") == (0, {"n": 29, "is_prime": True, "source": "archive", "status": "ok"})
    assert said(capsys, "next-prime", "29", "--archive", f"{tmp_path}/a")[1]["next_prime"] == 31
    assert said(capsys, "is-prime", "2003", "--archive", f"{tmp_path}/a")[0] == 1


def test_memory_report(capsys):
    assert cli.main(["memory-report", "--blocks", "10"]) == 0
    assert "bitmap=320" in capsys.readouterr().out


def test_proofs_and_rounds(spark, capsys):
    row = said(capsys, "--timing", "is-prime", str(2**89 - 1), "--prove")[1]
    assert row["elapsed_seconds"] > 0
    assert row["status"] == "proven_prime" and row["valid"] and row["digits"] == 27
    row = said(capsys, "next-prime", str(2**89 - 1), "--prove", "--effort", "100")[1]
    assert int(row["p"]) > 2**89 - 1 and row["proven"] in (True, False)
    assert said(capsys, "is-prime", str(2**89 - 1), "--rounds", "3")[1]["rounds"] == 3
    assert said(capsys, "next-prime", str(10**25), "--rounds", "5")[1]["rounds"] == 5


def test_upkeep(spark, capsys, tmp_path):
    path, exact = f"{tmp_path}/a", f"{tmp_path}/e"
    row = said(capsys, "build", path, "200", "--chunk-primes", "50")[1]
    assert (row["version"], row["found"], row["last_prime"]) == (1, 200, 1223)
    row = said(capsys, "build", path, "420", "--chunk-primes", "50", "--exact", exact)[1]
    assert (row["version"], row["first_chunk"], row["last_chunk"], row["found"], row["last_prime"]) == (2, 4, 8, 420, 2903)
    assert said(capsys, "status", path)[1]["healthy"]
    for folder in (tmp_path / "a").glob("version=2/wheel/block=*"):
        for file in folder.iterdir():
            file.unlink()
    row = said(capsys, "status", path)[1]
    assert (row["healthy"], row["missing"], row["missing_chunks"], row["chunks"]) == (False, "4-8", 5, 9)
    assert said(capsys, "repair", path, "--from-chunk", "4", "--to-chunk", "5")[1]["repaired"] == [4, 5]
    assert said(capsys, "repair", path, "--exact", exact)[1]["repaired"] == [6, 7, 8]
    assert said(capsys, "repair", path, "--finalize-only")[1]["version"] == 5
    row = said(capsys, "status", path)[1]
    assert row["healthy"] and row["missing"] is None and row["durable"] == 420
    assert said(capsys, "rebuild", exact, f"{tmp_path}/b")[1]["version"] == 1
    assert said(capsys, "rebuild", exact, f"{tmp_path}/b", "--missing-only")[1]["chunks"] == []
    assert said(capsys, "next-prime", "2887", "--archive", f"{tmp_path}/b")[1]["next_prime"] == 2897


def test_count_with_flags(spark, capsys, tmp_path):
    path = f"{tmp_path}/run"
    assert said(capsys, "progress", path)[0] == 1
    row = said(capsys, "count-first-n", "500", "--path", path, "--segment", "1000", "--checkpoint-every", "2", "--checkpoint-seconds", "60")[1]
    assert row["complete"] and row["last_prime"] == 3571 and row["percent"] == 100.0 and row["batches"] >= 2
    assert said(capsys, "progress", path)[1]["found"] == 500
    assert said(capsys, "count-first-n", "600", "--path", path, "--resume", "always")[1]["last_prime"] == 4409
