import hashlib
import re

import pytest

from numera.llm import exact_dedup

ROWS = [(5, "a b"), (3, "ab"), (4, "a  b"), (9, "a\tb "), (1, None), (2, ""), (None, " \n"), (6, "x"), (6, "x"), (None, "only"), (8, "A b"), (10, "é é"), (11, "éé" + "z" * 50_000), (12, "éé" + "z" * 50_000 + "\x0b"), (13, "a b")]


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    out = []
    for d, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[norm])
        out.append((d, best[3], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr), len(groups)


@pytest.mark.parametrize("budget", [exact_dedup.BUDGET, 0, 200])
def test_groups(spark, docs_of, budget):
    got = exact_dedup.exact_groups(docs_of(ROWS, 1), budget=budget).collect()
    want, n = brute(ROWS)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == want
    assert sum(r.kept for r in got) == n
    for r in got:
        assert not r.kept or r.doc_id == r.keep_id


def test_survivors_have_all_columns(spark, docs_of):
    docs = docs_of(ROWS)
    got = exact_dedup.exact_survivors(docs, budget=100)
    assert got.columns == docs.columns
    kept = {r.doc_id for r in exact_dedup.exact_groups(docs_of(ROWS, 1)).where("kept").collect()}
    assert {r.doc_id for r in got.collect()} == kept and got.count() == brute(ROWS)[1]


def test_empty(docs_of):
    assert exact_dedup.exact_groups(docs_of([])).count() == exact_dedup.exact_survivors(docs_of([])).count() == 0


def test_table_grows_and_compares_content():
    table = exact_dedup.ContentTable()
    own = [b"%d" % i for i in range(5000)]
    assert [table.find(7, c, True) for c in own] == list(range(5000))  # one hash for all
    assert table.find(7, own[4321], False) == 4321 and table.find(7, b"other", False) == -1
