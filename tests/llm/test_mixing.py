import pytest

from numera.llm import mixing


def test_sainte_lague_takes_the_highest_quotients():
    for votes, seats in (([53, 24, 23], 7), ([6.5, 6.5, 1], 9), ([1000, 1, 1, 1], 50), ([0, 0, 5], 4), ([3], 11), ([2, 2, 2], 1)):
        quotients = sorted(((v / (2 * s + 1), -i) for i, v in enumerate(votes) for s in range(seats) if v), reverse=True)[:seats]
        assert mixing.sainte_lague(votes, seats) == [sum(-i == k for _, i in quotients) for k in range(len(votes))]
    assert mixing.sainte_lague([5, 5], 20, [3, 30]) == [3, 17]
    assert mixing.sainte_lague([5, 5], 20, [3, 4]) == [3, 4]
    assert mixing.sainte_lague([0, 0], 5) == [0, 0] and mixing.sainte_lague([], 5) == []


def test_targets_stop_at_three_times():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = mixing.targets([10, 1000, 1000], [5, 2, 1])
    assert got[0] == 30 and sum(got) == pytest.approx(2010) and got[1] == pytest.approx(2 * got[2])
    assert mixing.targets([0, 7], [5, 2]) == [0, 7] and mixing.targets([], []) == []


ROWS = [(i, f"w{i} " * (i % 40), None, f"s{i % 3}") for i in range(300)]
ROWS += [(1000 + i, "a b c", None, None) for i in range(9)] + [(2000, None, None, "é"), (2001, "one two\x0bthree", None, "é"), (1003, "a b c", None, None), (None, "long " * 4000, None, "z")]


def test_mix(docs_of):
    got = mixing.mix(docs_of(ROWS)).toPandas()
    assert len(got) == len(ROWS)
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all()
    total = sum(len((t or "").split()) for _, t, _, _ in ROWS)
    by_source = got.groupby("source", dropna=False).agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by_source["size"] == by_source["source_size"]).all()
    assert by_source["target"].sum() == pytest.approx(total)
    assert (abs(by_source["taken"] - by_source["target"]) <= mixing.BLOCK_WORDS).all()
    again = mixing.mix(docs_of(ROWS, 7)).toPandas()
    key = ["doc_id", "size", "target", "taken"]
    assert got[key].sort_values(key).to_numpy().tolist().__repr__() == again[key].sort_values(key).to_numpy().tolist().__repr__()
    other = mixing.mix(docs_of(ROWS), seed=7).toPandas()
    assert other.set_index("doc_id")["taken"].to_dict() != got.set_index("doc_id")["taken"].to_dict()


def test_groups_of_shards_against_sql(spark, docs_of):
    import duckdb

    rows = [(i, f"w{i} " * (1 + i % 40), None, f"s{i % 3}") for i in range(600)]
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    for shard_docs, group_shards in ((20, 3), (7, 4), (2000, 1000)):
        want = sorted(con.sql(mixing.oracle_sql(shard_docs=shard_docs, group_shards=group_shards)).fetchall())
        got = mixing.mix(docs_of(rows), shard_docs=shard_docs, group_shards=group_shards).select("doc_id", "size", "source_size", "target", "taken")
        assert sorted(map(tuple, got.collect())) == want


def test_too_many_sources(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix(docs_of(ROWS))


def test_clashing_names(docs_of):
    docs = docs_of(ROWS).selectExpr("*", *(f"1 as {c}" for c in ("__k1", "__k2", "__rows", "__times", "__copy", "__number", "shard", "sid", "turn")))
    assert mixing.copies(docs).columns == docs.columns and mixing.copies(docs).count() > 100


def test_copies_follow_taken(docs_of):
    docs = docs_of(ROWS)
    got = mixing.copies(docs, shard_docs=20)
    assert got.columns == docs.columns
    times = {k: len(list(g)) for k, g in __import__("itertools").groupby(sorted(r.doc_id for r in got.where("doc_id < 300").collect()))}
    for r in mixing.mix(docs, shard_docs=20).where("doc_id < 300").collect():
        assert times.get(r.doc_id, 0) == (int(r.taken / r.size + 0.5) if r.size else 0)


def test_empty(docs_of):
    assert mixing.mix(docs_of([])).count() == mixing.copies(docs_of([])).count() == 0
    only = mixing.mix(docs_of([(1, None), (2, " ")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in only] == [(0, 0, 0.0, 0)] * 2


def test_equal_rows_share_their_copies(docs_of, monkeypatch):
    for taken, want in ((3, 1), (6, 2), (9, 3), (12, 4), (0, 0)):
        # three equal rows of three words, all words taken counted on the first of them
        found = lambda docs, **_: docs.withColumns(dict(zip(("k1", "k2"), mixing.row_keys(mixing.F.col("doc_id"), mixing.F.col("text"))))).withColumns({"size": mixing.F.lit(3), "taken": mixing.F.lit(taken / 3)})
        monkeypatch.setattr(mixing, "mix", found)
        assert mixing.copies(docs_of([(1, "a b c", None, "s")] * 3)).count() == want
