"""The pipeline's stages, each held against brute force on its own input."""

import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from numera.llm.mixing import BLOCK_WORDS, targets

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    toxic = {r[0] for r in duckdb.sql(f"select doc_id from '{DATA}/labels.parquet' where toxic = 1").fetchall()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, docs
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(after.columns == columns for name, (_, after) in seen.items() if name != "bpe")
    before, after = seen["toxicity"]
    gone = {r.doc_id for r in before.select("doc_id").collect()} - {r.doc_id for r in after.select("doc_id").collect()}
    assert gone and len(gone & toxic) >= 0.8 * len(gone & {r[0] for r in duckdb.sql(f"select doc_id from '{DATA}/labels.parquet'").fetchall()})
    before, after = seen["exact_dedup"]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    want = {}
    for r in before.collect():
        want[norm(r.text)] = min(want.get(norm(r.text), (0, 1 << 60)), (-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for _, d in want.values())
    before, after = seen["near_dedup"]
    from tests.llm.test_near_copies import survivors

    assert sorted((r.doc_id, False) for r in after.collect()) == survivors([(r.doc_id, r.text) for r in before.collect()])
    before, after = seen["mixing"]
    rows = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in before.collect()}
    sources = sorted({s for s, _ in rows.values()})
    sizes = [sum(n for s, n in rows.values() if s == source) for source in sources]
    taken = dict.fromkeys(sources, 0)
    for r in after.collect():
        taken[rows[r.doc_id][0]] += rows[r.doc_id][1]
    assert max(np.unique([r.doc_id for r in after.collect()], return_counts=True)[1]) <= 3
    for source, target in zip(sources, targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(sources))])):
        # one text of a shard is rounded
        assert abs(taken[source] - target) <= max(n for s, n in rows.values() if s == source) / 2 + BLOCK_WORDS
    before, after = seen["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in before.collect()}
    assert after.count() == before.count()
    for r in after.collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 50


ODD = [(1, None), (2, ""), (3, " \n"), (4, "one two three four five six"), (4, "one two three four five six"), (None, "one two three four five six"), (5, "ONE two  three four five six"), (6, "w " * 60_000), (7, "lone"), (None, None)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_any_rows(spark, docs_of, rows):
    clash = ("__k1", "__k2", "__score", "__hash", "__local", "__count", "__copy", "k1", "node", "fp", "turn", "n", "root")
    docs = docs_of(rows).selectExpr("*", *(f"{k} as {c}" for k, c in enumerate(clash)))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, DATA)
        if name != "bpe":
            assert result.columns == docs.columns
        left[name] = [(r.doc_id, r.text) for r in result.collect()] if name != "bpe" else result.collect()
    assert len(left["toxicity"]) == len(left["bpe"]) == len(rows)
    if rows:
        assert sorted(left["exact_dedup"], key=repr) == sorted([(3, " \n"), (4, ODD[3][1]), (5, ODD[6][1]), (6, ODD[7][1]), (7, "lone")], key=repr)
        assert sorted((d for d, _ in left["near_dedup"]), key=repr) == sorted([1, 2, 3, 4, 6, 7, None], key=repr)
        assert not {d for d, t in left["mixing"] if not (t or "").strip()} and {6, 7} <= {d for d, _ in left["mixing"]}
        assert len(left["near_dedup"]) == 7
