import pytest
import random
import zlib

import numpy as np

from numera.llm import langid

SYLLABLES = {"en": ["th", "he", "ing", "and", "ou", "wh"], "de": ["sch", "ung", "ei", "ä", "ich", "pf"], "fr": ["eau", "qu", "é", "oi", "ç", "ai"]}


def text(lang, seed, n=30):
    rnd = random.Random(f"{lang}{seed}")
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_contract(docs_of):
    rows = [(i, text(lang, i), lang) for i, lang in enumerate(["en", "de", "fr"] * 120)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !! 😀", "de"), (1003, "z", None), (None, text("de", 1), None), (4, rows[4][1], "de"), (1004, text("fr", 5, 40_000), None)]
    got = langid.language(docs_of(rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {d: lang for d, _, lang in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].lang_pred == by_id[1001].lang_pred == by_id[1002].lang_pred == "und" and by_id[1000].score == 0
    assert by_id[1004].lang_pred == "fr" and by_id[None].lang_pred == "de" and by_id[1003].lang_pred in truth.values()
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_held_out_rows_are_not_learned(docs_of):
    rows = [(i, text(lang, i), lang) for i, lang in enumerate(["en", "de"] * 50)]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    other = [r for r in rows if r not in held] + [(d, "qqq " * 9, "xx") for d, _, _ in held]
    a, b = langid.train(docs_of(rows)), langid.train(docs_of(other))
    assert a.langs == b.langs == ["de", "en"] and (a.idf == b.idf).all() and np.allclose(a.weight, b.weight)


def test_weights_are_sparse_and_calibrated(docs_of):
    rows = [(i, text(lang, i), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    model = langid.train(docs_of(rows))
    assert 0 < len(model.active) < (1 << langid.HASH_BITS) / 10 and 0.05 <= model.temperature <= 5


def test_long_texts_are_counted_whole():
    one = "abc déf " * 10
    long = one * (langid._CHUNK // 40)
    a, b = langid.gram_counts(one), langid.gram_counts(long)
    assert set(np.flatnonzero(a)) == set(np.flatnonzero(b))
    n = len(langid._NOT_LETTERS.sub(" ", f" {long.lower()} "))
    assert b.sum() == 3 * n - 3


def test_nothing_to_learn(docs_of):
    assert langid.language(docs_of([])).count() == 0
    assert [(r.lang_pred, r.score) for r in langid.language(docs_of([(1, "text")])).collect()] == [("und", 0.0)]
    assert {r.lang_pred for r in langid.language(docs_of([(i, "text", "en") for i in range(5)])).collect()} == {"en"}


def test_no_language_is_left_out_without_a_word(docs_of, monkeypatch):
    """Of many languages each has a smaller sample; too many are an error."""
    words = ["alpha beta", "gamma delta", "omega sigma", "theta kappa", "lambda rho"]
    docs = docs_of([(d, words[d % 5] * 3, f"l{d % 5}", None) for d in range(200)])
    monkeypatch.setattr(langid, "MOST_ROWS", 50)
    assert langid.train(docs.select("doc_id", "text", "lang")).langs == [f"l{k}" for k in range(5)]
    got = langid.language(docs).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id'] % 5}" for r in got)
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 4)
    with pytest.raises(ValueError, match="languages"):
        langid.language(docs)
