import random
import re

import numpy as np

from numera.llm import quality

EN = ["the", "of", "and", "to", "in", "is", "that"]


def prose(seed, n=80):
    rnd = random.Random(seed)
    words = [rnd.choice(EN) if rnd.random() < 0.4 else "".join(rnd.choice("aeioutrnsld") for _ in range(rnd.randrange(3, 9))) for _ in range(n)]
    return re.sub(r"(\w+)( \w+){9}", lambda m: m[0].capitalize() + ".", " ".join(words))


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_and_verdicts(docs_of):
    rnd = random.Random(5)
    rows = [(i, prose(i), "en") for i in range(60)]
    junk = {100: " ".join(f"{w}###" for w in prose(100).split()), 101: prose(101).upper().replace(" ", "!! "), 102: " | ".join("".join(rnd.choice("xqzjk") for _ in range(6)) for _ in range(60))}
    odd = {200: None, 201: "", 202: "a b c d e " * 40, 203: "x\nx\n \n \nx y z\x0bw", 204: "déjà vu 😀 " * 3, 205: "one two three four five six seven eight nine ten", 206: "a b c d e f a b c d e g h i j k l m n o p q r s t"}
    rows += [(d, t, "en") for d, t in junk.items()] + [(d, t, None) for d, t in odd.items()] + [(None, prose(7), None), (3, rows[3][1], "en"), (300, ("lorem ipsum " + prose(9)) * 300, "en")]
    got = quality.quality(docs_of(rows)).collect()
    assert sorted([(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got]) == sorted(brute(t) for _, t, _ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].kept for i in range(60)) and by_id[None].kept and by_id[205].kept
    assert not any(by_id[d].kept for d in junk) and by_id[202].base_failed


def test_a_hash_clash_does_not_count():
    ids, doc = np.arange(12) % 6, np.repeat([0, 1], 6)
    assert quality.repeated_words(ids, doc, 2).tolist() == [0, 0]
    assert quality.repeated_words(np.zeros(7, int), np.zeros(7, int), 1).tolist() == [7]
    assert quality.repeated_words(np.zeros(0, int), np.zeros(0, int), 1).tolist() == [0]


def test_distance():
    p, q = np.array([0.5, 0.5, 0]), np.array([0, 0, 1.0])
    assert quality.js_distance(p, p) == 0 and quality.js_distance(p, q) == 1
    assert 0 < quality.js_distance(p, np.array([0.6, 0.4, 0])) < 0.1


def test_empty_and_without_references(docs_of):
    assert quality.quality(docs_of([])).count() == 0
    only = quality.quality(docs_of([(1, prose(1)), (2, None)])).collect()
    assert {r.doc_id: r.kept for r in only} == {1: True, 2: False}
