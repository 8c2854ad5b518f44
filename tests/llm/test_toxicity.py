import random
import zlib

import numpy as np

from numera.llm import toxicity

WORDS = [f"wort{i}x" for i in range(400)]


def corpus(n, seed=1):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = rnd.choices(WORDS, k=60)
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rnd.randrange(60)] = rnd.choice(["idiot", "Moron!!", "grumblix", "grumblot", "grumblan"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_contract(spark, docs_of):
    rows, labels = corpus(600)
    extra = [(9001, None), (9002, ""), (9003, "you idiot, what a moron"), (None, "fine words"), (5, rows[5][1])]
    marks = spark.createDataFrame([*labels, (9002, None, None), (None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs_of(rows + extra), marks).collect()
    assert len(got) == 605
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert by_id[9001].score == by_id[9002].score and by_id[9001].predicted == 0 and by_id[9003].predicted == 1


def test_held_out_labels_are_not_learned(spark, docs_of):
    rows, labels = corpus(300)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (toxicity.train(docs_of(rows), spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert a.bias == b.bias and (a.weight == b.weight).all()


def test_pairs_weigh_more_than_their_words():
    # a and b are harmless alone, toxic together: no sum of two weights and a bias ranks these
    a, b, c = (np.array(x, np.int32) for x in ([1, 9], [2, 9], [1, 2]))
    none = np.array([9], np.int32)
    rows, labels = [a, b, c, none] * 200, np.array([0, 0, 1, 0] * 200, float)
    machine = toxicity.fit(rows, labels, epochs=600)
    place = {int(t): i for i, t in enumerate(machine.terms)}
    scores = machine.scores([np.array([place[t] for t in r if t in place]) for r in (a, b, c, none)])
    assert scores[2] > 0.9 and max(scores[[0, 1, 3]]) < 0.3
    v = machine.factor
    pair = float(v[place[1]] @ v[place[2]])
    assert pair > 0


def test_words_that_tell_only_together_are_learned():
    # two frequent words of which neither goes with the label, but both together do
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.3
        toxic = a and b
        if rng.random() < 0.5 and (a or b) and not toxic:
            a = b = False
        words = set(rng.integers(10, 400, 25).tolist()) | ({1} if a else set()) | ({2} if b else set())
        rows.append(np.array(sorted(words), np.int32))
        labels.append(float(toxic))
    labels = np.array(labels)
    # most other words stay out
    picked = toxicity._telling_pairs(np.concatenate(rows).astype(np.int64), np.repeat(np.arange(3000), [len(r) for r in rows]), labels, np.arange(1, 400))
    assert {1, 2} <= set(picked.tolist()) and len(picked) < 60
    machine = toxicity.fit(rows[:2400], labels[:2400])
    place = {int(t): i for i, t in enumerate(machine.terms)}
    got = machine.scores([np.array([place[t] for t in r.tolist() if t in place], np.int64) for r in rows[2400:]]) >= 0.5
    assert np.mean(got == labels[2400:].astype(bool)) > 0.97


def test_nothing_to_learn(spark, docs_of):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs_of([]), empty).count() == 0
    assert [r.score < 1e-9 for r in toxicity.toxicity(docs_of([(1, "text")]), empty).collect()] == [True]
