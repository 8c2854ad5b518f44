import numpy as np
import pytest
import xxhash

from numera.llm import common, simhash
from numera.llm import components as components_module
from numera.llm.components import connected_components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)) if shingles else 0


def components(prints):
    home = list(range(len(prints)))

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = find(i), find(j)
                home[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_ring_links_connect_what_brute_force_connects():
    rng = np.random.default_rng(0)
    for dense in (False, True):
        prints = set()
        for base in rng.integers(0, 2**63, 1 if dense else 12, dtype=np.uint64):
            for _ in range(1500 if dense else 40):
                x = int(base)
                for k in rng.choice(64, rng.integers(0, 6), replace=False):
                    x ^= 1 << int(k)
                prints.add(x)
        prints = np.array(sorted(prints), np.uint64)
        place, home = {int(x): i for i, x in enumerate(prints)}, list(range(len(prints)))

        def find(x):
            while home[x] != x:
                home[x] = home[home[x]]
                x = home[x]
            return x

        for s in range(5):
            seg = simhash._segments(prints, s)[0]
            for v in np.unique(seg):
                for a, b in zip(*(x.tolist() for x in simhash.ring_links(prints[seg == v], s))):
                    assert bin(a ^ b).count("1") <= 4
                    i, j = find(place[a]), find(place[b])
                    home[max(i, j)] = min(i, j)
        want = components([int(x) for x in prints]) if not dense else [0] * len(prints)
        assert [find(i) for i in range(len(prints))] == want


ROWS = [(i, " ".join(f"w{(i // 4 * 31 + k) % 97}" if k % 29 or i % 4 == 0 else f"v{i}" for k in range(120))) for i in range(40)]
ROWS += [(100, None), (101, ""), (102, " \t"), (103, "One two"), (104, "one  TWO"), (105, "É é"), (None, "one two"), (7, ROWS[7][1]), (200, "x y z " * 5000), (201, "x y z " * 5000)]


def test_near_duplicates(docs_of):
    got = simhash.near_duplicates(docs_of(ROWS)).collect()
    prints = [fingerprint(t) for _, t in ROWS]
    home = components(prints)
    least = {h: min((d for (d, _), x in zip(ROWS, home) if x == h and d is not None), default=None) for h in home}
    want = sorted([(d, f"{f:016x}", least[h]) for (d, _), f, h in zip(ROWS, prints, home)], key=repr)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=repr) == want


def test_small_blocks_lose_no_link(spark, docs_of):
    prints = simhash.fingerprints(docs_of(ROWS)).groupBy("fp").agg({"doc_id": "min"}).toDF("fp", "least_id")
    a, b = (connected_components(simhash.links(prints, block)).collect() for block in (simhash.BLOCK, 2))
    assert {(r.node, r.root) for r in a} == {(r.node, r.root) for r in b}


def test_hot_keys_are_looked_up_alike(spark, docs_of, monkeypatch):
    want = sorted(map(tuple, simhash.near_duplicates(docs_of(ROWS)).collect()), key=repr)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    assert sorted(map(tuple, simhash.near_duplicates(docs_of(ROWS)).collect()), key=repr) == want


def test_empty(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (None, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 140)}}


def test_components_that_take_too_long_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(components_module, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"))
