import random

import numpy as np
import pytest

from numera.llm import common, near_copies
from numera.llm.simhash import bit_majority, shingle_hashes


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def pairs(texts):
    """Index pairs of texts with a similarity of 0.8 or more, of them those that are short or have fingerprints within the budget, and all."""
    sets, prints = [shingles(t) for t in texts], []
    for t in texts:
        own = np.unique(np.fromiter(shingle_hashes((t or "").encode(), 5), np.uint64))
        prints.append(int(bit_majority(own, np.array([len(own)]))[0]))
    similar = {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] | sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    return {(i, j) for i, j in similar if (prints[i] ^ prints[j]).bit_count() <= near_copies.DISTANCE or min(len(sets[i]), len(sets[j])) < near_copies.FEW}, similar


def rows():
    rnd = random.Random(3)
    shared = " ".join(f"s{k}" for k in range(40))
    out = []
    for base in range(14):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(20, 200))]
        for _ in range(40 if base == 13 else 4):
            own = list(words)
            for _ in range(rnd.randrange(0, 6)):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
            out.append((len(out), " ".join(own) + (f" {shared}" if base % 2 else "")))
    return [*out, (900, None), (901, ""), (902, "one two"), (903, "One  TWO"), (904, "three"), (None, "one two"), (3, out[3][1]), (None, None), (910, "y z " * 9000), (911, "y z " * 9000 + "end")]


def survivors(all_rows):
    distinct = list(dict.fromkeys(all_rows))
    home = list(range(len(distinct)))
    links, similar = pairs([t for _, t in distinct])
    assert len(links) >= 0.99 * len(similar) > 0
    for i, j in links:
        home = [home[i] if h == home[j] else h for h in home]
    best = {}
    for (d, _), h in zip(distinct, home):
        best[h] = min(best.get(h, (True, 1 << 60)), (d is None, d or 0))
    return sorted((d, n) for n, d in best.values())


@pytest.mark.parametrize("block,hot", [(near_copies.BLOCK, 1000), (5, 2)])
def test_survivors_against_all_pairs(docs_of, monkeypatch, block, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    docs = docs_of(rows())
    got = near_copies.near_survivors(docs, block=block, members=block)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.doc_id is None) for r in got.collect()) == survivors(rows())


def test_without_broadcasts(docs_of, monkeypatch):
    want = sorted((r.doc_id is None, r.doc_id or 0) for r in near_copies.near_survivors(docs_of(rows())).collect())
    for module in (common, near_copies):
        monkeypatch.setattr(module, "MOST_BROADCAST", 0 if module is near_copies else 1)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near_copies.near_survivors(docs_of(rows())).collect()) == want


def test_clashing_names_and_empty(docs_of):
    docs = docs_of([(1, "a b c"), (1, "a b c"), (2, "d")]).selectExpr("*", "1 as __k1", "2 as __k2", "3 as node")
    got = near_copies.near_survivors(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 2]
    assert near_copies.near_survivors(docs_of([])).count() == 0


def test_pigeonring_prunes_exactly():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 20_000, dtype=np.uint64) & rng.integers(0, 2**63, 20_000, dtype=np.uint64) & rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    x[:8] = 0
    for distance in (0, 8, 12, 16):
        want = np.flatnonzero(np.bitwise_count(x) <= distance)
        assert near_copies.ring_fits(x, distance).tolist() == want.tolist()


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    common_shingles = np.sort(rng.choice(60, 20, replace=False))
    often = rng.integers(1, 99, 20)
    for _ in range(300):
        a = np.unique(rng.integers(0, 60, 30))
        b = np.unique(np.concatenate([rng.choice(a, int(0.95 * len(a)), replace=False), rng.integers(0, 60, 2)]))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert set(near_copies.prefix(a, common_shingles, often)) & set(near_copies.prefix(b, common_shingles, often))
