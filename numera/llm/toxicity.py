"""Toxicity by a factorization machine over hashed terms.

Terms are words and their first letters, so that an insult is met in any
inflection; they are hashed into ``2 ** HASH_BITS`` numbers. Terms whose
presence goes with the label, either way, become the machine's features, and so
do terms that tell nothing alone if their presence together does. Its
score is a bias, a weight for each feature and, for each pair of features, the
product of two learned vectors: a pair such as an insult and a group's name can
weigh more than both words by themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numera.llm.common import held_out

HASH_BITS = 22
#: First letters that count as a term of their own.
PREFIXES = (4, 5, 6)
#: Bound of the training sample: documents for each label.
SAMPLE = 2500
#: Bound of the training sample: characters of a document; longer ones are scored, but not learned from.
SAMPLE_CHARS = 200_000
FEATURES = 20_000
#: Frequent terms whose pairs are tested.
PAIRED = 1500
FACTORS = 8
_WORDS = re.compile(r"[^\W\d_]+")
_CACHE = 200_000


def term_hashes(word: str) -> list[int]:
    """Numbers of a word's terms, for a word in lower case."""
    terms = [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]
    return [xxhash.xxh64_intdigest(t) & ((1 << HASH_BITS) - 1) for t in terms]


def document_terms(text: str | None) -> np.ndarray:
    """The distinct terms of a whole text."""
    found: set[int] = set()
    for word in set(_WORDS.findall((text or "").lower())):
        found.update(term_hashes(word))
    return np.fromiter(found, np.int32, len(found))


def _chi_square(seen: np.ndarray, hits: np.ndarray, n: int, toxic: int) -> np.ndarray:
    """Presence against label, two by two."""
    return (hits - seen * toxic / n) ** 2 * n * n / np.maximum(1e-9, toxic * (n - toxic) * seen * (n - seen) / n)


def _telling_pairs(col: np.ndarray, row: np.ndarray, labels: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Those of the terms ``number`` that are in a pair which tells more than both its terms.

    col and row say which of all terms is in which document.
    """
    n, toxic, place = len(labels), int(labels.sum()), np.full(int(col.max(initial=0)) + 1, -1)
    place[number] = np.arange(len(number))
    own = place[col] >= 0
    x = np.zeros((n, len(number)), np.float32)
    x[row[own], place[col[own]]] = 1
    seen, hits = x.T @ x, x.T @ (x * labels[:, None].astype(np.float32))
    chi = _chi_square(seen.astype(float), hits.astype(float), n, toxic)
    alone = np.diag(chi).copy()
    np.fill_diagonal(chi, 0)
    # few pairs pass by chance, such as are in a handful of documents; the machine learns little from them
    good = (chi > 2 * np.log(max(2, len(number)) ** 2 / 2) + 2) & (seen >= 3) & (chi > 1.5 * np.maximum(alone[:, None], alone[None]))
    return number[good.any(axis=1)]


@dataclass
class Machine:
    """The fitted model: features by hashed term, their weights and vectors."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability for rows of feature numbers."""
        z = np.full(len(rows), self.bias)
        for i, row in enumerate(rows):
            if len(row):
                v = self.factor[row]
                total = v.sum(axis=0)
                z[i] += self.weight[row].sum() + 0.5 * float(total @ total - (v * v).sum())
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float | None = None, seed: int = 42, epochs: int = 120, rate: float = 0.05, decay: float = 1e-2, pair_decay: float = 1e-2) -> Machine:
    """Logistic loss, full-batch Adam on the features that chi-square tests of terms and of pairs pick.

    ``share`` is that of label 1 among all labelled documents, by default among
    the rows. The labels' weights have the square root of its odds: less than
    even, so that a document without a telling term is taken for what most are,
    but more than their numbers, so that the rare label is learned. Without rows
    of both labels there is nothing to learn: the score is the rows' share of
    label 1, or 0 without any row.
    """
    n, toxic = len(rows), int(labels.sum())
    share = share if share is not None else toxic / max(n, 1)
    if toxic in (0, n):
        share = toxic / n if n else 0.0
        return Machine(np.zeros(0, np.int64), 30.0 * (2 * share - 1), np.zeros(0), np.zeros((0, FACTORS)))
    flat = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    terms, number = np.unique(flat, return_inverse=True)
    seen = np.bincount(number, minlength=len(terms)).astype(float)
    hits = np.bincount(number, weights=labels[owner], minlength=len(terms))
    chi = _chi_square(seen, hits, n, toxic)
    # so high that of all terms, if none were telling, about one would pass
    good = np.flatnonzero((chi > 2 * np.log(len(terms)) + 2) & (seen >= 3))
    good = good[np.argsort(-chi[good], kind="stable")[:FEATURES]]
    frequent = np.setdiff1d(np.flatnonzero((seen >= 3) & (2 * seen <= n)), good)
    frequent = np.sort(frequent[np.argsort(-seen[frequent], kind="stable")[:PAIRED]])
    good = np.union1d(good, _telling_pairs(number, owner, labels, frequent))
    place = np.full(len(terms), -1)
    place[good] = np.arange(len(good))
    keep = place[number] >= 0
    col, row = place[number[keep]], owner[keep]
    rng = np.random.default_rng(seed)
    d = len(good)
    theta = [np.zeros(1), np.zeros(d), rng.normal(0, 0.05, (d, FACTORS))]
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]
    odds = np.sqrt(min(1.0, share / max(1e-9, 1 - share)))
    cost = np.where(labels > 0, odds / toxic, 1 / (n - toxic)) / (1 + odds)
    for step in range(1, epochs + 1):
        bias, w, v = theta
        sums = np.stack([np.bincount(row, weights=v[col, f], minlength=n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(row, weights=(v * v).sum(axis=1)[col], minlength=n)
        z = bias[0] + np.bincount(row, weights=w[col], minlength=n) + 0.5 * ((sums * sums).sum(axis=1) - squares)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * cost
        gw = np.bincount(col, weights=g[row], minlength=d)
        gv = np.stack([np.bincount(col, weights=g[row] * sums[row, f], minlength=d) for f in range(FACTORS)], axis=1) - v * gw[:, None]
        for k, grad in enumerate((np.array([g.sum()]), gw + decay * w / max(d, 1), gv + pair_decay * v / max(d, 1))):
            m, s = moments[k]
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            theta[k] = theta[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Machine(terms[good], float(theta[0][0]), theta[1], theta[2])


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [document_terms(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.binary())], ["doc_id", "toxic", "terms"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled documents for each label, drawn by a hash of the id.

    Rows with crc32(doc_id as text) mod 5 = 0 are held out. A null label does
    not count; of several labels for an id the highest does. Only texts and
    labels are learned from, whole texts of at most ``SAMPLE_CHARS`` each.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    own = own.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # at most 2 * sample rows, so the broadcast is bounded
    drawn = [own.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for x in (0, 1)]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    picked = texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").select("doc_id", "toxic", "text")
    # an id that has several rows counts once, so that the sample keeps its bound
    got = picked.mapInArrow(_term_rows, "doc_id long, toxic int, terms binary").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("terms").alias("terms")).toArrow()
    of = {r["toxic"]: r["count"] for r in own.where(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    order = sorted(zip(got.column("terms").to_pylist(), got.column("toxic").to_pylist()))
    return fit([np.frombuffer(t, np.int32) for t, _ in order], np.array([x for _, x in order], float), of.get(1, 0) / max(1, sum(of.values())))


def _scored(machine: Machine, text_col: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(t): i for i, t in enumerate(machine.terms)}
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            rows = []
            for value in batch.column(text_col):
                found: set[int] = set()
                for word in set(_WORDS.findall((value.as_py() or "").lower())):
                    hit = cache.get(word)
                    if hit is None:
                        if len(cache) >= _CACHE:
                            cache.clear()
                        hit = cache[word] = tuple(place[t] for t in term_hashes(word) if t in place)
                    if hit:
                        found.update(hit)
                rows.append(np.array(sorted(found), np.int64))
            yield batch.append_column(name, pa.array(machine.scores(rows), pa.float64()))

    return run


def score(docs: DataFrame, machine: Machine, text_col: str = "text", name: str = "__score") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1 for every whole text.

    Null and empty texts have no term and get the bias alone. Rows that repeat
    score alike; an empty table gives an empty result; only the text counts.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_scored(machine, text_col, name), schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null and empty texts have no term: they score as a text without a telling
    one. Long texts count whole; rows that repeat score alike; a null id is not
    held out; without labels of both kinds all score as the labels' share of 1.
    An empty table gives an empty result; other columns are not looked at.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), train(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
