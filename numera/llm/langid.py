"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams (1 to 3 letters, hashed), the
model is trained with follow-the-regularised-leader and elastic-net penalties,
and its logits are calibrated by a temperature fitted on training documents
that were set aside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from numera.llm.common import held_out, row_keys

GRAMS = (1, 2, 3)
HASH_BITS = 15
#: Bounds of the training sample: documents for each language, and in all.
SAMPLE = 1000
MOST_ROWS = 500_000
#: Languages whose weights fit the driver; more are an error, none is left out.
MOST_LANGUAGES = 1000
#: Characters that are hashed at a time.
_CHUNK = 1 << 20
_NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text: letters in lower case, all else one space."""
    size = 1 << HASH_BITS
    out = np.zeros(size, np.int64)
    clean = _NOT_LETTERS.sub(" ", f" {text.lower()} ")
    points = np.frombuffer(clean.encode("utf-32-le"), np.uint32)
    for at in range(0, len(points), _CHUNK):
        found = []
        part = points[at : at + _CHUNK + max(GRAMS) - 1].astype(np.uint64)
        h = np.zeros(len(part), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] ^ part[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            if n in GRAMS:
                found.append((h[:_CHUNK] >> np.uint64(7)).astype(np.int64) & (size - 1))
        out += np.bincount(np.concatenate(found), minlength=size)
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    #: Features with a weight, and their weights by language.
    active: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        tf = gram_counts(text)
        x = np.log1p(tf) * self.idf
        z = (x[self.active] @ self.weight) / max(1e-12, float(np.sqrt(x @ x))) + self.bias
        z = z / self.temperature
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.langs[best], float(p[best] / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], idf: np.ndarray, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 42) -> LanguageModel:
    """FTRL-Proximal over rows (feature numbers, counts); every fifth row is set aside for the temperature.

    A single row is both. Without rows the model knows no language; with one language it always
    answers that one.
    """
    langs = sorted(set(labels))
    if not langs:
        return LanguageModel([], idf, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 1.0)
    y = np.array([langs.index(x) for x in labels])
    order = np.random.default_rng(seed).permutation(len(rows))
    aside, own = order[::5], order[np.arange(len(order)) % 5 > 0]
    if not len(own):
        aside = own = order
    weights = []
    for i, tf in rows:
        x = np.log1p(tf) * idf[i]
        weights.append(x / max(1e-12, float(np.sqrt(x @ x))))
    k, d = len(langs), len(idf)
    z, n = np.zeros((d + 1, k)), np.zeros((d + 1, k))
    penalty = np.full((d + 1, 1), l1)
    penalty[d] = 0  # the bias

    def current(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        shrunk = np.sign(zi) * np.maximum(0, np.abs(zi) - penalty[i])
        return -shrunk / ((beta + np.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for r in own:
            i = np.append(rows[r][0], d)
            x = np.append(weights[r], 1.0)
            w = current(i)
            p = _softmax(x @ w)
            p[y[r]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = current(np.arange(d + 1))
    active = np.flatnonzero((w[:d] != 0).any(axis=1))
    logits = np.array([weights[r] @ w[rows[r][0]] + w[d] for r in aside])
    # the temperature that makes the set-aside labels likeliest
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(np.maximum(1e-12, _softmax(logits / t)[np.arange(len(aside)), y[aside]])).mean() for t in grid]
    return LanguageModel(langs, idf, active, w[active], w[d], float(grid[int(np.argmin(loss))]))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of a partition each n-gram occurs; the last bin counts documents."""
    size = 1 << HASH_BITS
    total = np.zeros(size + 1, np.int64)
    for batch in batches:
        for value in batch.column("text"):
            total[:size] += gram_counts(value.as_py() or "") > 0
            total[size] += 1
    bins = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bin": pa.array(bins), "n": pa.array(total[bins])})


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            tf = gram_counts(value.as_py() or "")
            i = np.flatnonzero(tf)
            rows.append(np.stack([i, tf[i]]).astype(np.int32).tobytes())
        yield batch.drop_columns(["text"]).append_column("grams", pa.array(rows, pa.binary()))


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learn from text and non-null lang of rows with crc32(doc_id as text) mod 4 other than 2.

    Document frequencies cover all those rows. The weights are fitted on at
    most ``sample`` of them for each language, and at most ``MOST_ROWS`` in all,
    drawn by a hash of id and text; rows without an id are learned from too. A
    row's counts have at most 2 ** HASH_BITS entries, however long its text is.
    More than ``MOST_LANGUAGES`` languages are an error.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    size = 1 << HASH_BITS
    found = own.select("text").mapInArrow(_frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(size + 1)
    seen[found["bin"].to_numpy(int)] = found["n"].to_numpy(float)
    idf = np.log((1 + seen[size]) / (1 + seen[:size])) + 1
    keys = row_keys(F.col("doc_id"), F.col("text"))
    turns = own.select("lang", keys[0].alias("k1"), keys[1].alias("k2")).withColumn("turn", F.xxhash64(F.lit("turn"), "k1", "k2"))
    share = own.groupBy("lang").agg(F.count("*").alias("n"))
    languages = share.limit(MOST_LANGUAGES + 1).count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sample = min(sample, MOST_ROWS // max(1, languages))
    # a hash leaves about 1.5 samples of each language, whatever its size, for the window to choose from; rows that
    # are equal in id and text count once
    turns = turns.join(F.broadcast(share), "lang").where(F.pmod("turn", F.lit(1_000_003)) < F.lit(1.5 * sample) / F.col("n") * 1_000_003).select("lang", "turn", "k1", "k2").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "k1", "k2"))
    drawn = turns.withColumn("rank", rank).where(F.col("rank") <= sample)
    # the broadcast is bounded: at most ``sample`` rows for each language
    picked = own.select("*", keys[0].alias("k1"), keys[1].alias("k2")).join(F.broadcast(drawn.select("lang", "k1", "k2")), ["lang", "k1", "k2"], "left_semi").select("lang", "k1", "k2", "text")
    got = picked.mapInArrow(_gram_rows, "lang string, k1 long, k2 long, grams binary").dropDuplicates(["lang", "k1", "k2"]).toArrow()
    pairs = sorted(zip(got.column("lang").to_pylist(), got.column("grams").to_pylist()))
    rows = []
    for _, packed in pairs:
        i, tf = np.frombuffer(packed, np.int32).reshape(2, -1)
        rows.append((i.astype(np.int64), tf.astype(float)))
    return fit(rows, [lang for lang, _ in pairs], idf)


def _predicted(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(v.as_py()) for v in batch.column("text")]
            yield batch.drop_columns(["text"]).append_column("lang_pred", pa.array([x for x, _ in got], pa.string())).append_column("score", pa.array([p for _, p in got], pa.float64()))

    return run


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if there was nothing to learn from. Rows that repeat are predicted
    each; an empty table gives an empty result; only the text is looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predicted(model), schema)


def language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``identify`` by a model that learns from the rows of ``docs`` which are not held out."""
    return identify(docs, train(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), sample))
