"""Quality rules: base counts, and divergence from language references.

A document's histogram of character classes and its histogram of a language's
common words are compared to references by Jensen-Shannon distance. The
references are mean histograms of the corpus's own documents of a language. A document passes if it is close
to some language in both; short ones are not judged by their histograms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numera.llm.common import WHITE_BYTES, checkpoint

SYMBOLS = b"#*$%&|<>"
#: Words from which on the histograms say something.
MIN_WORDS = 30
#: Distances (base 2, 0 to 1) above which a document is too far from a language.
MAX_CHARS = 0.18
MAX_WORDS = 0.55
WINDOW = 5
_AT_ONCE = 2 << 20

# Frequent words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not are this from or at which an have but you he we were has they his all",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux cette",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei für",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si este",
    "it": "di e il la che in un a per è una sono non con del si da le dei al come più nel della alla",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao",
    "nl": "de van een het en in is dat op te zijn met voor niet aan er om ook als bij maar door uit",
}


def vocabulary() -> list[str]:
    """The common words of all languages, each once."""
    return sorted({w for words in COMMON_WORDS.values() for w in words.split()})


def _byte_classes() -> tuple[np.ndarray, list[str]]:
    """Class of each byte. Digits are left out: numbers belong to no language, and a few long ones outweigh a short text."""
    names = ["upper", "lower", "stop", "punctuation", "symbol", "beyond", "none"]
    kind = np.full(256, names.index("punctuation"))
    for c in range(256):
        ch = chr(c)
        if 0x80 <= c < 0xC0 or c <= 0x20 or c == 0x7F or ch.isdigit() and c < 0x80:
            kind[c] = names.index("none")
        elif c >= 0xC0:
            kind[c] = names.index("beyond")
        elif bytes([c]) in (b".", b","):
            kind[c] = names.index("stop")
        elif c in SYMBOLS:
            kind[c] = names.index("symbol")
        elif ch.isalnum():
            kind[c] = names.index("upper" if ch.isupper() else "lower")
    return kind, names[:-1]


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """For texts laid end to end (word numbers, text numbers): words in windows that a text has twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return np.zeros(n_docs, np.int64)
    mixed = doc[:n].astype(np.uint64)
    for k in range(window):
        mixed = (mixed ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    order = inside[np.argsort(mixed[inside], kind="stable")]
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return np.zeros(n_docs, np.int64)
    a, b = order[:-1][same], order[1:][same]
    if not ((doc[a] == doc[b]) & np.all([ids[a + k] == ids[b + k] for k in range(window)], axis=0)).all():
        # two windows with one hash: compare the windows themselves
        rows = np.stack([doc[inside], *(ids[inside + k] for k in range(window))], axis=1)
        _, back, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        hit = inside[count[back.reshape(-1)] > 1]
    else:
        hit = np.union1d(a, b)
    edge = np.bincount(hit, minlength=len(ids) + 1)[: len(ids) + 1] - np.bincount(hit + window, minlength=len(ids) + 1)[: len(ids) + 1]
    return np.bincount(doc[np.cumsum(edge[: len(ids)]) > 0], minlength=n_docs)


class _Counter:
    def __init__(self) -> None:
        self.kind, self.classes = _byte_classes()
        self.common = {w.encode(): i for i, w in enumerate(vocabulary())}

    def count(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        numbers: dict[bytes, int] = {}
        found, per_text, rows, chars = [], [], [], []
        for raw in texts:
            words = raw.split()
            for w in words:
                if w not in numbers:
                    numbers[w] = len(numbers)
            found += map(numbers.__getitem__, words)
            per_text.append(len(words))
            dense = raw.translate(None, WHITE_BYTES)
            seen, dup = set(), 0
            for line in raw.split(b"\n"):
                if line not in seen:
                    seen.add(line)
                elif line.strip(WHITE_BYTES):
                    dup += 1
            bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            rows.append((len(dense) - int(bytes_[0x80:0xC0].sum()), len(raw) - len(raw.translate(None, SYMBOLS)), dup))
            chars.append(np.bincount(self.kind, weights=bytes_, minlength=len(self.classes) + 1)[:-1])
        ids, n = np.array(found, np.int64), len(texts)
        doc = np.repeat(np.arange(n), per_text)
        other = len(self.common)
        strip = b".,;:!?\"'()[]{}-" + SYMBOLS
        kinds = np.array([self.common.get(w.strip(strip).decode(errors="replace").lower().encode(), other) for w in numbers], np.int64)
        words = np.zeros((n, other + 1), np.int32)
        if len(ids):
            words = np.bincount(doc * (other + 1) + kinds[ids], minlength=n * (other + 1)).reshape(n, other + 1).astype(np.int32)
        base = np.array(rows, np.int64).reshape(n, 3)
        return {"n_words": np.array(per_text, np.int64), "word_chars": base[:, 0], "n_symbols": base[:, 1], "n_dup_lines": base[:, 2], "n_repeat_words": repeated_words(ids, doc, n), "chars": np.array(chars).reshape(n, len(self.classes)).astype(np.int32), "words": words}


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = _Counter()
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < _AT_ONCE):
                size += len(texts[to])
                to += 1
            got = counter.count(texts[at:to])
            columns = {"doc_id": batch.column("doc_id").slice(at, to - at), "lang": batch.column("lang").slice(at, to - at)}
            for k, v in got.items():
                columns[k] = pa.array([r.tobytes() for r in v], pa.binary()) if v.ndim > 1 else pa.array(v, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)
            at = to


_COUNTS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars binary, words binary"


def counts(docs: DataFrame) -> DataFrame:
    """Base counts and packed histograms of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count_batches, _COUNTS)


def _share(rows: np.ndarray) -> np.ndarray:
    total = rows.sum(axis=-1, keepdims=True)
    return rows / np.maximum(total, 1)


def _packed(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.int32) for x in column.to_pylist()]).astype(float)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = [np.where(x > 0, x * np.log2(x / m), 0).sum(axis=-1) for x in (p, q)]
    return np.sqrt(np.clip((kl[0] + kl[1]) / 2, 0, 1))


@dataclass
class References:
    langs: list[str]
    chars: np.ndarray
    words: np.ndarray


def _histograms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return _share(_packed(batch.column("chars"))), _share(_packed(batch.column("words")))


def _spread(refs: References):
    """(lang, distance) of each document to its own language's reference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                chars, words = _histograms(batch)
                own = [refs.langs.index(x) for x in batch.column("lang").to_pylist()]
                yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "distance": pa.array(js_distance(chars, refs.chars[own]) + js_distance(words, refs.words[own]))})

    return run


def _partial_means(refs: References | None, within: dict[str, float]):
    """Sums of histograms for each language, of all documents or of those within a distance of ``refs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            chars, words = _histograms(batch)
            langs = np.array(batch.column("lang").to_pylist(), object)
            rows = np.concatenate([np.ones((len(langs), 1)), chars, words], axis=1)
            if refs:
                own = [refs.langs.index(x) for x in langs]
                near = js_distance(chars, refs.chars[own]) + js_distance(words, refs.words[own]) <= np.array([within[x] for x in langs])
                langs, rows = langs[near], rows[near]
            for lang in set(langs.tolist()):
                own_sum = rows[langs == lang].sum(axis=0)
                sums[lang] = sums[lang] + own_sum if lang in sums else own_sum
        for lang, row in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(row)), "bin": pa.array(np.arange(len(row))), "total": pa.array(row)})

    return run


def _means(rows: DataFrame, refs: References | None = None, within: dict[str, float] | None = None) -> References:
    got = rows.mapInArrow(_partial_means(refs, within or {}), "lang string, bin long, total double").groupBy("lang", "bin").agg(F.sum("total").alias("total")).collect()
    langs = sorted({r["lang"] for r in got})
    n_chars = len(_byte_classes()[1])
    table = np.zeros((len(langs), 1 + n_chars + len(vocabulary()) + 1))
    for r in got:
        table[langs.index(r["lang"]), r["bin"]] = r["total"]
    table = table[:, 1:] / np.maximum(table[:, :1], 1)
    return References(langs, table[:, :n_chars], table[:, n_chars:])


def references(counted: DataFrame, min_words: int = MIN_WORDS) -> References:
    """Mean histograms for each language over the documents that are long enough, first all of them,
    then the half that is nearest to that mean, so that junk has no part in a reference.

    A row for each language and histogram bin reaches the driver.
    """
    rows = counted.where((F.col("n_words") >= min_words) & F.col("lang").isNotNull()).select("lang", "chars", "words")
    first = _means(rows)
    if not first.langs:
        return first
    spread = rows.mapInArrow(_spread(first), "lang string, distance double").groupBy("lang").agg(F.percentile_approx("distance", 0.5, F.lit(1000)).alias("median")).collect()
    return _means(rows, first, {r["lang"]: r["median"] for r in spread})


def _verdicts(refs: References, min_words: int, max_chars: float, max_words: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            n_words = batch.column("n_words").to_numpy()
            chars, words = np.zeros(n), np.zeros(n)
            near: list[str | None] = [None] * n
            if refs.langs:
                own_chars, own_words = _histograms(batch)
                by_chars, by_words = js_distance(own_chars[:, None], refs.chars[None]), js_distance(own_words[:, None], refs.words[None])
                best = np.argmin(by_chars / max_chars + by_words / max_words, axis=1)
                chars, words = by_chars[np.arange(n), best], by_words[np.arange(n), best]
                near = [refs.langs[k] for k in best]
            failed = (n_words < 10) | (100 * batch.column("n_repeat_words").to_numpy() > 20 * n_words)
            fine = (n_words < min_words) | ((chars <= max_chars) & (words <= max_words))
            out = batch.drop_columns(["lang", "chars", "words"])
            for name, values in (("base_failed", failed), ("kept", ~failed & fine), ("char_distance", chars), ("word_distance", words), ("nearest", pa.array(near, pa.string()))):
                out = out.append_column(name, values if isinstance(values, pa.Array) else pa.array(values))
            yield out

    return run


def quality(docs: DataFrame, min_words: int = MIN_WORDS, max_chars: float = MAX_CHARS, max_words: float = MAX_WORDS) -> DataFrame:
    """Counts and verdict for every row of ``docs``.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, char_distance, word_distance, nearest.
    Null and empty texts have no words and fail the base rule. Documents
    without a language count for no reference but are judged like the others.
    With no reference at all (no long text with a language) only the base rule
    decides. Rows that repeat are judged each; an empty table gives an empty
    result.
    """
    counted = checkpoint(counts(docs))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double, nearest string"
    return counted.mapInArrow(_verdicts(references(counted, min_words), min_words, max_chars, max_words), schema)
