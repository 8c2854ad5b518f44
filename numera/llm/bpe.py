"""BPE encoding and decoding; long text by tree concatenation.

Stretches are what ASCII white space separates. The tokenizer drops white
space, and neither its normaliser, its added tokens nor its pre-tokens reach
across, so stretches are encoded on their own, and one that recurs is looked up.

A text above ``LONG`` bytes is halved, at whatever code point that falls on, until
its pieces are short. The pieces are encoded side by side, and neighbours joined
from the leaves up: a window around the cut is read anew and grows until it has a
stretch with the same tokens in common with the left half and one with the right
half. What lies between these two comes from the window, all else from the halves.

What nothing splits, a pre-token above ``PIECE`` bytes, is halved until its
pieces are short. All pieces are encoded side by side, and neighbours are
joined again from the leaves up: a window around the cut is encoded anew and
grows until it has a token in common with the left half, before the cut, and
one with the right half, behind it. What lies outside comes from the halves,
what lies inside from the window. A sequence of tokens is the encoding of its
text if each two neighbours are the encoding of theirs; halves and window are
encodings, and both sides of a common token are neighbours in one of them, so
the result is the encoding of the unsplit text, which the tests hold against it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a pre-token is encoded in one go.
PIECE = 4096
#: Bytes up to which a text is read in one go.
LONG = 1 << 15
#: Bytes of the first window on each side of a join.
WINDOW = 64
#: Stretches whose tokens are remembered.
REMEMBERED = 150_000
#: Bytes of texts, and texts, that are encoded at a time.
_AT_ONCE = 1 << 20
_MOST_AT_ONCE = 2000
_RESULTS = 2000
#: A word of one pre-token, and perhaps a second one of punctuation.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#$%&()\"-]*)")
_STRETCH = re.compile(rb"[^\x20\x09-\x0D]+")
# The steps before the merges for which a plain word's pre-tokens are known.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


@dataclass
class Encoded:
    """Tokens of a part of a pre-token: where each begins, and its id."""

    start: np.ndarray
    ids: np.ndarray

    def part(self, a: int, b: int) -> Encoded:
        return Encoded(self.start[a:b], self.ids[a:b])

    def __add__(self, other: Encoded) -> Encoded:
        return Encoded(np.concatenate([self.start, other.start]), np.concatenate([self.ids, other.ids]))


class TreeEncoder:
    """Encodes with a tokenizer of the tokenizers library that drops white space, long texts by tree concatenation."""

    def __init__(self, path: str, piece: int = PIECE, window: int = WINDOW, remembered: int = REMEMBERED, long: int = LONG) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the merges alone: what it is given is one pre-token
        self.merges = Tokenizer(self.tokenizer.model)
        self.piece, self.window, self.remembered, self.long = piece, window, remembered, long
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token = [""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.token[i] = token
        self.known: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        steps = json.loads(self.tokenizer.to_str())
        self.plain = all(steps[k] == v for k, v in _STEPS.items())
        suffix = steps["model"].get("end_of_word_suffix") or ""
        self.length = np.array([len(t.removesuffix(suffix)) if suffix else len(t) for t in self.token], np.int64)
        self.added = [t["content"].lower() for t in steps["added_tokens"]]
        # bytes as the letters that stand for them before the merges
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}
        #: Bytes of windows that were encoded at joins, so far, and the joins of texts.
        self.encoded_again = self.joins = 0

    def _pre_token(self, word: str) -> bytes:
        """Ids of one pre-token, given in lower case."""
        ids = self.words.get(word)
        if ids is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            if len(mapped) > self.piece:
                return self._tree(mapped).astype("<u4").tobytes()
            tokens = self.tokenizer.model.tokenize(mapped)
            ids = self.words[word] = np.array([t.id for t in tokens], "<u4").tobytes()
        return ids

    def _long(self, text: str) -> bytes:
        """Ids of a long stretch by its pre-tokens."""
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        out = []
        for word, _ in found:
            # the letters stand for bytes already
            out.append(self._tree(word).astype("<u4").tobytes() if len(word) > self.piece else np.array([t.id for t in self.tokenizer.model.tokenize(word)], "<u4").tobytes())
        return b"".join(out)

    def _learn(self, stretches: Iterable[bytes]) -> None:
        """Remember the tokens of stretches: of plain words by their pre-tokens, of all others as the library encodes them."""
        rest = []
        for s in set(stretches).difference(self.known):
            m = _PLAIN.fullmatch(s.decode()) if self.plain else None
            if m:
                self.known[s] = self._pre_token(m[1].lower()) + (self._pre_token(m[2]) if m[2] else b"")
            elif self.plain and len(s) > self.piece and not any(t in s.decode().lower() for t in self.added):
                self.known[s] = self._long(s.decode())
            else:
                rest.append(s)
        # the library's results are wide, so they are taken in parts
        for at in range(0, len(rest), _RESULTS):
            part = rest[at : at + _RESULTS]
            for s, e in zip(part, self.tokenizer.encode_batch_fast([s.decode() for s in part], add_special_tokens=False)):
                self.known[s] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, as the library encodes it whole."""
        if len(self.known) > self.remembered:
            self.known.clear()
        if len(self.words) > self.remembered:
            self.words.clear()
        whole = [t.encode() for t in texts]
        # the leaves of all long texts, and all short texts, are encoded side by side
        leaves = [_leaves(b, self.long) for b in whole]
        split = [[b[x:y].split() for x, y in zip(own, own[1:])] for b, own in zip(whole, leaves)]
        for k, (b, own) in enumerate(zip(whole, split)):
            if len(own) > 1 and any(len(s) > self.piece for part in own for s in part):
                # what nothing splits is halved by itself
                leaves[k], split[k] = [0, len(b)], [b.split()]
        self._learn(s for own in split for part in own for s in part)
        joined = [own[0] if len(own) == 1 else self._grown(b, at, own) for b, at, own in zip(whole, leaves, split)]
        self._learn(s for own, parts in zip(joined, split) if len(parts) > 1 for s in own)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, own)), "<u4") for own in joined]

    def _grown(self, text: bytes, at: list[int], parts: list[list[bytes]]) -> list[bytes]:
        """The stretches of a text from those of its leaves, neighbours joined level by level."""
        level = list(zip(at, at[1:], parts))
        while len(level) > 1:
            joined = [self._met(text, *level[k], *level[k + 1][1:]) for k in range(0, len(level) - 1, 2)]
            level = joined + level[len(level) // 2 * 2 :]
        return level[0][2]

    def _met(self, text: bytes, a: int, cut: int, left: list[bytes], b: int, right: list[bytes]) -> tuple[int, int, list[bytes]]:
        """Two halves joined at ``cut``: the window grows until each half has a stretch in common with it."""
        width = self.window
        self.joins += 1
        while True:
            lo, hi = _whole_point(text, max(a, cut - width), -1), _whole_point(text, min(b, cut + width), 1)
            window = [m.span() for m in _STRETCH.finditer(text, lo, hi)]
            # what begins where the window does, or ends there, may be cut by it
            mine = [m.span() for m in _STRETCH.finditer(text, lo, cut) if lo == a or m.start() > lo]
            theirs = [m.span() for m in _STRETCH.finditer(text, cut, hi) if hi == b or m.end() < hi]
            before, behind = (set(own).intersection(window) for own in (mine, theirs))
            self.encoded_again += hi - lo
            if (before or lo == a) and (behind or hi == b):
                first, last = max(before, default=(lo - 1, lo - 1)), min(behind, default=(hi, hi))
                keep = len(left) - sum(s > first for s in mine) if before else 0
                skip = sum(s < last for s in theirs) if behind else len(right)
                return a, b, left[:keep] + [text[x:y] for x, y in window if first < (x, y) < last] + right[skip:]
            width *= 2

    def _encoded(self, parts: list[tuple[int, int]], word: str) -> list[Encoded]:
        """Parts of a pre-token, all of them side by side."""
        out = []
        for (a, b), e in zip(parts, self.merges.encode_batch_fast([word[a:b] for a, b in parts], add_special_tokens=False)):
            ids = np.array(e.ids, np.int64)
            ends = a + np.cumsum(self.length[ids])
            if not len(ids) or ends[-1] != b:
                raise ValueError("tokens do not cover their text")
            out.append(Encoded(ends - self.length[ids], ids))
        return out

    def _tree(self, word: str) -> np.ndarray:
        """Ids of a pre-token whose letters stand for bytes: its pieces, joined level by level."""
        bounds = _bounds(len(word), self.piece)
        parts = list(zip(bounds, bounds[1:]))
        level = [(a, b, e) for (a, b), e in zip(parts, self._encoded(parts, word))]
        while len(level) > 1:
            joined = self._join([(*level[k][:2], level[k][2], *level[k + 1]) for k in range(0, len(level) - 1, 2)], word)
            level = joined + level[len(level) // 2 * 2 :]
        return level[0][2].ids

    def _join(self, pairs: list[tuple[int, int, Encoded, int, int, Encoded]], word: str) -> list[tuple[int, int, Encoded]]:
        """All joins of a level; those whose windows have no token in common with a half are tried again with larger ones."""
        done: dict[int, tuple[int, int, Encoded]] = {}
        width, waiting = self.window, list(range(len(pairs)))
        while waiting:
            spans = [(max(pairs[k][0], pairs[k][1] - width), min(pairs[k][4], pairs[k][1] + width)) for k in waiting]
            self.encoded_again += sum(hi - lo for lo, hi in spans)
            for k, (lo, hi), window in zip(waiting, spans, self._encoded(spans, word)):
                a, cut, left, _, b, right = pairs[k]
                before = (0, 0) if lo == a else _common(left, window, lo, cut, last=True)
                # what ends at hi ends there by chance, unless the pre-token's half does
                behind = (len(window.ids), len(right.ids)) if hi == b else _common(window.part(0, len(window.ids) - 1), right, cut, hi, last=False)
                if before and behind:
                    done[k] = a, b, left.part(0, before[0]) + window.part(before[1], behind[0]) + right.part(behind[1], len(right.ids))
            waiting = [k for k in waiting if k not in done]
            width *= 2
        return [done[k] for k in range(len(pairs))]

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode(ids, skip_special_tokens=False) for a tokenizer without a decoder, else the library's own."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.token.__getitem__, ids.tolist()))


def _whole_point(text: bytes, at: int, step: int) -> int:
    """The nearest place from ``at`` on, in the direction of ``step``, that is not inside a code point."""
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at += step
    return at


def _leaves(text: bytes, most: int) -> list[int]:
    """Where the leaves of a text begin and end."""
    return [0, len(text)] if len(text) <= most else sorted({_whole_point(text, at, -1) for at in _bounds(len(text), most)})


def _bounds(length: int, most: int) -> list[int]:
    """Where the leaves of a pre-token begin and end: halves of halves."""
    bounds = [0, length]
    while max(y - x for x, y in zip(bounds, bounds[1:])) > most:
        bounds = sorted({*bounds, *((x + y) // 2 for x, y in zip(bounds, bounds[1:]))})
    return bounds


def _common(first: Encoded, second: Encoded, lo: int, hi: int, last: bool) -> tuple[int, int] | None:
    """Numbers in both of the last or first token that begins in [lo, hi) and is the same in both.

    A half's last token ends where the half does, with the mark of a word's end
    if the tokenizer has one, so it is the same in the other only if nothing is amiss.
    """
    x, y = slice(*np.searchsorted(first.start, [lo, hi])), slice(*np.searchsorted(second.start, [lo, hi]))
    _, i, j = np.intersect1d(first.start[x] << 32 | first.ids[x], second.start[y] << 32 | second.ids[y], assume_unique=True, return_indices=True)
    if not len(i):
        return None
    k = -1 if last else 0
    return x.start + int(i[k]), y.start + int(j[k])


def _encode_batches(path: str, piece: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the pieces of a pre-token, and the stretches of a batch, are encoded in parallel where a task has more than one core
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if TaskContext.get().cpus() > 1 else "false")
        encoder = None
        for batch in batches:
            encoder = encoder or TreeEncoder(path, piece)
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at : at + _MOST_AT_ONCE], dtype=np.int64), _AT_ONCE, "right")))
                ids = encoder.encode([t or "" for t in batch.column("text").slice(at, to - at).to_pylist()])
                columns = [
                    batch.column("doc_id").slice(at, to - at),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                at = to

    return run


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    ``path`` names a tokenizer file that every executor can open; by default
    the public word_bpe_49k.json. A null text counts as empty and has no
    tokens. Rows that repeat are encoded each for itself; an empty table gives
    an empty result; other columns are not looked at.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode_batches(path, piece, with_ids), T.StructType(fields))
