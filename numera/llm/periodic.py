"""Periodic runs of words in texts, by the runs theorem.

A run is a maximal stretch in which words a smallest period apart are the same,
at least two periods long. The theorem: a Lyndon word that is a period of the run,
under the order of words in which the run's end descends, is the longest Lyndon
word that begins at its place. So the longest Lyndon words under an order and its
reverse, two for each place, are the candidates; each is stretched to both sides
as far as its period holds, and what is two periods long is a run.

The longest Lyndon word at a place ends where the next smaller value of the
inverse suffix array stands. The reverse order needs no array of its own: with the
end of a text as its largest letter it turns all comparisons round, so its words
end at the next larger value. Runs that reach the end of a text descend there under
the first order, hence words that end with the text are no candidates. How far a
period holds is the longest common prefix of two suffixes, and of two reversed
prefixes: a minimum over a range of the LCP array, from a sparse table.

Suffixes of many texts are sorted at once, by doubling, each text for itself; LCP
arrays are made only for texts in which a candidate's neighbourhood repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numera.llm.common import free_name

#: Words that a run has at least.
LEAST = 12
#: Bytes of texts, and texts, that are sorted at a time; a longer text is sorted alone.
_AT_ONCE = 1 << 20
_MOST_AT_ONCE = 4000
#: Values of a block of the sparse table.
_BLOCK = 16

RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])


def suffix_ranks(letters: np.ndarray, text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The rank of each place's suffix among all, texts one after the other; -1 at the end of a text.

    ``letters`` has -1 behind each text, ``text`` the number of the text a place
    belongs to, ``end`` the place behind that text. Each round sorts only what
    the rounds before left in one group.
    """
    rank = np.full(len(letters), -1, np.int64)
    places = np.flatnonzero(letters >= 0)
    if not len(places):
        return rank
    key = text[places] * (int(letters.max()) + 1) + letters[places]
    slots, step = np.arange(len(places)), 0
    while len(places):
        order = np.argsort(key, kind="stable")
        places, key = places[order], key[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        own = slots[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        rank[places] = own
        alone = first & np.concatenate((first[1:], [True]))
        places, slots, own = places[~alone], slots[~alone], own[~alone]
        step = max(1, 2 * step)
        key = own * (len(letters) + 1) + rank[np.minimum(places + step, end[places])] + 1
    return rank


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value; the last value has to be the smallest."""
    own, out = values.tolist(), [len(values)] * len(values)
    for i in range(len(own) - 2, -1, -1):
        v, j = own[i], i + 1
        while own[j] > v:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


class RangeMinimum:
    """Minima of ranges: a sparse table over blocks, and minima from the ends of a block to each of its values."""

    def __init__(self, values: np.ndarray) -> None:
        blocks = np.full((-(-len(values) // _BLOCK), _BLOCK), np.iinfo(np.int64).max, np.int64)
        blocks.ravel()[: len(values)] = values
        self.values = blocks.ravel()
        self.from_left = np.minimum.accumulate(blocks, axis=1).ravel()
        self.from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table, width = [blocks.min(axis=1)], 1
        while 2 * width <= len(blocks):
            self.table.append(np.minimum(self.table[-1][:-width], self.table[-1][width:]))
            width *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least value of each range, both ends included."""
        a, b = lo // _BLOCK, hi // _BLOCK
        out = np.minimum(self.from_right[lo], self.from_left[hi])
        inside = np.flatnonzero(a == b)
        out[inside] = self.values[lo[inside]]
        for k in range(1, _BLOCK):
            out[inside] = np.minimum(out[inside], self.values[np.minimum(lo[inside] + k, hi[inside])])
        between = np.flatnonzero(b - a > 1)
        level = np.log2(b[between] - a[between] - 1).astype(np.int64)
        for k in np.unique(level).tolist():
            at = between[level == k]
            row = self.table[k]
            out[at] = np.minimum(out[at], np.minimum(row[a[at] + 1], row[b[at] - (1 << k)]))
        return out


class CommonPrefix:
    """Lengths of the longest common prefixes of a text's suffixes."""

    def __init__(self, letters: np.ndarray, rank: np.ndarray) -> None:
        self.rank = rank
        order = np.empty(len(rank), np.int64)
        order[rank] = np.arange(len(rank))
        before = np.full(len(rank), -1, np.int64)
        before[order[1:]] = order[:-1]
        own, n, h, lcp = letters.tolist(), len(letters), 0, np.zeros(len(rank), np.int64)
        for i, (j, r) in enumerate(zip(before.tolist(), rank.tolist())):
            if j < 0:
                h = 0
                continue
            most = n - max(i, j)
            while h < most and own[i + h] == own[j + h]:
                h += 1
            lcp[r] = h
            h = max(h - 1, 0)
        self.minimum = RangeMinimum(lcp)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For different places i and j."""
        a, b = self.rank[i], self.rank[j]
        return self.minimum.of(np.minimum(a, b) + 1, np.maximum(a, b))


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts one behind the other with -1 after each: letters, number and end of each place's text, where texts begin."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    letters = np.full(int(sizes.sum()), -1, np.int64)
    for t, b in zip(texts, begins.tolist()):
        letters[b : b + len(t)] = t
    return letters, np.repeat(np.arange(len(texts)), sizes), np.repeat(begins + sizes - 1, sizes), begins


def word_runs(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each text, given by the numbers of its words, its runs as rows (start, length, period), in that order by start and period."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    if not texts:
        return out
    letters, text, end, begins = _laid(texts)
    rank = suffix_ranks(letters, text, end)
    # behind a text a value that ends every word under both orders
    larger = np.where(letters < 0, -len(letters), -rank)
    i = np.concatenate([np.arange(len(letters))] * 2)
    j = np.concatenate([next_smaller(np.append(rank, -2))[:-1], next_smaller(np.append(larger, -len(letters) - 1))[:-1]])
    fine = (letters[i] >= 0) & (j < end[i])
    i, j = i[fine], j[fine]
    # The period holds over its words to the right and left together that a run has beyond one
    # period, and the first root of a run has one of them on its right; half of them are on one side.
    fine = letters[i] == letters[j]
    i, j = i[fine], j[fine]
    sides = []
    for sign in (range(3), range(-1, -4, -1)):
        same = np.ones(len(i), bool)
        for k in sign:
            x, y = letters[np.clip(i + k, 0, len(letters) - 1)], letters[np.clip(j + k, 0, len(letters) - 1)]
            same &= (x == y) & (x >= 0) & (i + k >= 0) & (j + k < len(letters))
        sides.append(same)
    fine = sides[0] | sides[1] if least >= 12 else np.ones(len(i), bool)
    i, j = i[fine], j[fine]
    if not len(i):
        return out
    order = np.argsort(text[i], kind="stable")
    i, j = i[order], j[order]
    asked, first = np.unique(text[i], return_index=True)
    turned = [texts[t][::-1] for t in asked.tolist()]
    back_letters, back_text, back_end, back_begins = _laid(turned)
    back_rank = suffix_ranks(back_letters, back_text, back_end)
    bounds = [*first.tolist(), len(i)]
    ranked = 0
    for k, t in enumerate(asked.tolist()):
        n, b, own = len(texts[t]), int(begins[t]), slice(bounds[k], bounds[k + 1])
        # ranks of a text follow those of the texts before it
        ahead = CommonPrefix(texts[t], rank[b : b + n] - (b - t))
        behind = CommonPrefix(turned[k], back_rank[back_begins[k] : back_begins[k] + n] - ranked)
        ranked += n
        x, y = i[own] - b, j[own] - b
        period = y - x
        left = np.zeros(len(x), np.int64)
        inner = x > 0
        left[inner] = behind.of(n - x[inner], n - y[inner])
        start = x - left
        length = y + ahead.of(x, y) - start
        long = length >= np.maximum(least, 2 * period)
        if long.any():
            out[t] = np.unique(np.stack([start, period, length], axis=1)[long], axis=0)[:, [0, 2, 1]]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """For each of n words, whether no run contains it behind the run's first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:n]) == 0


def _find(names: tuple[str, str], text_col: str, least: int):
    def found(texts: list[bytes | None]) -> tuple[pa.Array, pa.Array]:
        # bytes.split() cuts at the six characters of ASCII white space
        words = [(t or b"").split() for t in texts]
        numbers = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode().indices.to_numpy()
        ends = np.cumsum([len(own) for own in words]).tolist()
        runs = word_runs([numbers[e - len(own) : e] for own, e in zip(words, ends)], least)
        collapsed = [own if not len(r) else [w for w, k in zip(own, kept_words(len(own), r).tolist()) if k] for own, r in zip(words, runs)]
        flat = np.concatenate(runs)
        rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, rows), pa.array([b" ".join(own) for own in collapsed], pa.binary()).cast(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_col)
            sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at : at + _MOST_AT_ONCE], dtype=np.int64), _AT_ONCE, "right")))
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, *found(part.column(text_col).cast(pa.binary()).to_pylist())], [*part.schema.names, *names])
                at = to

    return run


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period) by start and period, and ``collapsed``,
    the words that no run repeats, joined by single spaces.

    Words are what ASCII white space separates, numbered from 0. Names that
    ``docs`` has already get underscores in front. Null, empty and blank texts
    have no word, no run and an empty ``collapsed``; equal rows, and equal
    texts, get equal results, each row its own. A text is worked on whole by
    one task, in about 200 bytes of memory a word; an empty table gives an empty result.
    """
    names = (free_name(docs, "runs"), free_name(docs, "collapsed"))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(RUN, True)), T.StructField(names[1], T.StringType())])
    return docs.mapInArrow(_find(names, text_col, least), schema)


def tiled(text: str, doc_id: str) -> F.Column:
    """The text of a document, in which for one in ten ids by CRC-32 the words behind a place repeat with a period.

    A text that is not tiled, null too, stays as it is; a null id is never tiled.
    """
    h = f"crc32(cast(cast({doc_id} as string) as binary))"
    words = rf"filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    # one struct a step, so that the words are split once
    g = f"({h} div 10)"
    own = f"named_struct('w', {words}, 'g', {g})"
    own = f"transform(array({own}), s -> named_struct('w', s.w, 'n', size(s.w), 'a', s.g % size(s.w), 'g', s.g))[0]"
    own = f"transform(array({own}), s -> named_struct('w', s.w, 'n', s.n, 'a', s.a, 'p', 1 + (s.n - s.a) div (3 + s.g % 8)))[0]"
    repeated = f"transform(array({own}), s -> array_join(transform(sequence(0, s.n - 1), i -> if(i < s.a, s.w[i], s.w[cast(s.a + (i - s.a) % s.p as int)])), ' '))[0]"
    return F.expr(rf"if({h} % 10 = 0 and rlike({text}, '[^\\x20\\x09-\\x0D]'), {repeated}, {text})")


def summary(found: DataFrame, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: the first by start, then
    period; null without one), and digests of all runs and of the collapsed text."""
    by_length = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), by_length.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(collapsed, 256).alias("collapsed_sha256"))
    period = -F.col("b.p")
    exponent = F.expr("b.length * 1000 div -b.p")
    return rows.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
