"""Near-copies for a corpus: word shingles of a similarity of 0.8 or more, by SimHash and pigeonring filtering.

``simhash`` links fingerprints of a few differing bits, by segments that they
share. A Jaccard similarity of 0.8 lets fingerprints differ in about a sixth
of their bits, where shared segments tell nothing any more. So texts meet by
shingles: two sets reach the similarity t only if each has one of the other's
among its first n - ceil(t n) + 1 in one order of all shingles; the order puts
those last that a sample of the corpus has often, so that few texts meet. The
pairs that meet are pruned by their fingerprints: on the ring of eight segments
a chain of consecutive segments has to keep to its share of the budget of 18
bits before the full Hamming distance counts. What is left is compared by its
shingles, so no link is wrong; links whose fingerprints differ in more bits are
lost, about 5 of 10,000. Fingerprints of a few shingles tell little, so pairs
of short texts are compared by their shingles whatever their fingerprints are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numera.llm.common import MOST_BROADCAST, batches_of, checkpoint, row_keys, without
from numera.llm.components import connected_components
from numera.llm.simhash import _pairs, bit_majority, shingle_hashes

SHINGLE = 5
LEAST = 0.8
#: Bits in which the fingerprints of a link differ at most, and segments of the ring.
DISTANCE = 18
SEGMENTS = 8
#: Shingles below which a fingerprint prunes nothing.
FEW = 32
#: Documents by which the order of shingles is chosen, and the most shingles that it names.
ORDER_DOCS = 20_000
ORDER_SHINGLES = 50_000
#: Texts with one shingle that a task takes; more are split in blocks that meet pairwise.
BLOCK = 50_000
#: Texts of a family that a task compares; more are split in blocks that meet pairwise.
MEMBERS = 5000
#: Texts that Python gets at a time.
TEXTS_AT_ONCE = 1000
#: Pairs that are looked at at a time.
_CHUNK = 1 << 17


def needed(share: float, n):
    """The least whole number that is ``share`` of ``n``."""
    return np.ceil(share * n - 1e-9)


def prefix(own: np.ndarray, common: np.ndarray, often: np.ndarray, least: float = LEAST) -> np.ndarray:
    """The shingles of a sorted set of which one must be in any set that reaches ``least`` with it."""
    weight = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        weight = np.where(common[at] == own, often[at], 0)
    return own[np.lexsort((own, weight))][: len(own) - int(needed(least, len(own))) + 1]


def ring_fits(x: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Which differences (XOR of fingerprints) have at most ``distance`` bits, by pigeonring.

    If all of the ring's segments together keep to the budget, there is a
    segment from which each chain of 1, 2, ... segments keeps to its share.
    """
    own = np.bitwise_count(np.ascontiguousarray(x).view(np.uint8).reshape(-1, SEGMENTS)).astype(np.int16)
    alive = np.flatnonzero((own * SEGMENTS <= distance).any(axis=1))
    spent, starts = own[alive], np.ones((len(alive), SEGMENTS), bool)
    for length in range(1, SEGMENTS + 1):
        starts &= spent * SEGMENTS <= length * distance
        fits = starts.any(axis=1)
        alive, spent, starts = alive[fits], spent[fits], starts[fits]
        if length < SEGMENTS:
            spent = spent + np.roll(own[alive], -length, axis=1)
    return alive


def _shingles(text: pa.Scalar, size: int) -> np.ndarray:
    raw = text.as_py()
    return np.fromiter(shingle_hashes(raw, size), np.uint64) if raw else np.zeros(0, np.uint64)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, sorted; none without a word."""
    return np.unique(_shingles(pa.scalar((text or "").encode()), size).view(np.int64))


def _sample(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text").cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_shingles(t, size)).view(np.int64))], ["shingle"])

    return run


def _features(size: int, least: float, common: np.ndarray, often: np.ndarray):
    """For each text the number of its distinct shingles, their fingerprint, and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held, counts, first, sizes = [], [], [], [], []
            for t in batch.column("text").cast(pa.binary()):
                own = np.unique(_shingles(t, size).view(np.int64))
                held.append(own.view(np.uint64))
                counts.append(len(own))
                sizes.append(len(own))
                first.append(prefix(own, common, often, least) if len(own) else own)
                if sum(counts) > 1 << 19:
                    done.append(bit_majority(np.concatenate(held), np.array(counts)))
                    held, counts = [], []
            if held:
                done.append(bit_majority(np.concatenate(held), np.array(counts)))
            prints = np.concatenate([np.zeros(0, np.uint64), *done])
            more = {"n": pa.array(sizes, pa.int32()), "fp": pa.array(prints.view(np.int64)), "prefix": pa.array(first, pa.list_(pa.int64()))}
            batch = batch.drop_columns(["text"])
            for name, column in more.items():
                batch = batch.append_column(name, column)
            yield batch

    return run


def _groups(of):
    """Give ``of`` the rows of a sorted partition group after group: many groups of one shingle and block at a time,
    as arrays and the end of each row's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if held:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            # the last group's rows may go on in the next batch
            new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            whole = int(new[-1]) if len(new) else 0
            if whole:
                yield from of([x[:whole] for x in rows], np.append(new, len(rows[0]))[np.searchsorted(new, np.arange(whole), "right")])
            held = [x[whole:] for x in rows]
        if held and len(held[0]):
            yield from of(held, np.full(len(held[0]), len(held[0])))

    return run


def _met(least: float, distance: int):
    """Edges (a, b) that connect, group by group, what pairs connect that sizes and fingerprints allow: at most one a row."""

    def of(rows: list[np.ndarray], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, _, node, n, fp = rows
        at = np.arange(len(ends))
        label = at.copy()
        for i, j in _pairs(at + 1, ends - at - 1, _CHUNK):
            fits = (label[i] != label[j]) & (node[i] != node[j]) & (np.minimum(n[i], n[j]) >= needed(least, np.maximum(n[i], n[j])))
            i, j = i[fits], j[fits]
            near = np.union1d(ring_fits((fp[i] ^ fp[j]).view(np.uint64), distance), np.flatnonzero(np.minimum(n[i], n[j]) < FEW))
            i, j = i[near], j[near]
            while len(i := i[open_ := label[i] != label[j]]):
                j = j[open_]
                low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                np.minimum.at(label, high, low)
                while (label != label[label]).any():
                    label = label[label]
        own = np.flatnonzero(label != at)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[label[own]])], ["a", "b"])

    return _groups(of)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(_shingles(t, size)) for t in batch.column("text").cast(pa.binary())]
            prints = bit_majority(np.concatenate([np.zeros(0, np.uint64), *own]), np.array([len(x) for x in own], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(prints.view(np.int64)), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "fp", "own"])

    return run


def similar_pairs(sets: list[np.ndarray], fp: np.ndarray, least: float, distance: int) -> Iterator[tuple[int, int]]:
    """Index pairs that connect what all pairs connect that reach ``least`` and have fingerprints within
    ``distance``, or few shingles: a spanning forest. Each set is counted against all others at once."""
    n = np.array([len(x) for x in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    holder, many = np.repeat(np.arange(len(sets)), n)[order], np.bincount(number)
    start, first = np.cumsum(many) - many, np.cumsum(n) - n
    label = np.arange(len(sets))
    for i in range(1, len(sets)):
        own = number[first[i] : first[i] + n[i]]
        count = many[own]
        places = np.arange(count.sum()) + np.repeat(start[own] - np.cumsum(count) + count, count)
        both = np.bincount(holder[places], minlength=len(sets))[:i]
        j = np.flatnonzero((both > 0) & (both >= needed(least, n[i] + n[:i] - both)))
        j = j[(np.minimum(n[i], n[j]) < FEW) | np.isin(np.arange(len(j)), ring_fits(fp[j] ^ fp[i], distance))]
        roots, at = np.unique(label[j], return_index=True)
        yield from ((i, int(j[k])) for k in at)
        if len(roots):
            label[np.isin(label, roots)] = roots[0]
            label[i] = roots[0]


def _compared(least: float, distance: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        node, first = np.unique(group.column("node").to_numpy(), return_index=True)
        fp = group.column("fp").to_numpy()[first].view(np.uint64)
        sets = [np.frombuffer(group.column("own")[int(k)].as_py(), np.uint64) for k in first]
        pairs = list(similar_pairs(sets, fp, least, distance)) if len(node) > 1 else []
        return pa.table({"a": pa.array([node[i] for i, _ in pairs], pa.int64()), "b": pa.array([node[j] for _, j in pairs], pa.int64())})

    return run


def similar_links(rows: DataFrame, features: DataFrame, blocks: DataFrame, size: int = SHINGLE, least: float = LEAST, distance: int = DISTANCE, members: int = MEMBERS) -> DataFrame:
    """Pairs (a, b) of nodes that connect whatever all pairs connect that have a similarity of ``least`` and
    fingerprints within ``distance`` bits, or fewer than ``FEW`` shingles.

    First texts are put into families, by what sizes and fingerprints allow
    among those that meet: no more edges than rows. Then the texts of a family
    are compared by their shingles, each of which is sent once; families of
    more than ``members`` texts in blocks that meet pairwise.
    """
    met = features.select(F.col("k1").alias("node"), "n", "fp", F.explode("prefix").alias("shingle"))
    met = met.join(F.broadcast(blocks), "shingle", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = _dealt(met, "block").select("shingle", "block", "node", "n", "fp").repartition("shingle", "block").sortWithinPartitions("shingle", "block", "node")
    edges = checkpoint(met.mapInArrow(_met(least, distance), "a long, b long").distinct())
    home = checkpoint(connected_components(edges))
    # families above a block are few: each has that many texts
    large = home.groupBy("root").count().where(F.col("count") > members).select("root", F.ceil(F.col("count") / members).alias("blocks"))
    wanted = home.select("node")
    wanted = F.broadcast(wanted) if home.count() <= MOST_BROADCAST else wanted
    with batches_of(rows.sparkSession, TEXTS_AT_ONCE):
        sets = rows.join(wanted, "node", "left_semi").mapInArrow(_sets(size), "node long, fp long, own binary").join(home, "node")
        sets = _dealt(sets.join(F.broadcast(large), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), "block")
        return checkpoint(sets.groupBy("root", "block").applyInArrow(_compared(least, distance), "a long, b long"))


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    """Rows once for each pair of blocks of which one is theirs; ``blocks`` says how many there are, one for most."""
    rows = rows.withColumn("own_block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumn(name, F.least("own_block", "other") * F.col("blocks") + F.greatest("own_block", "other"))


def features_of(docs: DataFrame, id_col: str, text_col: str, size: int, least: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, text) of ``docs``; (doc_id, k1, k2, n, fp, prefix); and the shingles that are split in blocks."""
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).cast("string").alias("text"))
    every = max(1, -(-rows.count() // ORDER_DOCS))
    # at most ORDER_SHINGLES rows reach the driver
    often = rows.where(F.pmod("k1", F.lit(every)) == 0).select("text").mapInArrow(_sample(size), "shingle long").groupBy("shingle").count().where("count >= 4")
    named = often.orderBy(F.desc("count"), "shingle").limit(ORDER_SHINGLES).orderBy("shingle").toArrow()
    common, count = named.column("shingle").to_numpy(), named.column("count").to_numpy()
    schema = "doc_id long, k1 long, k2 long, n int, fp long, prefix array<long>"
    with batches_of(docs.sparkSession, TEXTS_AT_ONCE):
        features = checkpoint(rows.mapInArrow(_features(size, least, common, count), schema))
    # a shingle that is not named is in a few texts of each ORDER_DOCS
    split = [(int(s), math.ceil(c * every / block)) for s, c in zip(common.tolist(), count.tolist()) if c * every > block]
    return rows.select(F.col("k1").alias("node"), "text"), features, docs.sparkSession.createDataFrame(split, "shingle long, blocks long")


def near_survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = LEAST, distance: int = DISTANCE, block: int = BLOCK, members: int = MEMBERS) -> DataFrame:
    """The rows of ``docs``, with all columns, of which one stays for each group that similar pairs connect.

    The row with the smallest id stays (null last, then by row key); of rows
    that are equal in id and text one is left. Words are lower-cased (A-Z) and
    separated by ASCII white space; texts of fewer words than a shingle are one
    shingle; null, empty and blank texts have none and are like no other. An
    empty table gives an empty result. Columns of any name pass through.
    """
    rows, features, blocks = features_of(docs, id_col, text_col, size, least, block)
    home = connected_components(similar_links(rows, features, blocks, size, least, distance, members))
    named = features.select("doc_id", "k1", "k2").distinct()
    rank = F.struct(F.col("doc_id").isNull().alias("null_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("k1").alias("k1"), F.col("k2").alias("k2"))
    member = checkpoint(named.join(home.withColumnRenamed("node", "k1"), "k1").select("root", rank.alias("rank")))
    stay = member.groupBy("root").agg(F.min("rank").alias("rank")).select("rank")
    gone = checkpoint(member.select("rank").join(stay, "rank", "left_anti").select("rank.k1", "rank.k2"))
    repeated = features.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2")
    return without(docs, gone, repeated, row_keys(F.col(id_col), F.col(text_col)))
