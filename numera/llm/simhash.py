"""Near-duplicates by SimHash fingerprints, linked by pigeonring filtering.

The 64 bits form a ring of five segments. If two fingerprints differ in at
most four bits, there is a segment from which every chain of 1 to 5 consecutive
segments has no more differences than its share of the budget, 4/5 of a bit a
segment rounded down: 0, 1, 2, 3, 4. So fingerprints meet by one segment that
is equal; inside such a group they are probed by the next segment with at most
one bit changed; the chain's further segments prune what is left before the
full Hamming distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numera.llm.common import checkpoint, lookup
from numera.llm.components import connected_components

BITS = 64
MAX_DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Widths of the ring's segments, from the lowest bit up.
WIDTHS = (13, 13, 13, 13, 12)
#: Fingerprints of one group that a task takes; larger groups are split in blocks that meet pairwise.
BLOCK = 400_000
#: Pairs that are compared at a time.
_CHUNK = 1 << 21


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[int]:
    """XXH64 of the space-joined shingles of the lower-cased words; none without a word."""
    words = text.lower().split()
    if not words:
        return iter(())
    joined = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(ends + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > size:
        starts, ends = starts[: -size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist()))


def bit_majority(hashes: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Fingerprints of texts whose hashes follow one another, ``per_text`` of them each."""
    out = np.zeros(len(per_text), np.uint64)
    full = np.flatnonzero(per_text)
    if not len(full):
        return out
    first = np.concatenate([[0], np.cumsum(per_text[full])[:-1]])
    one = np.uint64(1)
    for bit in range(BITS):
        ones = np.add.reduceat(((hashes >> np.uint64(bit)) & one).astype(np.int32), first)
        out[full] |= (2 * ones > per_text[full]).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprints(text_col: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary())
            done: list[np.ndarray] = []
            hashes: list[int] = []
            counts: list[int] = []
            for text in texts:
                raw = text.as_py()
                before = len(hashes)
                if raw:
                    hashes.extend(shingle_hashes(raw, size))
                counts.append(len(hashes) - before)
                if len(hashes) > 1 << 19:
                    done.append(bit_majority(np.array(hashes, np.uint64), np.array(counts)))
                    hashes, counts = [], []
            done.append(bit_majority(np.array(hashes, np.uint64), np.array(counts, np.int64)))
            prints = np.concatenate(done).view(np.int64)
            yield batch.drop_columns([text_col]).append_column("fp", pa.array(prints))

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), a row for each row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints("text", size), "doc_id long, fp long")


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _segments(fps: np.ndarray, start: int) -> list[np.ndarray]:
    """The ring's segments from ``start`` on."""
    low = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])
    own = [(fps >> np.uint64(low[s])) & np.uint64((1 << WIDTHS[s]) - 1) for s in range(len(WIDTHS))]
    return [own[(start + k) % len(WIDTHS)] for k in range(len(WIDTHS))]


def _linked(segs: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs keep to the chain's budgets, the last of which is the full distance."""
    alive, spent = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, seg in enumerate(segs):
        spent = spent + _ones(seg[a[alive]] ^ seg[b[alive]])
        fits = spent <= (k + 1) * MAX_DISTANCE // len(segs)
        alive, spent = alive[fits], spent[fits]
    return alive


def ring_links(fps: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints that are equal in segment ``start``.

    They connect whatever the pairs connect that satisfy the chain from
    ``start``. While the probes meet few candidates, all pairs are checked;
    a dense group is searched breadth first instead, each fingerprint against
    those not reached yet, which stay few, and gives a spanning forest.
    """
    segs = _segments(fps, start)
    order = np.argsort(segs[1], kind="stable")
    fps, segs = fps[order], [s[order] for s in segs]
    probe, n = segs[1], len(fps)
    masks = [0] + [1 << k for k in range(WIDTHS[(start + 1) % len(WIDTHS)])]
    runs = []
    for m in masks:
        target = probe ^ np.uint64(m)
        lo, hi = np.searchsorted(probe, target, "left"), np.searchsorted(probe, target, "right")
        if m:
            lo = np.where(target > probe, lo, hi)
        else:
            lo = np.maximum(lo, np.arange(n) + 1)
        runs.append((lo, np.maximum(hi - lo, 0)))
    if sum(int(c.sum()) for _, c in runs) > 64 * n + 100_000:
        return _search(fps, segs, masks)
    left, right = [fps[:0]], [fps[:0]]
    for lo, count in runs:
        for i, j in _pairs(lo, count):
            ok = _linked(segs, i, j)
            left.append(fps[i[ok]])
            right.append(fps[j[ok]])
    return np.concatenate(left), np.concatenate(right)


def _pairs(lo: np.ndarray, count: np.ndarray, chunk: int = _CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    own = np.flatnonzero(count)
    total = np.cumsum(count[own])
    at = 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chunk, "right")))
        i, c = own[at:to], count[own[at:to]]
        step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(i, c), np.repeat(lo[i], c) + step
        at = to


def _search(fps: np.ndarray, segs: list[np.ndarray], masks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    values, first = np.unique(segs[1], return_index=True)
    waiting = dict(zip(values.tolist(), np.split(np.arange(len(fps)), first[1:])))
    probe, seen = segs[1].tolist(), np.zeros(len(fps), bool)
    left, right = [fps[:0]], [fps[:0]]
    for root in range(len(fps)):
        if seen[root]:
            continue
        seen[root] = True
        stack = [root]
        while stack:
            f = stack.pop()
            for m in masks:
                rest = waiting.get(probe[f] ^ m)
                if rest is None:
                    continue
                rest = rest[~seen[rest]]
                near = _linked(segs, np.full(len(rest), f), rest)
                hit = rest[near]
                seen[hit] = True
                stack += hit.tolist()
                left.append(np.full(len(hit), fps[f]))
                right.append(fps[hit])
                rest = np.delete(rest, near)
                if len(rest):
                    waiting[probe[f] ^ m] = rest
                else:
                    del waiting[probe[f] ^ m]
    return np.concatenate(left), np.concatenate(right)


#: A fingerprint as a node: fingerprints are ordered by their least id (none comes last), so that a component's
#: smallest node has the component's id.
NODE = "struct<no_id boolean, id long, fp long>"


def _link_group(key: tuple, group: pa.Table) -> pa.Table:
    fps, first = np.unique(group.column("fp").to_numpy().view(np.uint64), return_index=True)
    a, b = ring_links(fps, key[0].as_py()) if len(fps) > 1 else (fps[:0], fps[:0])
    ids = group.column("least_id").combine_chunks()

    def nodes(own: np.ndarray) -> pa.StructArray:
        id_of = ids.take(pa.array(first[np.searchsorted(fps, own)], pa.int64()))
        return pa.StructArray.from_arrays([id_of.is_null(), id_of.fill_null(0), pa.array(own.view(np.int64))], ["no_id", "id", "fp"])

    return pa.table({"a": nodes(a), "b": nodes(b)})


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp, least_id) that connect all within four bits; a node is a ``NODE``."""
    low = 0
    keys = []
    for s, width in enumerate(WIDTHS):
        keys.append(F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1).alias("value")))
        low += width
    met = distinct.select("fp", "least_id", F.explode(F.array(*keys)).alias("k")).select("fp", "least_id", "k.seg", "k.value")
    # at most 5 * 8192 groups exist, so the list of those over a block is small at any size
    large = met.groupBy("seg", "value").count().where(F.col("count") > block).select("seg", "value", F.ceil(F.col("count") / block).alias("blocks"))
    dealt = met.join(F.broadcast(large), ["seg", "value"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))
    dealt = dealt.withColumn("other", other).select("fp", "least_id", "seg", "value", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    return dealt.groupBy("seg", "value", "p", "q").applyInArrow(_link_group, f"a {NODE}, b {NODE}")


def near_groups(prints: DataFrame) -> DataFrame:
    """(fp, component_id, n) for each distinct fp of ``prints`` (doc_id, fp): component_id is the smallest
    non-null doc_id of its component (null if there is none), n the number of rows with this fp."""
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    home = connected_components(links(distinct.select("fp", "least_id"))).select("node.fp", F.struct(F.when(~F.col("root.no_id"), F.col("root.id")).alias("id")).alias("found"))
    # both sides have one row a fingerprint
    return distinct.join(home, "fp", "left").select("fp", F.when(F.col("found").isNull(), F.col("least_id")).otherwise(F.col("found.id")).alias("component_id"), "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null, empty and blank texts have fingerprint zero and link like any other.
    Texts of fewer words than a shingle are one shingle. component_id is the
    smallest id within reach; rows that repeat or lack an id belong to their
    group all the same. An empty table gives an empty result; other columns
    are not looked at.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col))
    groups = checkpoint(near_groups(prints))
    return lookup(prints, groups, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
