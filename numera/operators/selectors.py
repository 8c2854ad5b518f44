"""Packed selector words: 60 numbers of a class in a long."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from numera.functions.integers import class_index, div, lowest_bit

BITS = 60
MASK = (1 << BITS) - 1
#: Periods and bytes of a block by kind.
PERIODS_PER_BLOCK = 240
BYTES_PER_BLOCK = {"implicit_full": 0, "bitmap": 32, "cell24": 40, "bit_packed": 30}
SPARSE_OFFSET_BYTES = 4


def pack(numbers: DataFrame, column: str = "n") -> DataFrame:
    """(class_index, block, selector) of the candidates among a column's longs."""
    n = F.col(column).cast("long")
    rows = numbers.where(n >= 0).select(class_index(n).alias("class_index"), div(n, 10).alias("q")).where("class_index is not null")
    word = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("q", F.lit(BITS)).cast("int"))
    return rows.groupBy("class_index", F.expr(f"q div {BITS}").alias("block")).agg(F.bit_or(word).alias("selector"))


def active(selector: Column) -> Column:
    """The 60 bits of a word that count; what a source has above them is left out."""
    return selector.bitwiseAND(F.lit(MASK).cast("long"))


def bit_is_set(selector: Column, mask_index: Column) -> Column:
    return F.call_function("getbit", selector, mask_index) == 1


def clear_bit(selector: Column, mask_index: Column) -> Column:
    return selector.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), mask_index.cast("int"))))


def digit(class_index: Column) -> Column:
    """The last digit 1, 3, 7 or 9 of a class's numbers."""
    return 1 + 2 * class_index + class_index.bitwiseAND(2)


#: The numbers of the set bits of each six-bit pattern.
CELL_OFFSETS = tuple(tuple(i for i in range(6) if pattern >> i & 1) for pattern in range(64))


def _offsets(selector: Column, mode: str) -> Column:
    """The numbers of a word's set bits, as an array."""
    if mode == "sparse":
        # as many steps as bits are set: each takes the lowest one off
        start = F.struct(F.array().cast("array<int>").alias("found"), selector.alias("left"))
        step = lambda s, _: F.struct(F.array_append(s["found"], lowest_bit(s["left"])).alias("found"), s["left"].bitwiseAND(s["left"] - 1).alias("left"))
        counted = F.sequence(F.lit(1), F.bit_count(selector))
        return F.when(selector == 0, F.array().cast("array<int>")).otherwise(F.aggregate(counted, start, step, lambda s: s["found"]))
    if mode == "dense":
        return F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("getbit", selector, i) == 1)
    if mode == "table":
        table = F.array(*(F.array(*map(F.lit, own)).cast("array<int>") for own in CELL_OFFSETS))

        def looked_up(k: int) -> Column:
            return F.transform(F.element_at(table, (cell(selector, k) + 1).cast("int")), lambda i: i + 6 * k)

        return F.concat(*map(looked_up, range(BITS // 6)))
    raise ValueError(f"mode: {mode}")


def events(words: DataFrame, mode: str = "dense") -> DataFrame:
    """A row for each set bit: mask_index, period and its multiples by 1, 3, 9 and 7.

    mode: dense looks at all 60 places, sparse takes set bits off one by one,
    table looks ten slices of six bits up; the rows are the same.
    """
    rows = words.select("class_index", "block", F.explode(_offsets(active(F.col("selector")), mode)).alias("mask_index"))
    period = (F.col("block") * BITS + F.col("mask_index")) * 10 + digit(F.col("class_index"))
    rows = rows.select("class_index", "block", "mask_index", period.cast("long").alias("period"))
    return rows.select("*", F.array("period", F.col("period") * 3, F.col("period") * 9, F.col("period") * 7).alias("channel_values"))


def scanned(words: DataFrame) -> DataFrame:
    """``events``, each word in the mode that ``scan_mode`` chooses for it."""
    mode = scan_mode(F.bit_count(active(F.col("selector"))), F.lit(BITS))
    return events(words.where(mode == "sparse"), "sparse").unionByName(events(words.where(mode == "dense"), "dense"))


def popcount(words: DataFrame) -> DataFrame:
    """(class_index, words, active_bits)."""
    return words.groupBy("class_index").agg(F.count("*").alias("words"), F.sum(F.bit_count(active(F.col("selector")))).cast("long").alias("active_bits"))


def checksum(rows: DataFrame) -> DataFrame:
    """One row: the sum of all channel values (20 times the periods) modulo 2^64, as decimal(20)."""
    total = F.sum(F.col("period").cast("decimal(38,0)") * 20) % F.lit(str(2**64)).cast("decimal(20,0)")
    return rows.agg(F.coalesce(total, F.lit(0)).cast("decimal(20,0)").alias("checksum"))


def position_sum(selector: Column) -> Column:
    """Sum of the numbers of the set bits: each binary digit of the numbers is counted under a mask of its own, which leaves out what is above the 60 bits."""
    masks = [sum(1 << i for i in range(BITS) if i >> k & 1) for k in range(6)]
    return sum((F.call_function("shiftleft", F.bit_count(selector.bitwiseAND(F.lit(m).cast("long"))), F.lit(k)) for k, m in enumerate(masks)), F.lit(0))


def word_checksum(words: DataFrame) -> DataFrame:
    """``checksum`` of the words' events, from the words alone: nothing is made for a set bit.

    The large sum is kept in halves of 32 bits, so that it stays a long for 2^31 words.
    """
    selector = F.col("selector")
    n = F.bit_count(active(selector))
    in_blocks = F.col("block") * n
    sums = words.agg(
        F.sum(F.shiftright(in_blocks, 32)).alias("high"),
        F.sum(in_blocks.bitwiseAND(F.lit((1 << 32) - 1))).alias("low"),
        F.sum(position_sum(selector) * 10 + digit(F.col("class_index")) * n).alias("rest"),
    )
    wide = {c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)") for c in sums.columns}
    periods = (wide["high"] * F.lit(1 << 32).cast("decimal(10,0)") + wide["low"]) * (10 * BITS) + wide["rest"]
    return sums.select(((periods * 20) % F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)").alias("checksum"))


def kind_counts(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """(kind, n): how many blocks are stored each way."""
    return rows.groupBy(kind).agg(F.count("*").alias("n"))


def cell(selector: Column, i: int) -> Column:
    """The i-th slice of six bits."""
    return F.shiftrightunsigned(selector, 6 * i).bitwiseAND(63)


def storage_bytes(kind: str, blocks: Column, active: Column) -> Column:
    if kind == "sparse":
        return (blocks + 1) * SPARSE_OFFSET_BYTES + active
    return blocks * BYTES_PER_BLOCK[kind]


def storage_choice(blocks: Column, active: Column) -> Column:
    """implicit_full, sparse or bitmap: full blocks need nothing, sparse only if strictly smaller."""
    full = (blocks == 0) | (active == blocks * PERIODS_PER_BLOCK)
    return F.when(full, "implicit_full").when(storage_bytes("sparse", blocks, active) < storage_bytes("bitmap", blocks, active), "sparse").otherwise("bitmap")


def scan_mode(active: Column, slots: Column) -> Column:
    return F.when(active * 2 <= slots, "sparse").otherwise("dense")


def memory_partition(total: int, device: int, staging: int) -> dict[str, int]:
    """Bytes of selectors on host and device, and of the doubled staging buffer."""
    own = min(device, total)
    unit = BYTES_PER_BLOCK["bitmap"]
    parts = {"host": (total - own) * unit, "device": own * unit, "staging": 2 * staging * unit}
    return parts | {"total": sum(parts.values())}


def memory_columns(total: Column, device: Column, staging: Column) -> list[Column]:
    """``memory_partition`` as columns."""
    unit, own = BYTES_PER_BLOCK["bitmap"], F.least(device, total)
    parts = {"host": (total - own) * unit, "device": own * unit, "staging": staging * (2 * unit)}
    return [c.alias(name) for name, c in (parts | {"total": parts["host"] + parts["device"] + parts["staging"]}).items()]


#: Shifts and factor of the generator, and the seed of the published scan figures.
SHIFTS, FACTOR = (12, 25, 27), 0x2545F4914F6CDD1D
SEED = 0x9E3779B97F4A7C15
#: Words that a task draws at a time.
_WORDS = 1 << 14


def _step(state: np.ndarray) -> np.ndarray:
    a, b, c = map(np.uint64, SHIFTS)
    state = state ^ (state >> a)
    state = state ^ (state << b)
    return state ^ (state >> c)


def _applied(columns: np.ndarray, states: np.ndarray) -> np.ndarray:
    """A 64 x 64 bit matrix, given by the images of the single bits, times many states."""
    out = np.zeros(len(states), np.uint64)
    for k, image in enumerate(columns):
        out ^= np.where(states >> np.uint64(k) & np.uint64(1), image, np.uint64(0))
    return out


def _jumps(steps: int, powers: int) -> list[np.ndarray]:
    """Matrices that advance a state by ``steps`` times 1, 2, 4 and so on: a step is linear over bits, so squaring doubles it."""
    matrix, base = np.uint64(1) << np.arange(64, dtype=np.uint64), _step(np.uint64(1) << np.arange(64, dtype=np.uint64))
    while steps:
        if steps & 1:
            matrix = _applied(base, matrix)
        base, steps = _applied(base, base), steps >> 1
    out = [matrix]
    while len(out) < powers:
        out.append(_applied(out[-1], out[-1]))
    return out


def synthetic_words(n: int, density: int, seed: int = SEED, first: int = 0) -> np.ndarray:
    """Test words ``first`` to ``first + n - 1``: bits that are set where a xorshift64* draw modulo 100 is below ``density``.

    Draws are numbered through all words; the state before a word is found by
    jumps, so that words are drawn side by side and parts of a stream apart.
    """
    jumps, states = _jumps(BITS, max(1, (first + n).bit_length())), np.array([seed], np.uint64)
    for k, matrix in enumerate(jumps):
        if first >> k & 1:
            states = _applied(matrix, states)
    for matrix in jumps:
        if len(states) >= n:
            break
        states = np.concatenate([states, _applied(matrix, states)])
    states, out = states[:n], np.zeros(n, np.uint64)
    for bit in range(BITS):
        states = _step(states)
        draw = (states * np.uint64(FACTOR)) & np.uint64(0xFFFFFFFF)
        out |= (draw % np.uint64(100) < np.uint64(density)).astype(np.uint64) << np.uint64(bit)
    return out


def synthetic(spark: SparkSession, n: int, density: int, seed: int = SEED) -> DataFrame:
    """(class_index, block, selector) of n test words, one stream drawn in disjoint parts; class 0, blocks from 0 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("id").to_pylist():
                first, size = part * _WORDS, min(_WORDS, n - part * _WORDS)
                words = synthetic_words(size, density, seed, first).view(np.int64)
                yield pa.RecordBatch.from_pydict({"class_index": np.zeros(size, np.int32), "block": np.arange(first, first + size), "selector": words})

    return spark.range(-(-n // _WORDS)).mapInArrow(run, "class_index int, block long, selector long")
