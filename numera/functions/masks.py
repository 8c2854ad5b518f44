"""Periodic masks of primes, wheel-840 coordinates and documented worksheet columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from numera.functions.integers import CLASSES, div, hit_position, long_array

# Weight of each class's bit in a mask symbol.
SYMBOL_BITS = {1: 8, 3: 4, 7: 2, 9: 1}
# Multipliers in channel order, and each one's mirror.
MULTIPLIERS = (1, 3, 9, 7)
MIRRORS = {1: 9, 9: 1, 3: 7, 7: 3}
WHEEL_840 = 840


def struck_digits(p: Column, k: Column) -> Column:
    """The classes d for which p divides 10k + d."""
    return F.filter(long_array(CLASSES), lambda d: (k * 10 + d) % p == 0)


def symbol(p: Column, k: Column) -> Column:
    """One hex digit: 15 less the bits of the struck classes."""
    struck = sum((F.when((k * 10 + d) % p == 0, bit).otherwise(0) for d, bit in SYMBOL_BITS.items()), F.lit(0))
    return F.lower(F.hex(F.lit(15) - struck))


def full_mask(p: Column) -> Column:
    """The p symbols of a period."""
    return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), p - 1), lambda k: symbol(p, k)), "")


def cleaned_mask(p: Column) -> Column:
    """The full mask with the position of p itself cleared; null unless p ends in 1, 3, 7 or 9."""
    return F.when(F.pmod(p, F.lit(10)).isin(*CLASSES), F.overlay(full_mask(p), F.lit("f"), (div(p, 10) + 1).cast("int")))


def symbol_order(mask: Column) -> Column:
    """The symbols other than f, in order."""
    return F.replace(mask, F.lit("f"), F.lit(""))


def mask_strings(primes: DataFrame) -> DataFrame:
    """(p, full_mask, cleaned_mask, symbol_order) for rows p."""
    return primes.select("p", full_mask(F.col("p")).alias("full_mask")).select("p", "full_mask", F.when(F.pmod("p", F.lit(10)).isin(*CLASSES), F.overlay("full_mask", F.lit("f"), (div(F.col("p"), 10) + 1).cast("int"))).alias("cleaned_mask"), symbol_order(F.col("full_mask")).alias("symbol_order"))


def mask_positions(primes: DataFrame) -> DataFrame:
    """A row for each p and k of its period: candidates, struck digits, symbol."""
    rows = primes.select("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)).alias("k"))
    candidates = F.transform(long_array(CLASSES), lambda d: F.col("k") * 10 + d)
    return rows.select("p", "k", candidates.alias("candidates"), struck_digits(F.col("p"), F.col("k")).alias("struck_digits"), symbol(F.col("p"), F.col("k")).alias("symbol"))


def hit_positions(primes: DataFrame) -> DataFrame:
    """(p, k1, k3, k7, k9): where p strikes each class. For p coprime to 10."""
    return primes.where("p % 2 <> 0 and p % 5 <> 0").select("p", *(hit_position(F.col("p"), d).alias(f"k{d}") for d in CLASSES))


def worksheet(primes: DataFrame) -> DataFrame:
    """The documented columns: 840 div p, its multiples, remainders of 840 to 4200 and what they lack to p."""
    p = F.col("p")
    quotient = div(F.lit(WHEEL_840).cast("long"), p)
    columns = [quotient.alias("quotient"), (quotient * p).alias("multiple")]
    for k in range(1, 6):
        rest = F.lit(k * WHEEL_840).cast("long") % p
        columns += [rest.alias(f"rest_{k}"), (p - rest).alias(f"lack_{k}")]
    return primes.select("p", *columns)


def mask_events(primes: DataFrame) -> DataFrame:
    """A row for each p and multiplier: value, position, channel, symbol, residues, wheel eligibility."""
    value = F.col("p") * F.col("multiplier")
    rows = primes.select("p", F.explode(long_array(MULTIPLIERS)).alias("multiplier")).withColumn("value", value).withColumn("channel", F.pmod("value", F.lit(10)))
    mark = F.lower(F.hex(F.lit(15) - F.coalesce(*(F.when(F.col("channel") == d, bit) for d, bit in SYMBOL_BITS.items()))))
    eligible = F.expr(" and ".join(f"value % {m} <> 0" for m in (2, 3, 5, 7)))
    residues = [(F.col("value") % m).alias(f"mod_{m}") for m in (8, 3, 5, 7)]
    return rows.where(F.col("channel").isin(*CLASSES)).select("p", "multiplier", "value", div(F.col("value"), 10).alias("position"), "channel", mark.alias("symbol"), *residues, eligible.alias("wheel_eligible"))


def mirror_pairs(events: DataFrame) -> DataFrame:
    """Events joined to those of the mirror multiplier: positions add up to p - 1, channels to 10."""
    left = events.select("p", F.col("multiplier"), F.col("position"), F.col("channel"))
    mirror = F.coalesce(*(F.when(F.col("multiplier") == a, F.lit(b).cast("long")) for a, b in MIRRORS.items()))
    right = events.select(F.col("p"), mirror.alias("multiplier"), F.col("multiplier").alias("mirror"), F.col("position").alias("mirror_position"), F.col("channel").alias("mirror_channel"))
    joined = left.join(right, ["p", "multiplier"])
    holds = (F.col("position") + F.col("mirror_position") == F.col("p") - 1) & (F.col("channel") + F.col("mirror_channel") == 10)
    return joined.select("p", "multiplier", "mirror", "position", "mirror_position", holds.alias("holds"))


def advance(position: Column, multiplier: Column, steps: Column) -> Column:
    """The position ``steps`` masks of the class later; the channel stays."""
    return position + steps * multiplier


def batch_coordinate(mask_index: Column) -> list[Column]:
    """Layers modulo 2 and 3 of a mask index in [0, 6), and the index that they give back."""
    two, three = mask_index % 2, mask_index % 3
    return [two.alias("layer_2"), three.alias("layer_3"), ((two * 3 + three * 4) % 6).alias("back")]


def block_coordinate(mask_index: Column) -> list[Column]:
    """Layers of a mask index in [0, 60), 30g + 6c + m, and the index that they give back."""
    g, c, m = div(mask_index, 30), div(mask_index % 30, 6), mask_index % 6
    return [g.alias("golden_layer"), c.alias("cell_layer"), m.alias("mask_layer"), (g * 30 + c * 6 + m).alias("back")]


def wheel_840_units(spark: SparkSession) -> DataFrame:
    """The residues coprime to 840."""
    return spark.range(WHEEL_840).where("id % 2 <> 0 and id % 3 <> 0 and id % 5 <> 0 and id % 7 <> 0").select(F.col("id").alias("residue"))


def wheel_840_coordinates(units: DataFrame) -> DataFrame:
    """Coordinates of units modulo 840 by the discrete logarithms modulo 8, 3, 5 and 7."""

    def log_of(modulus: int, powers: dict[int, int]) -> Column:
        return F.coalesce(*(F.when(F.col("residue") % modulus == r, F.lit(e)) for r, e in powers.items()))

    # a residue modulo 8 is 7^a 3^b, modulo 7 it is 6^s 2^l, modulo 5 it is 3^c
    of_8 = {(7**a * 3**b) % 8: (a, b) for a in (0, 1) for b in (0, 1)}
    of_7 = {(6**s * 2**x) % 7: (s, x) for s in (0, 1) for x in (0, 1, 2)}
    of_5 = {3**c % 5: c for c in range(4)}
    rows = units.select(
        "residue",
        log_of(8, {r: a for r, (a, _) in of_8.items()}).alias("internal_bit_1"),
        log_of(8, {r: b for r, (_, b) in of_8.items()}).alias("internal_bit_2"),
        F.when(F.col("residue") % 3 == 1, 0).otherwise(1).alias("sign_3"),
        log_of(7, {r: s for r, (s, _) in of_7.items()}).alias("sign_7"),
        log_of(7, {r: x for r, (_, x) in of_7.items()}).alias("layer"),
        log_of(5, of_5).alias("channel_phase"),
    )
    rows = rows.withColumn("external_bit_1", F.expr("internal_bit_1 ^ sign_3")).withColumn("external_bit_2", F.expr("internal_bit_1 ^ sign_7"))
    # the vertex after 0 to 3 rotations from 0; a rotation swaps the two high bits and flips bit 2
    turned = [0]
    for _ in range(3):
        v = turned[-1]
        turned.append((v & 3 | (v & 4) << 1 | (v & 8) >> 1) ^ 4)
    rotated = F.element_at(F.array(*map(F.lit, turned)), F.col("channel_phase") + 1)
    vertex = rotated.bitwiseXOR(F.col("internal_bit_1") * 13).bitwiseXOR(F.col("internal_bit_2") * 14)
    rows = rows.withColumn("tesseract_index", F.expr("4 * layer + 2 * external_bit_1 + external_bit_2")).withColumn("vertex", vertex).withColumn("address", F.expr("16 * tesseract_index + vertex"))
    rows = rows.withColumn("word", F.expr("address div 64").cast("int")).withColumn("bit", F.expr("address % 64"))
    return rows.select("residue", "layer", "external_bit_1", "external_bit_2", "tesseract_index", "channel_phase", "internal_bit_1", "internal_bit_2", "vertex", "address", "word", "bit")


def serialised_coordinates(coordinates: DataFrame) -> DataFrame:
    """(residue, document): coordinates as JSON, bits as zero-padded binary text."""
    text = F.to_json(
        F.struct(
            "residue",
            "layer",
            F.concat(F.col("external_bit_1").cast("string"), F.col("external_bit_2").cast("string")).alias("external_bits"),
            "tesseract_index",
            "channel_phase",
            F.concat(F.col("internal_bit_1").cast("string"), F.col("internal_bit_2").cast("string")).alias("internal_bits"),
            "vertex",
            F.lpad(F.bin("vertex"), 4, "0").alias("vertex_bits"),
            "address",
            "word",
            "bit",
        )
    )
    return coordinates.select("residue", text.alias("document"))


def wheel_840_symmetries(coordinates: DataFrame) -> DataFrame:
    """One row: units, and how many break a symmetry. Times 673 advances the channel phase, turns the
    vertex and stays in the tesseract; times -1 flips the vertex's lowest bit and stays there."""
    own = coordinates.select("residue", "tesseract_index", "channel_phase", "vertex")

    def moved(by: int, prefix: str) -> DataFrame:
        names = {c: f"{prefix}_{c}" for c in ("tesseract_index", "channel_phase", "vertex")}
        images = coordinates.select((F.col("residue") * pow(by, -1, WHEEL_840) % WHEEL_840).alias("residue"), *(F.col(c).alias(n) for c, n in names.items()))
        return images

    rows = own.join(moved(673, "turned"), "residue").join(moved(WHEEL_840 - 1, "mirrored"), "residue")
    turned = F.expr("((vertex & 3) | shiftleft(vertex & 4, 1) | shiftright(vertex & 8, 1)) ^ 4")
    bad_turn = (F.col("turned_tesseract_index") != F.col("tesseract_index")) | (F.col("turned_channel_phase") != (F.col("channel_phase") + 1) % 4) | (F.col("turned_vertex") != turned)
    bad_mirror = (F.col("mirrored_tesseract_index") != F.col("tesseract_index")) | (F.col("mirrored_vertex") != F.col("vertex").bitwiseXOR(F.lit(1)))
    return rows.agg(F.count("*").alias("units"), F.count_if(bad_turn).alias("bad_turns"), F.count_if(bad_mirror).alias("bad_mirrors"))


def sieve_seeds(primes: DataFrame) -> DataFrame:
    """(p, first_composite, block_index, residue, quotient_residue, wheel_phase) for primes from 11 on:
    where striking begins, and the place of p among the wheel's units."""
    p = F.col("p")
    phase = F.array_position(long_array(coprime_units(WHEEL_840)), p % WHEEL_840) - 1
    return primes.where(p >= 11).select("p", (p * p).alias("first_composite"), div(p * p, WHEEL_840).alias("block_index"), (p * p % WHEEL_840).alias("residue"), (p % WHEEL_840).alias("quotient_residue"), phase.alias("wheel_phase"))


_SHEET_COLUMNS = ("cleaned_mask", "full_mask", "symbol_order")


def mask_mismatches(sheet: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(row_number, prime, kind, differing): where a mask sheet (row_number, prime and three masks) is not what its primes give.

    kind: differs, with the names of the columns that do; repeated, a prime's
    rows beyond its first; and with ``expected`` (p) also missing, an expected
    prime without a row, and unexpected, a row whose prime is not expected. No
    row means that sheet and primes are equal both ways.
    """
    own = mask_strings(sheet.select(F.col("prime").alias("p")).distinct()).select(F.col("p").alias("prime"), *(F.col(c).alias(f"own_{c}") for c in _SHEET_COLUMNS))
    wrong = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"own_{c}")), F.lit(c)) for c in _SHEET_COLUMNS)))
    rows = sheet.join(own, "prime", "left").select("row_number", "prime", F.lit("differs").alias("kind"), wrong.alias("differing")).where(F.size("differing") > 0)

    def told(found: DataFrame, kind: str) -> DataFrame:
        return found.select("row_number", "prime", F.lit(kind).alias("kind"), F.array().cast("array<string>").alias("differing"))

    first = sheet.groupBy("prime").agg(F.min("row_number").alias("first"))
    rows = rows.unionByName(told(sheet.join(first, "prime").where(F.col("row_number") > F.col("first")), "repeated"))
    if expected is not None:
        primes = expected.select(F.col("p").alias("prime")).distinct()
        absent = primes.join(sheet, "prime", "left_anti").select(F.lit(None).cast("int").alias("row_number"), "prime")
        rows = rows.unionByName(told(absent, "missing")).unionByName(told(sheet.join(primes, "prime", "left_anti"), "unexpected"))
    return rows


def first_mismatches(mismatches: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` mismatches by row, missing primes last, and in each row how many there are in all."""
    first = mismatches.orderBy(F.col("row_number").asc_nulls_last(), "prime", "kind").limit(most)
    return first.crossJoin(F.broadcast(mismatches.agg(F.count("*").alias("total"))))


def research_documents(primes: DataFrame) -> DataFrame:
    """(p, document): masks, events and sieve seed of each prime as JSON."""
    events = mask_events(primes).groupBy("p").agg(F.array_sort(F.collect_list(F.struct("multiplier", "value", "position", "channel", "symbol", "wheel_eligible"))).alias("events"))
    rows = mask_strings(primes).join(events, "p").join(sieve_seeds(primes).withColumnRenamed("residue", "seed_residue"), "p", "left")
    seed = F.struct("first_composite", "block_index", F.col("seed_residue").alias("residue"), "quotient_residue", "wheel_phase")
    return rows.select("p", F.to_json(F.struct(F.col("p").alias("prime"), "full_mask", "cleaned_mask", "symbol_order", "events", seed.alias("sieve_seed"))).alias("document"))


def coprime_units(modulus: int) -> list[int]:
    return [r for r in range(modulus) if math.gcd(r, modulus) == 1]
