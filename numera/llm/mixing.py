"""Mixing sources to target weights by Sainte-Lague apportionment.

The corpus is measured in words. Sources get targets by weight, none above
three times its own size. The words to take are cut into equal blocks; the
blocks are seats that sources win by the highest quotients target / (2s + 1),
then, inside a source, groups of shards win by size, and inside a group its
shards. A shard lays its documents end to end in an order drawn from the seed
and takes its first blocks, going round again if it has won more than it holds.
Blocks are positions in that stream, so nothing is materialised but four
numbers a document, and no task apportions more than one source's groups or
one group's shards.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from numera.llm.common import WORD, checkpoint, free_name, row_keys

#: Weights of the sources in the order of their names, again and again.
WEIGHTS = (5, 2, 1)
#: No document is taken more often.
MOST_REPEATS = 3
#: Words in a block.
BLOCK_WORDS = 16
#: Documents that a shard has, about.
SHARD_DOCS = 2000
#: Shards of a group.
GROUP_SHARDS = 1000
#: Sources that a mix may have: each has a row on the driver.
MOST_SOURCES = 1_000_000
SEED = 42
#: A quota beyond what any source holds.
ALL = 1 << 60


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2s + 1), ties to the earlier party, at most ``most`` each.

    The seats that a divisor safely gives are handed out at once, so that the
    heap deals with about as many seats as there are parties. All zero votes
    give no seats; if the parties' limits are below ``seats``, all are full.
    """
    n = len(votes)
    most = most or [seats] * n
    total = sum(Fraction(v) for v in votes)
    if seats <= 0 or total <= 0:
        return [0] * n
    safe = seats - Fraction(n, 2)
    won = [0] * n
    if safe > 0:
        divisor = total / safe
        won = [min(m, int(Fraction(v) / divisor + Fraction(1, 2))) for v, m in zip(votes, most)]
    heap = [(-Fraction(v) / (2 * w + 1), i) for i, (v, w, m) in enumerate(zip(votes, won, most)) if v > 0 and w < m]
    heapq.heapify(heap)
    left = seats - sum(won)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        won[i] += 1
        left -= 1
        if won[i] < most[i]:
            heapq.heappush(heap, (-Fraction(votes[i]) / (2 * won[i] + 1), i))
    return won


def targets(sizes: list[int], weights: list[int], most: int = MOST_REPEATS) -> list[float]:
    """Shares of the sum of ``sizes`` by weight; what is above ``most`` times a source's size is
    shared again by weight among the others until none is above."""
    left, free, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] > most * sizes[i] * weight}
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= most * sizes[i]
        free -= over
    return out


def source_quotas(sources: pd.DataFrame, block: int = BLOCK_WORDS) -> pd.DataFrame:
    """target and quota (blocks) for rows (source, source_size); a source that takes all it may gets all its blocks."""
    # code points order as UTF-8 bytes do
    key = sources["source"].map(lambda s: (s is None, (s or "").encode()))
    sources = sources.iloc[np.array(sorted(range(len(sources)), key=lambda i: key.iloc[i]), int)].reset_index(drop=True)
    sizes = [int(x) for x in sources["source_size"]]
    target = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
    full = [t >= MOST_REPEATS * s for t, s in zip(target, sizes)]
    open_words = sum(sizes) - sum(MOST_REPEATS * s for s, f in zip(sizes, full) if f)
    seats = sainte_lague([0.0 if f else t for t, f in zip(target, full)], (2 * open_words + block) // (2 * block))
    return sources.assign(target=target, quota=[ALL if f else s for s, f in zip(seats, full)])


def _quotas(party: str):
    """Seats of the parties of one source, or of one group, from rows (..., ``party``, votes, most, seats)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(party, ignore_index=True)
        most = rows["most"].astype(int).tolist()
        won = sainte_lague(rows["votes"].astype(int).tolist(), min(int(rows["seats"].iloc[0]), sum(most)), most)
        return rows.assign(won=won)[["sid", "grp", *(["shard"] if party == "shard" else []), "won"]]

    return run


def _shard_words(shards: DataFrame, block: int, group_shards: int) -> DataFrame:
    """(sid, shard, shard_size, words) from (sid, shard, quota, shard_size)."""
    most = F.ceil(F.lit(MOST_REPEATS) * F.col("shard_size") / block)
    shards = checkpoint(shards.select("*", F.expr(f"shard div {group_shards}").alias("grp"), most.cast("long").alias("most")))
    groups = shards.groupBy("sid", "grp").agg(F.sum("shard_size").alias("votes"), F.sum("most").alias("most"), F.max("quota").alias("seats"))
    groups = groups.groupBy("sid").applyInPandas(_quotas("grp"), "sid long, grp long, won long").withColumnRenamed("won", "seats")
    parties = shards.withColumnRenamed("shard_size", "votes").drop("quota").join(groups, ["sid", "grp"])
    won = parties.groupBy("sid", "grp").applyInPandas(_quotas("shard"), "sid long, grp long, shard long, won long")
    return shards.join(won, ["sid", "grp", "shard"]).select("sid", "shard", "shard_size", F.least(F.col("won") * block, F.col("shard_size") * MOST_REPEATS).alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, group_shards: int = GROUP_SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, taken, and two row keys.

    taken counts the words that the mix takes, repeats counted; it is 0 for
    texts without a word. A null source is a source of its own, after all
    others. Rows that repeat are rows of their own; which of two equal rows is
    taken more often does not show. An empty table gives an empty result. The
    order inside a shard is that of a hash of seed, id and text, then of a row key, so reruns agree.
    More than ``MOST_SOURCES`` sources are an error.
    """
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("digest"), k1.alias("k1"), k2.alias("k2"))
    sized = checkpoint(sized)
    # a row for each source: the driver's share of the work
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).limit(MOST_SOURCES + 1).collect()
    if len(per_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources = source_quotas(pd.DataFrame([(r["source"], r["source_size"], r["docs"]) for r in per_source], columns=["source", "source_size", "docs"]).astype({"source": object}), block)
    rows = [(i, None if pd.isna(r.source) else r.source, int(r.source_size), float(r.target), int(r.quota), max(1, -(-int(r.docs) // shard_docs))) for i, r in enumerate(sources.itertuples())]
    shares = docs.sparkSession.createDataFrame(rows, "sid long, source string, source_size long, target double, quota long, shards long")
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest")
    turn = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    number = F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}:shard:"), name).cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long")
    dealt = sized.join(F.broadcast(shares), sized["source"].eqNullSafe(shares["source"])).drop(shares["source"]).withColumn("turn", turn).withColumn("shard", F.pmod(number, F.col("shards")))
    quotas = _shard_words(dealt.groupBy("sid", "shard", "quota").agg(F.sum("size").alias("shard_size")), block, group_shards)
    taken = dealt.join(quotas, ["sid", "shard"])
    ring = Window.partitionBy("sid", "shard").orderBy("turn", "k1", "k2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = taken.withColumn("end", F.sum("size").over(ring)).withColumn("rest", F.when(F.col("shard_size") > 0, F.col("words") % F.col("shard_size")).otherwise(0))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0)
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("end") + F.col("size")))
    return taken.withColumn("taken", (rounds * F.col("size") + part).cast("long")).select("doc_id", "size", "source", "source_size", "target", "taken", "k1", "k2")


def copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: each row as many times as its words are taken, whole texts only.

    A document of which a part is taken at the end of a shard's stream counts as
    taken if that is half of it or more. Documents that are not taken go.
    """
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")

    def own(k1: Column, source: Column) -> Column:
        return F.xxhash64(k1, F.coalesce(source.cast("string"), F.lit("\0")))

    # equal rows of a source: the whole copies of all of them, dealt out one by one
    wanted = mix(docs, **options).where("size > 0").withColumn("k1", own(F.col("k1"), F.col("source"))).groupBy("k1", "k2").agg(F.sum("taken").alias("words"), F.max("size").alias("size"), F.count("*").alias("rows"))
    name = {x: free_name(docs, f"__{x}") for x in ("k1", "k2", "rows", "times", "number", "copy")}
    times = wanted.select(F.col("k1").alias(name["k1"]), F.col("k2").alias(name["k2"]), F.col("rows").alias(name["rows"]), F.round(F.col("words") / F.col("size")).cast("long").alias(name["times"])).where(F.col(name["times"]) > 0)
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    keys = [name["k1"], name["k2"]]
    kept = docs.withColumn(keys[0], own(k1, F.col(source_col))).withColumn(keys[1], k2).join(times, keys)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    share = F.floor((F.col(name["times"]) + F.col(name["rows"]) - F.col(name["number"])) / F.col(name["rows"])).cast("int")
    kept = kept.withColumn(name["number"], number).withColumn(name["times"], share).where(F.col(name["times"]) > 0)
    return kept.withColumn(name["copy"], F.explode(F.sequence(F.lit(1), F.col(name["times"])))).select(*docs.columns)


def oracle_sql(block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED, group_shards: int = GROUP_SHARDS) -> str:
    """``mix`` of documents with distinct ids in DuckDB's SQL.

    Sources below three times their size are found in the order of size by
    weight; seats that a divisor gives safely are topped up by the highest
    quotients, for sources, for groups of shards, and for shards.
    """

    def apportioned(name: str, rows: str, key: str, party: str, most: str) -> str:
        own = f"PARTITION BY {key}"
        return f"""
{name}_safe AS (
    SELECT *, least({most}, CASE WHEN seats > 0 AND votes > 0 AND seats - count(*) OVER ({own}) / 2.0 > 0
        THEN floor(votes * (seats - count(*) OVER ({own}) / 2.0) / sum(votes) OVER ({own}) + 0.5) ELSE 0 END)::BIGINT AS won
    FROM {rows}),
{name}_open AS (SELECT *, count(*) OVER ({own}) AS parties, seats - sum(won) OVER ({own}) AS unfilled FROM {name}_safe),
{name}_top AS (
    SELECT {key}, {party}, count(*) AS more FROM (
        SELECT {key}, {party}, unfilled, row_number() OVER ({own} ORDER BY votes / (2 * s + 1) DESC, {party}) AS place
        FROM (SELECT *, unnest(range(won, least({most}, won + parties + 1)::BIGINT)) AS s FROM {name}_open WHERE votes > 0))
    WHERE place <= unfilled GROUP BY {key}, {party}),
{name} AS (SELECT o.*, o.won + coalesce(t.more, 0) AS blocks FROM {name}_open o LEFT JOIN {name}_top t USING ({key}, {party}))"""

    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size, doc_id || ':' || md5(coalesce(text, '')) AS name FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(i % {len(WEIGHTS)} + 1)::INT]::BIGINT AS weight FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s)),
c AS (SELECT *, sum(source_size) OVER () - {MOST_REPEATS} * coalesce(sum(source_size) OVER p, 0) AS words_left, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS weight_left
      FROM w WINDOW p AS (ORDER BY source_size / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, words_left * weight > {MOST_REPEATS} * source_size * weight_left AS is_over FROM c),
t AS (SELECT *, (CASE WHEN is_over THEN {MOST_REPEATS} * source_size
        ELSE (sum(source_size) OVER () - {MOST_REPEATS} * sum(CASE WHEN is_over THEN source_size ELSE 0 END) OVER ()) * weight / sum(CASE WHEN is_over THEN 0 ELSE weight END) OVER () END)::DOUBLE AS target FROM f),
v AS (SELECT 0 AS g, i, source, source_size, docs, target, target >= {MOST_REPEATS} * source_size AS is_full,
        CASE WHEN target >= {MOST_REPEATS} * source_size THEN 0 ELSE target END AS votes,
        ((2 * (sum(source_size) OVER () - {MOST_REPEATS} * sum(CASE WHEN target >= {MOST_REPEATS} * source_size THEN source_size ELSE 0 END) OVER ()) + {block}) // {2 * block})::BIGINT AS seats FROM t),
{apportioned("q", "v", "g", "i", "seats")},
e AS (SELECT d.*, q.i, q.source_size, q.target, q.is_full, q.blocks AS source_blocks,
        ('0x' || substr(md5('{seed}:shard:' || name), 1, 8))::BIGINT % greatest(1, ceil(q.docs / {shard_docs}))::BIGINT AS shard
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
h AS (SELECT i, shard, shard // {group_shards} AS grp, sum(size)::BIGINT AS votes, any_value(is_full) AS full_source, any_value(source_blocks) AS seats, ceil({MOST_REPEATS} * sum(size) / {block})::BIGINT AS most FROM e GROUP BY i, shard),
k AS (SELECT i, grp, sum(votes)::BIGINT AS votes, any_value(seats) AS seats, sum(most)::BIGINT AS most FROM h GROUP BY i, grp),
{apportioned("p", "k", "i", "grp", "most")},
l AS (SELECT h.i * 1000000000 + h.grp AS part, h.i, h.shard, h.votes, h.full_source, h.most, p.blocks AS seats FROM h JOIN p USING (i, grp)),
{apportioned("r", "l", "part", "shard", "most")},
x AS (SELECT i, shard, votes AS shard_size, CASE WHEN full_source THEN {MOST_REPEATS} * votes ELSE least(blocks * {block}, {MOST_REPEATS} * votes) END::BIGINT AS words FROM r),
y AS (SELECT e.*, x.shard_size, x.words, sum(size) OVER (PARTITION BY i, shard ORDER BY md5('{seed}:' || name) ROWS UNBOUNDED PRECEDING) AS upto FROM e JOIN x USING (i, shard))
SELECT doc_id, size, source_size, target,
       CASE WHEN shard_size = 0 THEN 0 ELSE words // shard_size * size + least(size, greatest(0, words % shard_size - upto + size)) END::BIGINT AS taken
FROM y
"""
