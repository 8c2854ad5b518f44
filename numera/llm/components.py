"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numera.llm.common import checkpoint, lookup

#: Rounds double the reach at least, so this many cover any graph.
MAX_ROUNDS = 64


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of any type that has an order).

    root is the smallest node of the component. Alternates large-star and
    small-star steps until every component is a star around its smallest node;
    each round is checkpointed, nothing but counts reaches the driver. A node
    with many edges is no task of its own: its smallest neighbour is sent to
    all. Loops and repeated edges do no harm; edges with a null end are
    ignored; an empty table gives an empty result. Raises if ``MAX_ROUNDS``
    rounds don't do.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    e = checkpoint(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        both, n = _both_ways(e), 2 * e.count()
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = checkpoint(lookup(both, least, ["u"], "n", n).where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        down = lookup(large, low, ["a"], "n", n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpoint(down.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        parents = e.groupBy("a").agg(F.count("*").alias("n"))
        roots = e.select("b").distinct()
        if not parents.join(roots, parents["a"] == roots["b"], "left").where((F.col("n") > 1) | F.col("b").isNotNull()).limit(1).count():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components are not found after {MAX_ROUNDS} rounds")
