"""The reflection group of the 24 short roots of F4, as permutations of those roots.

A finite computation of fixed size (1152 elements): the group is closed on the
driver, its elements become rows for the counts.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Twice the simple roots.
SIMPLE_ROOTS = ((0, 2, -2, 0), (0, 0, 2, -2), (0, 0, 0, 2), (1, -1, -1, -1))


def short_roots() -> np.ndarray:
    """Twice the short roots, in order."""
    units = [tuple(2 * s if k == axis else 0 for k in range(4)) for axis in range(4) for s in (-1, 1)]
    return np.array(sorted(units + list(itertools.product((-1, 1), repeat=4))))


def long_roots() -> np.ndarray:
    """The long roots, one in absolute value at two places."""
    return np.array([v for v in itertools.product((-1, 0, 1), repeat=4) if sum(map(abs, v)) == 2])


def reflection(root: np.ndarray) -> np.ndarray:
    """Twice the matrix of the reflection in a root; halves are all that occur."""
    twice = 2 * np.eye(4) - 4 * np.outer(root, root) / (root @ root)
    return np.rint(twice).astype(int)


def permutation(twice_matrix: np.ndarray, roots: np.ndarray) -> tuple[int, ...]:
    place = {tuple(r): i for i, r in enumerate(roots.tolist())}
    return tuple(place[tuple(v)] for v in (roots @ twice_matrix.T // 2).tolist())


def compose(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(a[k] for k in b)


def closure(generators: list[tuple[int, ...]]) -> set[tuple[int, ...]]:
    """All products of the generators: each round multiplies what the last one found."""
    one = tuple(range(len(generators[0])))
    found, fresh = {one}, {one}
    while fresh:
        fresh = {compose(g, x) for g in fresh for x in generators} - found
        found |= fresh
    return found


def order(p: tuple[int, ...]) -> int:
    one, x, n = tuple(range(len(p))), p, 1
    while x != one:
        x, n = compose(x, p), n + 1
    return n


def power(p: tuple[int, ...], n: int) -> tuple[int, ...]:
    x = tuple(range(len(p)))
    for _ in range(n):
        x = compose(x, p)
    return x


def simple_reflections() -> list[tuple[int, ...]]:
    return [permutation(reflection(np.array(r)), short_roots()) for r in SIMPLE_ROOTS]


def coxeter_element() -> tuple[int, ...]:
    out = tuple(range(24))
    for g in simple_reflections():
        out = compose(out, g)
    return out


def elements(spark: SparkSession) -> DataFrame:
    """(element, order, sixth): the whole group, with each element's sixth power."""
    rows = [(list(p), order(p), list(power(p, 6))) for p in sorted(closure(simple_reflections()))]
    return spark.createDataFrame(rows, "element array<int>, order int, sixth array<int>")


def _product(a, b):
    return F.transform(b, lambda k: F.element_at(a, k + 1))


def centralizers(group: DataFrame, of: DataFrame) -> DataFrame:
    """(element, n, involutions): how many of the group commute with each element of ``of``, and how
    many of them are involutions other than its own sixth power's. Both tables have fixed sizes."""
    e, x = F.col("element"), F.col("other")
    pairs = group.select(F.col("element").alias("other"), F.col("order").alias("other_order")).join(F.broadcast(of.select("element", "sixth")), F.lit(True))
    commuting = pairs.where(_product(x, e) == _product(e, x))
    foreign = (F.col("other_order") == 2) & (x != F.col("sixth"))
    return commuting.groupBy("element").agg(F.count("*").alias("n"), F.sum(foreign.cast("int")).alias("involutions"))


def twisted_generators() -> list[tuple[int, ...]]:
    """Elements of order 4 whose square is the Coxeter element's sixth power, that conjugate it to
    its seventh, and that generate with it a group of 24 with one orbit."""
    c, group = coxeter_element(), closure(simple_reflections())
    c6, c7 = power(c, 6), power(c, 7)
    out = []
    for x in group:
        if order(x) == 4 and compose(x, x) == c6 and compose(compose(x, c), power(x, 3)) == c7:
            own = closure([c, x])
            if len(own) == 24 and len({p[0] for p in own}) == 24:
                out.append(x)
    return out


def duality_frames() -> list[np.ndarray]:
    """Matrices of four orthogonal long roots that map the short roots to long ones."""
    roots = long_roots()
    own = {tuple(r) for r in roots.tolist()}
    signs = np.array(list(itertools.product((-1, 1), repeat=4)))
    out = []

    def extend(columns: list[np.ndarray]) -> None:
        if len(columns) == 4:
            m = np.stack(columns, axis=1)
            images = signs @ m.T
            if not (images % 2).any() and all(tuple(v) in own for v in (images // 2).tolist()):
                out.append(m)
            return
        for r in roots:
            if all(r @ c == 0 for c in columns):
                extend([*columns, r])

    extend([])
    return out


def summary(spark: SparkSession) -> DataFrame:
    """One row with the group's invariants."""
    group = elements(spark)
    c = coxeter_element()
    twelve = group.where("order = 12")
    around = centralizers(group, twelve)
    twice_c = np.rint(np.linalg.multi_dot([reflection(np.array(r)) / 2 for r in SIMPLE_ROOTS]) * 2).astype(int)
    frames = duality_frames()
    orbits, left = 0, set(range(24))
    while left:
        x = min(left)
        while x in left:
            left.remove(x)
            x = c[x]
        orbits += 1
    facts = around.agg(F.count("*").alias("order_twelve_elements"), F.min("n").alias("least_centralizer"), F.max("n").alias("largest_centralizer"), F.sum("involutions").alias("foreign_involutions"))
    return facts.crossJoin(group.agg(F.count("*").alias("group_order"))).select(
        "group_order",
        F.lit(order(c)).cast("long").alias("coxeter_order"),
        F.lit(orbits).cast("long").alias("coxeter_orbits"),
        "order_twelve_elements",
        "least_centralizer",
        "largest_centralizer",
        "foreign_involutions",
        F.lit(len(twisted_generators())).cast("long").alias("twisted_generators"),
        F.lit(len(frames)).cast("long").alias("duality_frames"),
        F.lit(sum(bool((m @ m == twice_c).all()) for m in frames)).cast("long").alias("dual_square_roots"),
    )
