"""Nearest neighbours and distance joins in space, by cells.

No side is ever compared with all of another: an equi-join on cells finds the candidates, cells grow
for what is still without a neighbour, and points at one place are reduced to one before.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.runtime import by_sort, written

XYZ = ("x", "y", "z")


def _cells(size: float) -> list[Column]:
    return [F.floor(F.col(a) / F.lit(size)).cast("bigint").alias(f"c{a}") for a in XYZ]


def _around(df: DataFrame, reach: int = 1) -> DataFrame:
    """Each row once per cell within ``reach`` cells of its own."""
    steps = F.array(*[F.struct(*[F.lit(d).cast("bigint").alias(f"d{a}") for a, d in zip(XYZ, step)]) for step in product(range(-reach, reach + 1), repeat=3)])
    return df.withColumn("__d", F.explode(steps)).withColumns({f"c{a}": F.col(f"c{a}") + F.col(f"__d.d{a}") for a in XYZ}).drop("__d")


def squared(a: str, b: str) -> Column:
    """Squared distance of columns a_x.. and b_x.."""
    return sum(((F.col(f"{a}_{i}") - F.col(f"{b}_{i}")) * (F.col(f"{a}_{i}") - F.col(f"{b}_{i}")) for i in XYZ[1:]), (F.col(f"{a}_x") - F.col(f"{b}_x")) * (F.col(f"{a}_x") - F.col(f"{b}_x")))


def _corners(df: DataFrame, size: float) -> DataFrame:
    """Each row once per cell of the 2^3 that surround it most closely, with how far it lies from what they leave out (``margin``)."""
    moves = F.array(*[F.struct(*[F.lit(d).cast("bigint").alias(f"m{a}") for a, d in zip(XYZ, step)]) for step in product((0, 1), repeat=3)])
    part = {a: F.col(f"q_{a}") / F.lit(size) - F.floor(F.col(f"q_{a}") / F.lit(size)) for a in XYZ}
    d = df.withColumns({f"h{a}": F.when(part[a] < 0.5, -1).otherwise(1).cast("bigint") for a in XYZ})
    d = d.withColumn("margin", F.least(*[F.greatest(p, 1 - p) for p in part.values()]) * size).withColumn("__d", F.explode(moves))
    at = {f"c{a}": F.floor(F.col(f"q_{a}") / F.lit(size)).cast("bigint") + F.col(f"h{a}") * F.col(f"__d.m{a}") for a in XYZ}
    return d.withColumns(at).drop("__d", *[f"h{a}" for a in XYZ])


def _fitted(targets: DataFrame, group: list[str], cell: float) -> float:
    """The smallest cell of a ladder around ``cell`` whose occupied cells hold two targets on average: one pass with partial counts."""
    sizes = [cell * 2.0**m for m in range(-4, 7)]
    seen = targets.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.struct(*group, *_cells(v)), 0.1).alias(f"d{m}") for m, v in enumerate(sizes)]).first()
    return next((v for m, v in enumerate(sizes) if seen["n"] >= LOAD * seen[f"d{m}"]), sizes[-1])


#: Targets in an occupied cell on average, and in a crowded one.
LOAD = 4
CROWDED = 512


def nearest(queries: DataFrame, targets: DataFrame, group: list[str], query_id: str, target_id: str, cell: float) -> DataFrame:
    """The nearest target of each query within its group: (*group, query_id, target_id, dist).

    Both sides have x, y, z as doubles. Ties go to the smaller target_id. Queries whose group has
    no target have no row, as have rows with a null coordinate, group or id; repeated query rows
    count once per id.

    Exact: the cells around a query hold all targets up to some margin, and a neighbour within it is
    final; the other queries go on in cells twice as large. The first size is fitted to the
    targets' density around ``cell``, the usual distance. Where cells are crowded, as around a
    place that holds a third of all points, their queries begin in smaller cells, as small as it takes.
    """
    t = targets.select(*group, F.col("x"), F.col("y"), F.col("z"), F.col(target_id).alias("__t")).dropna()
    t = t.groupBy(*group, *XYZ).agg(F.min("__t").alias("__t"))
    q = queries.select(*group, F.col("x"), F.col("y"), F.col("z"), F.col(query_id).alias("__q")).dropna()
    q = q.groupBy(*group, "__q").agg(*[F.min_by(a, F.struct(*XYZ)).alias(a) for a in XYZ])
    # Queries at one place ask once.
    places = q.select(*group, *XYZ).distinct().join(t.select(*group).distinct(), group, "left_semi") if group else q.select(*XYZ).distinct()
    t, left = written(t, "nn-targets"), written(places, "nn-places")
    reach = left.unionByName(t.select(*group, *XYZ)).agg(*[F.max(F.abs(a)) for a in XYZ]).first()
    width = max([cell, *[v for v in reach if v is not None]]) * 8
    key = [*group, *[f"c{a}" for a in XYZ]]

    # The levels, from the fitted size down as long as cells are crowded, and the queries that begin at each.
    size = _fitted(t, group, cell)
    begin: list[tuple[float, DataFrame]] = []
    while len(begin) < 24:
        full = t.groupBy(*group, *_cells(size)).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > CROWDED)
        full = written(full.select(*key), "nn-crowded")
        if full.isEmpty():
            break
        mine = left.select("*", *_cells(size))
        begin.append((size, written(mine.join(full, key, "left_anti").select(*group, *XYZ), "nn-begin")))
        left = written(mine.join(full, key, "left_semi").select(*group, *XYZ), "nn-begin")
        size /= 4
    found: DataFrame | None = None
    while True:
        last = size >= width
        near = t.select(*group, "__t", *[F.col(a).alias(f"t_{a}") for a in XYZ], *_cells(size))
        ask = _corners(left.select(*group, *[F.col(a).alias(f"q_{a}") for a in XYZ]), size)
        at = [*group, *[f"q_{a}" for a in XYZ]]
        # The least distance first, a number that hash aggregation can hold; then the targets that lie just so far.
        best = ask.join(by_sort(near), key).groupBy(*at).agg(F.min(squared("q", "t")).alias("__b"), F.first("margin").alias("__m"))
        if not last:
            best = best.where(F.sqrt("__b") <= F.col("__m"))
        ties = _corners(best.drop("__m"), size).join(by_sort(near), key).where(squared("q", "t") == F.col("__b"))
        done = ties.groupBy(*at).agg(F.min("__t").alias("__t"), F.first("__b").alias("__b"))
        done = written(done.select(*group, *[F.col(f"q_{a}").alias(a) for a in XYZ], "__t", F.sqrt("__b").alias("dist")), "nn-level")
        found = done if found is None else found.unionByName(done)
        if last:
            break
        left = left.join(by_sort(done), [*group, *XYZ], "left_anti")
        if begin:
            size, more = begin.pop()
            left = written(left.unionByName(more), "nn-left")
            continue
        left = written(left, "nn-left")
        if left.isEmpty():
            break
        size *= 2
    return q.join(by_sort(found), [*group, *XYZ]).select(*group, F.col("__q").alias(query_id), F.col("__t").alias(target_id), "dist")


def within(a: DataFrame, b: DataFrame, radius: float, group: list[str], a_id: str, b_id: str) -> DataFrame:
    """Pairs no farther apart than ``radius``: (*group, a_id, b_id, d2), by 27 cells of that size."""
    x = a.select(*group, F.col(a_id), *[F.col(i).alias(f"a_{i}") for i in XYZ], *_cells(radius))
    y = _around(b.select(*group, F.col(b_id), *[F.col(i).alias(f"b_{i}") for i in XYZ], *_cells(radius)))
    d2 = squared("a", "b")
    return x.join(by_sort(y), [*group, *[f"c{i}" for i in XYZ]]).where(d2 <= radius * radius).select(*group, a_id, b_id, d2.alias("d2"))


def far_from(points: DataFrame, others: DataFrame, radius: float, group: list[str]) -> DataFrame:
    """Points with no row of ``others`` in their group within ``radius``; all columns and repeated rows stay.

    Points with a null coordinate are near nothing and stay.
    """
    cells = dict(zip((f"__c{a}" for a in XYZ), (F.floor(F.col(a) / F.lit(radius)).cast("bigint") for a in XYZ)))
    p = points.withColumns(cells)
    o = _around(others.select(*group, *[F.col(a).alias(f"__o{a}") for a in XYZ], *_cells(radius)).distinct())
    o = o.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], *[f"__o{a}" for a in XYZ], *[F.col(f"c{a}").alias(f"__k{a}") for a in XYZ])
    on = [F.col(g) == F.col(f"__g{i}") for i, g in enumerate(group)] + [F.col(f"__c{a}") == F.col(f"__k{a}") for a in XYZ]
    d2 = sum(((F.col(a) - F.col(f"__o{a}")) * (F.col(a) - F.col(f"__o{a}")) for a in XYZ), F.lit(0.0))
    return p.join(o, [*on, d2 <= radius * radius], "left_anti").drop(*cells)


def offsets(radius: int, shape: str = "ball") -> list[tuple[int, int, int]]:
    """Steps of a structuring element: a Euclidean ball, a Manhattan ball ("cross") or a cube."""
    r = range(-radius, radius + 1)
    keep = {"ball": lambda d: sum(i * i for i in d) <= radius * radius, "cross": lambda d: sum(map(abs, d)) <= radius, "cube": lambda d: True}[shape]
    return [d for d in product(r, repeat=3) if keep(d)]


def shifted(cells: DataFrame, steps: list[tuple[int, int, int]], names: tuple[str, str, str] = ("i", "j", "k"), group: list[str] | None = None) -> DataFrame:
    """All cells that a step leads to from one of ``cells`` in its group, once each; other columns are dropped."""
    keep = group or []
    moves = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(names, s)]) for s in steps])
    return cells.select(*keep, *names).withColumn("__s", F.explode(moves)).select(*keep, *[(F.col(n) + F.col(f"__s.{n}")).alias(n) for n in names]).distinct()
