"""Reachability and connected components over grid cells, in groups of cells that have nothing to do with each other.

Groups of up to SMALL cells, a size that is checked, are searched by one task each; with a larger
one, rounds of joins do it, with the state of each round written to the shared folder so that
lineage stays short.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators.spatial import shifted
from aerolith.runtime import spread, written

SMALL = 200_000
FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
IJK = ["i", "j", "k"]


def _small(cells: DataFrame, limit: int, group: list[str]) -> bool:
    if not group:
        return cells.select(F.lit(1)).limit(limit + 1).count() <= limit
    return (cells.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= limit


def _fields(cells: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {cells.schema[n].dataType.simpleString()}" for n in names)


def _cells(cells: DataFrame, group: list[str], purpose: str) -> DataFrame:
    return written(cells.select(*group, *[F.col(c).cast("bigint").alias(c) for c in IJK]).dropna().distinct(), purpose)


def reachable(cells: DataFrame, start: tuple[int, int, int] | DataFrame, steps: list[tuple[int, int, int]] = FACES, small: int = SMALL, group: list[str] | None = None) -> DataFrame:
    """(*group, i, j, k, depth): the cells that steps lead to from ``start``, with the number of steps.

    ``start`` is one cell, or with groups a table (*group, i, j, k) of one cell for each group. It must
    itself be one of ``cells``, else nothing of its group is reached. Cells with a null are left out.
    """
    group = group or []
    key = [*group, *IJK]
    cells = _cells(cells, group, "reach-cells")
    if isinstance(start, tuple):
        begin = cells.where(" and ".join(f"{c} = {v}" for c, v in zip(IJK, start)))
    else:
        begin = cells.join(start.select(*group, *[F.col(c).cast("bigint").alias(c) for c in IJK]).distinct(), key, "left_semi")
    if _small(cells, small, group):
        marked = cells.join(begin.withColumn("__start", F.lit(True)), key, "left").withColumn("__start", F.coalesce("__start", F.lit(False)))

        def search(p: pd.DataFrame) -> pd.DataFrame:
            at = list(zip(p["i"].tolist(), p["j"].tolist(), p["k"].tolist()))
            queue = deque((*c, 0) for c, s in zip(at, p["__start"].tolist()) if s)
            left = set(at).difference(c[:3] for c in queue)
            out = []
            while queue:
                i, j, k, d = queue.popleft()
                out.append((i, j, k, d))
                for a, b, c in steps:
                    n = (i + a, j + b, k + c)
                    if n in left:
                        left.discard(n)
                        queue.append((*n, d + 1))
            got = pd.DataFrame(out, columns=[*IJK, "depth"]).astype("int64")
            for n, g in enumerate(group):
                got.insert(n, g, p[g].iat[0])
            return got

        return (spread(marked, *group) if group else marked).groupBy(*group).applyInPandas(search, f"{_fields(cells, key)}, depth bigint")
    edge = written(begin.withColumn("depth", F.lit(0).cast("bigint")), "reach-edge")
    seen, depth = edge, 0
    while not edge.isEmpty():
        depth += 1
        new = shifted(edge, steps, group=group).join(cells, key, "left_semi").join(seen.select(*key), key, "left_anti").withColumn("depth", F.lit(depth).cast("bigint"))
        edge = written(new, "reach-edge")
        seen = seen.unionByName(edge)
        if depth % 16 == 0:
            seen = written(seen, "reach-seen")
    return seen


def components(cells: DataFrame, steps: list[tuple[int, int, int]] = FACES, small: int = SMALL, group: list[str] | None = None) -> DataFrame:
    """(*group, i, j, k, cluster): cells that steps connect share the smallest (i, j, k) struct of their cluster. ``steps`` go both ways."""
    group = group or []
    key = [*group, *IJK]
    cells = _cells(cells, group, "cluster-cells")
    kind = "struct<i: bigint, j: bigint, k: bigint>"
    if _small(cells, small, group):

        def search(p: pd.DataFrame) -> pd.DataFrame:
            left = set(zip(p["i"].tolist(), p["j"].tolist(), p["k"].tolist()))
            out = []
            for first in sorted(left):
                if first not in left:
                    continue
                left.discard(first)
                queue = deque([first])
                while queue:
                    i, j, k = queue.popleft()
                    out.append((i, j, k, *first))
                    for a, b, c in steps:
                        n = (i + a, j + b, k + c)
                        if n in left:
                            left.discard(n)
                            queue.append(n)
            got = pd.DataFrame(out, columns=[*IJK, "ci", "cj", "ck"]).astype("int64")
            for n, g in enumerate(group):
                got.insert(n, g, p[g].iat[0])
            return got

        done = (spread(cells, *group) if group else cells).groupBy(*group).applyInPandas(search, f"{_fields(cells, key)}, ci bigint, cj bigint, ck bigint")
        return done.select(*key, F.struct(F.col("ci").alias("i"), F.col("cj").alias("j"), F.col("ck").alias("k")).alias("cluster"))
    moves = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(IJK, s)]) for s in [(0, 0, 0), *steps]])
    labels = written(cells.withColumn("cluster", F.struct(*IJK).cast(kind)), "cluster-labels")
    while True:
        # Spread each label one step, take the least, then jump to the label of the label.
        told = labels.withColumn("__m", F.explode(moves)).select(*group, *[(F.col(c) + F.col(f"__m.{c}")).alias(c) for c in IJK], "cluster")
        least = told.join(cells, key, "left_semi").groupBy(*key).agg(F.min("cluster").alias("cluster"))
        least = written(least, "cluster-least")
        own = least.select(*group, F.struct(*IJK).cast(kind).alias("cluster"), F.col("cluster").alias("__up"))
        new = written(least.join(own, [*group, "cluster"], "left").select(*key, F.least("cluster", F.coalesce("__up", "cluster")).alias("cluster")), "cluster-labels")
        if new.join(labels.withColumnRenamed("cluster", "__old"), key).where(F.col("cluster") != F.col("__old")).isEmpty():
            return new
        labels = new
