"""Exploration planning: rays, visibility, viewpoints and their choice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.operators.voxel import cell, clipped_cell
from aerolith.runtime import by_sort, spread


def raycast(points: DataFrame, scan: list[str], low: tuple[float, float, float] | None, shape: tuple[int, int, int] | None, res: float) -> DataFrame:
    """(*scan, ix, iy, iz): the grid cells that the rays of each scan pass, clipped to the grid.

    Without ``low`` and ``shape`` the grid has no end, and cells are numbered from the zero of space.

    ``points`` has x, y, z and origin columns ox, oy, oz. Endpoints are first reduced to one per
    cell; all rays of a scan share the step count of its longest ray, two steps a cell at least.
    """
    ends = points.groupBy(*scan, *[cell(F.col(a), res).alias(f"__{a}") for a in "xyz"]).agg(F.min_by(F.struct("x", "y", "z", "ox", "oy", "oz"), "pt_id").alias("e")).select(*scan, "e.*")
    length = F.sqrt(sum(((F.col(a) - F.col(f"o{a}")) * (F.col(a) - F.col(f"o{a}")) for a in "yz"), (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox"))))
    steps = ends.groupBy(*scan).agg(F.greatest(F.lit(2), F.ceil(F.max(length) / (res / 2)) + 1).cast("int").alias("__n"))
    rays = by_sort(ends).join(steps, scan).withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    t = F.col("__s") / (F.col("__n") - 1)
    way = {a: F.col(f"o{a}") + (F.col(a) - F.col(f"o{a}")) * t for a in "xyz"}
    if low is None:
        at = [cell(c, res).alias(f"i{a}") for a, c in way.items()]
    else:
        at = [clipped_cell(way[a], lo, res, n).alias(f"i{a}") for a, lo, n in zip("xyz", low, shape)]
    return rays.select(*scan, *at).distinct()


def frustum_pairs(candidates: DataFrame, unknown: DataFrame, reach: float, half_angle: float, group: list[str] | None = None) -> DataFrame:
    """(*group, cid, x, y, z, i, j, k): unknown cells of unit size below each candidate of their group, in its cone and range.

    Both sides are cut into blocks of a third of ``reach``; a candidate is told to those blocks only
    that its cone and range can touch.
    """
    group = group or []
    size = float(math.ceil(reach / 3))
    tan = math.tan(math.radians(half_angle))
    far = math.ceil(reach / size)

    def touched(x: int, y: int, z: int) -> bool:
        flat, high = math.hypot(*(max(0, abs(v) - 1) * size for v in (x, y))), max(0, z - 1) * size
        return math.hypot(flat, high) <= reach and flat <= (z + 1) * size * tan

    blocks = [(x, y, z) for x in range(-far, far + 1) for y in range(-far, far + 1) for z in range(far + 1) if touched(x, y, z)]
    names = ("bx", "by_", "bz")
    u = unknown.select(*group, "i", "j", "k", *[F.floor((F.col(i) + 0.5) / size).alias(n) for i, n in zip("ijk", names)])
    near = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(names, block)]) for block in blocks])
    c = candidates.select(*group, "cid", "x", "y", "z", F.explode(near).alias("__d"))
    c = c.withColumns({n: F.floor(F.col(a) / size) + F.col(f"__d.{n}") for a, n in zip("xyz", names)}).drop("__d")
    d = {"__x": F.col("i") + 0.5 - F.col("x"), "__y": F.col("j") + 0.5 - F.col("y"), "__z": F.col("k") + 0.5 - F.col("z")}
    flat = F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y")
    cone = F.col("__z") * tan
    # Few bytes, many pairs: both sides keep all cores busy.
    p = spread(c, *group, *names).join(spread(u, *group, *names), [*group, *names]).withColumns(d).where((F.col("__z") > 0) & (flat <= cone * cone) & (flat + F.col("__z") * F.col("__z") <= reach * reach))
    return p.select(*group, "cid", "x", "y", "z", "i", "j", "k")


def columnar_gain(pairs: DataFrame, occupied: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(*group, cid, gain): pairs whose column holds no occupied cell from just below the candidate down to the cell.

    The first occupied cell below decides, so each candidate's columns meet theirs by an equi-join.
    """
    group = group or []
    key = [*group, "cid"]
    p = pairs.withColumn("__from", F.floor(F.col("z")) + 1).where(F.col("k") >= F.col("__from"))
    o = occupied.select(*group, "i", "j", F.col("k").alias("__ok"))
    columns = p.select(*key, "i", "j", "__from").distinct()
    first = columns.join(o, [*group, "i", "j"]).where(F.col("__ok") >= F.col("__from")).groupBy(*key, "i", "j").agg(F.min("__ok").alias("__first"))
    clear = p.join(first, [*key, "i", "j"], "left").where(F.col("__first").isNull() | (F.col("k") < F.col("__first")))
    return clear.groupBy(*key).agg(F.count(F.lit(1)).alias("gain"))


def ray_cells(pairs: DataFrame, low: tuple[int, int, int] | None, group: list[str] | None = None) -> DataFrame:
    """Cells between candidate and target, both excluded, by integer steps of the longest axis.

    Grid coordinates count from ``low`` and truncate; without it they count from zero and round down.
    """
    zero = low or (0, 0, 0)
    o = {f"o{i}": F.col(a) - lo for a, i, lo in zip("xyz", "ijk", zero)}
    p = pairs.withColumns(o).withColumns({f"d{i}": (F.col(i) - lo) - F.col(f"o{i}") for i, lo in zip("ijk", zero)})
    n = F.greatest(*[F.abs(F.bround(F.col(f"d{i}"), 0)) for i in "ijk"], F.lit(1.0)).cast("int")
    p = p.withColumn("__n", n).where("__n > 1").withColumn("__s", F.explode(F.sequence(F.lit(1), F.col("__n") - 1)))
    way = {i: F.col(f"o{i}") + F.col(f"d{i}") * (1.0 / F.col("__n")) * F.col("__s") for i in "ijk"}
    at = [((way[i].cast("bigint") if low else F.floor(way[i])) + lo).alias(f"r{i}") for i, lo in zip("ijk", zero)]
    return p.select(*(group or []), "cid", "i", "j", "k", *at)


def ray_gain(pairs: DataFrame, occupied: DataFrame, low: tuple[int, int, int] | None, group: list[str] | None = None) -> DataFrame:
    """(*group, cid, gain): pairs whose ray meets no occupied cell on the way."""
    group = group or []
    o = occupied.select(*group, *[F.col(i).alias(f"r{i}") for i in "ijk"])
    blocked = ray_cells(pairs, low, group).join(o, [*group, "ri", "rj", "rk"], "left_semi").select(*group, "cid", "i", "j", "k").distinct()
    return pairs.join(blocked, [*group, "cid", "i", "j", "k"], "left_anti").groupBy(*group, "cid").agg(F.count(F.lit(1)).alias("gain"))


def score(gain: Column, dist: Column, exponent: float) -> Column:
    """Gain over distance (1 cm at least) to a power."""
    return gain / F.pow(F.greatest(dist, F.lit(0.01)), F.lit(exponent))


def line_samples(ax: Column, bx: Column, t: Column) -> Column:
    return ax + (bx - ax) * t


#: Edge of the tiles of candidates whose surroundings are searched at once; a tile and its reach hold some 30,000 cells.
TILE = 16


def marched_gain(candidates: DataFrame, cells: DataFrame, bounds: DataFrame, reach: float, half_angle: float, group: list[str]) -> DataFrame:
    """(*group, cid, gain): what ``ray_gain`` counts of ``frustum_pairs``, without listing pairs or the cells of their rays.

    ``cells`` (*group, i, j, k, occ) are the known ones; the others within ``bounds`` are unknown. Candidates are
    searched tile by tile against the known cells of their tile and its reach.
    """
    import numpy as np
    import pandas as pd

    r, tan = math.ceil(reach), math.tan(math.radians(half_angle))
    tiles = ["ti", "tj", "tk"]
    c = candidates.join(bounds, group).select("*", *[F.floor(F.col(a) / TILE).cast("bigint").alias(t) for a, t in zip("xyz", tiles)])
    k = cells.select(*group, "i", "j", "k", "occ")
    # Cells from r + 1 before a candidate's to r + 1 beyond it along i and j, and not before it along k.
    for i, t, above in zip("ijk", tiles, (r + 1, r + 1, 1)):
        k = k.withColumn(t, F.explode(F.sequence(F.floor((F.col(i) - r - 1) / TILE).cast("bigint"), F.floor((F.col(i) + above) / TILE).cast("bigint"))))
    steps = np.stack(np.meshgrid(np.arange(-r - 1, r + 2), np.arange(-r - 1, r + 2), np.arange(-1, r + 2), indexing="ij"), -1).reshape(-1, 3)

    def search(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = p[[*group, "cid"]].copy()
        if p.empty:
            return out.assign(gain=pd.Series(dtype="int64"))
        low = np.array([p[t].iat[0] * TILE for t in tiles]) - r - 2
        state = np.zeros([TILE + 2 * r + 5] * 3, "int8")  # 0 not known, 1 free, 2 occupied
        at = q[["i", "j", "k"]].to_numpy("int64") - low
        here = ((at >= 0) & (at < state.shape[0])).all(1)
        state[tuple(at[here].T)] = 1 + q["occ"].to_numpy(bool)[here]
        gains = []
        for x, y, z, *box in p[["x", "y", "z", "i0", "j0", "k0", "i1", "j1", "k1"]].itertuples(index=False):
            o = np.array([x, y, z])
            t = np.floor(o).astype("int64") + steps
            t = t[((t >= np.array(box[:3])) & (t <= np.array(box[3:]))).all(1)]
            v = (t + 0.5) - o
            flat, cone = v[:, 0] * v[:, 0] + v[:, 1] * v[:, 1], v[:, 2] * tan
            t = t[(v[:, 2] > 0) & (flat <= cone * cone) & (flat + v[:, 2] * v[:, 2] <= reach * reach)]
            t = t[state[tuple((t - low).T)] == 0]
            d = t - o
            n = np.maximum(np.abs(np.rint(d)).max(1, initial=1), 1).astype("int64")
            free = np.ones(len(t), bool)
            for s in range(1, int(n.max(initial=1))):
                way = np.floor(o + d * (1.0 / n)[:, None] * np.minimum(s, n)[:, None]).astype("int64") - low
                free &= (state[tuple(way.T)] != 2) | (s >= n)
            gains.append(int(free.sum()))
        return out.assign(gain=np.array(gains, "int64"))

    key = [*group, *tiles]
    kind = ", ".join(f"`{n}` {candidates.schema[n].dataType.simpleString()}" for n in [*group, "cid"])
    got = spread(c, *key).groupBy(*key).cogroup(spread(k, *key).groupBy(*key)).applyInPandas(search, f"{kind}, gain bigint")
    return got.where("gain > 0")
