"""Voxel grids: cells, packed keys, dedup, downsampling and set algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(c: Column, resolution: float) -> Column:
    """Index of the voxel that holds a coordinate: floor of the product with 1 / resolution."""
    return F.floor(c.cast("double") * F.lit(1.0 / resolution)).cast("bigint")


def explode_points(frames: DataFrame, *keep: str) -> DataFrame:
    """One row per valid point of ``points``: (*keep, pt_id, x, y, z) as doubles.

    Null arrays and null points give no row; points with all coordinates zero are invalid returns.
    """
    p = frames.select(*keep, F.posexplode("points").alias("pt_id", "p")).where(F.col("p").isNotNull())
    p = p.select(*keep, F.col("pt_id").cast("bigint").alias("pt_id"), *[F.col(f"p.{a}").cast("double").alias(a) for a in "xyz"])
    return p.where(valid_point())


def valid_point(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """Any coordinate differs from zero. NaN differs, so such rows pass; nulls do not."""
    return (F.col(x) != 0) | (F.col(y) != 0) | (F.col(z) != 0)


def occupied_per_group(frames: DataFrame, group: str, resolution: float) -> DataFrame:
    """(group, n_frames, n_points, n_voxels). Points are deduplicated per voxel before they are counted by group."""
    pts = explode_points(frames, group, "file_id")
    cells = pts.groupBy(group, *[cell(F.col(a), resolution).alias(i) for a, i in zip("xyz", "ijk")]).agg(F.count(F.lit(1)).alias("n"))
    vox = cells.groupBy(group).agg(F.sum("n").alias("n_points"), F.count(F.lit(1)).alias("n_voxels"))
    n = frames.groupBy(group).agg(F.count(F.lit(1)).alias("n_frames"))
    return n.join(vox, group, "left").select(group, "n_frames", F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce("n_voxels", F.lit(0)).alias("n_voxels"))


_BITS, _MASK, _SIGN = 21, (1 << 21) - 1, 1 << 20


def pack_key(i: Column, j: Column, k: Column) -> Column:
    """Three indices in 21 bits each; an index outside [-2^20, 2^20) wraps."""
    def low(c: Column) -> Column:
        return c.cast("bigint").bitwiseAND(F.lit(_MASK))

    return F.shiftleft(low(i), 2 * _BITS).bitwiseOR(F.shiftleft(low(j), _BITS)).bitwiseOR(low(k))


def unpack_key(key: Column) -> tuple[Column, Column, Column]:
    """The indices of a packed key, with their signs."""
    def signed(shift: int) -> Column:
        v = F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(_MASK))
        return F.when(v >= _SIGN, v - (1 << _BITS)).otherwise(v)

    return signed(2 * _BITS), signed(_BITS), signed(0)


def centre(index: Column, resolution: float) -> Column:
    return index * F.lit(resolution) + F.lit(resolution / 2)


def truncated_cell(c: Column, low: float, resolution: float) -> Column:
    """Planner index, truncated towards zero and not clipped; null where it does not fit an int."""
    return F.try_divide(c - F.lit(low), F.lit(resolution)).cast("double").try_cast("int")


def clipped_cell(c: Column, low: float, resolution: float, n: int) -> Column:
    """Planner index, truncated and clipped to [0, n)."""
    at = (c - F.lit(low)) / F.lit(resolution)
    return F.least(F.lit(float(n - 1)), F.greatest(F.lit(0.0), at)).cast("int")


def grid_world(index: Column, low: float, resolution: float) -> Column:
    return F.lit(low) + (index + 0.5) * F.lit(resolution)


def dense_counts(points: DataFrame, resolution: float, shape: tuple[int, int, int]) -> DataFrame:
    """(ix, iy, iz, n) of a dense grid with the origin in its middle; points outside are dropped."""
    idx = [(F.floor(F.col(a) / resolution).cast("bigint") + n // 2).alias(f"i{a}") for a, n in zip("xyz", shape)]
    inside = [F.col(f"i{a}").between(0, n - 1) for a, n in zip("xyz", shape)]
    return points.select(*idx).where(inside[0] & inside[1] & inside[2]).groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"))


def in_box(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    for c, (lo, hi) in limits.items():
        df = df.where(F.col(c).between(lo, hi))
    return df


def radius_crop(points: DataFrame, group: str, radius: float, least: int) -> DataFrame:
    """Points within ``radius`` of the origin; a group with fewer than ``least`` of them keeps all, as does radius <= 0."""
    from pyspark.sql import Window

    if radius <= 0:
        return points
    near = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") <= radius * radius
    counted = points.withColumn("__near", near).withColumn("__n", F.count_if("__near").over(Window.partitionBy(group)))
    return counted.where(F.col("__near") | (F.col("__n") < least)).drop("__near", "__n")
