"""A module's queries with their SQL twins, and the views both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.geometry import Quat, Vec, quat, to_world
from aerolith.operators.voxel import explode_points
from aerolith.runtime import table


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f):
            if name in self.queries:
                raise ValueError(f"{name} is taken")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lidar_frame with its pose as px..pz and the unit quaternion qw..qz; a missing pose is the identity at zero."""
    f = table(spark, sf_dir, "lidar_frame")
    q = quat("orientation").unit()
    pos = [F.coalesce(F.col(f"position.{a}"), F.lit(0.0)).alias(f"p{a}") for a in "xyz"]
    return f.select("file_id", "recording", "frame_id", "lidar_ts", "path", "n_bytes", "points", "gps", *pos, *q.named("q"))


FRAMES = """fr0 AS (SELECT *, sqrt(orientation.w * orientation.w + orientation.x * orientation.x + orientation.y * orientation.y + orientation.z * orientation.z) AS qn FROM lidar_frame),
fr AS (SELECT file_id, recording, frame_id, lidar_ts, path, n_bytes, points, gps, coalesce(position.x, 0) AS px, coalesce(position.y, 0) AS py, coalesce(position.z, 0) AS pz,
  CASE WHEN qn > 0 THEN orientation.w / qn ELSE 1 END AS qw, CASE WHEN qn > 0 THEN orientation.x / qn ELSE 0 END AS qx,
  CASE WHEN qn > 0 THEN orientation.y / qn ELSE 0 END AS qy, CASE WHEN qn > 0 THEN orientation.z / qn ELSE 0 END AS qz FROM fr0)"""


def rotated_sql(x: str, y: str, z: str, q: str = "q") -> tuple[str, str, str]:
    """The three coordinates of a point turned by the unit quaternion {q}w..{q}z, written out for the oracle."""
    w, a, b, c = (f"{q}{i}" for i in "wxyz")
    return (
        f"((1 - 2 * ({b} * {b} + {c} * {c})) * {x} + 2 * ({a} * {b} - {w} * {c}) * {y} + 2 * ({a} * {c} + {w} * {b}) * {z})",
        f"(2 * ({a} * {b} + {w} * {c}) * {x} + (1 - 2 * ({a} * {a} + {c} * {c})) * {y} + 2 * ({b} * {c} - {w} * {a}) * {z})",
        f"(2 * ({a} * {c} - {w} * {b}) * {x} + 2 * ({b} * {c} + {w} * {a}) * {y} + (1 - 2 * ({a} * {a} + {b} * {b})) * {z})",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid points of all frames with their frame's pose: (file_id, recording, frame_id, pose, pt_id, x, y, z)."""
    return explode_points(frames(spark, sf_dir), "file_id", "recording", "frame_id", "px", "py", "pz", "qw", "qx", "qy", "qz")


POINTS = FRAMES + """,
pt AS (SELECT file_id, recording, frame_id, px, py, pz, qw, qx, qy, qz, pt_id, CAST(p.x AS DOUBLE) AS x, CAST(p.y AS DOUBLE) AS y, CAST(p.z AS DOUBLE) AS z
  FROM (SELECT *, unnest(points) AS p, generate_subscripts(points, 1) - 1 AS pt_id FROM fr) WHERE p IS NOT NULL AND (p.x <> 0 OR p.y <> 0 OR p.z <> 0))"""


_TURNED = [f"{turned} + p{a} AS {a}" for turned, a in zip(rotated_sql("x", "y", "z"), "xyz")]
WORLD = POINTS.replace("pt AS (", "ps AS (") + f""",
pt AS (SELECT file_id, recording, frame_id, px, py, pz, pt_id, {", ".join(_TURNED)} FROM ps)"""


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``points`` in the world frame of their recording: turned and shifted by the pose of their frame."""
    p = points(spark, sf_dir)
    pose = Quat(*[F.col(f"q{a}") for a in "wxyz"]), Vec(*[F.col(f"p{a}") for a in "xyz"])
    at = to_world(*pose, Vec(F.col("x"), F.col("y"), F.col("z")))
    return p.select("file_id", "recording", "frame_id", "px", "py", "pz", "pt_id", *at.named())


def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the saved maps, one row per map_id and valid point; maps written again count once."""
    m = table(spark, sf_dir, "slam_map").dropDuplicates(["map_id"])
    return explode_points(m, "map_id", "recording")


MAPS = """mp AS (SELECT map_id, recording, pt_id, CAST(p.x AS DOUBLE) AS x, CAST(p.y AS DOUBLE) AS y, CAST(p.z AS DOUBLE) AS z
  FROM (SELECT *, unnest(points) AS p, generate_subscripts(points, 1) - 1 AS pt_id FROM (SELECT DISTINCT ON (map_id) * FROM slam_map)) WHERE p IS NOT NULL AND (p.x <> 0 OR p.y <> 0 OR p.z <> 0))"""


def world_map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``map_points`` in the world frame: stored relative to the centre of their map's bounds. Maps without whole bounds have no place in the world."""
    m = table(spark, sf_dir, "slam_map").dropDuplicates(["map_id"]).where((F.size("bounds") == 6) & F.forall("bounds", lambda b: b.isNotNull() & ~F.isnan(b)))
    m = m.withColumns({f"m{a}": (F.col("bounds")[2 * n] + F.col("bounds")[2 * n + 1]) / 2 for n, a in enumerate("xyz")})
    return explode_points(m, "map_id", "recording", "mx", "my", "mz").select("map_id", "recording", "pt_id", *[(F.col(f"m{a}") + F.col(a)).alias(a) for a in "xyz"])


WORLD_MAPS = """mp AS (SELECT map_id, recording, pt_id, (bounds[1] + bounds[2]) / 2 + CAST(p.x AS DOUBLE) AS x, (bounds[3] + bounds[4]) / 2 + CAST(p.y AS DOUBLE) AS y, (bounds[5] + bounds[6]) / 2 + CAST(p.z AS DOUBLE) AS z
  FROM (SELECT *, unnest(points) AS p, generate_subscripts(points, 1) - 1 AS pt_id FROM (SELECT DISTINCT ON (map_id) * FROM slam_map) WHERE len(bounds) = 6 AND len([b for b in bounds if b IS NULL OR isnan(b)]) = 0) WHERE p IS NOT NULL AND (p.x <> 0 OR p.y <> 0 OR p.z <> 0))"""


def r6(c: Column) -> Column:
    return F.round(c, 6)


__all__ = ["FRAMES", "MAPS", "POINTS", "WORLD", "WORLD_MAPS", "Book", "Quat", "frames", "map_points", "points", "r6", "rotated_sql", "world", "world_map_points"]
