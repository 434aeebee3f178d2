"""Rigid-body geometry as closed-form column expressions.

Quaternions are (w, x, y, z). Every function takes columns and gives columns that stay in
whole-stage codegen; none needs a Python worker. Results are null where an argument is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Vec:
    """Three columns."""

    x: Column
    y: Column
    z: Column

    def __add__(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def times(self, c: Column) -> Vec:
        return Vec(self.x * c, self.y * c, self.z * c)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def named(self, a: str = "x", b: str = "y", c: str = "z", digits: int | None = None) -> list[Column]:
        cols = (self.x, self.y, self.z)
        return [(F.round(v, digits) if digits is not None else v).alias(n) for v, n in zip(cols, (a, b, c))]


@dataclass(frozen=True)
class Quat:
    """Four columns of a quaternion."""

    w: Column
    x: Column
    y: Column
    z: Column

    def norm(self) -> Column:
        return F.sqrt(self.w * self.w + self.x * self.x + self.y * self.y + self.z * self.z)

    def unit(self) -> Quat:
        """Normalised; a null, partly null or zero quaternion becomes the identity."""
        n = self.norm()
        good = n > 0

        def part(c: Column, otherwise: float) -> Column:
            return F.when(good, c / n).otherwise(F.lit(otherwise))

        return Quat(part(self.w, 1.0), part(self.x, 0.0), part(self.y, 0.0), part(self.z, 0.0))

    def inverse(self) -> Quat:
        """Of a unit quaternion."""
        return Quat(self.w, -self.x, -self.y, -self.z)

    def __mul__(self, o: Quat) -> Quat:
        return Quat(
            self.w * o.w - self.x * o.x - self.y * o.y - self.z * o.z,
            self.w * o.x + self.x * o.w + self.y * o.z - self.z * o.y,
            self.w * o.y - self.x * o.z + self.y * o.w + self.z * o.x,
            self.w * o.z + self.x * o.y - self.y * o.x + self.z * o.w,
        )

    def named(self, prefix: str = "q", digits: int | None = None) -> list[Column]:
        return [(F.round(v, digits) if digits is not None else v).alias(prefix + n) for v, n in zip((self.w, self.x, self.y, self.z), "wxyz")]


def vec(name: str) -> Vec:
    """The members of a struct column, or of columns name+x, name+y, name+z if it ends with ``_``."""
    return Vec(*[F.col(f"{name[:-1]}{a}" if name.endswith("_") else f"{name}.{a}") for a in "xyz"])


def quat(name: str) -> Quat:
    return Quat(*[F.col(f"{name[:-1]}{a}" if name.endswith("_") else f"{name}.{a}") for a in "wxyz"])


def matrix(q: Quat) -> list[Column]:
    """Rotation matrix of a unit quaternion, row by row."""
    w, x, y, z = q.w, q.x, q.y, q.z
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def rotate(q: Quat, v: Vec) -> Vec:
    m = matrix(q)
    return Vec(*[m[3 * i] * v.x + m[3 * i + 1] * v.y + m[3 * i + 2] * v.z for i in range(3)])


def to_world(q: Quat, t: Vec, v: Vec) -> Vec:
    """Rotate by the pose's orientation, then shift by its position."""
    return rotate(q, v) + t


def to_body(q: Quat, t: Vec, v: Vec) -> Vec:
    """The inverse of to_world for a unit quaternion."""
    return rotate(q.inverse(), v - t)


def apply_matrix(m: list[Column] | list[float], v: Vec) -> Vec:
    """The upper three rows of a 4x4 matrix, row by row (12 numbers), on a point."""
    c = [F.lit(e) if isinstance(e, (int, float)) else e for e in m]
    return Vec(*[c[4 * i] * v.x + c[4 * i + 1] * v.y + c[4 * i + 2] * v.z + c[4 * i + 3] for i in range(3)])


def between(qa: Quat, ta: Vec, qb: Quat, tb: Vec) -> tuple[Quat, Vec]:
    """Pose b as seen from pose a: inverse(a) * b."""
    return qa.inverse() * qb, to_body(qa, ta, tb)


def part_between(t: Column, before: Column, after: Column) -> Column:
    """Where ``t`` lies between two times, clipped to [0, 1]; 0 if they do not differ."""
    dt = (after - before).cast("double")
    return F.when(dt > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - before).cast("double") / dt))).otherwise(F.lit(0.0))


def lerp(a: Vec, b: Vec, part: Column) -> Vec:
    return a + (b - a).times(part)


def slerp(df: DataFrame, a: str, b: str, part: Column, out: str = "q") -> DataFrame:
    """Adds {out}w..{out}z: along the shorter arc from quaternion {a}w..{a}z to {b}w..{b}z.

    Both are normalised first; nearly equal ones go by the straight line, renormalised. The steps
    are columns of their own, so no expression is repeated inside another.
    """
    qa, qb = (Quat(*[F.col(f"{n}{i}") for i in "wxyz"]).unit() for n in (a, b))
    d = df.withColumns({"__t": part} | {f"__a{i}": getattr(qa, i) for i in "wxyz"} | {f"__b{i}": getattr(qb, i) for i in "wxyz"})
    d = d.withColumn("__dot", sum((F.col(f"__a{i}") * F.col(f"__b{i}") for i in "xyz"), F.col("__aw") * F.col("__bw")))
    d = d.withColumns({"__ang": F.acos(F.least(F.lit(1.0), F.abs("__dot"))), "__near": F.abs("__dot") > 0.9999999})
    t, ang, near = F.col("__t"), F.col("__ang"), F.col("__near")
    ka = F.when(near, 1 - t).otherwise(F.sin((1 - t) * ang) / F.sin(ang))
    kb = F.when(near, t).otherwise(F.sin(t * ang) / F.sin(ang)) * F.when(F.col("__dot") < 0, -1.0).otherwise(1.0)
    d = d.withColumns({"__ka": ka, "__kb": kb})
    d = d.withColumns({f"__s{i}": F.col(f"__a{i}") * F.col("__ka") + F.col(f"__b{i}") * F.col("__kb") for i in "wxyz"})
    whole = Quat(*[F.col(f"__s{i}") for i in "wxyz"]).unit()
    d = d.withColumns({f"{out}{i}": getattr(whole, i) for i in "wxyz"})
    return d.drop("__t", "__dot", "__ang", "__near", "__ka", "__kb", *[f"__{n}{i}" for n in "abs" for i in "wxyz"])


def from_rotation_vector(v: Vec) -> Quat:
    """Unit quaternion of a rotation vector (axis times radians)."""
    n = v.norm()
    k = F.when(n > 1e-12, F.sin(n / 2) / n).otherwise(F.lit(0.5))
    return Quat(F.cos(n / 2), v.x * k, v.y * k, v.z * k).unit()


def back_projected(q: Quat, p: Vec, velocity: Vec, angular: Vec, dt_s: Column) -> tuple[Quat, Vec]:
    """The pose ``dt_s`` seconds earlier by constant velocity; within 1 ms it is left as it is."""
    moved = F.abs(dt_s) > 0.001
    turn = from_rotation_vector(angular.times(-dt_s)) * q

    def pick(new: Column, old: Column) -> Column:
        return F.when(moved, new).otherwise(old)

    at = p - velocity.times(dt_s)
    return (
        Quat(pick(turn.w, q.w), pick(turn.x, q.x), pick(turn.y, q.y), pick(turn.z, q.z)),
        Vec(pick(at.x, p.x), pick(at.y, p.y), pick(at.z, p.z)),
    )


def yaw_deg(q: Quat) -> Column:
    return F.degrees(F.atan2(2 * (q.w * q.z + q.x * q.y), 1 - 2 * (q.y * q.y + q.z * q.z)))


def pitch_deg(q: Quat) -> Column:
    return F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 2 * (q.w * q.y - q.z * q.x)))))


def roll_deg(q: Quat) -> Column:
    return F.degrees(F.atan2(2 * (q.w * q.x + q.y * q.z), 1 - 2 * (q.x * q.x + q.y * q.y)))


def euler_norm_deg(q: Quat) -> Column:
    """Length of the extrinsic x, y, z angles: roll, pitch and yaw of the same rotation."""
    r, p, y = roll_deg(q), pitch_deg(q), yaw_deg(q)
    return F.sqrt(r * r + p * p + y * y)


def angle_deg(m: list[Column]) -> Column:
    """Rotation angle from the trace, the cosine clipped to [-1, 1]."""
    c = (m[0] + m[4] + m[8] - 1) / 2
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))))


def wrap_deg(d: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(d + 180.0, F.lit(360.0)) - 180.0


#: Fixed value: metres per degree and the earth radius used for flat-earth positions.
EARTH_RADIUS_M = 6378137.0


def gps_to_ned(lat: Column, lon: Column, alt: Column, home_lat: Column, home_lon: Column, home_alt: Column) -> Vec:
    """Flat earth around home, with the cosine of home's latitude; down is positive."""
    return Vec(
        F.radians(lat - home_lat) * EARTH_RADIUS_M,
        F.radians(lon - home_lon) * EARTH_RADIUS_M * F.cos(F.radians(home_lat)),
        home_alt - alt,
    )


def latlon_to_enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> Vec:
    """East, north, up by an equirectangular plane, with the cosine of the mean latitude."""
    mean = F.radians((lat + lat0) / 2)
    return Vec(F.radians(lon - lon0) * F.cos(mean) * EARTH_RADIUS_M, F.radians(lat - lat0) * EARTH_RADIUS_M, alt - alt0)


def closest_on_segment(p: Vec, a: Vec, b: Vec) -> tuple[Vec, Column]:
    """Closest point of segment a-b to p and its part in [0, 1]; a degenerate segment gives (a, 0)."""
    ab = b - a
    n2 = ab.dot(ab)
    t = F.when(n2 > 1e-24, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (p - a).dot(ab) / n2))).otherwise(F.lit(0.0))
    return a + ab.times(t), t


def icp_sigma(rmse: Column, scale: float = 1.0) -> Column:
    """Position noise of a registration: the larger of max(0.05, r / 2) and max(0.1, 1.5 r), scaled."""
    return F.greatest(F.greatest(F.lit(0.05), rmse * 0.5), F.greatest(F.lit(0.1), rmse * 1.5)) * scale


def two_sided_z(confidence: float) -> float:
    """Normal quantile of (1 + confidence) / 2; a constant of the plan."""
    from statistics import NormalDist

    return NormalDist().inv_cdf((1 + confidence) / 2)


def normal_tail(z: Column) -> Column:
    """One-sided p-value of a z-score, to 1.2e-7, by a fixed rational approximation of erfc in Horner form."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.5 * x)
    # Chebyshev coefficients of the published approximation, highest power first.
    coefficients = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    poly = F.lit(0.0)
    for c in coefficients:
        poly = poly * t + c
    erfc = t * F.exp(poly - x * x)
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)
