import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.functions import geometry as G
from aerolith.functions.timeunits import to_ns, usable_reading


def rot(q):
    w, x, y, z = np.array(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


@pytest.fixture(scope="module")
def poses(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(40, 14)).tolist()
    cols = [f"a{c}" for c in "wxyz"] + [f"b{c}" for c in "wxyz"] + ["px", "py", "pz", "tx", "ty", "tz"]
    return data, spark.createDataFrame(data, ", ".join(f"{c} double" for c in cols))


def quats(n):
    return G.Quat(*[F.col(f"{n}{c}") for c in "wxyz"])


def test_world_and_back(poses):
    data, df = poses
    p, t = G.Vec(F.col("px"), F.col("py"), F.col("pz")), G.Vec(F.col("tx"), F.col("ty"), F.col("tz"))
    q = quats("a").unit()
    w = df.select(*G.to_world(q, t, p).named("x", "y", "z")).collect()
    for d, r in zip(data, w):
        want = rot(d[:4]) @ np.array(d[8:11]) + np.array(d[11:14])
        assert np.allclose(list(r), want)
    b = df.select(*G.to_body(q, t, G.to_world(q, t, p)).named("x", "y", "z")).collect()
    assert np.allclose([list(r) for r in b], [d[8:11] for d in data])


def test_product_is_composition(poses):
    data, df = poses
    m = df.select(*[c.alias(f"m{i}") for i, c in enumerate(G.matrix(quats("a").unit() * quats("b").unit()))]).collect()
    for d, r in zip(data, m):
        assert np.allclose(np.array(list(r)).reshape(3, 3), rot(d[:4]) @ rot(d[4:8]))


def test_slerp_halves_the_angle(poses):
    data, df = poses
    for part in (0.0, 0.25, 1.0):
        out = G.slerp(df, "a", "b", F.lit(part)).select("qw", "qx", "qy", "qz").collect()
        for d, r in zip(data, out):
            a, b = np.array(d[:4]) / np.linalg.norm(d[:4]), np.array(d[4:8]) / np.linalg.norm(d[4:8])
            dot = a @ b
            b, dot = (b, dot) if dot >= 0 else (-b, -dot)
            ang = math.acos(min(1, dot))
            want = (math.sin((1 - part) * ang) * a + math.sin(part * ang) * b) / math.sin(ang)
            assert np.allclose(list(r), want, atol=1e-9)


def test_edge_quaternions(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (None, 1.0, 0.0, 0.0)], "aw double, ax double, ay double, az double")
    assert [tuple(r) for r in df.select(*quats("a").unit().named("q")).collect()] == [(1.0, 0.0, 0.0, 0.0)] * 2
    same = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], ", ".join(f"{n}{c} double" for n in "ab" for c in "wxyz"))
    assert tuple(G.slerp(same, "a", "b", F.lit(0.3)).select("qw", "qx", "qy", "qz").first()) == (1.0, 0.0, 0.0, 0.0)


def test_angles_and_positions(spark):
    df = spark.createDataFrame([(190.0,), (-190.0,), (180.0,), (540.0,)], "d double")
    assert [r[0] for r in df.select(G.wrap_deg(F.col("d"))).collect()] == [-170.0, 170.0, -180.0, -180.0]
    yaw = math.radians(30)
    q = spark.createDataFrame([(math.cos(yaw / 2), 0.0, 0.0, math.sin(yaw / 2))], "aw double, ax double, ay double, az double")
    r = q.select(G.yaw_deg(quats("a")), G.pitch_deg(quats("a")), G.roll_deg(quats("a")), G.angle_deg(G.matrix(quats("a"))), G.euler_norm_deg(quats("a"))).first()
    assert np.allclose(list(r), [30, 0, 0, 30, 30])
    one = spark.range(1)
    ned = one.select(*G.gps_to_ned(*[F.lit(v) for v in (0.001, 0.001, 5.0, 0.0, 0.0, 2.0)]).named()).first()
    assert np.allclose(list(ned), [math.radians(0.001) * 6378137, math.radians(0.001) * 6378137, -3.0])


def test_normal_tail(spark):
    zs = [-3.0, -0.5, 0.0, 0.7, 1.96, 4.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(G.normal_tail(F.col("z"))).collect()]
    assert np.allclose(got, [0.5 * math.erfc(z / math.sqrt(2)) for z in zs], atol=2e-7)


def test_back_projection_and_segment(spark):
    one = spark.range(1)
    zero, v = G.Vec(*[F.lit(0.0)] * 3), G.Vec(F.lit(2.0), F.lit(0.0), F.lit(0.0))
    ident = G.Quat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    turn = G.Vec(F.lit(0.0), F.lit(0.0), F.lit(math.pi))
    q, p = G.back_projected(ident, v, v, turn, F.lit(0.5))
    r = one.select(*p.named(), G.yaw_deg(q).alias("yaw")).first()
    assert np.allclose(list(r), [1.0, 0.0, 0.0, -90.0])
    q, p = G.back_projected(ident, v, v, turn, F.lit(0.0005))
    assert one.select(*p.named()).first()[0] == 2.0
    c, t = G.closest_on_segment(G.Vec(F.lit(5.0), F.lit(1.0), F.lit(0.0)), zero, zero)
    assert tuple(one.select(*c.named(), t.alias("t")).first()) == (0.0, 0.0, 0.0, 0.0)


def test_units_and_usable(spark):
    df = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_000,), (1_700_000_000_000_000,), (1_700_000_000_000_000_000,), (None,), (50_000_000_000,), (-5,)], "t long")
    assert [r[0] for r in df.select(to_ns(F.col("t"))).collect()] == [1_700_000_000_000_000_000] * 4 + [None, None, -5_000_000_000]
    nan = float("nan")
    data = [("imu", [1.0] * 6, True), ("imu", [1.0] * 10, True), ("imu", [1.0] * 6 + [nan] * 4, True), ("imu", [1.0] * 5 + [nan], False), ("imu", [1.0] * 3, False), ("gps", [1.0] * 3, True), ("gps", [1.0, None, 1.0], False), ("gps", [], False), ("gps", None, False), ("state", [1.0] * 7, False), (None, [1.0] * 3, False)]
    d = spark.createDataFrame(data, "s string, v array<double>, want boolean")
    assert all(r[0] == r[1] for r in d.select(usable_reading(F.col("s"), F.col("v")), "want").collect())
