"""Points of all frames of a recording lie in one world frame before cells are counted."""

import math

from pyspark.sql import functions as F

from aerolith.plans import aggregates, book, lattice
from conftest import rows

WALL = [(x + 0.7, 5.3, z + 0.4) for x in range(-6, 7, 2) for z in range(-2, 3, 2)]


def seen_from(position, yaw):
    """The wall as a sensor at ``position`` that is turned by ``yaw`` sees it."""
    c, s = math.cos(-yaw), math.sin(-yaw)
    out = []
    for p in WALL:
        dx, dy, dz = (a - b for a, b in zip(p, position))
        out.append({"x": c * dx - s * dy, "y": s * dx + c * dy, "z": dz})
    return out


def frame(n, position, yaw):
    pose = dict(zip("xyz", position))
    turn = {"w": math.cos(yaw / 2), "x": 0.0, "y": 0.0, "z": math.sin(yaw / 2)}
    return (n, "r", n, n, f"f{n}", 1, seen_from(position, yaw), pose, turn, None)


SCHEMA = "file_id long, recording string, frame_id long, lidar_ts long, path string, n_bytes long, points array<struct<x: double, y: double, z: double>>, position struct<x: double, y: double, z: double>, orientation struct<w: double, x: double, y: double, z: double>, gps struct<lat: double, lon: double, alt: double>"


def test_two_poses_of_one_wall_give_one_set_of_cells(spark, monkeypatch):
    f = spark.createDataFrame([frame(0, (0.5, 0.5, 0.5), 0.0), frame(1, (1.5, -7.5, 0.5), 1.2)], SCHEMA)
    monkeypatch.setattr(book, "table", lambda *_: f)
    new = {r["frame_id"]: r["n_new"] for r in aggregates.a01(spark, "").collect()}
    assert set(new) == {0}
    w = book.world(spark, "").groupBy("pt_id").agg(*[F.max(a) - F.min(a) for a in "xyz"]).collect()
    assert all(max(r[1:]) < 1e-9 for r in w)
    lat = lattice.Lattice(spark, "")
    assert lat.occupied.count() == len({tuple(math.floor(a / lattice.CELL_M) for a in p) for p in WALL})


def test_long_scans_keep_all_their_points(spark):
    """Two files of 2000 points each: ids of neighbouring files are told apart."""
    from aerolith.operators import spatial as S

    q = spark.range(4000).select(F.lit("r").alias("g"), F.struct((F.col("id") % 2).alias("file_id"), F.expr("id div 2").alias("pt_id")).alias("pid"), (F.col("id") * 0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    n = S.nearest(q, q.withColumnRenamed("pid", "other"), ["g"], "pid", "other", 1.0)
    assert n.count() == 4000 and n.where("pid = other and dist = 0").count() == 4000


def test_a_crowded_place_is_cut_finer(spark, monkeypatch):
    from aerolith.operators import spatial as S

    monkeypatch.setattr(S, "CROWDED", 20)
    near = spark.range(300).select(F.col("id").alias("t"), (F.rand(1) * 0.1).alias("x"), (F.rand(2) * 0.1).alias("y"), (F.rand(3) * 0.1).alias("z"))
    far = spark.range(300, 330).select(F.col("id").alias("t"), (F.rand(4) * 500).alias("x"), (F.rand(5) * 500).alias("y"), (F.rand(6) * 500).alias("z"))
    t = near.unionByName(far).cache()
    q = t.select((F.col("t") + 1000).alias("q"), *[(F.col(a) + 0.01).alias(a) for a in "xyz"]).cache()
    pt, pq = t.collect(), q.collect()
    want = []
    for a in pq:
        d, i = min((sum((a[c] - b[c]) ** 2 for c in "xyz"), b["t"]) for b in pt)
        want.append((a["q"], i, round(math.sqrt(d), 9)))
    got = S.nearest(q, t, [], "q", "t", 4.0).select("q", "t", F.round("dist", 9)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert rows(q.limit(0).toPandas()) == []
