"""Registration, pose graphs and submaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions import geometry as G
from aerolith.operators import posegraph, registration
from aerolith.operators import spatial as S
from aerolith.plans.aggregates import CONTEXT, IJK, RINGS, SECTORS, scan_context
from aerolith.plans.book import FRAMES, POINTS, WORLD, Book, frames, points, r6, rotated_sql
from aerolith.plans.joins import _LOOP, APART, halves, loop_candidates, one_pose
from aerolith.runtime import table

book = Book()


def clouds(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, cloud): the valid points of each frame in the world frame, turned row by row without being exploded."""
    q, t = G.Quat(*[F.col(f"q{a}") for a in "wxyz"]), G.Vec(F.col("px"), F.col("py"), F.col("pz"))

    def placed(p: Column) -> Column:
        w = G.to_world(q, t, G.Vec(*[p[a].cast("double") for a in "xyz"]))
        return F.struct(w.x.alias("x"), w.y.alias("y"), w.z.alias("z"))

    good = F.filter("points", lambda p: p.isNotNull() & ((p["x"] != 0) | (p["y"] != 0) | (p["z"] != 0)))
    return frames(spark, sf).where("points is not null").select("file_id", F.transform(good, placed).alias("cloud"))


def with_clouds(pairs: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """``pairs`` of (src_file, tgt_file) with src and tgt, the clouds of both; only ids went through what made the pairs."""
    c = clouds(spark, sf)
    d = pairs.join(c.select(F.col("file_id").alias("src_file"), F.col("cloud").alias("src")), "src_file")
    return d.join(c.select(F.col("file_id").alias("tgt_file"), F.col("cloud").alias("tgt")), "tgt_file")


def scan_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(recording, frame_id, src, tgt): the cloud of each frame and of the frame before it in the world; one file per frame number."""
    w = Window.partitionBy("recording").orderBy("frame_id")
    f = table(spark, sf, "lidar_frame").where("points is not null").groupBy("recording", "frame_id").agg(F.min("file_id").alias("src_file"))
    return with_clouds(f.withColumn("tgt_file", F.lag("src_file").over(w)).where("tgt_file is not null"), spark, sf)


@book.query("reg_r01_state_only", f"WITH {FRAMES} SELECT file_id, CAST(0 AS DOUBLE) AS fitness, CAST(0 AS DOUBLE) AS rmse FROM fr")
def r01(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).select("file_id", F.lit(0.0).alias("fitness"), F.lit(0.0).alias("rmse"))


def _method(name: str, method: str, scales=registration.COARSE):
    @book.query(name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = registration.register_pairs(scan_pairs(spark, sf), ["recording", "frame_id"], method, scales)
        return d.select("recording", "frame_id", *[r6(F.col(c)).alias(c) for c in ("fitness", "rmse", "tx", "ty", "tz", "angle_deg")])

    return run


# The test scans have some dozen points over some hundred metres, so distances are COARSE; FINE holds those for dense scans.
for _n, _m in (("reg_r02_icp_point_to_plane", "icp_p2l"), ("reg_r03_gicp", "gicp"), ("reg_r04_ndt", "ndt"), ("reg_r05_feature_ransac", "fpfh_ransac"), ("reg_r08_vgicp", "vgicp"), ("reg_r11_scan_to_scan_icp", "icp_single")):
    _method(_n, _m)
_method("reg_r02_fine_schedule", "icp_p2l", registration.FINE)


@book.query("reg_r10_single_scale_icp")
def r10(spark: SparkSession, sf: str) -> DataFrame:
    """Each frame against the map of the recording's ten frames before it, in one scale."""
    w = Window.partitionBy("recording").orderBy("frame_id").rowsBetween(-10, -1)
    f = table(spark, sf, "lidar_frame").where("points is not null").groupBy("recording", "frame_id").agg(F.min("file_id").alias("file_id"))
    before = f.withColumn("before", F.collect_list("file_id").over(w)).where("size(before) > 0").select("recording", "frame_id", F.col("file_id").alias("src_file"), F.explode("before").alias("tgt_file"))
    c = clouds(spark, sf)
    tgt = before.join(c.withColumnRenamed("file_id", "tgt_file"), "tgt_file").groupBy("recording", "frame_id", "src_file").agg(F.flatten(F.collect_list("cloud")).alias("tgt"))
    d = registration.register_pairs(tgt.join(c.select(F.col("file_id").alias("src_file"), F.col("cloud").alias("src")), "src_file"), ["recording", "frame_id"], "icp_single", registration.COARSE)
    return d.select("recording", "frame_id", *[r6(F.col(c)).alias(c) for c in ("fitness", "rmse", "tx", "ty", "tz", "angle_deg")])


@book.query("reg_r12_map_alignment")
def r12(spark: SparkSession, sf: str) -> DataFrame:
    """Each saved map aligned to the first map of its recording, in three passes of falling distance."""
    m = table(spark, sf, "slam_map").where("points is not null").dropDuplicates(["map_id"]).select("map_id", "recording", F.filter("points", lambda p: p.isNotNull()).alias("src"))
    first = m.groupBy("recording").agg(F.min_by("src", "map_id").alias("tgt"))
    d = registration.register_pairs(m.join(first, "recording"), ["map_id"], "icp_p2l", [(8.0, 50), (4.0, 50), (2.0, 50)])
    return d.select("map_id", *[r6(F.col(c)).alias(c) for c in ("fitness", "rmse", "tx", "ty", "tz", "angle_deg")])


_SHIFT = f"""{WORLD}, al AS (SELECT recording, frame_id, struct_pack(f := file_id, p := pt_id) AS pid, x, y, z FROM pt), ev AS (SELECT recording, pid, -y + 0.5 AS x, x AS y, z - 0.25 AS z FROM al WHERE frame_id % 2 = 0), od AS (SELECT * FROM al WHERE frame_id % 2 = 1),
nn AS (SELECT e.recording, e.pid, sqrt(min(pow(e.x - o.x, 2) + pow(e.y - o.y, 2) + pow(e.z - o.z, 2))) AS dist FROM ev e JOIN od o USING (recording) GROUP BY ALL)"""


@book.query("join_j07_after_transform", f"WITH {_SHIFT} SELECT recording, count(*) AS n, round(avg(dist), 6) AS mean_dist, round(max(dist), 6) AS max_dist FROM nn GROUP BY recording")
def j07(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-neighbour distances once the source is moved by a transform."""
    from aerolith.plans.scalar import MOUNT

    ev, od = halves(spark, sf)
    moved = ev.select("recording", "pid", *G.apply_matrix(MOUNT, G.Vec(F.col("x"), F.col("y"), F.col("z"))).named())
    n = S.nearest(moved, od.withColumnRenamed("pid", "other"), ["recording"], "pid", "other", 4.0)
    return n.groupBy("recording").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("dist")).alias("mean_dist"), r6(F.max("dist")).alias("max_dist"))


_CTX = f"""{CONTEXT}, one2 AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY frame_id) - 1 AS idx FROM (SELECT recording, frame_id, min(file_id) AS file_id FROM fr GROUP BY recording, frame_id)),
d AS (SELECT recording, idx, ring, sector, h FROM one2 JOIN co USING (file_id)), nr AS (SELECT recording, idx, frame_id, sqrt(coalesce(sum(h * h), 0)) AS nrm FROM one2 LEFT JOIN d USING (recording, idx) GROUP BY ALL),
sh AS (SELECT x.recording, x.idx, y.idx AS before, (y.sector - x.sector + {SECTORS}) % {SECTORS} AS turn, sum(x.h * y.h) AS dot FROM d x JOIN d y ON x.recording = y.recording AND x.ring = y.ring AND y.idx <= x.idx - {APART} GROUP BY ALL),
mx AS (SELECT recording, idx, before, CASE WHEN count(*) < {SECTORS} THEN greatest(max(dot), 0) ELSE max(dot) END AS dot FROM sh GROUP BY ALL),
bd AS (SELECT a.recording, a.frame_id, b.frame_id AS earlier, CASE WHEN a.nrm > 0 AND b.nrm > 0 THEN abs(round(1 - coalesce(dot, 0) / (a.nrm * b.nrm), 6)) ELSE 'Infinity'::DOUBLE END AS dist
  FROM nr a JOIN nr b ON a.recording = b.recording AND b.idx <= a.idx - {APART} LEFT JOIN mx ON mx.recording = a.recording AND mx.idx = a.idx AND mx.before = b.idx)"""


def most_alike(spark: SparkSession, sf: str) -> DataFrame:
    """(recording, frame_id, file_id, best, best_file, dist): of each frame the most alike of all frames of its recording that are APART or more before it."""
    bins = scan_context(spark, sf).groupBy("file_id").agg(F.collect_list(F.struct((F.col("ring") * SECTORS + F.col("sector")).alias("bin"), "h")).alias("cells"))
    one = one_pose(spark, sf).select("recording", "frame_id", "file_id", "idx")
    best = registration.context_blocks(one.join(bins, "file_id", "left"), "recording", "idx", "cells", RINGS, SECTORS, APART)
    other = one.select("recording", F.col("idx").alias("best_idx"), F.col("frame_id").alias("best"), F.col("file_id").alias("best_file"))
    return best.withColumnRenamed("best", "best_idx").join(one, ["recording", "idx"]).join(other, ["recording", "best_idx"]).select("recording", "frame_id", "file_id", "best", "best_file", "dist")


@book.query("reg_r06_context_distance", f"WITH {_CTX} SELECT recording, frame_id, arg_min(earlier, (dist, earlier)) AS best, min(dist) AS dist FROM bd GROUP BY recording, frame_id")
def r06(spark: SparkSession, sf: str) -> DataFrame:
    """Scan-context distance of each frame to the most alike earlier one of its recording, wherever it was taken."""
    return most_alike(spark, sf).select("recording", "frame_id", "best", "dist")


# Scans are alike below this distance, refined within so many metres, and a closure needs this share of points near.
ALIKE, REFINE_M, FIT = 0.3, 2.0, 0.20


@book.query("reg_r07_context_loop_closure")
def r07(spark: SparkSession, sf: str) -> DataFrame:
    """Frames alike enough to close a loop, refined by point-to-plane ICP, and whether the fit is good enough."""
    alike = most_alike(spark, sf).where(F.col("dist") < ALIKE)
    pairs = with_clouds(alike.select("recording", "frame_id", "best", "dist", F.col("file_id").alias("src_file"), F.col("best_file").alias("tgt_file")), spark, sf)
    d = registration.register_pairs(pairs, ["recording", "frame_id", "best", "dist"], "icp_p2l", [(REFINE_M, 50)])
    return d.select("recording", "frame_id", "best", "dist", r6(F.col("fitness")).alias("fitness"), r6(F.col("rmse")).alias("rmse"), (F.col("fitness") > FIT).alias("closed"))


# Reach of the closing ICP in metres with its iterations, and the largest error of a closure.
LOOP_ICP, LOOP_RMSE = (1.5, 60), 0.5


def loops(spark: SparkSession, sf: str) -> DataFrame:
    """(recording, a, b, matrix, rmse): loops that ICP confirms, of each frame b the first earlier frame a; ``matrix`` moves b's scan onto a's in the world."""
    one = one_pose(spark, sf)
    late = one.select("recording", "idx", F.col("frame_id").alias("b"), F.col("file_id").alias("src_file"))
    early = one.select("recording", F.col("idx").alias("before"), F.col("frame_id").alias("a"), F.col("file_id").alias("tgt_file"))
    pairs = with_clouds(loop_candidates(spark, sf).drop("d2").join(late, ["recording", "idx"]).join(early, ["recording", "before"]), spark, sf)
    d = registration.register_pairs(pairs, ["recording", "a", "b"], "icp_p2l", [LOOP_ICP]).where((F.col("fitness") > FIT) & (F.col("rmse") < LOOP_RMSE))
    return d.groupBy("recording", "b").agg(F.min_by(F.struct("a", "matrix", "rmse"), "a").alias("c")).select("recording", "c.a", "b", "c.matrix", "c.rmse")


@book.query("flt_f20_loop_closures")
def f20b(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates that also pass the gates of fitness and error."""
    return loops(spark, sf).select("recording", "a", "b", r6(F.col("rmse")).alias("rmse"))


def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """One pose per frame number with its GPS position, taken to metres around the recording's first fix before it is used."""
    f = frames(spark, sf)
    one = f.groupBy("recording", "frame_id").agg(F.min_by(F.struct("px", "py", "pz", "qw", "qx", "qy", "qz", "gps"), "file_id").alias("f")).select("recording", "frame_id", "f.*")
    home = one.where("gps is not null").groupBy("recording").agg(F.min_by(F.struct("gps", "px", "py", "pz"), "frame_id").alias("h"))
    d = one.join(home, "recording", "left")
    at = G.gps_to_ned(*[F.col(f"gps.{m}") for m in ("lat", "lon", "alt")], *[F.col(f"h.gps.{m}") for m in ("lat", "lon", "alt")])
    return d.select("recording", "frame_id", "px", "py", "pz", "qw", "qx", "qy", "qz", (at.x + F.col("h.px")).alias("gx"), (at.y + F.col("h.py")).alias("gy"), (at.z + F.col("h.pz")).alias("gz"))


def odometry(spark: SparkSession, sf: str) -> DataFrame:
    """(recording, frame_id, matrix, rmse): how ICP moves each scan onto the one before it in the world."""
    return registration.register_pairs(scan_pairs(spark, sf), ["recording", "frame_id"], "icp_single", registration.COARSE).where("fitness > 0").select("recording", "frame_id", "matrix", "rmse")


@book.query("grid_g17_pose_graph")
def g17(spark: SparkSession, sf: str) -> DataFrame:
    """Poses from scan-to-scan motions, weighted by their error, and GPS positions."""
    return posegraph.optimise(graph_nodes(spark, sf), "recording", "frame_id", odometry=odometry(spark, sf)).drop("matrix")


def closed_graph(spark: SparkSession, sf: str) -> DataFrame:
    return posegraph.optimise(graph_nodes(spark, sf), "recording", "frame_id", odometry=odometry(spark, sf), loops=loops(spark, sf))


@book.query("grid_g18_pose_graph_with_loops")
def g18(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the loops that ICP confirms."""
    return closed_graph(spark, sf).drop("matrix")


@book.query("grid_g19_rebuilt_map")
def g19(spark: SparkSession, sf: str) -> DataFrame:
    """Voxels per recording once scans in body coordinates are placed by the optimised poses, turns included."""
    new = closed_graph(spark, sf).select("recording", "frame_id", "matrix")
    p = points(spark, sf).select("recording", "frame_id", "x", "y", "z").join(new, ["recording", "frame_id"])
    w = G.apply_matrix([F.col("matrix")[n] for n in range(12)], G.Vec(F.col("x"), F.col("y"), F.col("z")))
    cells = p.select("recording", *[F.floor(c / 0.5).cast("bigint").alias(i) for c, i in zip((w.x, w.y, w.z), "ijk")]).distinct()
    return cells.groupBy("recording").agg(F.count(F.lit(1)).alias("n_voxels"))


@book.query("grid_g20_two_poses", "SELECT 1 AS pose, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z UNION ALL SELECT 2, 2.0, 0.0, 0.0")
def g20(spark: SparkSession, sf: str) -> DataFrame:
    """The example of two poses: a prior at zero, two metres of motion, and a start that is off."""
    first = (1, "example", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, None, None, None)
    second = (2, "example", 2.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, None, None, None)
    nodes = spark.createDataFrame([first, second], "pose int, run string, px double, py double, pz double, qw double, qx double, qy double, qz double, gx double, gy double, gz double")
    return posegraph.optimise(nodes, "run", "pose", jolt=(0.1, 0.1, 0.05)).select("pose", *[(r6(F.col(a)) + 0.0).alias(a) for a in "xyz"])


_RX, _RY, _RZ = rotated_sql("x", "y", "z")
_SUBMAP = f"""{POINTS}, w AS (SELECT recording, frame_id // 4 AS submap, {_RX} + px + CASE WHEN (frame_id // 4) % 2 = 0 THEN 1 ELSE 0 END AS x, {_RY} + py + CASE WHEN (frame_id // 4) % 2 = 0 THEN 1 ELSE 0 END AS y, {_RZ} + pz + CASE WHEN (frame_id // 4) % 2 = 0 THEN 1 ELSE 0 END AS z FROM pt)"""


@book.query("grid_g21_recomposed_submaps", f"WITH {_SUBMAP}, c AS (SELECT DISTINCT recording, {IJK.format('0.5')} FROM w) SELECT recording, count(*) AS n_voxels FROM c GROUP BY recording")
def g21(spark: SparkSession, sf: str) -> DataFrame:
    """The map of a recording put together from submaps at their corrected anchors (even ones moved by a metre)."""
    q, t = G.Quat(*[F.col(f"q{a}") for a in "wxyz"]), G.Vec(F.col("px"), F.col("py"), F.col("pz"))
    w = G.to_world(q, t, G.Vec(F.col("x"), F.col("y"), F.col("z")))
    local = points(spark, sf).select("recording", F.expr("frame_id div 4").alias("submap"), *w.named())
    keys = local.select("recording", "submap").distinct()
    fix = keys.where("submap % 2 = 0").select("recording", "submap", F.lit(1).alias("d"))
    moved = local.join(fix, ["recording", "submap"], "left").select("recording", *[(F.col(a) + F.coalesce("d", F.lit(0))).alias(a) for a in "xyz"])
    cells = moved.select("recording", *[F.floor(F.col(a) / 0.5).cast("bigint").alias(i) for a, i in zip("xyz", "ijk")]).distinct()
    return cells.groupBy("recording").agg(F.count(F.lit(1)).alias("n_voxels"))


@book.query("grid_g22_pose_readout", f"WITH {_LOOP}, op AS (SELECT recording, frame_id, px + 0.5 AS ox, py AS oy, pz AS oz FROM one WHERE frame_id % 3 = 0) SELECT recording, frame_id, round(coalesce(ox, px, 0), 6) AS x, round(coalesce(oy, py, 0), 6) AS y, round(coalesce(oz, pz, 0), 6) AS z FROM one LEFT JOIN op USING (recording, frame_id)")
def g22(spark: SparkSession, sf: str) -> DataFrame:
    """The optimised pose where there is one, else the raw one, else the origin."""
    one = one_pose(spark, sf)
    op = one.where("frame_id % 3 = 0").select("recording", "frame_id", (F.col("x") + 0.5).alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))
    return one.join(op, ["recording", "frame_id"], "left").select("recording", "frame_id", *[r6(F.coalesce(f"o{a}", a, F.lit(0.0))).alias(a) for a in "xyz"])


COURSE = [(3.0, 3.0, 1.0), (6.0, 5.0, 1.2), (4.0, 8.0, 1.0), (8.0, 7.0, 0.7)]


def _trees(spark: SparkSession, both_ways: bool) -> DataFrame:
    from aerolith.operators.trees import grow_trees

    return grow_trees(spark.range(8).withColumnRenamed("id", "seed"), (1.0, 1.0), (9.0, 9.0), 10.0, COURSE, both_ways)


@book.query("grid_g16_rrt")
def g16(spark: SparkSession, sf: str) -> DataFrame:
    """Random trees through the plane course, one per seed, with the path from the node nearest the goal."""
    return _trees(spark, False)


@book.query("grid_g16_birrt")
def g16b(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of trees from both ends that meet."""
    return _trees(spark, True)


@book.query("grid_g16_birrt_paths", "SELECT CAST(s AS BIGINT) AS seed, true AS connected, true AS clear FROM generate_series(0, 7) q(s)")
def g16c(spark: SparkSession, sf: str) -> DataFrame:
    """Does each pair of trees join both ends, by nodes that all lie outside the obstacles."""
    clear = F.lit(True)
    for x, y, r in COURSE:
        clear = clear & ((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) > r * r)
    ends = (F.col("on_path") & (F.col("parent") == -1)).cast("int")
    return _trees(spark, True).groupBy("seed").agg((F.sum(ends) == 2).alias("connected"), F.bool_and(clear).alias("clear"))


QUERIES, SQL = book.queries, book.sql
