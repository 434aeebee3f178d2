"""Projections, scalar functions and filters, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions import geometry as G
from aerolith.functions import labels as L
from aerolith.functions.timeunits import TO_NS_SQL, to_ns, usable_reading, usable_sql
from aerolith.operators import voxel as V
from aerolith.plans.book import FRAMES, MAPS, POINTS, Book, frames, map_points, points, r6, rotated_sql
from aerolith.runtime import table

book = Book()
RX, RY, RZ = rotated_sql("x", "y", "z")


def pose() -> tuple[G.Quat, G.Vec]:
    """Orientation and position columns of ``frames`` and ``points``."""
    return G.Quat(*[F.col(f"q{a}") for a in "wxyz"]), G.Vec(F.col("px"), F.col("py"), F.col("pz"))


def pt() -> G.Vec:
    return G.Vec(F.col("x"), F.col("y"), F.col("z"))


@book.query("fn_p01_world_points", f"WITH {POINTS} SELECT file_id, CAST(pt_id AS BIGINT) AS pt_id, round({RX} + px, 6) AS wx, round({RY} + py, 6) AS wy, round({RZ} + pz, 6) AS wz FROM pt")
def world_points(spark: SparkSession, sf: str) -> DataFrame:
    w = G.to_world(*pose(), pt())
    return points(spark, sf).select("file_id", "pt_id", *w.named("wx", "wy", "wz", 6))


@book.query(
    "fn_p03_rotation_matrix",
    f"WITH {FRAMES} SELECT file_id, round(1 - 2 * (qy * qy + qz * qz), 6) AS r0, round(2 * (qx * qy - qw * qz), 6) AS r1, round(2 * (qx * qz + qw * qy), 6) AS r2, round(2 * (qx * qy + qw * qz), 6) AS r3, round(1 - 2 * (qx * qx + qz * qz), 6) AS r4, round(2 * (qy * qz - qw * qx), 6) AS r5, round(2 * (qx * qz - qw * qy), 6) AS r6, round(2 * (qy * qz + qw * qx), 6) AS r7, round(1 - 2 * (qx * qx + qy * qy), 6) AS r8 FROM fr",
)
def rotation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).select("file_id", *[r6(c).alias(f"r{i}") for i, c in enumerate(G.matrix(pose()[0]))])


#: A fixed mount pose for the three-step chain: half a metre ahead, turned 90 degrees about z.
MOUNT = [0.0, -1.0, 0.0, 0.5, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, -0.25]


@book.query("fn_p04_apply_matrix", f"WITH {POINTS} SELECT file_id, CAST(pt_id AS BIGINT) AS pt_id, round(-y + 0.5, 6) AS bx, round(x, 6) AS by_, round(z - 0.25, 6) AS bz FROM pt")
def apply_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("file_id", "pt_id", *G.apply_matrix(MOUNT, pt()).named("bx", "by_", "bz", 6))


@book.query(
    "fn_p05_pose_between",
    f"""WITH {FRAMES}, one AS (SELECT DISTINCT ON (recording, frame_id) * FROM fr ORDER BY recording, frame_id, file_id),
  pr AS (SELECT file_id, px - lag(px) OVER w AS x, py - lag(py) OVER w AS y, pz - lag(pz) OVER w AS z, qw AS bw, qx AS bx, qy AS b_y, qz AS bz,
    lag(qw) OVER w AS qw, -lag(qx) OVER w AS qx, -lag(qy) OVER w AS qy, -lag(qz) OVER w AS qz FROM one WINDOW w AS (PARTITION BY recording ORDER BY frame_id, file_id))
  SELECT file_id, round({RX}, 6) AS tx, round({RY}, 6) AS ty, round({RZ}, 6) AS tz, round(qw * bw - qx * bx - qy * b_y - qz * bz, 6) AS dw FROM pr WHERE qw IS NOT NULL""",
)
def pose_between(spark: SparkSession, sf: str) -> DataFrame:
    """Motion of each frame as seen from the frame before it in its recording."""
    f = frames(spark, sf)
    one = f.groupBy("recording", "frame_id").agg(F.min_by(F.struct(*[c for c in f.columns if c not in ("recording", "frame_id")]), "file_id").alias("f")).select("recording", "frame_id", "f.*")
    w = Window.partitionBy("recording").orderBy("frame_id", "file_id")
    d = one.select("file_id", "px", "py", "pz", "qw", "qx", "qy", "qz", *[F.lag(c).over(w).alias(f"a_{c}") for c in ("px", "py", "pz", "qw", "qx", "qy", "qz")]).where("a_qw is not null")
    qa, ta = G.Quat(*[F.col(f"a_q{a}") for a in "wxyz"]), G.Vec(*[F.col(f"a_p{a}") for a in "xyz"])
    dq, dt = G.between(qa, ta, *pose())
    return d.select("file_id", *dt.named("tx", "ty", "tz", 6), r6(dq.w).alias("dw"))


@book.query(
    "fn_p06_sensor_to_world",
    f"""WITH {POINTS}, b AS (SELECT file_id, pt_id, px, py, pz, qw, qx, qy, qz, -y + 0.5 AS x, x AS y, z - 0.25 AS z FROM pt)
  SELECT file_id, CAST(pt_id AS BIGINT) AS pt_id, round({RX} + px, 6) AS wx, round({RY} + py, 6) AS wy, round({RZ} + pz, 6) AS wz FROM b WHERE sqrt(x * x + y * y + z * z) >= 1.0""",
)
def sensor_to_world(spark: SparkSession, sf: str) -> DataFrame:
    """Sensor to body by the mount pose, self-returns within 1 m of the body cut, body to world."""
    body = points(spark, sf).select("file_id", "pt_id", "px", "py", "pz", "qw", "qx", "qy", "qz", *G.apply_matrix(MOUNT, pt()).named())
    return body.where(pt().norm() >= 1.0).select("file_id", "pt_id", *G.to_world(*pose(), pt()).named("wx", "wy", "wz", 6))


@book.query(
    "fn_p12_yaw_pitch_roll",
    f"""WITH {FRAMES} SELECT file_id, round(degrees(atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))), 6) AS yaw,
  round(degrees(asin(least(1, greatest(-1, 2 * (qw * qy - qz * qx))))), 6) AS pitch, round(degrees(atan2(2 * (qw * qx + qy * qz), 1 - 2 * (qx * qx + qy * qy))), 6) AS roll FROM fr""",
)
def yaw_pitch_roll(spark: SparkSession, sf: str) -> DataFrame:
    q = pose()[0]
    return frames(spark, sf).select("file_id", r6(G.yaw_deg(q)).alias("yaw"), r6(G.pitch_deg(q)).alias("pitch"), r6(G.roll_deg(q)).alias("roll"))


@book.query(
    "fn_p13_euler_norm",
    f"""WITH {FRAMES} SELECT file_id, round(sqrt(pow(degrees(atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))), 2)
  + pow(degrees(asin(least(1, greatest(-1, 2 * (qw * qy - qz * qx))))), 2) + pow(degrees(atan2(2 * (qw * qx + qy * qz), 1 - 2 * (qx * qx + qy * qy))), 2)), 6) AS euler_deg FROM fr""",
)
def euler_norm(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).select("file_id", r6(G.euler_norm_deg(pose()[0])).alias("euler_deg"))


@book.query(
    "fn_p14_rotation_angle",
    f"WITH {FRAMES} SELECT file_id, round(degrees(acos(least(1, greatest(-1, ((1 - 2 * (qy * qy + qz * qz)) + (1 - 2 * (qx * qx + qz * qz)) + (1 - 2 * (qx * qx + qy * qy)) - 1) / 2)))), 4) AS angle FROM fr",
)
def rotation_angle(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).select("file_id", F.round(G.angle_deg(G.matrix(pose()[0])), 4).alias("angle"))


@book.query("fn_p15_angle_wrap", "SELECT event_id, round(((value * 10 + 180) % 360 + 360) % 360 - 180, 6) AS wrapped FROM events")
def angle_wrap(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", r6(G.wrap_deg(F.col("value") * 10)).alias("wrapped"))


@book.query(
    "fn_p16_staleness",
    f"""SELECT sample_id, sensor, round(ms, 3) AS staleness_ms, round(rate, 6) AS yaw_rate, round(ms / 1000.0 * rate, 6) AS yaw_error
  FROM (SELECT sample_id, sensor, (epoch_us(received_at) - {TO_NS_SQL.format('ts_ns')} // 1000) / 1000.0 AS ms, CASE WHEN sensor = 'imu' AND {usable_sql('sensor', 'v')} THEN degrees(v[3]) END AS rate
  FROM sensor_sample WHERE ts_ns IS NOT NULL AND received_at IS NOT NULL)""",
)
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    """Milliseconds between a reading and its arrival; of imu readings the yaw rate in degrees a second and the yaw error that it makes of the delay."""
    s = table(spark, sf, "sensor_sample").where("ts_ns is not null and received_at is not null")
    us = F.unix_micros(F.col("received_at").cast("timestamp"))
    ms = (us - F.expr("ns div 1000")) / 1000.0
    rate = F.when((F.col("sensor") == "imu") & usable_reading(F.col("sensor"), F.col("v")), F.degrees(F.get("v", F.lit(2))))
    d = s.withColumn("ns", to_ns(F.col("ts_ns"))).select("sample_id", "sensor", ms.alias("ms"), rate.alias("rate"))
    return d.select("sample_id", "sensor", F.round("ms", 3).alias("staleness_ms"), F.round("rate", 6).alias("yaw_rate"), F.round(F.col("ms") / 1000.0 * F.col("rate"), 6).alias("yaw_error"))


@book.query("fn_p17_timestamp_units", f"SELECT sample_id, ts_ns AS raw, {TO_NS_SQL.format('ts_ns')} AS ns, round({TO_NS_SQL.format('ts_ns')} / 1e9, 3) AS seconds FROM sensor_sample")
def timestamp_units(spark: SparkSession, sf: str) -> DataFrame:
    ns = to_ns(F.col("ts_ns"))
    return table(spark, sf, "sensor_sample").select("sample_id", F.col("ts_ns").alias("raw"), ns.alias("ns"), F.round(ns / 1e9, 3).alias("seconds"))


_HOME = "h AS (SELECT recording, arg_min(gps, file_id) AS h FROM lidar_frame WHERE gps IS NOT NULL GROUP BY recording)"


def _with_home(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lidar_frame").where("gps is not null")
    home = f.groupBy("recording").agg(F.min_by("gps", "file_id").alias("h"))
    return f.select("recording", "file_id", "gps").join(home, "recording")


def gps() -> list:
    return [F.col(f"gps.{m}") for m in ("lat", "lon", "alt")] + [F.col(f"h.{m}") for m in ("lat", "lon", "alt")]


@book.query(
    "fn_p18_gps_to_ned",
    f"WITH {_HOME} SELECT file_id, round(radians(gps.lat - h.lat) * 6378137.0, 4) AS n, round(radians(gps.lon - h.lon) * 6378137.0 * cos(radians(h.lat)), 4) AS e, CASE WHEN abs(h.alt - gps.alt) < 0.00005 THEN 0 ELSE round(h.alt - gps.alt, 4) END AS d FROM lidar_frame JOIN h USING (recording) WHERE gps IS NOT NULL",
)
def gps_to_ned(spark: SparkSession, sf: str) -> DataFrame:
    """Position relative to the first fix of the recording."""
    return _with_home(spark, sf).select("file_id", *G.gps_to_ned(*gps()).named("n", "e", "d", 4))


@book.query(
    "fn_p19_latlon_to_enu",
    f"WITH {_HOME} SELECT file_id, round(radians(gps.lon - h.lon) * cos(radians((gps.lat + h.lat) / 2)) * 6378137.0, 4) AS e, round(radians(gps.lat - h.lat) * 6378137.0, 4) AS n, CASE WHEN abs(gps.alt - h.alt) < 0.00005 THEN 0 ELSE round(gps.alt - h.alt, 4) END AS u FROM lidar_frame JOIN h USING (recording) WHERE gps IS NOT NULL",
)
def latlon_to_enu(spark: SparkSession, sf: str) -> DataFrame:
    return _with_home(spark, sf).select("file_id", *G.latlon_to_enu(*gps()).named("e", "n", "u", 4))


@book.query("fn_p42_drone_position", f"WITH {_HOME} SELECT recording, round(max(sqrt(pow(radians(gps.lat - h.lat) * 6378137.0, 2) + pow(radians(gps.lon - h.lon) * 6378137.0 * cos(radians(h.lat)), 2))), 4) AS reach_m, count(*) AS n FROM lidar_frame JOIN h USING (recording) WHERE gps IS NOT NULL GROUP BY recording")
def drone_position(spark: SparkSession, sf: str) -> DataFrame:
    """How far a recording's GPS positions lie from its home."""
    p = G.gps_to_ned(*gps())
    return _with_home(spark, sf).groupBy("recording").agg(F.round(F.max(F.sqrt(p.x * p.x + p.y * p.y)), 4).alias("reach_m"), F.count(F.lit(1)).alias("n"))


_IJK = "CAST(floor(x * {0}) AS BIGINT) AS i, CAST(floor(y * {0}) AS BIGINT) AS j, CAST(floor(z * {0}) AS BIGINT) AS k"


@book.query("fn_p20_voxel_index", f"WITH {POINTS} SELECT file_id, CAST(pt_id AS BIGINT) AS pt_id, {_IJK.format('(1.0 / 0.15)')} FROM pt")
def voxel_index(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("file_id", "pt_id", *[V.cell(F.col(a), 0.15).alias(i) for a, i in zip("xyz", "ijk")])


_M = "2097151"


@book.query(
    "fn_p21_packed_keys",
    f"""WITH {POINTS}, c AS (SELECT DISTINCT {_IJK.format('(1.0 / 0.15)')} FROM pt)
  SELECT ((i & {_M}) << 42) | ((j & {_M}) << 21) | (k & {_M}) AS key, i, j, k FROM c""",
)
def packed_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Packed 64-bit keys and the indices unpacked from them; 21 bits each, sign-extended."""
    c = points(spark, sf).select(*[V.cell(F.col(a), 0.15).alias(i) for a, i in zip("xyz", "ijk")]).distinct()
    key = c.select(V.pack_key(F.col("i"), F.col("j"), F.col("k")).alias("key"))
    return key.select("key", *[v.alias(n) for v, n in zip(V.unpack_key(F.col("key")), "ijk")])


@book.query("fn_p22_voxel_centres", f"WITH {POINTS}, c AS (SELECT DISTINCT {_IJK.format('(1.0 / 0.5)')} FROM pt) SELECT i, j, k, CAST(i * 0.5 + 0.25 AS DOUBLE) AS cx, CAST(j * 0.5 + 0.25 AS DOUBLE) AS cy, CAST(k * 0.5 + 0.25 AS DOUBLE) AS cz FROM c")
def voxel_centres(spark: SparkSession, sf: str) -> DataFrame:
    c = points(spark, sf).select(*[V.cell(F.col(a), 0.5).alias(i) for a, i in zip("xyz", "ijk")]).distinct()
    return c.select("i", "j", "k", *[V.centre(F.col(i), 0.5).alias(n) for i, n in zip("ijk", ("cx", "cy", "cz"))])


@book.query(
    "fn_p23_planner_cells",
    f"WITH {POINTS} SELECT file_id, CAST(pt_id AS BIGINT) AS pt_id, " + ", ".join(f"CAST(least({n - 1}, greatest(0, trunc(({a} - ({lo})) / 1.0))) AS INTEGER) AS {i}" for a, lo, n, i in (("x", -20.0, 40, "ix"), ("y", -20.0, 40, "iy"), ("z", -10.0, 15, "iz"))) + " FROM pt",
)
def planner_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Truncated and clipped to the grid: points outside pile up in its edge cells."""
    c = [V.clipped_cell(F.col(a), lo, 1.0, n).alias(i) for a, lo, n, i in (("x", -20.0, 40, "ix"), ("y", -20.0, 40, "iy"), ("z", -10.0, 15, "iz"))]
    return points(spark, sf).select("file_id", "pt_id", *c)


@book.query("fn_p24_unchecked_cells", f"WITH {POINTS} SELECT file_id, CAST(pt_id AS BIGINT) AS pt_id, CAST(trunc((x - (-20.0)) / 1.0) AS INTEGER) AS ix, CAST(trunc((y - (-20.0)) / 1.0) AS INTEGER) AS iy, CAST(trunc((z - (-10.0)) / 1.0) AS INTEGER) AS iz FROM pt")
def unchecked_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Truncated towards zero and not clipped, so cells just below the origin fall into cell 0."""
    return points(spark, sf).select("file_id", "pt_id", *[V.truncated_cell(F.col(a), lo, 1.0).alias(i) for a, lo, i in (("x", -20.0, "ix"), ("y", -20.0, "iy"), ("z", -10.0, "iz"))])


@book.query("fn_p25_grid_to_world", f"WITH {POINTS}, c AS (SELECT DISTINCT CAST(trunc(x + 20) AS INTEGER) AS ix, CAST(trunc(y + 20) AS INTEGER) AS iy, CAST(trunc(z + 10) AS INTEGER) AS iz FROM pt) SELECT ix, iy, iz, -20 + (ix + 0.5) * 1.0::DOUBLE AS wx, -20 + (iy + 0.5) * 1.0::DOUBLE AS wy, -10 + (iz + 0.5) * 1.0::DOUBLE AS wz FROM c")
def grid_to_world(spark: SparkSession, sf: str) -> DataFrame:
    c = points(spark, sf).select(*[V.truncated_cell(F.col(a), lo, 1.0).alias(i) for a, lo, i in (("x", -20.0, "ix"), ("y", -20.0, "iy"), ("z", -10.0, "iz"))]).distinct()
    return c.select("ix", "iy", "iz", *[V.grid_world(F.col(i), lo, 1.0).alias(n) for i, lo, n in (("ix", -20.0, "wx"), ("iy", -20.0, "wy"), ("iz", -10.0, "wz"))])


@book.query(
    "fn_p26_dense_index",
    f"""WITH {POINTS}, c AS (SELECT CAST(floor(x / 0.5) AS BIGINT) + 40 AS ix, CAST(floor(y / 0.5) AS BIGINT) + 40 AS iy, CAST(floor(z / 0.5) AS BIGINT) + 20 AS iz FROM pt)
  SELECT ix, iy, iz, count(*) AS n FROM c WHERE ix BETWEEN 0 AND 79 AND iy BETWEEN 0 AND 79 AND iz BETWEEN 0 AND 39 GROUP BY ALL""",
)
def dense_index(spark: SparkSession, sf: str) -> DataFrame:
    """Index in a dense grid whose middle is the origin; points outside are dropped."""
    return V.dense_counts(points(spark, sf), 0.5, (80, 80, 40))


@book.query(
    "fn_p43_dense_to_world",
    f"""WITH {POINTS}, c AS (SELECT DISTINCT CAST(floor(x / 0.5) AS BIGINT) + 40 AS ix, CAST(floor(y / 0.5) AS BIGINT) + 40 AS iy, CAST(floor(z / 0.5) AS BIGINT) + 20 AS iz FROM pt)
  SELECT ix, iy, iz, (ix - 40 + 0.5) * 0.5::DOUBLE AS centre_x, (iy - 40 + 0.5) * 0.5::DOUBLE AS centre_y, (iz - 20 + 0.5) * 0.5::DOUBLE AS centre_z, (ix - 40) * 0.5::DOUBLE AS corner_x, (iy - 40) * 0.5::DOUBLE AS corner_y, (iz - 20) * 0.5::DOUBLE AS corner_z
  FROM c WHERE ix BETWEEN 0 AND 79 AND iy BETWEEN 0 AND 79 AND iz BETWEEN 0 AND 39""",
)
def dense_to_world(spark: SparkSession, sf: str) -> DataFrame:
    """Centres as one map class has them, corners as the other."""
    c = V.dense_counts(points(spark, sf), 0.5, (80, 80, 40))
    half = {"x": 40, "y": 40, "z": 20}
    centre = [((F.col(f"i{a}") - half[a] + 0.5) * 0.5).alias(f"centre_{a}") for a in "xyz"]
    corner = [((F.col(f"i{a}") - half[a]) * 0.5).alias(f"corner_{a}") for a in "xyz"]
    return c.select("ix", "iy", "iz", *centre, *corner)


@book.query("fn_p27_icp_sigma", "SELECT DISTINCT run_id, round(greatest(greatest(0.05, plane_residual * 0.5), greatest(0.1, plane_residual * 1.5)) * 2, 6) AS sigma FROM benchmark_run WHERE plane_residual IS NOT NULL AND isfinite(plane_residual)")
def icp_sigma(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark_run").where("plane_residual is not null and abs(plane_residual) < double('Infinity') and not isnan(plane_residual)")
    return b.select("run_id", r6(G.icp_sigma(F.col("plane_residual"), 2.0)).alias("sigma")).distinct()


@book.query(
    "fn_p28_confidence_threshold",
    """SELECT run_id, round(avg(v) + 1.0364333894937898 * coalesce(stddev_samp(v), 0), 4) AS threshold FROM (SELECT run_id, t_total_ms AS v FROM frame_timing WHERE isfinite(t_total_ms) AND t_total_ms >= 0) GROUP BY run_id""",
)
def confidence_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Mean plus z times sample deviation at a two-sided confidence of 0.70."""
    v = table(spark, sf, "frame_timing").where("t_total_ms >= 0 and t_total_ms < double('Infinity')")
    return v.groupBy("run_id").agg(F.round(F.avg("t_total_ms") + G.two_sided_z(0.70) * F.coalesce(F.stddev_samp("t_total_ms"), F.lit(0.0)), 4).alias("threshold"))


@book.query("fn_p29_p_values")
def p_values(spark: SparkSession, sf: str) -> DataFrame:
    """One-sided p-value of each event's value among its user's, deviation floored at 1e-12, 1.0 with fewer than 4."""
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id")
    z = (F.col("value") - F.avg("value").over(w)) / F.greatest(F.stddev_samp("value").over(w), F.lit(1e-12))
    return e.select("event_id", F.when(F.count("value").over(w) < 4, F.lit(1.0)).otherwise(r6(G.normal_tail(z))).alias("p"))


@book.query("fn_p30_method_name", "SELECT map_id, folder, regexp_replace(regexp_replace(regexp_replace(folder, '^[A-Za-z_]*[0-9]+_', ''), '_noise_[0-9.]+cm_[0-9.]+deg$', ''), '_clean$', '') AS method FROM slam_map")
def method_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "slam_map").select("map_id", "folder", L.method_name(F.col("folder")).alias("method"))


@book.query("fn_p31_noise_level", "SELECT map_id, CAST(nullif(regexp_extract(folder, 'noise_([0-9.]+)cm_([0-9.]+)deg', 1), '') AS DOUBLE) AS noise_cm, CAST(nullif(regexp_extract(folder, 'noise_([0-9.]+)cm_([0-9.]+)deg', 2), '') AS DOUBLE) AS noise_deg FROM slam_map")
def noise_level(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "slam_map").select("map_id", L.noise_cm(F.col("folder")).alias("noise_cm"), L.noise_deg(F.col("folder")).alias("noise_deg"))


_LAB = """lab AS (SELECT map_id, recording, regexp_replace(regexp_replace(regexp_replace(folder, '^[A-Za-z_]*[0-9]+_', ''), '_noise_[0-9.]+cm_[0-9.]+deg$', ''), '_clean$', '') AS method,
  CAST(nullif(regexp_extract(folder, 'noise_([0-9.]+)cm_([0-9.]+)deg', 1), '') AS DOUBLE) AS cm, CAST(nullif(regexp_extract(folder, 'noise_([0-9.]+)cm_([0-9.]+)deg', 2), '') AS DOUBLE) AS deg FROM (SELECT DISTINCT map_id, recording, folder FROM slam_map))"""


@book.query("fn_p32_display_label", f"WITH {_LAB} SELECT map_id, CASE WHEN cm IS NOT NULL THEN method || ' (' || cm || 'cm)' WHEN bool_and(cm IS NULL) OVER (PARTITION BY recording) THEN method ELSE method || ' (clean)' END AS label FROM lab")
def display_label(spark: SparkSession, sf: str) -> DataFrame:
    """The method with its noise; " (clean)" only where another map of the recording has noise."""
    m = table(spark, sf, "slam_map").select("map_id", "recording", "folder").distinct()
    return m.select("map_id", L.display_label(F.col("folder"), Window.partitionBy("recording")).alias("label"))


@book.query("fn_p33_noise_fraction", f"WITH {_LAB} SELECT map_id, round(CASE WHEN max(cm) OVER w > min(cm) OVER w THEN (cm - min(cm) OVER w) / (max(cm) OVER w - min(cm) OVER w) ELSE 0 END, 6) AS frac FROM lab WHERE cm IS NOT NULL WINDOW w AS (PARTITION BY method)")
def noise_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """Where a map's noise lies between the least and the most of its method."""
    m = table(spark, sf, "slam_map").select("map_id", "folder").distinct().select("map_id", L.method_name(F.col("folder")).alias("method"), L.noise_cm(F.col("folder")).alias("cm")).where("cm is not null")
    w = Window.partitionBy("method")
    lo, hi = F.min("cm").over(w), F.max("cm").over(w)
    return m.select("map_id", r6(F.when(hi > lo, (F.col("cm") - lo) / (hi - lo)).otherwise(F.lit(0.0))).alias("frac"))


@book.query("fn_p34_noise_tag", "SELECT DISTINCT run_id, CASE WHEN noise_pos_std_m > 0 OR noise_rot_std_deg > 0 THEN printf('noise_%.3fcm_%.3fdeg', noise_pos_std_m * 100, noise_rot_std_deg) ELSE 'clean' END AS tag FROM benchmark_run")
def noise_tag(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark_run").select("run_id", L.noise_tag(F.col("noise_pos_std_m"), F.col("noise_rot_std_deg")).alias("tag")).distinct()


@book.query("fn_p35_height_ramp", f"WITH {POINTS}, s AS (SELECT file_id, pt_id, CASE WHEN max(z) OVER w > min(z) OVER w THEN (z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w) ELSE 0 END AS t FROM pt WINDOW w AS (PARTITION BY file_id)) SELECT file_id, CAST(pt_id AS BIGINT) AS pt_id, round(t, 6) AS red, round(1 - abs(2 * t - 1), 6) AS green, round(1 - t, 6) AS blue FROM s")
def height_ramp(spark: SparkSession, sf: str) -> DataFrame:
    """A colour by height within the frame."""
    w = Window.partitionBy("file_id")
    lo, hi = F.min("z").over(w), F.max("z").over(w)
    p = points(spark, sf).select("file_id", "pt_id", F.when(hi > lo, (F.col("z") - lo) / (hi - lo)).otherwise(F.lit(0.0)).alias("t"))
    return p.select("file_id", "pt_id", r6(F.col("t")).alias("red"), r6(1 - F.abs(2 * F.col("t") - 1)).alias("green"), r6(1 - F.col("t")).alias("blue"))


def gauss(draw: int, *ids: str, seed: int = 42) -> Column:
    """A normal number that a row's ids and the seed fix, however the rows are split over tasks."""
    def unit(half: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(*ids, F.lit(2 * draw + half), F.lit(seed)), 11) + 1) / F.lit(float(1 << 53))

    return F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * F.pi() * unit(1))


@book.query("fn_p37_pose_noise")
def pose_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Frame poses with seeded Gaussian noise of 0.1 m and half a degree about each axis; another generator than the reference's, so not bit-equal."""
    f = frames(spark, sf).withColumns({f"h{n}": F.radians(gauss(3 + n, "file_id") * 0.5) / 2 for n in range(3)})
    for n in range(3):
        axis = [F.sin(f"h{n}") if m == n else F.lit(0.0) for m in range(3)]
        turned = G.Quat(*[F.col(f"q{a}") for a in "wxyz"]) * G.Quat(F.cos(f"h{n}"), *axis)
        f = f.withColumns({f"q{a}": getattr(turned, a) for a in "wxyz"})
    return f.select("file_id", *[(F.col(f"p{a}") + gauss(n, "file_id") * 0.1).alias(f"p{a}") for n, a in enumerate("xyz")], *[f"q{a}" for a in "wxyz"])


@book.query(
    "fn_p39_closest_on_segment",
    """WITH s AS (SELECT scan_id, position.x AS x, position.y AS y, position.z AS z FROM (SELECT DISTINCT ON (scan_id) * FROM scan_buffer) WHERE position IS NOT NULL),
  t AS (SELECT *, least(1, greatest(0, (x * 10 + y * 10 + (z + 10) * -5) / 225.0)) AS t FROM s)
  SELECT scan_id, round(10 * t, 6) AS cx, round(10 * t, 6) AS cy, round(-10 - 5 * t, 6) AS cz, round(t, 6) AS t FROM t""",
)
def closest_on_segment(spark: SparkSession, sf: str) -> DataFrame:
    """Each scan position's closest point on the segment from (0, 0, -10) to (10, 10, -15)."""
    s = table(spark, sf, "scan_buffer").dropDuplicates(["scan_id"]).where("position is not null")
    a, b = G.Vec(F.lit(0.0), F.lit(0.0), F.lit(-10.0)), G.Vec(F.lit(10.0), F.lit(10.0), F.lit(-15.0))
    c, t = G.closest_on_segment(G.vec("position"), a, b)
    return s.select("scan_id", *c.named("cx", "cy", "cz", 6), r6(t).alias("t"))


@book.query("fn_p40_distance_and_steer", f"WITH {MAPS} SELECT map_id, CAST(pt_id AS BIGINT) AS pt_id, round(sqrt(x * x + y * y), 6) AS dist, round(x / sqrt(x * x + y * y) * 0.5, 6) AS sx, round(y / sqrt(x * x + y * y) * 0.5, 6) AS sy FROM mp WHERE x * x + y * y > 0")
def distance_and_steer(spark: SparkSession, sf: str) -> DataFrame:
    """Plane distance from the origin and a fixed step of 0.5 towards the point, even past it."""
    d = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    m = map_points(spark, sf).where(F.col("x") * F.col("x") + F.col("y") * F.col("y") > 0)
    return m.select("map_id", "pt_id", r6(d).alias("dist"), r6(F.col("x") / d * 0.5).alias("sx"), r6(F.col("y") / d * 0.5).alias("sy"))


@book.query("fn_p41_flatten_messages", "SELECT file_id, lidar_ts, imu_angular_vel.x AS wx, imu_angular_vel.y AS wy, imu_angular_vel.z AS wz, imu_linear_acc.x AS ax, imu_linear_acc.y AS ay, imu_linear_acc.z AS az, gps.lat AS lat, gps.lon AS lon, gps.alt AS alt FROM lidar_frame")
def flatten_messages(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lidar_frame")
    imu = [F.col(f"imu_angular_vel.{a}").alias(f"w{a}") for a in "xyz"] + [F.col(f"imu_linear_acc.{a}").alias(f"a{a}") for a in "xyz"]
    return f.select("file_id", "lidar_ts", *imu, "gps.lat", "gps.lon", "gps.alt")


# Filters


@book.query("flt_f01_valid_points", f"WITH {POINTS} SELECT file_id, count(*) AS n FROM pt GROUP BY file_id")
def valid_points(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@book.query("flt_f02_self_returns", f"WITH {POINTS} SELECT recording, count(*) AS n_all, CAST(count_if(sqrt(x * x + y * y + z * z) >= 1.0) AS BIGINT) AS n_kept FROM pt GROUP BY recording")
def self_returns(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).groupBy("recording").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(pt().norm() >= 1.0).alias("n_kept"))


@book.query("flt_f03_box", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 30 AND l_discount BETWEEN 0.02 AND 0.07 AND l_tax BETWEEN 0.01 AND 0.05")
def box(spark: SparkSession, sf: str) -> DataFrame:
    """An axis-aligned box, both ends inclusive; the three ranges reach the Parquet scan."""
    return V.in_box(table(spark, sf, "lineitem"), {"l_quantity": (5, 30), "l_discount": (0.02, 0.07), "l_tax": (0.01, 0.05)}).select("l_orderkey", "l_linenumber")


@book.query(
    "flt_f04_radius_crop",
    f"""WITH {POINTS}, c AS (SELECT *, x * x + y * y + z * z <= 100 AS near, count_if(x * x + y * y + z * z <= 100) OVER (PARTITION BY file_id) AS n FROM pt)
  SELECT file_id, CAST(pt_id AS BIGINT) AS pt_id FROM c WHERE near OR n < 5""",
)
def radius_crop(spark: SparkSession, sf: str) -> DataFrame:
    """Points within 10 m of the sensor; frames with fewer than 5 of them keep all."""
    return V.radius_crop(points(spark, sf), "file_id", 10.0, 5).select("file_id", "pt_id")


@book.query("flt_f05_target_crop", f"WITH {MAPS} SELECT map_id, count(*) AS n FROM mp WHERE x * x + y * y + z * z <= 900 GROUP BY map_id")
def target_crop(spark: SparkSession, sf: str) -> DataFrame:
    return map_points(spark, sf).where(pt().dot(pt()) <= 900.0).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))


@book.query("flt_f06_minimum_scan", "SELECT file_id, CAST(len(points) AS INTEGER) AS n FROM lidar_frame WHERE len(points) * 3 >= 9")
def minimum_scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lidar_frame").where(F.size("points") * 3 >= 9).select("file_id", F.size("points").alias("n"))


_SCANS = f"sc AS (SELECT DISTINCT ON (scan_id) *, {TO_NS_SQL.format('lidar_ts')} AS ns FROM scan_buffer WHERE lidar_ts IS NOT NULL)"


def scans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "scan_buffer").where("lidar_ts is not null").dropDuplicates(["scan_id"]).withColumn("ns", to_ns(F.col("lidar_ts")))


@book.query("flt_f07_duplicate_scans", f"WITH s AS (SELECT scan_id, recording, lag({TO_NS_SQL.format('lidar_ts')}) OVER (PARTITION BY recording ORDER BY {TO_NS_SQL.format('lidar_ts')}, scan_id, collect_time) = {TO_NS_SQL.format('lidar_ts')} AS again FROM scan_buffer WHERE lidar_ts IS NOT NULL) SELECT recording, count(*) AS n, CAST(count_if(again) AS BIGINT) AS n_again FROM s GROUP BY recording")
def duplicate_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Scans with the LiDAR time of the one before, per recording."""
    s = table(spark, sf, "scan_buffer").where("lidar_ts is not null").withColumn("ns", to_ns(F.col("lidar_ts")))
    w = Window.partitionBy("recording").orderBy("ns", "scan_id", "collect_time")
    again = s.select("recording", (F.lag("ns").over(w) == F.col("ns")).alias("again"))
    return again.groupBy("recording").agg(F.count(F.lit(1)).alias("n"), F.count_if("again").alias("n_again"))


@book.query("flt_f09_in_grid", f"WITH {POINTS} SELECT recording, CAST(count_if(x >= -20 AND x < 20 AND y >= -20 AND y < 20 AND z >= -10 AND z < 5) AS BIGINT) AS n_in, CAST(count_if(x >= -20 AND x < 20 AND y >= -20 AND y < 20 AND z < -10) AS BIGINT) AS n_above FROM pt GROUP BY recording")
def in_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Half-open grid bounds, and the airspace above the grid (down is positive)."""
    flat = (F.col("x") >= -20) & (F.col("x") < 20) & (F.col("y") >= -20) & (F.col("y") < 20)
    return points(spark, sf).groupBy("recording").agg(F.count_if(flat & (F.col("z") >= -10) & (F.col("z") < 5)).alias("n_in"), F.count_if(flat & (F.col("z") < -10)).alias("n_above"))


@book.query("flt_f12_registration_gate", "SELECT run_id, method <> 'state_only' AND coalesce(voxel_count, 0) >= 3000 AND coalesce(pose_count, 0) > 0 AS registers FROM benchmark_run")
def registration_gate(spark: SparkSession, sf: str) -> DataFrame:
    gate = (F.col("method") != "state_only") & (F.coalesce("voxel_count", F.lit(0)) >= 3000) & (F.coalesce("pose_count", F.lit(0)) > 0)
    return table(spark, sf, "benchmark_run").select("run_id", gate.alias("registers"))


@book.query("flt_f13_sanity_clamp", f"WITH {FRAMES} SELECT file_id, CASE WHEN sqrt(px * px + py * py + pz * pz) > 15 OR 2 * acos(least(1, abs(qw))) > 0.3 THEN 'rejected' ELSE 'kept' END AS verdict FROM fr")
def sanity_clamp(spark: SparkSession, sf: str) -> DataFrame:
    """A transform that moves or turns too far is replaced by none."""
    turn = 2 * F.acos(F.least(F.lit(1.0), F.abs(F.col("qw"))))
    return frames(spark, sf).select("file_id", F.when((pose()[1].norm() > 15) | (turn > 0.3), "rejected").otherwise("kept").alias("verdict"))


@book.query("flt_f16_f19_population", f"WITH {POINTS}, c AS (SELECT recording, {_IJK.format('(1.0 / 2.0)')}, count(*) AS n FROM pt GROUP BY ALL) SELECT recording, i, j, k, n FROM c WHERE n >= 5")
def population(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with at least 5 points."""
    c = points(spark, sf).groupBy("recording", *[V.cell(F.col(a), 2.0).alias(i) for a, i in zip("xyz", "ijk")]).agg(F.count(F.lit(1)).alias("n"))
    return c.where("n >= 5")


@book.query("flt_f21_status", "SELECT recording, CAST(count_if(status = 'OK') AS BIGINT) AS ok, CAST(count_if(status <> 'OK') AS BIGINT) AS failed FROM benchmark_run GROUP BY recording")
def status(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark_run").groupBy("recording").agg(F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status") != "OK").alias("failed"))


@book.query("flt_f22_displayed_points", f"WITH {MAPS} SELECT map_id, count(*) AS shown FROM mp GROUP BY map_id")
def displayed_points(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a padded buffer that hold a point."""
    return map_points(spark, sf).groupBy("map_id").agg(F.count(F.lit(1)).alias("shown"))


_CIRCLES = [(3.0, 3.0, 1.0), (6.0, 5.0, 1.5), (-4.0, 2.0, 2.0)]


@book.query(
    "flt_f23_segment_collision",
    f"""WITH {MAPS}, s AS (SELECT map_id, pt_id, x, y, unnest(generate_series(0, 9)) / 9.0::DOUBLE AS t FROM mp),
  h AS (SELECT map_id, pt_id, bool_or({" OR ".join(f"sqrt(pow(x * t - ({a}), 2) + pow(y * t - ({b}), 2)) <= {r}" for a, b, r in _CIRCLES)}) AS hit FROM s GROUP BY ALL)
  SELECT map_id, CAST(count_if(hit) AS BIGINT) AS n_hit, count(*) AS n FROM h GROUP BY map_id""",
)
def segment_collision(spark: SparkSession, sf: str) -> DataFrame:
    """Segments from the origin to each map point that touch a circle, by 10 samples, both ends inclusive."""
    def touches(t):
        part = t / 9.0
        hit = F.lit(False)
        for a, b, r in _CIRCLES:
            hit = hit | (F.sqrt(F.pow(F.col("x") * part - a, F.lit(2)) + F.pow(F.col("y") * part - b, F.lit(2))) <= r)
        return hit

    m = map_points(spark, sf).withColumn("hit", F.exists(F.sequence(F.lit(0), F.lit(9)), touches))
    return m.groupBy("map_id").agg(F.count_if("hit").alias("n_hit"), F.count(F.lit(1)).alias("n"))


QUERIES, SQL = book.queries, book.sql
