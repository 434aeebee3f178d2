"""Joins: as-of in both directions, nearest neighbours, distance, offset and lookup joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions import geometry as G
from aerolith.functions.timeunits import TO_NS_SQL, to_ns, usable_reading, usable_sql
from aerolith.operators import spatial as S
from aerolith.operators import voxel as V
from aerolith.operators.asof import bracket
from aerolith.plans.book import FRAMES, POINTS, WORLD, Book, frames, points, r6, world
from aerolith.plans.lattice import KEY, LATTICE, R, Lattice, ball_sql, poses
from aerolith.plans.scalar import _SCANS, scans
from aerolith.runtime import table

book = Book()


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Usable imu and gps readings and complete states, once per sample_id, with ns."""
    s = table(spark, sf, "sensor_sample").where("vehicle is not null and ts_ns is not null")
    state = (F.col("sensor") == "state") & (F.size("v") == 7)
    s = s.where(usable_reading(F.col("sensor"), F.col("v")) | F.coalesce(state, F.lit(False)))
    return s.select("sample_id", "vehicle", "sensor", "v", to_ns(F.col("ts_ns")).alias("ns")).dropDuplicates(["sample_id"])


_READ = f"rd AS (SELECT DISTINCT ON (sample_id) sample_id, vehicle, sensor, v, {TO_NS_SQL.format('ts_ns')} AS ns FROM sensor_sample WHERE vehicle IS NOT NULL AND ts_ns IS NOT NULL AND ({usable_sql('sensor', 'v')} OR (sensor = 'state' AND len(v) = 7)))"


def _one_time(sensor: str, name: str, pick: str) -> str:
    return f"{name} AS (SELECT vehicle, ns, {pick}(v, sample_id) AS v, {pick}(sample_id, sample_id) AS sid FROM rd WHERE sensor = '{sensor}' GROUP BY vehicle, ns)"


_TWO = ", ".join(_one_time(s, f"{s}_b", "arg_max") + ", " + _one_time(s, f"{s}_a", "arg_min") for s in ("imu", "gps", "state"))


def _asof(sensors: tuple[str, ...]) -> str:
    cols = ", ".join(f"{s}1.ns AS {s}_bns, {s}1.v AS {s}_bv, {s}1.sid AS {s}_bid, {s}2.ns AS {s}_ans, {s}2.v AS {s}_av, {s}2.sid AS {s}_aid" for s in sensors)
    joins = " ".join(f"ASOF LEFT JOIN {s}_b {s}1 ON sc.vehicle = {s}1.vehicle AND sc.ns >= {s}1.ns ASOF LEFT JOIN {s}_a {s}2 ON sc.vehicle = {s}2.vehicle AND sc.ns < {s}2.ns" for s in sensors)
    return f"{_SCANS}, {_READ}, {_TWO}, j AS (SELECT sc.scan_id, sc.recording, sc.vehicle, sc.ns, {cols} FROM sc {joins})"


SENSORS = ["imu", "gps", "state"]


def bracketed(spark: SparkSession, sf: str, kinds: list[str], values: bool = True) -> DataFrame:
    """Scans with their brackets; without ``values`` only ids and times travel."""
    sc = scans(spark, sf).select("scan_id", "recording", "vehicle", "ns")
    what = F.struct("sample_id", "v") if values else F.struct("sample_id")
    return bracket(sc, readings(spark, sf).where(F.col("sensor").isin(kinds)), "vehicle", "ns", F.col("sensor"), kinds, what, F.col("sample_id"))


@book.query("join_j01_bracket", f"WITH {_asof(('imu',))} SELECT scan_id, imu_bid AS before_id, imu_aid AS after_id FROM j")
def j01(spark: SparkSession, sf: str) -> DataFrame:
    """The imu readings just before and after each scan."""
    return bracketed(spark, sf, ["imu"], False).select("scan_id", F.col("before_imu.v.sample_id").alias("before_id"), F.col("after_imu.v.sample_id").alias("after_id"))


@book.query("join_j02_guarded_bracket", f"WITH {_asof(('gps',))}, n AS (SELECT vehicle, count(*) AS n FROM rd WHERE sensor = 'gps' GROUP BY vehicle) SELECT scan_id, CASE WHEN n.n >= 2 THEN coalesce(gps_bid, gps_aid) END AS before_id, CASE WHEN n.n >= 2 THEN coalesce(gps_aid, gps_bid) END AS after_id FROM j LEFT JOIN n ON j.vehicle = n.vehicle")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    """At the ends of the series both sides are the end reading; a vehicle with fewer than two readings has none."""
    n = readings(spark, sf).where("sensor = 'gps'").groupBy("vehicle").agg(F.count(F.lit(1)).alias("n"))
    b = bracketed(spark, sf, ["gps"], False).join(n, "vehicle", "left")
    before, after, enough = F.col("before_gps.v.sample_id"), F.col("after_gps.v.sample_id"), F.col("n") >= 2
    return b.select("scan_id", F.when(enough, F.coalesce(before, after)).alias("before_id"), F.when(enough, F.coalesce(after, before)).alias("after_id"))


@book.query("join_j03_carry_forward", f"WITH {_asof(('gps', 'state'))} SELECT scan_id, gps_bid AS gps_id, state_bid AS state_id FROM j")
def j03(spark: SparkSession, sf: str) -> DataFrame:
    """The latest state and GPS fix at each scan, however old."""
    b = bracketed(spark, sf, ["gps", "state"], False)
    return b.select("scan_id", F.col("before_gps.v.sample_id").alias("gps_id"), F.col("before_state.v.sample_id").alias("state_id"))


@book.query("join_j04_three_sensors", f"WITH {_asof(('imu', 'gps', 'state'))} SELECT scan_id, " + ", ".join(f"{s}_bid AS {s}_before, {s}_aid AS {s}_after" for s in ("imu", "gps", "state")) + " FROM j")
def j04(spark: SparkSession, sf: str) -> DataFrame:
    """State, imu and GPS brackets of each scan in one pass."""
    b = bracketed(spark, sf, SENSORS, False)
    return b.select("scan_id", *[F.col(f"{side}_{s}.v.sample_id").alias(f"{s}_{side}") for s in SENSORS for side in ("before", "after")])


_PART = "CASE WHEN {0}_ans > {0}_bns THEN least(1, greatest(0, CAST(ns - {0}_bns AS DOUBLE) / ({0}_ans - {0}_bns))) ELSE 0 END"


@book.query(
    "fn_p07_interpolate_vector",
    f"WITH {_asof(('imu',))} SELECT scan_id, " + ", ".join(f"round(imu_bv[{i}] + (imu_av[{i}] - imu_bv[{i}]) * ({_PART.format('imu')}), 6) AS {n}" for i, n in enumerate(("wx", "wy", "wz"), 1)) + " FROM j WHERE imu_bid IS NOT NULL AND imu_aid IS NOT NULL",
)
def p07(spark: SparkSession, sf: str) -> DataFrame:
    """Angular velocity at scan time, on the line between both readings."""
    b = bracketed(spark, sf, ["imu"]).where("before_imu is not null and after_imu is not null")
    part = G.part_between(F.col("ns"), F.col("before_imu.ts"), F.col("after_imu.ts"))
    a, z = F.col("before_imu.v.v"), F.col("after_imu.v.v")
    v = G.lerp(G.Vec(a[0], a[1], a[2]), G.Vec(z[0], z[1], z[2]), part)
    return b.select("scan_id", *v.named("wx", "wy", "wz", 6))


def with_pose(b: DataFrame) -> DataFrame:
    """Adds px..pz and qw..qz at ``ns`` to rows with both states."""
    part = G.part_between(F.col("ns"), F.col("before_state.ts"), F.col("after_state.ts"))
    a, z = F.col("before_state.v.v"), F.col("after_state.v.v")
    p = G.lerp(G.Vec(a[0], a[1], a[2]), G.Vec(z[0], z[1], z[2]), F.col("part"))
    ends = {f"s{n}": a[i] for i, n in enumerate("wxyz", 3)} | {f"e{n}": z[i] for i, n in enumerate("wxyz", 3)}
    d = b.withColumn("part", part).withColumns(ends | {"px": p.x, "py": p.y, "pz": p.z})
    return G.slerp(d, "s", "e", F.col("part")).drop(*ends, "part")


_UNIT = ", ".join(f"sqrt({v}[4] * {v}[4] + {v}[5] * {v}[5] + {v}[6] * {v}[6] + {v}[7] * {v}[7]) AS n_{v}" for v in ("state_bv", "state_av"))
_SLERP = f"""sa AS (SELECT *, {_UNIT}, {_PART.format('state')} AS t FROM j WHERE state_bid IS NOT NULL AND state_aid IS NOT NULL),
sb AS (SELECT scan_id, ns, t, state_bns, state_ans, state_bv AS a, state_av AS z, """ + ", ".join(f"CASE WHEN n_state_bv > 0 THEN state_bv[{i}] / n_state_bv ELSE {d} END AS a{i}, CASE WHEN n_state_av > 0 THEN state_av[{i}] / n_state_av ELSE {d} END AS z{i}" for i, d in ((4, 1), (5, 0), (6, 0), (7, 0))) + """ FROM sa),
sd AS (SELECT *, a4 * z4 + a5 * z5 + a6 * z6 + a7 * z7 AS dot FROM sb),
se AS (SELECT *, acos(least(1, abs(dot))) AS ang, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS sg FROM sd),
sf AS (SELECT *, CASE WHEN abs(dot) > 0.9999999 THEN 1 - t ELSE sin((1 - t) * ang) / sin(ang) END AS ka, sg * CASE WHEN abs(dot) > 0.9999999 THEN t ELSE sin(t * ang) / sin(ang) END AS kb FROM se),
sg AS (SELECT *, sqrt(pow(a4 * ka + z4 * kb, 2) + pow(a5 * ka + z5 * kb, 2) + pow(a6 * ka + z6 * kb, 2) + pow(a7 * ka + z7 * kb, 2)) AS nn FROM sf),
pose AS (SELECT scan_id, ns, t, state_bns, state_ans, """ + ", ".join(f"a[{i}] + (z[{i}] - a[{i}]) * t AS p{n}" for i, n in ((1, "x"), (2, "y"), (3, "z"))) + ", " + ", ".join(f"(a{i} * ka + z{i} * kb) / nn AS q{n}" for i, n in ((4, "w"), (5, "x"), (6, "y"), (7, "z"))) + " FROM sg)"


@book.query("fn_p08_interpolate_pose", f"WITH {_asof(('state',))}, {_SLERP} SELECT scan_id, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz, round(qw, 6) AS qw, round(qx, 6) AS qx, round(qy, 6) AS qy, round(qz, 6) AS qz FROM pose")
def p08(spark: SparkSession, sf: str) -> DataFrame:
    """The vehicle's pose at scan time: position on the line, orientation along the arc."""
    b = bracketed(spark, sf, ["state"]).where("before_state is not null and after_state is not null")
    return with_pose(b).select("scan_id", *[r6(F.col(c)).alias(c) for c in ("px", "py", "pz", "qw", "qx", "qy", "qz")])


@book.query("fn_p10_bracket_gaps", f"WITH {_asof(('state',))} SELECT scan_id, round(least(ns - state_bns, state_ans - ns) / 1e6, 6) AS near_ms, round(greatest(ns - state_bns, state_ans - ns) / 1e6, 6) AS far_ms FROM j WHERE state_bid IS NOT NULL AND state_aid IS NOT NULL")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    b = bracketed(spark, sf, ["state"], False).where("before_state is not null and after_state is not null")
    x, y = F.col("ns") - F.col("before_state.ts"), F.col("after_state.ts") - F.col("ns")
    return b.select("scan_id", r6(F.least(x, y) / 1e6).alias("near_ms"), r6(F.greatest(x, y) / 1e6).alias("far_ms"))


@book.query(
    "flt_f08_bracket_quality",
    f"""WITH {_asof(('state',))}, g AS (SELECT scan_id, least(ns - state_bns, state_ans - ns) / 1e6 AS near_ms, greatest(ns - state_bns, state_ans - ns) / 1e6 AS far_ms, state_bid IS NULL OR state_aid IS NULL AS none FROM j)
  SELECT scan_id, CASE WHEN none THEN 'no bracket' WHEN near_ms > 10 THEN 'near too far' WHEN far_ms > 20 THEN 'far too far' ELSE 'good' END AS verdict FROM g""",
)
def f08(spark: SparkSession, sf: str) -> DataFrame:
    """Brackets whose near edge is over 10 ms away or far edge over 20 ms are dropped, with the reason."""
    b = bracketed(spark, sf, ["state"], False)
    x, y = (F.col("ns") - F.col("before_state.ts")) / 1e6, (F.col("after_state.ts") - F.col("ns")) / 1e6
    none = F.col("before_state").isNull() | F.col("after_state").isNull()
    return b.select("scan_id", F.when(none, "no bracket").when(F.least(x, y) > 10, "near too far").when(F.greatest(x, y) > 20, "far too far").otherwise("good").alias("verdict"))


@book.query("fn_p09_imu_orientation_lerp", f"WITH {_asof(('imu',))} SELECT scan_id, " + ", ".join(f"round(imu_bv[{i}] + (imu_av[{i}] - imu_bv[{i}]) * ({_PART.format('imu')}), 6) AS o{n}" for i, n in ((7, "w"), (8, "x"), (9, "y"), (10, "z"))) + " FROM j WHERE len(imu_bv) = 10 AND len(imu_av) = 10")
def p09(spark: SparkSession, sf: str) -> DataFrame:
    """The imu's own orientation, which goes along the line and not along the arc."""
    b = bracketed(spark, sf, ["imu"]).where((F.size("before_imu.v.v") == 10) & (F.size("after_imu.v.v") == 10))
    part = G.part_between(F.col("ns"), F.col("before_imu.ts"), F.col("after_imu.ts"))
    a, z = F.col("before_imu.v.v"), F.col("after_imu.v.v")
    return b.select("scan_id", *[r6(a[i] + (z[i] - a[i]) * part).alias(f"o{n}") for i, n in ((6, "w"), (7, "x"), (8, "y"), (9, "z"))])


_VEL = "(z[{0}] - a[{0}]) / ((state_ans - state_bns) / 1e9)"


@book.query(
    "fn_p11_back_projection",
    f"""WITH {_asof(('state',))}, v AS (SELECT scan_id, state_av AS z, state_bv AS a, state_bns, state_ans, (state_ans - ns) / 1e9 AS dt FROM j WHERE state_bid IS NOT NULL AND state_aid IS NOT NULL AND state_ans > state_bns)
  SELECT scan_id, """ + ", ".join(f"round(CASE WHEN abs(dt) > 0.001 THEN z[{i}] - {_VEL.format(i)} * dt ELSE z[{i}] END, 6) AS p{n}" for i, n in ((1, "x"), (2, "y"), (3, "z"))) + " FROM v",
)
def p11(spark: SparkSession, sf: str) -> DataFrame:
    """The later state taken back to scan time by constant velocity."""
    b = bracketed(spark, sf, ["state"]).where("before_state is not null and after_state is not null and after_state.ts > before_state.ts")
    a, z = F.col("before_state.v.v"), F.col("after_state.v.v")
    span = (F.col("after_state.ts") - F.col("before_state.ts")) / 1e9
    at, before = G.Vec(z[0], z[1], z[2]), G.Vec(a[0], a[1], a[2])
    none = G.Vec(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    _, p = G.back_projected(G.Quat(z[3], z[4], z[5], z[6]).unit(), at, (at - before).times(1 / span), none, (F.col("after_state.ts") - F.col("ns")) / 1e9)
    return b.select("scan_id", *p.named("px", "py", "pz", 6))


# Nearest neighbours: points of a recording's even frames against those of its odd frames.


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """World points of even and of odd frames: (recording, pid, x, y, z), ``pid`` the file and the place in it."""
    p = world(spark, sf).select("recording", "frame_id", "x", "y", "z", F.struct("file_id", "pt_id").alias("pid"))
    return p.where("frame_id % 2 = 0").drop("frame_id"), p.where("frame_id % 2 = 1").drop("frame_id")


HALVES = f"""{WORLD}, al AS (SELECT recording, frame_id, file_id, CAST(pt_id AS BIGINT) AS pt_id, {{'file_id': file_id, 'pt_id': CAST(pt_id AS BIGINT)}} AS pid, x, y, z FROM pt),
ev AS (SELECT * FROM al WHERE frame_id % 2 = 0), od AS (SELECT * FROM al WHERE frame_id % 2 = 1),
pr AS (SELECT e.recording, e.pid AS ep, o.pid AS op, (e.x - o.x) * (e.x - o.x) + (e.y - o.y) * (e.y - o.y) + (e.z - o.z) * (e.z - o.z) AS d2 FROM ev e JOIN od o USING (recording)),
n1 AS (SELECT recording, ep AS pid, arg_min(op, (d2, op)) AS other, sqrt(min(d2)) AS dist FROM pr GROUP BY ALL),
n2 AS (SELECT recording, op AS pid, arg_min(ep, (d2, ep)) AS other, sqrt(min(d2)) AS dist FROM pr GROUP BY ALL)"""

IDS = "pid.file_id AS file_id, pid.pt_id AS pt_id"
OTHER = "other.file_id AS other_file, other.pt_id AS other_pt"


def ids(*more: str) -> list[Column]:
    """The parts of ``pid``, and of ``other`` if named."""
    out = [F.col("pid.file_id").alias("file_id"), F.col("pid.pt_id").alias("pt_id")]
    return out + [c for m in more for c in (F.col(f"{m}.file_id").alias(f"{m}_file"), F.col(f"{m}.pt_id").alias(f"{m}_pt"))]


@book.query("join_j05_nearest", f"WITH {HALVES} SELECT recording, {IDS}, {OTHER}, round(dist, 6) AS dist FROM n1")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    ev, od = halves(spark, sf)
    return S.nearest(ev, od.withColumnRenamed("pid", "other"), ["recording"], "pid", "other", 4.0).select("recording", *ids("other"), r6(F.col("dist")).alias("dist"))


@book.query(
    "join_j06_far_from_poses",
    f"""WITH {WORLD} SELECT file_id, CAST(pt_id AS BIGINT) AS pt_id FROM pt WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.recording = pt.recording AND pow(pt.x - fr.px, 2) + pow(pt.y - fr.py, 2) + pow(pt.z - fr.pz, 2) <= 25.0)""",
)
def j06(spark: SparkSession, sf: str) -> DataFrame:
    """World points farther than 5 m from every pose of their recording."""
    others = frames(spark, sf).select("recording", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    return S.far_from(world(spark, sf), others, 5.0, ["recording"]).select("file_id", "pt_id")


@book.query(
    "join_j08_nearest_mean",
    f"""WITH {POINTS}, c AS (SELECT recording, CAST(floor(x / 4.0) AS BIGINT) AS i, CAST(floor(y / 4.0) AS BIGINT) AS j, CAST(floor(z / 4.0) AS BIGINT) AS k, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(z), 6) AS mz FROM pt GROUP BY ALL)
  SELECT pt.file_id, CAST(pt.pt_id AS BIGINT) AS pt_id, round(sqrt(min(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))), 4) AS dist FROM pt JOIN c USING (recording) GROUP BY ALL""",
)
def j08(spark: SparkSession, sf: str) -> DataFrame:
    """Each point's distance to the nearest cell mean of its recording, which need not be its own cell's."""
    p = points(spark, sf)
    c = p.groupBy("recording", *[V.cell(F.col(a), 4.0).alias(i) for a, i in zip("xyz", "ijk")]).agg(*[r6(F.avg(a)).alias(f"m{a}") for a in "xyz"])
    means = c.select("recording", F.xxhash64("i", "j", "k").alias("cell"), *[F.col(f"m{a}").alias(a) for a in "xyz"])
    q = p.select("recording", "x", "y", "z", F.struct("file_id", "pt_id").alias("pid"))
    return S.nearest(q, means, ["recording"], "pid", "cell", 3.0).select("pid.file_id", "pid.pt_id", F.round("dist", 4).alias("dist"))


@book.query(
    "join_j09_radius_top_k",
    f"""WITH {HALVES}, r AS (SELECT recording, ep AS pid, op AS other, row_number() OVER (PARTITION BY recording, ep ORDER BY d2, op) AS rn FROM pr WHERE d2 <= 36) SELECT recording, {IDS}, {OTHER}, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 5""",
)
def j09(spark: SparkSession, sf: str) -> DataFrame:
    """Up to 5 nearest points within 6 m: the neighbourhoods of normals and features."""
    ev, od = halves(spark, sf)
    w = Window.partitionBy("recording", "pid").orderBy("d2", "other")
    near = S.within(ev, od.withColumnRenamed("pid", "other"), 6.0, ["recording"], "pid", "other")
    return near.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("recording", *ids("other"), "rn")


@book.query("join_j13_revisited", f"WITH {FRAMES} SELECT file_id, EXISTS (SELECT 1 FROM fr b WHERE b.recording = a.recording AND b.file_id < a.file_id AND pow(a.px - b.px, 2) + pow(a.py - b.py, 2) + pow(a.pz - b.pz, 2) <= 16.0) AS revisited FROM fr a")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    """Is an earlier pose of the recording within 4 m."""
    f = frames(spark, sf).select("recording", "file_id", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    near = S.within(f, f.withColumnRenamed("file_id", "earlier"), 4.0, ["recording"], "file_id", "earlier").where("earlier < file_id").select("file_id").distinct()
    return f.join(near.withColumn("r", F.lit(True)), "file_id", "left").select("file_id", F.coalesce("r", F.lit(False)).alias("revisited"))


_LOOP = f"{FRAMES}, one AS (SELECT recording, frame_id, file_id, px, py, pz, row_number() OVER (PARTITION BY recording ORDER BY frame_id) - 1 AS idx FROM (SELECT *, row_number() OVER (PARTITION BY recording, frame_id ORDER BY file_id) AS rn FROM fr) WHERE rn = 1)"

# A loop joins frames so many apart in order, whose poses lie so near, and is looked for at every so manieth frame.
APART, NEAR_M, EVERY = 15, 50.0, 10


def one_pose(spark: SparkSession, sf: str) -> DataFrame:
    """One pose per frame number, of its smallest file, with its place ``idx`` in the recording: (recording, frame_id, file_id, x, y, z, idx)."""
    f = frames(spark, sf).groupBy("recording", "frame_id").agg(F.min("file_id").alias("file_id"), *[F.min_by(f"p{a}", "file_id").alias(a) for a in "xyz"])
    return f.withColumn("idx", (F.row_number().over(Window.partitionBy("recording").orderBy("frame_id")) - 1).cast("bigint"))


def loop_candidates(spark: SparkSession, sf: str, every: int = EVERY) -> DataFrame:
    """(recording, idx, before, d2): frames at which a loop is looked for, with the earlier ones that are far enough back and near enough. Cells bound the self-join."""
    f = one_pose(spark, sf).select("recording", "idx", "x", "y", "z")
    late = f.where((F.col("idx") > APART) & (F.col("idx") % every == 0))
    return S.within(late, f.withColumnRenamed("idx", "before"), NEAR_M, ["recording"], "idx", "before").where(F.col("before") <= F.col("idx") - APART)


_CANDIDATES = f"{_LOOP}, lc AS (SELECT a.recording, a.idx, b.idx AS before, pow(a.px - b.px, 2) + pow(a.py - b.py, 2) + pow(a.pz - b.pz, 2) AS d2 FROM one a JOIN one b ON a.recording = b.recording AND b.idx <= a.idx - {APART} WHERE a.idx > {APART} AND pow(a.px - b.px, 2) + pow(a.py - b.py, 2) + pow(a.pz - b.pz, 2) <= {NEAR_M * NEAR_M})"


@book.query("join_j14_loop_closures", f"WITH {_CANDIDATES} SELECT recording, idx, arg_min(before, (d2, before)) AS best, min(before) AS first_one, round(sqrt(min(d2)), 6) AS dist FROM lc GROUP BY recording, idx")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    """Of every frame the nearest and the first of the earlier frames that it may close a loop with."""
    c = loop_candidates(spark, sf, 1)
    return c.groupBy("recording", "idx").agg(F.min_by("before", F.struct("d2", "before")).alias("best"), F.min("before").alias("first_one"), r6(F.sqrt(F.min("d2"))).alias("dist"))


@book.query("flt_f20_loop_gates", f"WITH {_CANDIDATES} SELECT recording, count(*) AS n FROM lc WHERE idx % {EVERY} = 0 GROUP BY recording")
def f20(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that pass the gates of order and place; those of fitness and error follow in flt_f20_loop_closures."""
    return loop_candidates(spark, sf).groupBy("recording").agg(F.count(F.lit(1)).alias("n"))


@book.query("join_j15_positional", f"WITH {_SCANS}, a AS (SELECT recording, scan_id, row_number() OVER (PARTITION BY recording ORDER BY ns, scan_id) AS pos FROM sc), b AS (SELECT recording, file_id, row_number() OVER (PARTITION BY recording ORDER BY lidar_ts, file_id) AS pos FROM lidar_frame) SELECT recording, CAST(pos AS INTEGER) AS pos, scan_id, file_id FROM a LEFT JOIN b USING (recording, pos)")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    """Scans and stored frames of a recording zipped by position; a scan without a frame keeps null."""
    a = scans(spark, sf).select("recording", "scan_id", F.row_number().over(Window.partitionBy("recording").orderBy("ns", "scan_id")).alias("pos"))
    b = table(spark, sf, "lidar_frame").select("recording", "file_id", F.row_number().over(Window.partitionBy("recording").orderBy("lidar_ts", "file_id")).alias("pos"))
    return a.join(b, ["recording", "pos"], "left").select("recording", "pos", "scan_id", "file_id")


@book.query("join_j16_by_label", "WITH a AS (SELECT method, round(avg(total_time), 6) AS mean_time FROM benchmark_run WHERE status = 'OK' GROUP BY method), b AS (SELECT r.method, count(*) AS frames FROM benchmark_run r JOIN frame_timing t USING (run_id) GROUP BY r.method) SELECT method, mean_time, frames FROM a JOIN b USING (method)")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    """Run metrics and frame timings joined by method label, each aggregated first."""
    r = table(spark, sf, "benchmark_run")
    a = r.where("status = 'OK'").groupBy("method").agg(r6(F.avg("total_time")).alias("mean_time"))
    per_run = table(spark, sf, "frame_timing").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return a.join(r.join(per_run, "run_id").groupBy("method").agg(F.sum("n").alias("frames")), "method")


_J17 = f"""{_LOOP}, an AS (SELECT recording, frame_id // 4 AS submap, arg_min(px, frame_id) AS ax, arg_min(py, frame_id) AS ay, arg_min(pz, frame_id) AS az FROM one GROUP BY ALL),
co AS (SELECT recording, submap, ax + 1 AS cx, ay + 1 AS cy, az + 1 AS cz FROM an WHERE submap % 2 = 0)"""


@book.query("join_j17_corrected_anchors", f"WITH {_J17} SELECT an.recording, an.submap, round(coalesce(cx, ax), 6) AS x, round(coalesce(cy, ay), 6) AS y, round(coalesce(cz, az), 6) AS z FROM an LEFT JOIN co USING (recording, submap)")
def j17(spark: SparkSession, sf: str) -> DataFrame:
    """Submap anchors with their corrected pose, or the stored one where there is none."""
    f = one_pose(spark, sf).withColumn("submap", F.expr("frame_id div 4"))
    an = f.groupBy("recording", "submap").agg(*[F.min_by(a, "frame_id").alias(f"a{a}") for a in "xyz"])
    co = an.where("submap % 2 = 0").select("recording", "submap", *[(F.col(f"a{a}") + 1).alias(f"c{a}") for a in "xyz"])
    return an.join(co, ["recording", "submap"], "left").select("recording", "submap", *[r6(F.coalesce(f"c{a}", f"a{a}")).alias(a) for a in "xyz"])


@book.query("join_j18_run_plan", "SELECT recording, method, noise_tag FROM (SELECT DISTINCT recording FROM benchmark_run), (SELECT DISTINCT method FROM benchmark_run), (SELECT DISTINCT noise_tag FROM benchmark_run WHERE noise_tag IS NOT NULL)")
def j18(spark: SparkSession, sf: str) -> DataFrame:
    """Runs to make: every recording with the methods and noise levels, which are short fixed lists held as arrays."""
    b = table(spark, sf, "benchmark_run")
    lists = b.agg(F.collect_set("method").alias("methods"), F.collect_set("noise_tag").alias("tags")).first()
    return b.select("recording").distinct().select("recording", F.explode(F.array(*map(F.lit, lists["methods"]))).alias("method")).select("recording", "method", F.explode(F.array(*map(F.lit, lists["tags"]))).alias("noise_tag"))


#: Names of registration methods and the family each belongs to; several names may share one.
METHODS = {"state_only": "none", "icp_p2l": "icp", "icp_gicp": "gicp", "gicp": "gicp", "ndt": "ndt", "fpfh_ransac": "feature", "small_gicp": "gicp", "vgicp": "gicp", "kiss_icp": "icp"}


@book.query("join_j19_registry", "SELECT run_id, method, CASE lower(trim(method)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METHODS.items()) + " END AS family FROM benchmark_run")
def j19(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])
    return table(spark, sf, "benchmark_run").select("run_id", "method", F.try_element_at(names, F.lower(F.trim("method"))).alias("family"))


@book.query("join_j23_nearest_tree_node", "WITH t AS (SELECT event_id AS node, (event_id * 7919 % 1000) / 100.0::DOUBLE AS x, (event_id * 104729 % 1000) / 100.0::DOUBLE AS y FROM events WHERE event_type = 'view'), s AS (SELECT event_id AS sample, (event_id * 15485863 % 1000) / 100.0::DOUBLE AS x, (event_id * 32452843 % 1000) / 100.0::DOUBLE AS y FROM events WHERE event_type = 'error') SELECT sample, round(sqrt(min((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y))), 6) AS dist FROM s, t GROUP BY sample")
def j23(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest node of a tree in the plane for each sample: one step of growth for all samples at once."""
    e = table(spark, sf, "events")

    def placed(kind: str, name: str, a: int, b: int) -> DataFrame:
        at = [(F.col("event_id") * f % 1000 / 100.0).alias(c) for f, c in ((a, "x"), (b, "y"))]
        return e.where(F.col("event_type") == kind).select(F.col("event_id").alias(name), *at, F.lit(0.0).alias("z"))

    n = S.nearest(placed("error", "sample", 15485863, 32452843), placed("view", "node", 7919, 104729), [], "sample", "node", 0.25)
    return n.select("sample", r6(F.col("dist")).alias("dist"))


@book.query("src_s13_replay_carry_forward", f"WITH {_asof(('state', 'gps'))} SELECT scan_id, ns - state_bns AS odom_age_ns, ns - gps_bns AS gps_age_ns FROM j")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    """How old the latest odometry and GPS are at each scan, carried to it as in the replay of a recording."""
    b = bracketed(spark, sf, ["state", "gps"], False)
    return b.select("scan_id", (F.col("ns") - F.col("before_state.ts")).alias("odom_age_ns"), (F.col("ns") - F.col("before_gps.ts")).alias("gps_age_ns"))


def occupied(spark: SparkSession, sf: str, resolution: float = 1.0) -> DataFrame:
    """Occupied cells of the world per recording: (recording, i, j, k)."""
    return world(spark, sf).select("recording", *[V.cell(F.col(a), resolution).alias(i) for a, i in zip("xyz", "ijk")]).distinct()


OCC = f"{WORLD}, oc AS (SELECT DISTINCT recording, CAST(floor(x) AS BIGINT) AS i, CAST(floor(y) AS BIGINT) AS j, CAST(floor(z) AS BIGINT) AS k FROM pt)"


@book.query("join_j20_clearance", f"WITH {OCC} SELECT f.file_id, round(sqrt(min(pow(i + 0.5 - px, 2) + pow(j + 0.5 - py, 2) + pow(k + 0.5 - pz, 2))), 6) AS clearance FROM fr f JOIN oc o ON f.recording = o.recording AND abs(o.i - floor(px)) <= 5 AND abs(o.j - floor(py)) <= 5 AND abs(o.k - floor(pz)) <= 5 GROUP BY f.file_id")
def j20(spark: SparkSession, sf: str) -> DataFrame:
    """Each pose's distance to the nearest occupied cell centre in the 11^3 cells around it; poses without one have no row."""
    box = 6.0
    o = occupied(spark, sf).select("recording", F.col("i"), F.col("j"), F.col("k"), *[F.floor(F.col(c) / box).alias(f"b{c}") for c in "ijk"])
    f = frames(spark, sf).select("file_id", "recording", "px", "py", "pz", *[F.floor(F.col(f"p{a}")).cast("bigint").alias(f"f{c}") for a, c in zip("xyz", "ijk")])
    for c in "ijk":
        lo, hi = F.floor((F.col(f"f{c}") - 5) / box), F.floor((F.col(f"f{c}") + 5) / box)
        f = f.withColumn(f"b{c}", F.explode(F.sequence(lo, hi)))
    near = f.join(o, ["recording", "bi", "bj", "bk"]).where(" and ".join(f"abs({c} - f{c}) <= 5" for c in "ijk"))
    d2 = sum((F.pow(F.col(c) + 0.5 - F.col(f"p{a}"), F.lit(2)) for a, c in zip("xyz", "ijk")), F.lit(0.0))
    return near.groupBy("file_id").agg(r6(F.sqrt(F.min(d2))).alias("clearance"))


_BOX = "bx AS (SELECT recording, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, min(k) AS k0, max(k) AS k1 FROM oc GROUP BY recording)"


@book.query("join_j21_inflate_ball", f"WITH {OCC}, {_BOX} SELECT DISTINCT recording, i + di AS i, j + dj AS j, k + dk AS k FROM oc JOIN bx USING (recording), {ball_sql(S.offsets(2))} WHERE i + di BETWEEN i0 AND i1 AND j + dj BETWEEN j0 AND j1 AND k + dk BETWEEN k0 AND k1")
def j21(spark: SparkSession, sf: str) -> DataFrame:
    """Occupied cells of each recording grown by a ball of 2 cells, clipped to its grid, which ends where its occupied cells do."""
    o = occupied(spark, sf)
    box = o.groupBy("recording").agg(*[c for i in "ijk" for c in (F.min(i).alias(f"{i}0"), F.max(i).alias(f"{i}1"))])
    inside = " and ".join(f"{i} between {i}0 and {i}1" for i in "ijk")
    return S.shifted(o, S.offsets(2), group=R).join(box, "recording").where(inside).select(*KEY)


@book.query("join_j22_inflate_cross", f"WITH {OCC} SELECT DISTINCT recording, i + di AS i, j + dj AS j, k + dk AS k FROM oc, {ball_sql(S.offsets(2, 'cross'))}")
def j22(spark: SparkSession, sf: str) -> DataFrame:
    """Grown twice over the six faces, as one join with the Manhattan ball of 2."""
    return S.shifted(occupied(spark, sf), S.offsets(2, "cross"), group=R)


@book.query("join_j12_frontier", f"WITH {LATTICE} SELECT recording, i, j, k FROM fo")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    """Free cells with an unknown face neighbour; cells beyond the grid are not unknown."""
    return Lattice(spark, sf).frontier


@book.query("flt_f10_traversable", f"WITH {LATTICE} SELECT file_id, ob.i IS NOT NULL AND NOT ob.occ AS traversable FROM po0 LEFT JOIN ob USING (recording, i, j, k)")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    """Is the cell of each pose observed and free; unknown cells are impassable."""
    return poses(spark, sf).join(Lattice(spark, sf).observed, KEY, "left").select("file_id", F.coalesce(~F.col("occ"), F.lit(False)).alias("traversable"))


@book.query("flt_f11_unknown_is_free", f"WITH {LATTICE} SELECT file_id FROM po0 LEFT JOIN ob USING (recording, i, j, k) WHERE ob.i IS NULL OR NOT ob.occ")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    """The older rule: only occupied cells are impassable."""
    return poses(spark, sf).join(Lattice(spark, sf).occupied, KEY, "left_anti").select("file_id")


QUERIES, SQL = book.queries, book.sql
