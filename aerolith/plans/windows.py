"""Order-dependent operators, sorting, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions import geometry as G
from aerolith.functions import labels as L
from aerolith.operators import folds, paths
from aerolith.operators import voxel as V
from aerolith.plans.aggregates import IJK, candidates, steps
from aerolith.plans.book import MAPS, POINTS, Book, frames, map_points, points, r6, WORLD, WORLD_MAPS, world, world_map_points
from aerolith.plans.joins import HALVES, IDS, halves, ids
from aerolith.plans.lattice import CELL_M, LATTICE, R, Lattice, poses
from aerolith.plans.scalar import _SCANS, scans
from aerolith.runtime import table

book = Book()
Z80 = 1.2815515655446008  # normal quantile of (1 + 0.80) / 2 = 0.90

_GATE = """o AS (SELECT user_id, event_id, value AS s, value % 97 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT user_id, event_id, rn, s <= 0 AS still, false AS rejected, CASE WHEN s > 0 THEN [s] ELSE [] END AS hs, CASE WHEN s > 0 THEN [t] ELSE [] END AS ht FROM o WHERE rn = 1
  UNION ALL SELECT * EXCLUDE (s, t, bad), FROM (SELECT o.user_id, o.event_id, o.rn, o.s <= 0 AS still, x.bad AS rejected, CASE WHEN x.bad OR o.s <= 0 THEN g.hs ELSE list_append(g.hs, o.s) END AS hs, CASE WHEN x.bad OR o.s <= 0 THEN g.ht ELSE list_append(g.ht, o.t) END AS ht, o.s, o.t, x.bad
    FROM g JOIN o ON o.user_id = g.user_id AND o.rn = g.rn + 1, LATERAL (SELECT o.s > 0 AND len(g.hs) >= 7 AND o.s > list_avg(g.hs) + {z} * list_stddev_samp(g.hs) AND o.t > list_avg(g.ht) + {z} * list_stddev_samp(g.ht) AS bad) x))"""
GATE = _GATE.format(z=Z80)


def gated(spark: SparkSession, sf: str) -> DataFrame:
    """The gate over events: a user is a recording, its value the shift, its value modulo 97 the turn."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("value").alias("s"), (F.col("value") % 97).alias("t"))
    return folds.outlier_gate(e, "user_id", ["ts", "event_id"], "s", "t", Z80, 7)


@book.query("win_w01_outlier_gate", f"WITH RECURSIVE {GATE} SELECT user_id, count(*) AS n, CAST(count_if(rejected) AS BIGINT) AS n_rejected, CAST(sum(CASE WHEN rejected THEN event_id ELSE 0 END) AS BIGINT) AS id_sum FROM g GROUP BY user_id")
def w01(spark: SparkSession, sf: str) -> DataFrame:
    g = gated(spark, sf)
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("rejected").alias("n_rejected"), F.sum(F.when(F.col("rejected"), F.col("event_id")).otherwise(0)).alias("id_sum"))


@book.query("win_w02_first_seen", f"WITH {WORLD}, c AS (SELECT DISTINCT recording, frame_id, {IJK.format('4.0')} FROM pt) SELECT recording, frame_id, i, j, k, min(frame_id) OVER (PARTITION BY recording, i, j, k) = frame_id AS first_time FROM c")
def w02(spark: SparkSession, sf: str) -> DataFrame:
    c = world(spark, sf).select("recording", "frame_id", *[V.cell(F.col(a), 4.0).alias(i) for a, i in zip("xyz", "ijk")]).distinct()
    return c.withColumn("first_time", F.min("frame_id").over(Window.partitionBy("recording", "i", "j", "k")) == F.col("frame_id"))


_PATH = f"{_SCANS}, pa AS (SELECT recording AS path, row_number() OVER (PARTITION BY recording ORDER BY ns, scan_id) AS seq, scan_id, position.x AS x, position.y AS y, position.z AS z FROM sc WHERE position IS NOT NULL AND position.x IS NOT NULL AND position.y IS NOT NULL AND position.z IS NOT NULL)"


def path(spark: SparkSession, sf: str) -> DataFrame:
    """Scan positions of a recording as a path: (path, seq, scan_id, x, y, z)."""
    s = scans(spark, sf).where("position.x is not null and position.y is not null and position.z is not null")
    return s.select(F.col("recording").alias("path"), F.row_number().over(Window.partitionBy("recording").orderBy("ns", "scan_id")).cast("bigint").alias("seq"), "scan_id", "position.x", "position.y", "position.z")


@book.query("win_w03_path_steps", f"WITH {_PATH} SELECT path, seq, round(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 6) AS step FROM pa WINDOW w AS (PARTITION BY path ORDER BY seq)")
def w03(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("path").orderBy("seq")
    d = G.Vec(*[F.col(a) - F.lag(a).over(w) for a in "xyz"])
    return path(spark, sf).select("path", "seq", r6(d.norm()).alias("step"))


_SUB = f"""{_PATH}, kp AS (SELECT path, seq, x AS kx, y AS ky, z AS kz, true AS kept FROM pa WHERE seq = 1
  UNION ALL SELECT p.path, p.seq, CASE WHEN b.far THEN p.x ELSE k.kx END, CASE WHEN b.far THEN p.y ELSE k.ky END, CASE WHEN b.far THEN p.z ELSE k.kz END, b.far FROM kp k JOIN pa p ON p.path = k.path AND p.seq = k.seq + 1, LATERAL (SELECT sqrt(pow(p.x - k.kx, 2) + pow(p.y - k.ky, 2) + pow(p.z - k.kz, 2)) >= 3.0 AS far) b),
en AS (SELECT path, max(seq) AS last FROM pa GROUP BY path)"""


@book.query("win_w04_subsample_path", f"WITH RECURSIVE {_SUB} SELECT path, seq FROM kp JOIN en USING (path) WHERE kept OR seq = last")
def w04(spark: SparkSession, sf: str) -> DataFrame:
    """Waypoints at least 3 m from the last kept one; the first and the last always stay."""
    p = path(spark, sf)
    end = p.groupBy("path").agg(F.max("seq").alias("last"))
    kept = folds.spaced(p, "path", "seq", ("x", "y", "z"), 3.0)
    return kept.join(end, "path").where("kept or seq = last").select("path", "seq")


@book.query("flt_f18_rate_limit", "WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), k AS (SELECT user_id, event_id, rn, us AS last, true AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.event_id, o.rn, CASE WHEN o.us - k.last >= 36000000000 THEN o.us ELSE k.last END, o.us - k.last >= 36000000000 FROM k JOIN o ON o.user_id = k.user_id AND o.rn = k.rn + 1) SELECT user_id, event_id FROM k WHERE kept")
def f18(spark: SparkSession, sf: str) -> DataFrame:
    """Events at least 10 hours after the last kept one of their user."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return folds.rate_limited(e, "user_id", "us", "event_id", 36_000_000_000).where("kept").select("user_id", "event_id")


#: The curve keeps about so many of its points.
CURVE = 5000


@book.query("win_w05_ecdf", f"WITH {HALVES}, rk AS (SELECT recording, pid, row_number() OVER (PARTITION BY recording ORDER BY dist, pid) AS rank, count(*) OVER (PARTITION BY recording) AS n FROM n1) SELECT recording, {IDS}, round(rank / n, 9) AS cdf FROM rk WHERE (rank - 1) % greatest(1, n // {CURVE}) = 0")
def w05(spark: SparkSession, sf: str) -> DataFrame:
    """Empirical distribution of nearest-neighbour distances, distinct steps on ties, thinned to about CURVE points.

    Ranks are counted in two levels, within bins of distance and over the bins, so no recording lies in one task.
    """
    from aerolith.operators.spatial import nearest

    ev, od = halves(spark, sf)
    n = nearest(ev, od.withColumnRenamed("pid", "other"), R, "pid", "other", 4.0).withColumn("bin", F.floor(F.col("dist") * 8))
    per = n.groupBy("recording", "bin").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("recording")
    below = per.select("recording", "bin", (F.sum("m").over(w.orderBy("bin")) - F.col("m")).alias("below"), F.sum("m").over(w).alias("n"))
    ranked = n.withColumn("r", F.row_number().over(Window.partitionBy("recording", "bin").orderBy("dist", "pid"))).join(below, ["recording", "bin"])
    ranked = ranked.withColumn("rank", F.col("below") + F.col("r")).where((F.col("rank") - 1) % F.greatest(F.lit(1), F.expr(f"n div {CURVE}")) == 0)
    return ranked.select("recording", *ids(), F.round(F.col("rank") / F.col("n"), 9).alias("cdf"))


_SHARED = """xs AS (SELECT unnest(generate_series(0, 50)) * 10.0::DOUBLE AS x), q AS (SELECT user_id, event_type AS method, value AS d FROM events),
c AS (SELECT method, user_id, x, CAST(count_if(d <= x) AS DOUBLE) / count(*) AS cdf FROM q, xs GROUP BY ALL)"""


def shared_cdf(spark: SparkSession, sf: str) -> DataFrame:
    """(method, user_id, x, cdf) at 51 shared positions: one counting pass per run, then a running sum over its few bins."""
    e = table(spark, sf, "events")
    at = F.greatest(F.lit(0), F.ceil(F.col("value") / 10.0)).cast("bigint")
    n = e.groupBy(F.col("event_type").alias("method"), "user_id", F.least(F.lit(51), at).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("method", "user_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    per = per.select("method", "user_id", "total", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(50).cast("bigint"))).alias("b"))
    w = Window.partitionBy("method", "user_id").orderBy("b")
    upto = F.sum(F.coalesce(F.try_element_at("m", "b"), F.lit(0))).over(w)
    return per.select("method", "user_id", (F.col("b") * 10.0).alias("x"), (upto / F.col("total")).alias("cdf"))


@book.query("win_w06_mean_cdf", f"WITH {_SHARED} SELECT method, x, round(avg(cdf), 9) AS mean_cdf, round(coalesce(stddev_samp(cdf), 0), 9) AS std_cdf FROM c GROUP BY method, x")
def w06(spark: SparkSession, sf: str) -> DataFrame:
    return shared_cdf(spark, sf).groupBy("method", "x").agg(F.round(F.avg("cdf"), 9).alias("mean_cdf"), F.round(F.coalesce(F.stddev_samp("cdf"), F.lit(0.0)), 9).alias("std_cdf"))


@book.query("win_w07_methods_by_cdf", f"WITH {_SHARED}, m AS (SELECT method, round(avg(cdf), 9) AS at_tau FROM c WHERE x = 100 GROUP BY method) SELECT method, at_tau, CAST(row_number() OVER (ORDER BY at_tau DESC, method) AS INTEGER) AS place FROM m")
def w07(spark: SparkSession, sf: str) -> DataFrame:
    m = shared_cdf(spark, sf).where("x = 100").groupBy("method").agg(F.round(F.avg("cdf"), 9).alias("at_tau"))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc("at_tau"), "method")))


_DENSE = f"""{_PATH}, sg AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM pa WINDOW w AS (PARTITION BY path ORDER BY seq)),
sl AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2) + pow(nz - z, 2)) AS seg FROM sg),
sn AS (SELECT *, coalesce(sum(seg) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, CASE WHEN seg IS NULL THEN 1 ELSE greatest(1, CAST(ceil(seg / 0.5) AS INTEGER)) END AS n FROM sl),
de AS (SELECT path, seq, sub, CASE WHEN seg IS NULL THEN x ELSE x + (nx - x) * (sub / n) END AS x, CASE WHEN seg IS NULL THEN y ELSE y + (ny - y) * (sub / n) END AS y, CASE WHEN seg IS NULL THEN z ELSE z + (nz - z) * (sub / n) END AS z, before + coalesce(seg, 0) * (sub / n) AS arc
  FROM (SELECT *, unnest(generate_series(0, n - 1)) AS sub FROM sn))"""


@book.query("win_w08_densify_path", f"WITH {_DENSE} SELECT path, seq, CAST(sub AS INTEGER) AS sub, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(arc, 6) AS arc FROM de")
def w08(spark: SparkSession, sf: str) -> DataFrame:
    d = paths.densified(path(spark, sf), "path", "seq", 0.5)
    return d.select("path", "seq", "sub", *[r6(F.col(c)).alias(c) for c in ("x", "y", "z", "arc")])


# The path to follow has every fourth scan position; the recorded trajectory has all of them.
_TRACK = _DENSE.replace("pa AS (SELECT", "al AS (SELECT", 1).replace(", sg AS", ", pa AS (SELECT path, (seq - 1) // 4 AS seq, x, y, z FROM al WHERE (seq - 1) % 4 = 0), sg AS", 1)


def coarse(spark: SparkSession, sf: str) -> DataFrame:
    return path(spark, sf).where("(seq - 1) % 4 = 0").select("path", F.expr("(seq - 1) div 4").alias("seq"), "x", "y", "z")


@book.query(
    "win_w09_trajectory_error",
    f"""WITH {_TRACK}, en AS (SELECT path, max(seq) AS last FROM pa GROUP BY path), pr AS (SELECT a.path, a.scan_id, d.seq, d.sub, pow(a.x - d.x, 2) + pow(a.y - d.y, 2) + pow(a.z - d.z, 2) AS d2 FROM al a JOIN de d USING (path))
  SELECT path, scan_id, round(sqrt(min(d2)), 6) AS error FROM pr GROUP BY path, scan_id""",
)
def w09(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every recorded position from the densified coarse path."""
    e = paths.trajectory_error(path(spark, sf), coarse(spark, sf), "path", "seq", "scan_id", 0.5)
    return e.select("path", "scan_id", r6(F.col("error")).alias("error"))


_TURN = """tu AS (SELECT path, seq, x, y, z, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, z - lag(z) OVER w AS az, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS b_y, lead(z) OVER w - z AS bz FROM pa WINDOW w AS (PARTITION BY path ORDER BY seq)),
ch AS (SELECT path, seq, x, y, z FROM tu WHERE sqrt(ax * ax + ay * ay + az * az) >= 1e-9 AND sqrt(bx * bx + b_y * b_y + bz * bz) >= 1e-9 AND (ax * bx + ay * b_y + az * bz) / (sqrt(ax * ax + ay * ay + az * az) * sqrt(bx * bx + b_y * b_y + bz * bz)) < cos(radians(3.0)))"""


@book.query("win_w03_direction_changes", f"WITH {_PATH}, {_TURN} SELECT path, seq FROM ch")
def w03b(spark: SparkSession, sf: str) -> DataFrame:
    return paths.direction_changes(path(spark, sf), "path", "seq").select("path", "seq")


@book.query("join_j11_change_samples", f"WITH {_TRACK}, {_TURN} SELECT c.path, c.seq, arg_min(a.scan_id, (pow(a.x - c.x, 2) + pow(a.y - c.y, 2) + pow(a.z - c.z, 2), a.scan_id)) AS scan_id FROM ch c JOIN al a USING (path) GROUP BY c.path, c.seq")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded position nearest to each turn of the coarse path."""
    from aerolith.operators.spatial import nearest

    turns = paths.direction_changes(coarse(spark, sf), "path", "seq")
    return nearest(turns, path(spark, sf).drop("seq"), ["path"], "seq", "scan_id", 0.5).select("path", "seq", "scan_id")


@book.query("join_j10_nearest_path_sample", f"WITH {_TRACK}, pr AS (SELECT a.path, a.scan_id, d.seq, d.sub, pow(a.x - d.x, 2) + pow(a.y - d.y, 2) + pow(a.z - d.z, 2) AS d2 FROM al a JOIN de d USING (path)) SELECT path, count(*) AS n, round(max(d), 6) AS worst FROM (SELECT path, scan_id, sqrt(min(d2)) AS d FROM pr GROUP BY path, scan_id) GROUP BY path")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    e = paths.trajectory_error(path(spark, sf), coarse(spark, sf), "path", "seq", "scan_id", 0.5)
    return e.groupBy("path").agg(F.count(F.lit(1)).alias("n"), r6(F.max("error")).alias("worst"))


@book.query("win_w10_submaps", f"WITH RECURSIVE {GATE}, r AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY rn) - 1) // 10 AS submap, rn FROM g WHERE NOT rejected) SELECT user_id, submap, count(*) AS n, arg_min(event_id, rn) AS anchor FROM r GROUP BY user_id, submap")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    """A new submap after every 10 accepted frames; its anchor is the first of them."""
    g = gated(spark, sf).where("not rejected")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    r = g.withColumn("submap", F.floor((pos - 1) / 10).cast("bigint"))
    return r.groupBy("user_id", "submap").agg(F.count(F.lit(1)).alias("n"), F.min_by("event_id", F.struct("ts", "event_id")).alias("anchor"))


@book.query("win_w11_sliding_pairs", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 6) AS err FROM events")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    """A window of two observations as the prediction of the next, and its error."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, -1)
    return table(spark, sf, "events").select("event_id", r6(F.col("value") - F.avg("value").over(w)).alias("err"))


@book.query("win_w12_every_k", f"WITH {_PATH} SELECT path, seq FROM (SELECT path, seq, max(seq) OVER (PARTITION BY path) AS last FROM pa) WHERE seq % 5 = 0 OR seq = last")
def w12(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth scan, and the last one."""
    p = path(spark, sf).select("path", "seq")
    return p.join(p.groupBy("path").agg(F.max("seq").alias("last")), "path").where("seq % 5 = 0 or seq = last").select("path", "seq")


@book.query("win_w13_marker_size", "SELECT event_id, round(5 + 20 * CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6) AS size FROM events WINDOW w AS (PARTITION BY user_id)")
def w13(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ends = e.groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    part = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return e.join(ends, "user_id").select("event_id", r6(5 + 20 * part).alias("size"))


_OBST = [(5.0, 5.0, 2.0), (15.0, 10.0, 3.0), (-5.0, 8.0, 2.5)]
_HIT = " OR ".join(f"sqrt(pow(a.x + (b.x - a.x) * (i / 9.0::DOUBLE) - ({x}), 2) + pow(a.y + (b.y - a.y) * (i / 9.0::DOUBLE) - ({y}), 2)) <= {r}" for x, y, r in _OBST)


@book.query(
    "win_w14_shortcuts",
    f"""WITH RECURSIVE {_PATH}, fr2 AS (SELECT a.path, a.seq AS s, b.seq AS t, bool_or({_HIT}) AS hit FROM pa a JOIN pa b ON a.path = b.path AND b.seq > a.seq, generate_series(0, 9) g(i) GROUP BY ALL),
  fa AS (SELECT path, s, max(t) AS t FROM fr2 WHERE NOT hit OR t = s + 1 GROUP BY path, s), ho AS (SELECT path, min(s) AS seq, 0 AS hop FROM fa GROUP BY path UNION ALL SELECT ho.path, fa.t, hop + 1 FROM ho JOIN fa ON fa.path = ho.path AND fa.s = ho.seq)
  SELECT path, seq, hop FROM ho""",
)
def w14(spark: SparkSession, sf: str) -> DataFrame:
    """Paths cut short by the farthest waypoint in free sight."""
    return paths.shortcuts(path(spark, sf), "path", "seq", _OBST).select("path", "seq", "hop")


# Sorting, limits and sampling


@book.query("ord_o01_densest_columns", f"WITH {LATTICE} SELECT recording, i, j, n FROM (SELECT recording, i, j, count(*) AS n FROM un GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY recording ORDER BY n DESC, i, j) <= 20")
def o01(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 columns of each recording with most unknown cells; ties by index."""
    c = Lattice(spark, sf).unknown.groupBy("recording", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("recording").orderBy(F.desc("n"), "i", "j")
    return c.withColumn("rn", F.row_number().over(w)).where("rn <= 20").drop("rn")


@book.query("ord_o02_best_candidate", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS best, max(value) AS score FROM events GROUP BY user_id")
def o02(spark: SparkSession, sf: str) -> DataFrame:
    """The best-scored row per user, the first on ties."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"), F.max("value").alias("score"))


@book.query("ord_o03_nearest_frontier", f"WITH {LATTICE} SELECT f.file_id, round(sqrt(min(pow(fo.i + 0.5 - x, 2) + pow(fo.j + 0.5 - y, 2) + pow(fo.k + 0.5 - z, 2))) * {CELL_M}, 6) AS dist FROM po0 f JOIN fo USING (recording) GROUP BY f.file_id")
def o03(spark: SparkSession, sf: str) -> DataFrame:
    """Metres from each pose to the nearest frontier cell of its recording: the fallback target."""
    from aerolith.operators.spatial import nearest

    goal = Lattice(spark, sf).frontier.select("recording", F.struct("i", "j", "k").alias("cell"), *[(F.col(i) + 0.5).alias(a) for i, a in zip("ijk", "xyz")])
    return nearest(poses(spark, sf), goal, R, "file_id", "cell", 2.0).select("file_id", r6(F.col("dist") * CELL_M).alias("dist"))


_NAT = "n AS (SELECT DISTINCT map_id, folder, regexp_replace(regexp_replace(regexp_replace(folder, '^[A-Za-z_]*[0-9]+_', ''), '_noise_[0-9.]+cm_[0-9.]+deg$', ''), '_clean$', '') AS method, coalesce(CAST(nullif(regexp_extract(folder, 'noise_([0-9.]+)cm_([0-9.]+)deg', 1), '') AS DOUBLE), -1) AS cm, coalesce(CAST(nullif(regexp_extract(folder, 'noise_([0-9.]+)cm_([0-9.]+)deg', 2), '') AS DOUBLE), -1) AS deg FROM slam_map)"


@book.query("ord_o04_natural_sort", f"WITH {_NAT} SELECT map_id, method, cm, deg FROM n ORDER BY method, cm, deg, map_id")
def o04(spark: SparkSession, sf: str) -> DataFrame:
    """Maps by method and numeric noise, clean ones first."""
    m = table(spark, sf, "slam_map").select("map_id", "folder").distinct()
    none = F.lit(-1.0)
    return m.select("map_id", L.method_name(F.col("folder")).alias("method"), F.coalesce(L.noise_cm(F.col("folder")), none).alias("cm"), F.coalesce(L.noise_deg(F.col("folder")), none).alias("deg")).orderBy("method", "cm", "deg", "map_id")


@book.query("ord_o05_scored_order", "SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS place FROM events")
def o05(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("place"))


@book.query("ord_o06_capped_sample")
def o06(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded uniform sample of at most 1000 points by hash order: the sampling operator itself, the same on every run."""
    p = points(spark, sf).select("file_id", "pt_id", "x", "y", "z")
    return p.orderBy(F.xxhash64("file_id", "pt_id", F.lit(42)), "file_id", "pt_id").limit(1000)


@book.query("ord_o07_sample_per_map")
def o07(spark: SparkSession, sf: str) -> DataFrame:
    """At most 8 points of every map, by hash order; the limit applies before the exchange too."""
    m = map_points(spark, sf)
    w = Window.partitionBy("map_id").orderBy(F.xxhash64("map_id", "pt_id", F.lit(7)), "pt_id")
    return m.withColumn("rn", F.row_number().over(w)).where("rn <= 8").select("map_id", "pt_id", "x", "y", "z")


@book.query("ord_o08_budget_scale", "SELECT user_id AS trial, CAST(round_even(CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) * 500.0::DOUBLE / 120, 0) AS BIGINT) AS scaled FROM events GROUP BY user_id")
def o08(spark: SparkSession, sf: str) -> DataFrame:
    """Visible counts of a ray budget scaled up, halves to even."""
    return candidates(spark, sf).groupBy("trial").agg(F.bround(F.sum("gen") * 500.0 / 120, 0).cast("bigint").alias("scaled"))


@book.query("ord_o09_every_nth", "SELECT recording, file_id FROM (SELECT recording, file_id, row_number() OVER (PARTITION BY recording ORDER BY path) AS rn FROM lidar_frame) WHERE (rn - 1) % 3 = 0 AND (rn - 1) // 3 < 4")
def o09(spark: SparkSession, sf: str) -> DataFrame:
    """Every third file of a recording by path, the first four of those: skip and cap of a replay."""
    w = Window.partitionBy("recording").orderBy("path")
    f = table(spark, sf, "lidar_frame").select("recording", "file_id", F.row_number().over(w).alias("rn")).where("rn <= 12")
    return f.where("(rn - 1) % 3 = 0").select("recording", "file_id")


@book.query("ord_o10_last_n", f"WITH {_PATH} SELECT path, seq FROM (SELECT path, seq, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS rn FROM pa) WHERE rn <= 5")
def o10(spark: SparkSession, sf: str) -> DataFrame:
    """The last five of each ring buffer."""
    w = Window.partitionBy("path").orderBy(F.desc("seq"))
    return path(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("path", "seq")


@book.query("ord_o11_first_per_cell", f"WITH {POINTS} SELECT file_id, {IJK.format('4.0')}, CAST(min(pt_id) AS BIGINT) AS pt_id FROM pt GROUP BY file_id, i, j, k")
def o11(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).groupBy("file_id", *[V.cell(F.col(a), 4.0).alias(i) for a, i in zip("xyz", "ijk")]).agg(F.min("pt_id").alias("pt_id"))


# Set operations

_CELLS = f"{WORLD}, ce AS (SELECT DISTINCT recording, frame_id, {IJK.format('4.0')} FROM pt)"


def frame_cells(spark: SparkSession, sf: str) -> DataFrame:
    return world(spark, sf).select("recording", "frame_id", *[V.cell(F.col(a), 4.0).alias(i) for a, i in zip("xyz", "ijk")]).distinct()


@book.query("set_u01_new_keys", f"WITH {_CELLS} SELECT DISTINCT recording, i, j, k FROM ce WHERE frame_id >= 5 EXCEPT SELECT recording, i, j, k FROM ce WHERE frame_id < 5")
def u01(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the later frames that the earlier ones had not seen."""
    c, key = frame_cells(spark, sf), ["recording", "i", "j", "k"]
    return c.where("frame_id >= 5").select(*key).distinct().join(c.where("frame_id < 5").select(*key).distinct(), key, "left_anti")


@book.query("set_u02_seen_keys", f"WITH {_CELLS} SELECT recording, i, j, k FROM ce WHERE frame_id < 5 UNION SELECT recording, i, j, k FROM ce WHERE frame_id >= 5")
def u02(spark: SparkSession, sf: str) -> DataFrame:
    c, key = frame_cells(spark, sf), ["recording", "i", "j", "k"]
    return c.where("frame_id < 5").select(*key).union(c.where("frame_id >= 5").select(*key)).distinct()


@book.query("set_u03_concat_clouds", f"WITH {POINTS}, {MAPS} SELECT recording, count(*) AS n FROM (SELECT recording FROM pt UNION ALL SELECT recording FROM mp) GROUP BY recording")
def u03(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("recording").unionByName(map_points(spark, sf).select("recording")).groupBy("recording").agg(F.count(F.lit(1)).alias("n"))


@book.query("set_u04_merge_maps", f"WITH {WORLD}, {WORLD_MAPS}, al AS (SELECT recording, x, y, z FROM pt UNION ALL SELECT recording, x, y, z FROM mp), a AS (SELECT recording, {IJK.format('0.5')} FROM al), n AS (SELECT recording, count(DISTINCT (i, j, k)) AS n1 FROM a GROUP BY recording), b AS (SELECT recording, {IJK.format('1.0')} FROM al), m AS (SELECT recording, count(DISTINCT (i, j, k)) AS n2 FROM b GROUP BY recording) SELECT recording, CASE WHEN n1 > 200 THEN n2 ELSE n1 END AS n_cells, n1 > 200 AS coarser FROM n JOIN m USING (recording)")
def u04(spark: SparkSession, sf: str) -> DataFrame:
    """Clouds merged and voxelised; maps of more than 200 cells at twice the cell size, from the finer cells."""
    both = world(spark, sf).select("recording", "x", "y", "z").unionByName(world_map_points(spark, sf).select("recording", "x", "y", "z"))
    fine = both.select("recording", *[V.cell(F.col(a), 0.5).alias(i) for a, i in zip("xyz", "ijk")]).distinct()
    n1 = fine.groupBy("recording").agg(F.count(F.lit(1)).alias("n1"))
    n2 = fine.select("recording", *[F.floor(F.col(i) / 2).alias(i) for i in "ijk"]).distinct().groupBy("recording").agg(F.count(F.lit(1)).alias("n2"))
    return n1.join(n2, "recording").select("recording", F.when(F.col("n1") > 200, F.col("n2")).otherwise(F.col("n1")).alias("n_cells"), (F.col("n1") > 200).alias("coarser"))


@book.query("set_u05_mask_algebra", f"WITH {LATTICE} SELECT recording, i, j, k, CASE WHEN occ THEN 'occupied' ELSE 'free' END AS state FROM ob UNION ALL SELECT recording, i, j, k, 'unknown' FROM un")
def u05(spark: SparkSession, sf: str) -> DataFrame:
    lat = Lattice(spark, sf)
    ob = lat.observed.select("recording", "i", "j", "k", F.when(F.col("occ"), "occupied").otherwise("free").alias("state"))
    return ob.unionByName(lat.unknown.withColumn("state", F.lit("unknown")))


@book.query("set_u06_candidate_pool", f"WITH {WORLD}, {WORLD_MAPS}, po AS (SELECT 0 AS src, file_id AS id, pt_id AS pt, x, y, z FROM pt UNION ALL SELECT 1, map_id, pt_id, x, y, z FROM mp) SELECT CAST(round_even(x / 2.0, 0) AS BIGINT) AS i, CAST(round_even(y / 2.0, 0) AS BIGINT) AS j, CAST(round_even(greatest(-15, least(0, z)) / 2.0, 0) AS BIGINT) AS k, min(src) AS src, arg_min(id, (src, id, pt)) AS id, CAST(arg_min(pt, (src, id, pt)) AS BIGINT) AS pt FROM po GROUP BY ALL")
def u06(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of two generators, heights clamped, snapped to 2 m with halves to even; the first of a snap stays."""
    a = world(spark, sf).select(F.lit(0).alias("src"), F.col("file_id").alias("id"), F.col("pt_id").alias("pt"), "x", "y", "z")
    b = world_map_points(spark, sf).select(F.lit(1).alias("src"), F.col("map_id").alias("id"), F.col("pt_id").alias("pt"), "x", "y", "z")
    p = a.unionByName(b).withColumn("z", F.greatest(F.lit(-15.0), F.least(F.lit(0.0), F.col("z"))))
    snap = [F.bround(F.col(c) / 2.0, 0).cast("bigint").alias(i) for c, i in zip("xyz", "ijk")]
    return p.groupBy(*snap).agg(F.min(F.struct("src", "id", "pt")).alias("first")).select("i", "j", "k", "first.*")


@book.query("set_u07_step_names", "SELECT DISTINCT step FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS step FROM frame_timing WHERE {s} >= 0 AND isfinite({s})" for s in ("t_transform_ms", "t_get_vis_ms", "t_local_crop_ms", "t_register_total_ms", "t_gtsam_ms", "t_octo_insert_ms", "t_vox_track_ms", "t_vis_ms")) + ")")
def u07(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).select("step").distinct()


QUERIES, SQL = book.queries, book.sql
