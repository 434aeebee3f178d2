"""Aggregations over maps, timings, trials, logs and flights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions import geometry as G
from aerolith.functions import labels as L
from aerolith.functions.timeunits import TO_NS_SQL, to_ns
from aerolith.operators import spatial as S
from aerolith.operators import summaries as A
from aerolith.operators import voxel as V
from aerolith.plans.book import FRAMES, MAPS, POINTS, Book, frames, map_points, points, r6, WORLD, world
from aerolith.plans.joins import HALVES, _asof, bracketed, halves, with_pose
from aerolith.plans.joins import _SLERP as SLERP
from aerolith.plans.lattice import KEY, LATTICE, Lattice, poses
from aerolith.plans.scalar import _SCANS, scans
from aerolith.runtime import table

book = Book()
IJK = "CAST(floor(x / {0}) AS BIGINT) AS i, CAST(floor(y / {0}) AS BIGINT) AS j, CAST(floor(z / {0}) AS BIGINT) AS k"


@book.query("agg_a01_new_voxels", f"WITH {WORLD}, f AS (SELECT recording, {IJK.format('2.0')}, min(frame_id) AS frame_id FROM pt GROUP BY recording, i, j, k) SELECT recording, frame_id, count(*) AS n_new FROM f GROUP BY recording, frame_id")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    """How many voxels each frame sees for the first time in its recording."""
    return A.first_seen(world(spark, sf), ["recording"], "frame_id", 2.0).groupBy("recording", F.col("first").alias("frame_id")).agg(F.count(F.lit(1)).alias("n_new"))


@book.query("agg_a01_lineitem_voxels", "WITH f AS (SELECT CAST(floor(l_quantity / 2.5) AS BIGINT) AS i, CAST(floor(l_discount * 100 / 2.5) AS BIGINT) AS j, CAST(floor(l_tax * 100 / 2.5) AS BIGINT) AS k, min(l_orderkey) AS o FROM lineitem GROUP BY ALL) SELECT o AS frame, count(*) AS n_new FROM f GROUP BY o")
def a01b(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))
    cells = li.groupBy(*[F.floor(F.col(a) / 2.5).cast("bigint").alias(i) for a, i in zip("xyz", "ijk")]).agg(F.min("l_orderkey").alias("frame"))
    return cells.groupBy("frame").agg(F.count(F.lit(1)).alias("n_new"))


@book.query("agg_a02_voxel_mean", f"WITH {WORLD} SELECT recording, {IJK.format('4.0')}, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(z), 6) AS mz, count(*) AS n FROM pt GROUP BY recording, i, j, k")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    d = A.downsample(world(spark, sf), ["recording"], 4.0)
    return d.select("recording", "i", "j", "k", *[r6(F.col(a)).alias(f"m{a}") for a in "xyz"], "n")


_COV = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


@book.query(
    "agg_a03_cell_gaussians",
    f"""WITH {MAPS}, c AS (SELECT {IJK.format('8.0')}, count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(z), 6) AS mz, """
    + ", ".join(f"covar_samp({a}, {b}){' + 0.001' if a == b else ''} AS c{a}{b}" for a, b in _COV)
    + """ FROM mp GROUP BY i, j, k HAVING count(*) >= 5),
  d AS (SELECT *, cxx * (cyy * czz - cyz * cyz) - cxy * (cxy * czz - cyz * cxz) + cxz * (cxy * cyz - cyy * cxz) AS det FROM c)
  SELECT i, j, k, n, mx, my, mz, round((cyy * czz - cyz * cyz) / det, 4) AS ixx, round((cxx * czz - cxz * cxz) / det, 4) AS iyy, round((cxx * cyy - cxy * cxy) / det, 4) AS izz FROM d WHERE det > 1e-9""",
)
def a03(spark: SparkSession, sf: str) -> DataFrame:
    """Cells as Gaussians: mean, and the inverse of the sample covariance plus 0.001 on its diagonal."""
    m = map_points(spark, sf)
    cov = [(F.covar_samp(a, b) + (0.001 if a == b else 0.0)).alias(f"c{a}{b}") for a, b in _COV]
    c = m.groupBy(*[F.floor(F.col(a) / 8.0).cast("bigint").alias(i) for a, i in zip("xyz", "ijk")]).agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(a)).alias(f"m{a}") for a in "xyz"], *cov).where("n >= 5")
    c = c.withColumn("det", F.expr("cxx * (cyy * czz - cyz * cyz) - cxy * (cxy * czz - cyz * cxz) + cxz * (cxy * cyz - cyy * cxz)")).where("det > 1e-9")
    inv = {"ixx": "(cyy * czz - cyz * cyz)", "iyy": "(cxx * czz - cxz * cxz)", "izz": "(cxx * cyy - cxy * cxy)"}
    return c.select("i", "j", "k", "n", "mx", "my", "mz", *[F.round(F.expr(f"{e} / det"), 4).alias(n) for n, e in inv.items()])


RINGS, SECTORS, REACH = 20, 60, 80.0
_RING = f"CAST(least({RINGS - 1}, floor(sqrt(x * x + y * y) / {REACH / RINGS})) AS INTEGER) AS ring, CAST(least({SECTORS - 1}, floor((atan2(CASE WHEN y = 0 THEN 0 ELSE y END, x) + pi()) / (2 * pi() / {SECTORS}))) AS INTEGER) AS sector"
CONTEXT = f"""{WORLD}, ct AS (SELECT file_id, x - px AS x, y - py AS y, z - pz AS z FROM pt),
co AS (SELECT file_id, {_RING}, max(z) AS h FROM ct WHERE sqrt(x * x + y * y) < {REACH} GROUP BY ALL)"""


def scan_context(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, ring, sector, h): highest point per ring and sector around the sensor, in the directions of the world; bins without a point are 0 and have no row."""
    p = world(spark, sf).select("file_id", *[(F.col(a) - F.col(f"p{a}")).alias(a) for a in "xyz"])
    p = p.withColumn("d", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).where(F.col("d") < REACH)
    ring = F.least(F.lit(RINGS - 1), F.floor(F.col("d") / (REACH / RINGS))).cast("int")
    turn = F.atan2(F.when(F.col("y") == 0, 0.0).otherwise(F.col("y")), "x") + F.pi()
    sector = F.least(F.lit(SECTORS - 1), F.floor(turn / (2 * F.pi() / SECTORS))).cast("int")
    return p.groupBy("file_id", ring.alias("ring"), sector.alias("sector")).agg(F.max("z").alias("h"))


@book.query("agg_a04_scan_context", f"WITH {CONTEXT} SELECT file_id, ring, sector, h FROM co")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    return scan_context(spark, sf)


@book.query(
    "agg_a05_registration_quality",
    f"""WITH {HALVES} SELECT recording, round(avg(CASE WHEN dist <= 3.0 THEN 1.0 ELSE 0.0 END), 6) AS fitness, round(coalesce(sqrt(avg(CASE WHEN dist <= 3.0 THEN dist * dist END)), 0), 6) AS inlier_rmse,
  round(sqrt(avg(dist * dist)), 6) AS full_rmse, round(avg(dist), 6) AS mean_dist FROM n1 GROUP BY recording""",
)
def a05(spark: SparkSession, sf: str) -> DataFrame:
    """Fitness and errors of all source points, also those without a target near."""
    ev, od = halves(spark, sf)
    n = S.nearest(ev, od.withColumnRenamed("pid", "other"), ["recording"], "pid", "other", 4.0)
    d, near = F.col("dist"), F.col("dist") <= 3.0
    return n.groupBy("recording").agg(
        r6(F.avg(near.cast("double"))).alias("fitness"),
        r6(F.coalesce(F.sqrt(F.avg(F.when(near, d * d))), F.lit(0.0))).alias("inlier_rmse"),
        r6(F.sqrt(F.avg(d * d))).alias("full_rmse"),
        r6(F.avg(d)).alias("mean_dist"),
    )


METRICS = ["rmse_s2g", "rmse_g2s", "rmse_sym", "chamfer", "accuracy", "median_s2g", "median_g2s", "mean_s2g", "mean_g2s", "precision", "recall", "fscore", "completeness"]
TAU = 3.0


def map_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The 15 scalars of a cloud against its truth, per recording."""
    ev, od = halves(spark, sf)
    one = S.nearest(ev, od.withColumnRenamed("pid", "other"), ["recording"], "pid", "other", 4.0)
    two = S.nearest(od, ev.withColumnRenamed("pid", "other"), ["recording"], "pid", "other", 4.0)

    def half(d: DataFrame, s: str) -> DataFrame:
        x = F.col("dist")
        return d.groupBy("recording").agg(F.count(F.lit(1)).alias(f"n_{s}"), F.avg(x * x).alias(f"sq_{s}"), F.avg(x).alias(f"mean_{s}"), F.median(x).alias(f"median_{s}"), F.avg((x <= TAU).cast("double")).alias(f"in_{s}"))

    m = half(one, "s2g").join(half(two, "g2s"), "recording")
    p, r = F.col("in_s2g"), F.col("in_g2s")
    values = {
        "rmse_s2g": F.sqrt("sq_s2g"), "rmse_g2s": F.sqrt("sq_g2s"), "rmse_sym": F.sqrt((F.col("sq_s2g") + F.col("sq_g2s")) / 2), "chamfer": (F.col("mean_s2g") + F.col("mean_g2s")) / 2,
        "accuracy": F.col("mean_s2g"), "median_s2g": F.col("median_s2g"), "median_g2s": F.col("median_g2s"), "mean_s2g": F.col("mean_s2g"), "mean_g2s": F.col("mean_g2s"),
        "precision": p, "recall": r, "fscore": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)), "completeness": r,
    }
    return m.select("recording", F.col("n_s2g").alias("n_slam"), F.col("n_g2s").alias("n_gt"), *[r6(values[k]).alias(k) for k in METRICS])


@book.query(
    "agg_a06_map_metrics",
    f"""WITH {HALVES}, s AS (SELECT recording, count(*) AS n_slam, avg(dist * dist) AS sq, avg(dist) AS me, median(dist) AS md, avg(CASE WHEN dist <= {TAU} THEN 1.0 ELSE 0.0 END) AS p FROM n1 GROUP BY recording),
  g AS (SELECT recording, count(*) AS n_gt, avg(dist * dist) AS gsq, avg(dist) AS gme, median(dist) AS gmd, avg(CASE WHEN dist <= {TAU} THEN 1.0 ELSE 0.0 END) AS r FROM n2 GROUP BY recording)
  SELECT recording, n_slam, n_gt, round(sqrt(sq), 6) AS rmse_s2g, round(sqrt(gsq), 6) AS rmse_g2s, round(sqrt((sq + gsq) / 2), 6) AS rmse_sym, round((me + gme) / 2, 6) AS chamfer, round(me, 6) AS accuracy, round(md, 6) AS median_s2g, round(gmd, 6) AS median_g2s,
    round(me, 6) AS mean_s2g, round(gme, 6) AS mean_g2s, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS fscore, round(r, 6) AS completeness FROM s JOIN g USING (recording)""",
)
def a06(spark: SparkSession, sf: str) -> DataFrame:
    return map_metrics(spark, sf)


STEPS = ["t_transform_ms", "t_get_vis_ms", "t_local_crop_ms", "t_register_total_ms", "t_gtsam_ms", "t_octo_insert_ms", "t_vox_track_ms", "t_vis_ms"]
_STEPS = "st AS (" + " UNION ALL ".join(f"SELECT run_id, '{s}' AS step, {s} / 1000 AS s FROM frame_timing WHERE {s} >= 0 AND isfinite({s})" for s in STEPS) + ")"


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Valid step times in seconds, long form: (run_id, step, s). One scan, no union."""
    t = table(spark, sf, "frame_timing")
    each = F.array(*[F.struct(F.lit(s).alias("step"), (F.col(s) / 1000).alias("s")) for s in STEPS])
    d = t.select("run_id", F.explode(each).alias("e")).select("run_id", "e.step", "e.s")
    return d.where("s >= 0 and s < double('Infinity')")


@book.query("agg_a07_step_timing", f"WITH {_STEPS} SELECT step, round(sum(s), 4) AS total_s, round(avg(s), 6) AS mean_s, max(s) AS max_s, min(s) AS min_s, round(stddev_pop(s), 6) AS std_s, count(*) AS n, round(100 * sum(s) / sum(sum(s)) OVER (), 4) AS pct FROM st GROUP BY step")
def a07(spark: SparkSession, sf: str) -> DataFrame:
    t = A.step_timing(steps(spark, sf), "step", "s")
    return t.select("step", F.round("total_s", 4).alias("total_s"), r6(F.col("mean_s")).alias("mean_s"), "max_s", "min_s", r6(F.col("std_s")).alias("std_s"), "n", F.round("pct", 4).alias("pct"))


_RUNS = "ru AS (SELECT method, coalesce(noise_tag, 'clean') AS noise, voxel_count, CASE WHEN isfinite(plane_residual) THEN plane_residual END AS plane_residual, total_time FROM benchmark_run WHERE status = 'OK')"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    finite = F.when((F.abs("plane_residual") < float("inf")) & ~F.isnan("plane_residual"), F.col("plane_residual"))
    return table(spark, sf, "benchmark_run").where("status = 'OK'").select("method", F.coalesce("noise_tag", F.lit("clean")).alias("noise"), "voxel_count", finite.alias("plane_residual"), "total_time", "recording", "run_id")


@book.query(
    "agg_a08_trials_by_method",
    f"WITH {_RUNS} SELECT method, noise, count(*) AS n_runs, round(avg(plane_residual), 6) AS plane_residual, round(CASE WHEN count(plane_residual) > 0 THEN coalesce(stddev_samp(plane_residual), 0) END, 6) AS plane_residual_std, round(avg(total_time), 6) AS total_time, round(CASE WHEN count(total_time) > 0 THEN coalesce(stddev_samp(total_time), 0) END, 6) AS total_time_std FROM ru GROUP BY method, noise",
)
def a08(spark: SparkSession, sf: str) -> DataFrame:
    return A.trials(runs(spark, sf), ["method", "noise"], ["plane_residual", "total_time"])


@book.query("agg_a08_orders_trials", "SELECT o_orderpriority AS label, o_orderstatus AS noise, count(*) AS n_runs, round(avg(o_totalprice), 4) AS o_totalprice, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS o_totalprice_std FROM orders GROUP BY ALL")
def a08b(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("noise"), "o_totalprice")
    return A.trials(o, ["label", "noise"], ["o_totalprice"], 4)


@book.query("agg_a09_concat_by_method", f"WITH {MAPS}, l AS (SELECT DISTINCT map_id, regexp_replace(regexp_replace(regexp_replace(folder, '^[A-Za-z_]*[0-9]+_', ''), '_noise_[0-9.]+cm_[0-9.]+deg$', ''), '_clean$', '') AS method FROM slam_map) SELECT method, count(DISTINCT map_id) AS n_maps, count(*) AS n_points FROM mp JOIN l USING (map_id) GROUP BY method")
def a09(spark: SparkSession, sf: str) -> DataFrame:
    """Clouds of all maps of a method as one bag; maps are counted from their own table, so no distinct over points."""
    m = table(spark, sf, "slam_map").dropDuplicates(["map_id"])
    n = F.size(F.filter(F.coalesce("points", F.array()), lambda p: p.isNotNull() & ((p.x != 0) | (p.y != 0) | (p.z != 0))))
    d = m.select(L.method_name(F.col("folder")).alias("method"), n.alias("n")).where("n > 0")
    return d.groupBy("method").agg(F.count(F.lit(1)).alias("n_maps"), F.sum("n").alias("n_points"))


@book.query("agg_a10_histogram", "WITH v AS (SELECT value AS v FROM events WHERE value >= 0), t AS (SELECT quantile_cont(v, 0.99) AS top FROM v) SELECT CAST(least(79, floor(v / (top / 79)) + 1) AS BIGINT) AS bin, count(*) AS n FROM v, t WHERE v <= top GROUP BY bin")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    """79 bins from 0 to the exact 99th percentile, the last one closed."""
    e = table(spark, sf, "events").where("value >= 0")
    top = A.exact_quantile(e, "value", 0.99)
    return A.histogram(e, "value", spark.range(1).select(F.lit(top).cast("double").alias("top")), 79)


@book.query("agg_a11_percentiles", "SELECT run_id, round(quantile_cont(t_total_ms, 0.02), 6) AS p2, round(median(t_total_ms), 6) AS p50, round(quantile_cont(t_total_ms, 0.98), 6) AS p98, round(quantile_cont(t_total_ms, 0.99), 6) AS p99 FROM frame_timing WHERE t_total_ms >= 0 AND isfinite(t_total_ms) GROUP BY run_id")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "frame_timing").where("t_total_ms >= 0 and t_total_ms < double('Infinity')")
    p = t.groupBy("run_id").agg(F.percentile("t_total_ms", [0.02, 0.5, 0.98, 0.99]).alias("p"))
    return p.select("run_id", *[r6(F.col("p")[i]).alias(n) for i, n in enumerate(("p2", "p50", "p98", "p99"))])


# Candidate logs, emulated on events: user = trial, type = source of the waypoint, value = number generated.
_CAND = "ca AS (SELECT user_id AS trial, CASE WHEN event_type = 'error' THEN 'none' ELSE event_type END AS source, CAST(floor(value) AS BIGINT) AS gen, event_id FROM events)"


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    source = F.when(F.col("event_type") == "error", "none").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select(F.col("user_id").alias("trial"), source.alias("source"), F.floor("value").cast("bigint").alias("gen"), "event_id", "ts")


@book.query("agg_a12_source_counts", f"WITH {_CAND} SELECT trial, CAST(sum(gen) AS BIGINT) AS generated, " + ", ".join(f"CAST(count_if(source = '{s}') AS BIGINT) AS n_{s}" for s in ("view", "click", "signup", "purchase")) + " FROM ca GROUP BY trial")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    """Selections by source without "none", and all generated with it."""
    return candidates(spark, sf).groupBy("trial").agg(F.sum("gen").alias("generated"), *[F.count_if(F.col("source") == s).alias(f"n_{s}") for s in ("view", "click", "signup", "purchase")])


_LIKE = f"""{_CAND}, g AS (SELECT trial, source, CAST(count(*) AS DOUBLE) AS sel, CAST(sum(gen) AS DOUBLE) AS gen FROM ca WHERE source <> 'none' GROUP BY ALL),
h AS (SELECT trial, source, 100 * sel / sum(sel) OVER w AS pct, CASE WHEN gen > 0 THEN (sel / sum(sel) OVER w) / (gen / sum(gen) OVER w) ELSE 0 END AS likelihood FROM g WINDOW w AS (PARTITION BY trial))"""


def likelihood(spark: SparkSession, sf: str) -> DataFrame:
    g = candidates(spark, sf).where("source <> 'none'").groupBy("trial", "source").agg(F.count(F.lit(1)).cast("double").alias("sel"), F.sum("gen").cast("double").alias("gen"))
    w = Window.partitionBy("trial")
    share = F.col("sel") / F.sum("sel").over(w)
    return g.select("trial", "source", (100 * share).alias("pct"), F.when(F.col("gen") > 0, share / (F.col("gen") / F.sum("gen").over(w))).otherwise(F.lit(0.0)).alias("likelihood"))


@book.query("agg_a13_selection_likelihood", f"WITH {_LIKE} SELECT trial, source, round(pct, 6) AS pct, round(likelihood, 6) AS likelihood FROM h")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return likelihood(spark, sf).select("trial", "source", r6(F.col("pct")).alias("pct"), r6(F.col("likelihood")).alias("likelihood"))


@book.query("agg_a14_likelihood_trials", f"WITH {_LIKE} SELECT source, count(*) AS n_runs, round(avg(pct), 6) AS pct, round(coalesce(stddev_samp(pct), 0), 6) AS pct_std, round(avg(likelihood), 6) AS likelihood, round(coalesce(stddev_samp(likelihood), 0), 6) AS likelihood_std FROM h GROUP BY source")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    return A.trials(likelihood(spark, sf), ["source"], ["pct", "likelihood"])


@book.query("agg_a15_sources_per_step", "SELECT date_trunc('day', ts) AS step, " + ", ".join(f"CAST(count_if(event_type = '{s}') AS BIGINT) AS {s}" for s in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY step")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("step"), "event_type")
    return e.groupBy("step").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1))).na.fill(0)


@book.query("agg_a16_unknown_columns_blocks", f"WITH {LATTICE} SELECT recording, 'column' AS kind, i AS a, j AS b, CAST(0 AS BIGINT) AS c, count(*) AS n FROM un GROUP BY recording, i, j UNION ALL SELECT recording, 'block', (i - i0) // 4 AS bi, (j - j0) // 4 AS bj, (k - k0) // 4 AS bk, count(*) FROM un JOIN bo USING (recording) WHERE (i - i0) // 4 < (i1 - i0 + 1) // 4 AND (j - j0) // 4 < (j1 - j0 + 1) // 4 AND (k - k0) // 4 < (k1 - k0 + 1) // 4 GROUP BY recording, bi, bj, bk")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown cells per column and per whole block of 4^3 of each recording's grid; the rest beyond the last whole block is trimmed."""
    lat = Lattice(spark, sf)
    n = F.count(F.lit(1)).alias("n")
    col = lat.unknown.groupBy("recording", F.col("i").alias("a"), F.col("j").alias("b")).agg(n).select("recording", F.lit("column").alias("kind"), "a", "b", F.lit(0).cast("bigint").alias("c"), "n")
    blocks = lat.unknown.join(lat.bounds, "recording").withColumns({b: F.expr(f"({i} - {i}0) div 4") for b, i in zip("abc", "ijk")})
    whole = " and ".join(f"{b} < ({i}1 - {i}0 + 1) div 4" for b, i in zip("abc", "ijk"))
    return col.unionByName(blocks.where(whole).groupBy("recording", "a", "b", "c").agg(n).select("recording", F.lit("block").alias("kind"), "a", "b", "c", "n"))


@book.query("agg_a17_unknown_in_box", f"WITH {LATTICE} SELECT file_id, count(*) AS gain FROM po0 JOIN un ON un.recording = po0.recording AND un.i BETWEEN po0.i - 2 AND po0.i + 2 AND un.j BETWEEN po0.j - 2 AND po0.j + 2 AND un.k BETWEEN po0.k - 2 AND po0.k + 2 GROUP BY file_id")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown cells in the 5^3 box around each pose: its 125 cells, less those beyond the bounds and those observed."""
    c = poses(spark, sf).select("file_id", *KEY)
    return Lattice(spark, sf).unknown_near(c, 2).groupBy("file_id").agg(F.count(F.lit(1)).alias("gain"))


@book.query("agg_a18_cluster_centroids", f"WITH {WORLD} SELECT recording, {IJK.format('10.0')}, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, count(*) AS size FROM pt GROUP BY recording, i, j, k HAVING count(*) >= 3")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    d = A.downsample(world(spark, sf), ["recording"], 10.0).where("n >= 3")
    return d.select("recording", *[F.col(i) for i in "ijk"], *[r6(F.col(a)).alias(f"c{a}") for a in "xyz"], F.col("n").alias("size"))


@book.query("agg_a19_plane_fit")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    """Plane of each recording's points: slopes and residual from moment sums; the eigenvector in closed form."""
    from aerolith.operators.planes import fit_planes

    return fit_planes(world(spark, sf), ["recording"])


@book.query("agg_a20_pipeline_summary", f"WITH {WORLD}, v AS (SELECT DISTINCT recording, {IJK.format('0.5')} FROM pt), a AS (SELECT recording, count(*) AS n_voxels, 120 * count(*) AS bytes FROM v GROUP BY recording), b AS (SELECT recording, count(*) AS n_points FROM pt GROUP BY recording), c AS (SELECT recording, count(DISTINCT frame_id) AS n_nodes FROM fr GROUP BY recording) SELECT recording, n_points, n_voxels, n_nodes, round(n_voxels / n_points, 6) AS ratio, CAST(bytes AS BIGINT) AS bytes FROM a JOIN b USING (recording) JOIN c USING (recording)")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    """Points, voxels, graph nodes and the memory estimate of 120 bytes per voxel key."""
    cells = A.downsample(world(spark, sf), ["recording"], 0.5).groupBy("recording").agg(F.sum("n").alias("n_points"), F.count(F.lit(1)).alias("n_voxels"))
    nodes = frames(spark, sf).groupBy("recording").agg(F.count_distinct("frame_id").alias("n_nodes"))
    return cells.join(nodes, "recording").select("recording", "n_points", "n_voxels", "n_nodes", r6(F.col("n_voxels") / F.col("n_points")).alias("ratio"), (F.col("n_voxels") * 120).alias("bytes"))


_YAW = "degrees(atan2(2 * ({0}w * {0}z + {0}x * {0}y), 1 - 2 * ({0}y * {0}y + {0}z * {0}z)))"
_SYNC = f"""{_asof(('state',))}, {SLERP}, rw AS (SELECT *, sqrt(pow(orientation.w, 2) + pow(orientation.x, 2) + pow(orientation.y, 2) + pow(orientation.z, 2)) AS qn FROM sc WHERE position IS NOT NULL AND orientation IS NOT NULL),
sy AS (SELECT p.scan_id, rw.recording, {_YAW.format('p.q')} AS buf_yaw, degrees(atan2(2 * (orientation.w * orientation.z + orientation.x * orientation.y) / (qn * qn), 1 - 2 * (pow(orientation.y, 2) + pow(orientation.z, 2)) / (qn * qn))) AS raw_yaw,
  100 * sqrt(pow(px - position.x, 2) + pow(py - position.y, 2) + pow(pz - position.z, 2)) AS pos_cm, (state_ans - ns) / 1e6 AS dt_ms FROM pose p JOIN rw USING (scan_id, ns) WHERE qn > 0),
sz AS (SELECT *, abs(((raw_yaw - buf_yaw + 180) % 360 + 360) % 360 - 180) AS d_yaw FROM sy)"""


def sync_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Scan poses against the interpolated states: yaw error in degrees and position error in cm."""
    b = bracketed(spark, sf, ["state"]).where("before_state is not null and after_state is not null")
    sc = scans(spark, sf).select("scan_id", "position", "orientation").where("position is not null and orientation is not null")
    d = with_pose(b).join(sc, "scan_id").withColumns({f"r{i}": F.col(f"orientation.{i}") for i in "wxyz"})
    d = d.where("rw * rw + rx * rx + ry * ry + rz * rz > 0")
    raw = G.Quat(*[F.col(f"r{i}") for i in "wxyz"])
    d = d.withColumns({f"u{i}": getattr(raw.unit(), i) for i in "wxyz"})
    raw_yaw, buf_yaw = (G.yaw_deg(G.Quat(*[F.col(f"{n}{i}") for i in "wxyz"])) for n in ("u", "q"))
    off = G.Vec(*[F.col(f"p{a}") - F.col(f"position.{a}") for a in "xyz"])
    return d.select("scan_id", "recording", raw_yaw.alias("raw_yaw"), buf_yaw.alias("buf_yaw"), F.abs(G.wrap_deg(raw_yaw - buf_yaw)).alias("d_yaw"), (off.norm() * 100).alias("pos_cm"))


@book.query(
    "agg_a21_sync_report",
    f"""WITH {_SYNC} SELECT recording, count(*) AS n, round(avg(d_yaw), 4) AS yaw_mean, round(max(d_yaw), 4) AS yaw_max, round(stddev_pop(d_yaw), 4) AS yaw_std, round(avg(pos_cm), 4) AS pos_mean, round(max(pos_cm), 4) AS pos_max,
  CASE WHEN max(d_yaw) < 1 AND max(pos_cm) < 5 THEN 'EXCELLENT' WHEN max(d_yaw) < 3 THEN 'GOOD' ELSE 'POOR' END AS verdict FROM sz GROUP BY recording""",
)
def a21(spark: SparkSession, sf: str) -> DataFrame:
    def r4(c):
        return F.round(c, 4)

    s = sync_rows(spark, sf).groupBy("recording").agg(
        F.count(F.lit(1)).alias("n"), r4(F.avg("d_yaw")).alias("yaw_mean"), r4(F.max("d_yaw")).alias("yaw_max"), r4(F.stddev_pop("d_yaw")).alias("yaw_std"), r4(F.avg("pos_cm")).alias("pos_mean"), r4(F.max("pos_cm")).alias("pos_max"),
        F.max("d_yaw").alias("__y"), F.max("pos_cm").alias("__p"),
    )
    return s.withColumn("verdict", F.when((F.col("__y") < 1) & (F.col("__p") < 5), "EXCELLENT").when(F.col("__y") < 3, "GOOD").otherwise("POOR")).drop("__y", "__p")


@book.query("agg_a22_staleness_summary", f"WITH s AS (SELECT sensor, (epoch_us(received_at) - {TO_NS_SQL.format('ts_ns')} // 1000) / 1000.0 AS ms FROM sensor_sample WHERE ts_ns IS NOT NULL AND received_at IS NOT NULL) SELECT sensor, round(avg(ms), 3) AS mean_ms, round(max(ms), 3) AS max_ms, round(min(ms), 3) AS min_ms, count(*) AS n FROM s GROUP BY sensor")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sensor_sample").where("ts_ns is not null and received_at is not null").withColumn("ns", to_ns(F.col("ts_ns")))
    ms = (F.unix_micros(F.col("received_at").cast("timestamp")) - F.expr("ns div 1000")) / 1000.0
    return s.select("sensor", ms.alias("ms")).groupBy("sensor").agg(F.round(F.avg("ms"), 3).alias("mean_ms"), F.round(F.max("ms"), 3).alias("max_ms"), F.round(F.min("ms"), 3).alias("min_ms"), F.count(F.lit(1)).alias("n"))


@book.query("agg_a23_duplicate_count", "WITH s AS (SELECT sensor, sample_id, count(*) AS n FROM sensor_sample GROUP BY ALL) SELECT sensor, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_ids, CAST(sum(n) - count(*) AS BIGINT) AS n_again FROM s GROUP BY sensor")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sensor_sample").groupBy("sensor", "sample_id").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("sensor").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"), (F.sum("n") - F.count(F.lit(1))).alias("n_again"))


@book.query(
    "agg_a24_comparison_table",
    "SELECT method, count(*) AS n, CAST(count_if(status <> 'OK') AS BIGINT) AS failed, round(avg(voxel_count), 4) AS voxels, round(avg(CASE WHEN plane_residual > 0 AND isfinite(plane_residual) THEN plane_residual END), 6) AS residual, round(avg(total_time), 6) AS time_s, CAST(sum(coalesce(rejected_count, 0)) AS BIGINT) AS rejected FROM benchmark_run GROUP BY method",
)
def a24(spark: SparkSession, sf: str) -> DataFrame:
    """Means over all runs of a method; residuals only where positive and finite."""
    res = F.when((F.col("plane_residual") > 0) & (F.col("plane_residual") < float("inf")), F.col("plane_residual"))
    return table(spark, sf, "benchmark_run").groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "OK").alias("failed"), F.round(F.avg("voxel_count"), 4).alias("voxels"), r6(F.avg(res)).alias("residual"), r6(F.avg("total_time")).alias("time_s"), F.sum(F.coalesce("rejected_count", F.lit(0))).alias("rejected")
    )


# Flights, emulated on events: a purchase is a flight, its value the arrival error; over 200 it collided, over 100 it missed.
@book.query(
    "agg_a25_flight_summary",
    """WITH f AS (SELECT user_id, value AS err, value > 200 AS collided, value <= 100 AS success, CASE WHEN value % 7 < 1 THEN 'Infinity'::DOUBLE ELSE value / 10 END AS clearance FROM events WHERE event_type = 'purchase')
  SELECT user_id, count(*) AS flights, CAST(count_if(success OR NOT collided) AS BIGINT) AS reached, CAST(count_if(success AND NOT collided) AS BIGINT) AS reached_strict, CAST(count_if(collided) AS BIGINT) AS collisions, round(avg(err), 6) AS mean_error, round(min(CASE WHEN isfinite(clearance) THEN clearance END), 6) AS min_clearance FROM f GROUP BY user_id""",
)
def a25(spark: SparkSession, sf: str) -> DataFrame:
    """Reached counts a missed flight that did not collide as reached; the strict form does not."""
    clear = F.when(F.col("value") % 7 < 1, F.lit(float("inf"))).otherwise(F.col("value") / 10)
    f = table(spark, sf, "events").where("event_type = 'purchase'").select("user_id", F.col("value").alias("err"), (F.col("value") > 200).alias("collided"), (F.col("value") <= 100).alias("success"), clear.alias("clearance"))
    return f.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("flights"), F.count_if(F.col("success") | ~F.col("collided")).alias("reached"), F.count_if(F.col("success") & ~F.col("collided")).alias("reached_strict"), F.count_if("collided").alias("collisions"),
        r6(F.avg("err")).alias("mean_error"), r6(F.min(F.when(F.col("clearance") < float("inf"), F.col("clearance")))).alias("min_clearance"),
    )


@book.query("agg_a26_path_length", f"WITH {_SCANS}, s AS (SELECT recording, position AS p, lag(position) OVER (PARTITION BY recording ORDER BY ns, scan_id) AS b FROM sc WHERE position IS NOT NULL) SELECT recording, round(sum(sqrt(pow(p.x - b.x, 2) + pow(p.y - b.y, 2) + pow(p.z - b.z, 2))), 6) AS length FROM s WHERE b IS NOT NULL GROUP BY recording")
def a26(spark: SparkSession, sf: str) -> DataFrame:
    s = scans(spark, sf).where("position is not null").withColumn("b", F.lag("position").over(Window.partitionBy("recording").orderBy("ns", "scan_id"))).where("b is not null")
    return s.groupBy("recording").agg(r6(F.sum((G.vec("position") - G.vec("b")).norm())).alias("length"))


@book.query("agg_a27_grid_shape", f"WITH {WORLD} SELECT recording, " + ", ".join(f"min({a}) - 2.0::DOUBLE AS lo_{a}, CAST(ceil((max({a}) - min({a}) + 4.0) / 0.5) AS BIGINT) AS n_{a}" for a in "xyz") + " FROM pt GROUP BY recording")
def a27(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of a recording padded by 2 m, and the grid of 0.5 m cells over them."""
    cols = [c for a in "xyz" for c in ((F.min(a) - 2.0).alias(f"lo_{a}"), F.ceil((F.max(a) - F.min(a) + 4.0) / 0.5).alias(f"n_{a}"))]
    return world(spark, sf).groupBy("recording").agg(*cols)


@book.query("agg_a28_grid_counts", f"WITH {LATTICE} SELECT recording, count(*) AS observed, CAST(count_if(occ) AS BIGINT) AS occupied, CAST(count_if(NOT occ) AS BIGINT) AS free, (max(i) - min(i) + 1) * (max(j) - min(j) + 1) * (max(k) - min(k) + 1) - count(*) AS unknown FROM ob GROUP BY recording")
def a28(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count(F.lit(1))
    cells = (F.max("i") - F.min("i") + 1) * (F.max("j") - F.min("j") + 1) * (F.max("k") - F.min("k") + 1)
    return Lattice(spark, sf).observed.groupBy("recording").agg(n.alias("observed"), F.count_if("occ").alias("occupied"), F.count_if(~F.col("occ")).alias("free"), (cells - n).alias("unknown"))


@book.query("agg_a29_alignment_report", f"WITH {FRAMES} SELECT recording, round(avg(sqrt(px * px + py * py + pz * pz)), 6) AS shift, round(avg(degrees(2 * acos(least(1, abs(qw))))), 4) AS turn FROM fr GROUP BY recording")
def a29(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    turn = F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs("qw"))))
    return f.groupBy("recording").agg(r6(F.avg(G.Vec(F.col("px"), F.col("py"), F.col("pz")).norm())).alias("shift"), F.round(F.avg(turn), 4).alias("turn"))


@book.query("agg_a30_quality_series", "SELECT DISTINCT run_id, frame, round(reg_src_pts / raw_pts, 6) AS kept, round(reg_total_ms / t_total_ms, 6) AS share FROM frame_timing WHERE raw_pts > 0 AND t_total_ms > 0 AND isfinite(t_total_ms) AND reg_total_ms >= 0 AND isfinite(reg_total_ms)")
def a30(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "frame_timing").where("raw_pts > 0 and t_total_ms > 0 and t_total_ms < double('Infinity') and reg_total_ms >= 0 and reg_total_ms < double('Infinity')")
    return t.select("run_id", "frame", r6(F.col("reg_src_pts") / F.col("raw_pts")).alias("kept"), r6(F.col("reg_total_ms") / F.col("t_total_ms")).alias("share")).distinct()


QUERIES, SQL = book.queries, book.sql
