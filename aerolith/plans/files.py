"""Sources and sinks: every format is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions import labels as L
from aerolith.operators import spatial as S
from aerolith.operators import summaries as A
from aerolith.plans import aggregates
from aerolith.plans.aggregates import IJK, _STEPS, map_metrics, steps, sync_rows
from aerolith.plans.book import FRAMES, MAPS, WORLD, WORLD_MAPS, Book, frames, map_points, r6, world, world_map_points
from aerolith.runtime import shared_dir, table, written
from aerolith.sources import recordings as R

book = Book()


def _frames_for_npz(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lidar_frame")
    mount = F.struct(*[F.lit(0.0).alias(a) for a in "xyz"]), F.struct(*[F.lit(v).alias(a) for a, v in zip("wxyz", (1.0, 0.0, 0.0, 0.0))])
    # The table does not hold the states around a frame; their times are left out of the file.
    none = [F.lit(None).cast("bigint").alias(f"state_{side}_ts") for side in ("before", "after")]
    return f.select("file_id", "recording", "frame_id", F.col("lidar_ts").alias("timestamp"), *none, "points", "position", "orientation", mount[0].alias("lidar_position"), mount[1].alias("lidar_orientation"), "imu_angular_vel", "imu_linear_acc", "gps")


def _saved(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    where = _posix(shared_dir(spark, "npz"))
    return where, written(R.write_frames(_frames_for_npz(spark, sf), where), "npz-list")


@book.query(
    "src_s01_s03_npz_frames",
    "SELECT file_id, frame_id, lidar_ts AS timestamp, CAST(CASE WHEN len(points) > 0 THEN len(points) END AS INTEGER) AS n_points, coalesce(position.x, 0) AS px, coalesce(orientation.w, 1) AS qw, gps.lat AS lat FROM lidar_frame",
)
def s01(spark: SparkSession, sf: str) -> DataFrame:
    """Frames written as one npz file each and read back in batches; absent members get their defaults."""
    where, _ = _saved(spark, sf)
    d = R.read_frames(spark, where)
    return d.select(F.regexp_extract("path", r"-(\d+)\.npz$", 1).cast("bigint").alias("file_id"), "frame_id", "timestamp", F.size("points").alias("n_points"), F.col("position.x").alias("px"), F.col("orientation.w").alias("qw"), F.col("gps.lat").alias("lat"))


@book.query("src_s02_npz_datasource", "SELECT file_id, frame_id FROM (SELECT file_id, frame_id, row_number() OVER (ORDER BY recording, printf('frame_%05d-%d', frame_id, file_id)) - 1 AS rn FROM lidar_frame) WHERE rn % 3 = 0 AND rn // 3 < 50")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    """Every third file, 50 at most, through the data source that skips and caps before it reads."""
    where, _ = _saved(spark, sf)
    spark.dataSource.register(R.NpzFrames)
    d = spark.read.format("npz_frames").option("skip", 3).option("max", 50).load(where)
    return d.select(F.regexp_extract("path", r"-(\d+)\.npz$", 1).cast("bigint").alias("file_id"), "frame_id")


_SEC = "CAST(nullif(regexp_extract(recording, '([0-9]{10,})', 1), '') AS BIGINT)"


@book.query("src_s04_latest_recording", f"SELECT recording FROM recording ORDER BY {_SEC} DESC NULLS LAST, recording DESC LIMIT 1")
def s04(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest(table(spark, sf, "recording").select("recording"), "recording")


@book.query("src_s05_recent_with_frames", f"SELECT recording FROM recording WHERE recording IN (SELECT recording FROM lidar_frame) ORDER BY {_SEC} DESC NULLS LAST, recording DESC LIMIT 5")
def s05(spark: SparkSession, sf: str) -> DataFrame:
    has = table(spark, sf, "lidar_frame").select("recording")
    return R.latest(table(spark, sf, "recording").select("recording").join(has, "recording", "left_semi"), "recording", 5)


@book.query("src_s06_folder_time", "SELECT map_id, CAST(nullif(regexp_extract(folder, '([0-9]{10,})', 1), '') AS BIGINT) AS seconds FROM slam_map")
def s06(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "slam_map").select("map_id", L.folder_seconds(F.col("folder")).alias("seconds"))


def _posix(where: str) -> str:
    """Files that Python writes one by one need a shared folder that is a POSIX path."""
    if "://" in where and not where.startswith("file:"):
        raise ValueError(f"npz files need a POSIX path, not {where}")
    return where if where.startswith("file:") else f"file://{where}"


@book.query("src_s07_map_files", "SELECT map_id, source, resolution, saved_s AS saved, CAST(len(points) AS INTEGER) AS n, round(bounds[1], 6) AS xmin, extra['registration_method'] AS method FROM (SELECT DISTINCT ON (map_id) * FROM slam_map)")
def s07(spark: SparkSession, sf: str) -> DataFrame:
    """Maps written as one npz file each with all their metadata, and read back."""
    where = _posix(shared_dir(spark, "maps"))
    m = table(spark, sf, "slam_map").dropDuplicates(["map_id"])
    m = m.select("map_id", "folder", "points", F.col("saved_s").alias("timestamp"), "source", "bounds", "resolution", F.map_entries("extra").alias("extra"))
    m = m.withColumn("extra", F.transform("extra", lambda e: F.array(e["key"], e["value"])))
    written(R.write_maps(m, where), "map-list")
    d = R.read_maps(spark, where)
    method = F.try_element_at("extra", F.lit("registration_method"))
    return d.select(F.regexp_extract("path", r"/(\d+)-[^/]*/slam_map\.npz$", 1).cast("bigint").alias("map_id"), "source", "resolution", F.col("timestamp").alias("saved"), F.size("points").alias("n"), r6(F.col("bounds")[0]).alias("xmin"), method.alias("method"))


@book.query("src_s08_maps_in_order", "WITH n AS (SELECT DISTINCT map_id, folder, regexp_replace(regexp_replace(regexp_replace(folder, '^[A-Za-z_]*[0-9]+_', ''), '_noise_[0-9.]+cm_[0-9.]+deg$', ''), '_clean$', '') AS method, coalesce(CAST(nullif(regexp_extract(folder, 'noise_([0-9.]+)cm', 1), '') AS DOUBLE), -1) AS cm FROM slam_map) SELECT map_id, CAST(row_number() OVER (PARTITION BY method ORDER BY cm, folder, map_id) AS INTEGER) AS place FROM n")
def s08(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "slam_map").select("map_id", "folder").distinct()
    w = Window.partitionBy(L.method_name(F.col("folder"))).orderBy(F.coalesce(L.noise_cm(F.col("folder")), F.lit(-1.0)), "folder", "map_id")
    return m.select("map_id", F.row_number().over(w).alias("place"))


_VOX = f"{MAPS}, vx AS (SELECT DISTINCT CAST(floor(x / 4.0) AS BIGINT) + 32 AS i, CAST(floor(y / 4.0) AS BIGINT) + 32 AS j, CAST(floor(z / 4.0) AS BIGINT) + 32 AS k FROM mp WHERE abs(x) < 128 AND abs(y) < 128 AND abs(z) < 128)"


@book.query("src_s09_binvox", f"WITH {_VOX} SELECT (i + 0.5) / 64.0::DOUBLE * 256.0 - 128.0 AS x, (k + 0.5) / 64.0::DOUBLE * 256.0 - 128.0 AS y, -((j + 0.5) / 64.0::DOUBLE * 256.0 - 128.0) AS z FROM vx")
def s09(spark: SparkSession, sf: str) -> DataFrame:
    """Voxels of all maps as a binvox grid of fixed size, written and read back."""
    import numpy as np
    import pandas as pd

    m = map_points(spark, sf).where("abs(x) < 128 and abs(y) < 128 and abs(z) < 128")
    cells = m.select(*[(F.floor(F.col(a) / 4.0).cast("bigint") + 32).alias(i) for a, i in zip("xyz", "ijk")]).distinct()

    def encode(batches):  # at most 64^3 distinct cells
        p = pd.concat(list(batches), ignore_index=True) if batches is not None else None
        raw = R.encode_binvox(p[["i", "j", "k"]].to_numpy(dtype=np.int64), [64, 64, 64], [-128.0, -128.0, -128.0], 256.0)
        yield pd.DataFrame({"path": ["maps.binvox"], "content": [raw]})

    files = written(cells.coalesce(1).mapInPandas(encode, "path string, content binary"), "binvox")
    return R.binvox_points(files).select("x", "y", "z")


_TRUTH = f"{MAPS}, b AS (SELECT recording, floor(min(x)) - 2 AS lx, floor(min(y)) - 2 AS ly, floor(min(z)) - 2 AS lz, CAST(ceil(max(x) - min(x)) AS BIGINT) + 4 AS nx FROM mp GROUP BY recording)"


@book.query("src_s10_truth_grids", f"WITH {_TRUTH}, c AS (SELECT DISTINCT mp.recording, CAST(trunc(x - lx) AS INTEGER) AS ix, CAST(trunc(y - ly) AS INTEGER) AS iy, CAST(trunc(z - lz) AS INTEGER) AS iz FROM mp JOIN b USING (recording)) SELECT recording, count(*) AS occupied, max(ix) AS max_ix, max(iy) AS max_iy, max(iz) AS max_iz FROM c GROUP BY recording")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    """Truth clouds as occupied cells of a grid over their padded bounds; also the loader of saved points (S12)."""
    m = map_points(spark, sf)
    b = m.groupBy("recording").agg(*[(F.floor(F.min(a)) - 2).alias(f"l{a}") for a in "xyz"])
    c = m.join(b, "recording").select("recording", *[(F.col(a) - F.col(f"l{a}")).cast("int").alias(f"i{a}") for a in "xyz"]).distinct()
    return c.groupBy("recording").agg(F.count(F.lit(1)).alias("occupied"), *[F.max(f"i{a}").alias(f"max_i{a}") for a in "xyz"])


@book.query("src_s12_points_to_grid", f"WITH {MAPS}, b AS (SELECT map_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM mp GROUP BY map_id) SELECT map_id, count(DISTINCT (CAST(floor((x - lx) / 2.0) AS BIGINT), CAST(floor((y - ly) / 2.0) AS BIGINT), CAST(floor((z - lz) / 2.0) AS BIGINT))) AS occupied FROM mp JOIN b USING (map_id) GROUP BY map_id")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    """Saved points as occupied cells of 2 m over each map's own bounds: the loader of maps without a grid."""
    m = map_points(spark, sf)
    b = m.groupBy("map_id").agg(*[F.min(a).alias(f"l{a}") for a in "xyz"])
    cells = m.join(b, "map_id").select("map_id", *[F.floor((F.col(a) - F.col(f"l{a}")) / 2.0).cast("bigint").alias(i) for a, i in zip("xyz", "ijk")]).distinct()
    return cells.groupBy("map_id").agg(F.count(F.lit(1)).alias("occupied"))


@book.query("src_s11_latest_truth", "SELECT arg_max(map_id, (saved_s, map_id)) AS map_id FROM slam_map WHERE points IS NOT NULL AND saved_s IS NOT NULL")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "slam_map").where("points is not null and saved_s is not null").agg(F.max_by("map_id", F.struct("saved_s", "map_id")).alias("map_id"))


TIMING = ["run_id", "frame", "t_total_ms", "t_gtsam_ms", "t_register_total_ms", "reg_src_pts"]


@book.query("src_s17_timing_csv", "SELECT run_id, frame, coalesce(t_total_ms, 0) AS t_total_ms, coalesce(t_gtsam_ms, 0) AS t_gtsam_ms, coalesce(t_register_total_ms, 0) AS t_register_total_ms, coalesce(reg_src_pts, 0) AS reg_src_pts FROM frame_timing")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    """Timings through CSV with a given schema; blanks are 0, NaN stays NaN."""
    where = shared_dir(spark, "timing-csv")
    t = table(spark, sf, "frame_timing").select(*TIMING)
    t.write.option("header", True).csv(where)
    d = spark.read.schema(t.schema).option("header", True).csv(where)
    return d.select("run_id", "frame", *[F.coalesce(c, F.lit(0)).alias(c) for c in TIMING[2:]])


@book.query("src_s18_candidate_csv", "SELECT event_type AS selected_source, count(*) AS n FROM events GROUP BY event_type")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    where = shared_dir(spark, "candidates-csv")
    c = table(spark, sf, "events").select(F.col("event_id").alias("timestep"), F.col("event_type").alias("selected_source"), F.col("value").alias("score"))
    c.write.option("header", True).csv(where)
    return spark.read.schema(c.schema).option("header", True).csv(where).groupBy("selected_source").agg(F.count(F.lit(1)).alias("n"))


# Sinks


@book.query("snk_k01_k02_frames", "SELECT recording, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM lidar_frame GROUP BY recording")
def k01(spark: SparkSession, sf: str) -> DataFrame:
    """Frames as Parquet with a folder per recording; reading one recording touches its folder only."""
    where = shared_dir(spark, "frames")
    table(spark, sf, "lidar_frame").write.partitionBy("recording").parquet(where)
    return spark.read.parquet(where).groupBy("recording").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"))


@book.query("snk_k02_exploration_frames", "SELECT file_id, CAST(CASE WHEN len(points) > 0 THEN len(points) END AS INTEGER) AS n_points, CAST(NULL AS BIGINT) AS timestamp, gps.alt AS alt, 1.0::DOUBLE AS mount_w FROM lidar_frame")
def k02(spark: SparkSession, sf: str) -> DataFrame:
    """Frames as the explorer stores them: points, pose, mount and GPS if there is one, but no times."""
    where = _posix(shared_dir(spark, "npz-exploration"))
    f = _frames_for_npz(spark, sf).select("file_id", "recording", "frame_id", "points", "position", "orientation", "lidar_position", "lidar_orientation", "gps")
    written(R.write_frames(f, where), "npz-list")
    d = R.read_frames(spark, where)
    return d.select(F.regexp_extract("path", r"-(\d+)\.npz$", 1).cast("bigint").alias("file_id"), F.size("points").alias("n_points"), "timestamp", F.col("gps.alt").alias("alt"), F.col("lidar_orientation.w").alias("mount_w"))


_EXPORT = f"""{FRAMES}, {WORLD_MAPS}, ra AS (SELECT DISTINCT ON (map_id) map_id, source, resolution, greatest(2 * coalesce(resolution, 0), 1.0) AS r FROM slam_map),
kp AS (SELECT mp.map_id, source, resolution FROM mp JOIN ra USING (map_id) WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.recording = mp.recording AND pow(mp.x - fr.px, 2) + pow(mp.y - fr.py, 2) + pow(mp.z - fr.pz, 2) <= r * r))"""


@book.query("snk_k03_k04_map_export", f"WITH {_EXPORT} SELECT map_id, source, resolution, count(*) AS n FROM kp GROUP BY ALL")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    """World map points that lie farther from every pose of the recording than twice the resolution and a metre, saved beside a row of metadata per map."""
    where = shared_dir(spark, "map-export")
    m = table(spark, sf, "slam_map").dropDuplicates(["map_id"])
    radius = m.select("map_id", F.greatest(2 * F.coalesce("resolution", F.lit(0.0)), F.lit(1.0)).alias("r"))
    widest = radius.agg(F.max("r")).first()[0] or 1.0
    poses = frames(spark, sf).select("recording", F.col("file_id").alias("pose"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    p = world_map_points(spark, sf)
    near = S.within(poses, p.withColumn("pid", F.struct("map_id", "pt_id")), widest, ["recording"], "pose", "pid").select("pid.map_id", "pid.pt_id", "d2")
    near = near.join(radius, "map_id").where(F.col("d2") <= F.col("r") * F.col("r")).select("map_id", "pt_id").distinct()
    p.join(near, ["map_id", "pt_id"], "left_anti").select("map_id", "x", "y", "z").write.parquet(f"{where}/points")
    m.select("map_id", F.col("saved_s").alias("timestamp"), "source", "bounds", "resolution", "extra").write.parquet(f"{where}/metadata")
    n = spark.read.parquet(f"{where}/points").groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))
    return spark.read.parquet(f"{where}/metadata").join(n, "map_id").select("map_id", "source", "resolution", "n")


@book.query("snk_k05_truth", f"WITH {WORLD_MAPS} SELECT recording, count(*) AS n, " + ", ".join(f"round((min({a}) + max({a})) / 2, 6) AS c{a}, CAST(ceil(max({a}) - min({a})) AS BIGINT) AS n{a}" for a in "xyz") + ", 1.0::DOUBLE AS resolution FROM mp GROUP BY recording")
def k05(spark: SparkSession, sf: str) -> DataFrame:
    """Truth clouds with their centre, grid size and resolution."""
    where = shared_dir(spark, "truth")
    p = world_map_points(spark, sf)
    p.write.parquet(f"{where}/points")
    saved = spark.read.parquet(f"{where}/points")
    parts = [c for a in "xyz" for c in (r6((F.min(a) + F.max(a)) / 2).alias(f"c{a}"), F.ceil(F.max(a) - F.min(a)).alias(f"n{a}"))]
    return written(saved.groupBy("recording").agg(F.count(F.lit(1)).alias("n"), *parts, F.lit(1.0).alias("resolution")), "truth-members")


@book.query("snk_k06_octree_levels", f"WITH {WORLD}, v AS (SELECT DISTINCT recording, {IJK.format('0.5')} FROM pt), l AS (SELECT recording, lv, CAST(floor(i / pow(2, lv)) AS BIGINT) AS i, CAST(floor(j / pow(2, lv)) AS BIGINT) AS j, CAST(floor(k / pow(2, lv)) AS BIGINT) AS k FROM v, generate_series(0, 4) q(lv)) SELECT recording, CAST(lv AS INTEGER) AS level, count(DISTINCT (i, j, k)) AS n FROM l GROUP BY ALL")
def k06(spark: SparkSession, sf: str) -> DataFrame:
    """Voxels of the world with their ancestors of four levels, as an octree would store them."""
    v = world(spark, sf).select("recording", *[F.floor(F.col(a) / 0.5).cast("bigint").alias(i) for a, i in zip("xyz", "ijk")]).distinct()
    up = v.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(4))))
    cells = up.select("recording", "level", *[F.expr(f"shiftright({i}, level)").alias(i) for i in "ijk"]).distinct()
    return written(cells, "octree").groupBy("recording", "level").agg(F.count(F.lit(1)).alias("n"))


@book.query("snk_k07_ply", f"WITH {MAPS} SELECT count(*) AS n, round(sum(x), 3) AS sum_x FROM mp")
def k07(spark: SparkSession, sf: str) -> DataFrame:
    """Map points as an ASCII cloud, and what comes back from it."""
    where = shared_dir(spark, "ply")
    R.write_ply(map_points(spark, sf), where)
    p = spark.read.text(f"{where}/points").select(F.split("value", " ")[0].cast("double").alias("x"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("sum_x"))


def _csv(d: DataFrame, purpose: str) -> DataFrame:
    where = shared_dir(d.sparkSession, purpose)
    d.write.option("header", True).csv(where)
    return d.sparkSession.read.schema(d.schema).option("header", True).csv(where)


@book.query("snk_k08_frame_rows", "SELECT run_id, frame, raw_pts, voxel_count FROM frame_timing")
def k08(spark: SparkSession, sf: str) -> DataFrame:
    """The row of every frame through CSV; only the listed columns are written."""
    where = shared_dir(spark, "frame-csv")
    d = table(spark, sf, "frame_timing").select("run_id", "frame", "raw_pts", "voxel_count")
    d.write.option("header", True).csv(where)
    return spark.read.schema(d.schema).option("header", True).csv(where)


@book.query("snk_k09_timing_breakdown", f"WITH {_STEPS} SELECT step, round(sum(s), 4) AS total_s, count(*) AS n FROM st GROUP BY step UNION ALL SELECT 'wall_clock', round(sum(total_time), 4), NULL FROM benchmark_run WHERE status = 'OK'")
def k09(spark: SparkSession, sf: str) -> DataFrame:
    """Steps and a row of the wall clock with blanks."""
    s = A.step_timing(steps(spark, sf), "step", "s").select("step", F.round("total_s", 4).alias("total_s"), "n")
    wall = table(spark, sf, "benchmark_run").where("status = 'OK'").agg(F.round(F.sum("total_time"), 4).alias("total_s")).select(F.lit("wall_clock").alias("step"), "total_s", F.lit(None).cast("bigint").alias("n"))
    return _csv(s.unionByName(wall), "breakdown")


@book.query("snk_k10_benchmark_csv", "SELECT run_id, method, status, voxel_count, total_time FROM benchmark_run")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    return _csv(table(spark, sf, "benchmark_run").select("run_id", "method", "status", "voxel_count", "total_time"), "benchmark")


@book.query("snk_k11_metric_csv", aggregates.SQL["agg_a06_map_metrics"])
def k11(spark: SparkSession, sf: str) -> DataFrame:
    return _csv(map_metrics(spark, sf), "metrics")


_METRICS = [c for c in ("rmse_s2g", "rmse_g2s", "rmse_sym", "chamfer", "accuracy", "median_s2g", "median_g2s", "mean_s2g", "mean_g2s", "precision", "recall", "fscore", "completeness")]
_KIND = "split_part(recording, '_', 1)"


@book.query("snk_k11_averaged_metric_csv", f"SELECT {_KIND} AS kind, count(*) AS n_runs, " + ", ".join(f"round(avg({c}), 5) AS {c}, round(coalesce(stddev_samp({c}), 0), 5) AS {c}_std" for c in _METRICS) + f" FROM ({aggregates.SQL['agg_a06_map_metrics']}) GROUP BY kind")
def k11b(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics averaged over the recordings of a kind, with their spread."""
    cols = [c for m in _METRICS for c in (F.round(F.avg(m), 5).alias(m), F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 5).alias(f"{m}_std"))]
    return _csv(map_metrics(spark, sf).groupBy(F.expr("split_part(recording, '_', 1)").alias("kind")).agg(F.count(F.lit(1)).alias("n_runs"), *cols), "metrics-averaged")


@book.query("snk_k12_trial_csv", "SELECT run_id, method, round(total_time, 3) AS total_time FROM benchmark_run WHERE status = 'OK'")
def k12(spark: SparkSession, sf: str) -> DataFrame:
    return _csv(table(spark, sf, "benchmark_run").where("status = 'OK'").select("run_id", "method", F.round("total_time", 3).alias("total_time")), "trials")


@book.query("snk_k13_candidate_log", "SELECT event_id AS timestep, event_type AS selected_source, round(value, 6) AS score FROM events WHERE event_type <> 'error'")
def k13(spark: SparkSession, sf: str) -> DataFrame:
    """The candidate log as CSV; an empty log writes no file."""
    d = table(spark, sf, "events").where("event_type <> 'error'").select(F.col("event_id").alias("timestep"), F.col("event_type").alias("selected_source"), r6(F.col("value")).alias("score"))
    return d if d.isEmpty() else _csv(d, "candidate-log")


@book.query("snk_k14_sync_report")
def k14(spark: SparkSession, sf: str) -> DataFrame:
    """Report lines of scan against buffer poses, N/A for missing; then the summary."""
    def num(c: str, digits: int):
        return F.coalesce(F.format_string(f"%10.{digits}f", F.col(c)), F.lit("       N/A"))

    s = sync_rows(spark, sf)
    lines = s.select("recording", "scan_id", F.concat_ws(" ", F.format_string("%8d", "scan_id"), num("raw_yaw", 3), num("buf_yaw", 3), num("d_yaw", 3), num("pos_cm", 2)).alias("line"))
    total = s.groupBy("recording").agg(F.format_string("mean %.4f deg, max %.4f deg, position %.2f cm", F.avg("d_yaw"), F.max("d_yaw"), F.avg("pos_cm")).alias("line")).select("recording", F.lit(None).cast("bigint").alias("scan_id"), "line")
    return written(lines.unionByName(total), "sync-report")


@book.query("snk_k15_timestamp_deltas", f"WITH {FRAMES} SELECT file_id, round((lidar_ts - lag(lidar_ts) OVER (PARTITION BY recording ORDER BY lidar_ts, file_id)) / 1e6, 6) AS delta_ms FROM fr")
def k15(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("recording").orderBy("lidar_ts", "file_id")
    return written(frames(spark, sf).select("file_id", r6((F.col("lidar_ts") - F.lag("lidar_ts").over(w)) / 1e6).alias("delta_ms")), "deltas")


@book.query("snk_k18_metric_lines", "SELECT method, printf('%-16s runs %3d  time %10.3f s', method, count(*), avg(total_time)) AS line FROM benchmark_run WHERE status = 'OK' AND total_time IS NOT NULL GROUP BY method")
def k18(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "benchmark_run").where("status = 'OK' and total_time is not null").groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg("total_time").alias("t"))
    return d.select("method", F.format_string("%-16s runs %3d  time %10.3f s", "method", "n", "t").alias("line"))


QUERIES, SQL = book.queries, book.sql
