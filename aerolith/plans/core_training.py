"""Queries of the core operators for training data: the regular grid and the compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions.timeunits import TO_NS_SQL, to_ns, usable_reading, usable_sql
from aerolith.operators.compaction import compact
from aerolith.operators.regular_grid import regular_grid
from aerolith.runtime import shared_dir, table

GRID_NS = 100_000_000


def _imu_grid(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    imu = table(spark, sf_dir, "sensor_sample").where(
        (F.col("sensor") == "imu") & usable_reading(F.col("sensor"), F.col("v"))
    )
    return regular_grid(imu, "recording", to_ns(F.col("ts_ns")), F.slice("v", 1, 6), [F.col("sample_id")], GRID_NS, **how)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imu_grid(spark, sf_dir).where(F.col("status") != "measured").select("recording", "slot")


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series itself: gaps of up to 1 s hold the last reading, longer ones are marked missing."""
    v = F.col("value")
    return _imu_grid(spark, sf_dir, max_fill=10).select(
        "recording", "slot", "status", "age", *[v[i].alias(n) for i, n in enumerate(("wx", "wy", "wz", "ax", "ay", "az"))]
    )


def p3_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per recording: slots by status and the mean of the linearly filled first component."""
    return (
        _imu_grid(spark, sf_dir, max_fill=10, fill="linear")
        .groupBy("recording", "status")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value")[0]), 6).alias("sum_wx"))
    )


def _lidar_compaction(spark: SparkSession, sf_dir: str, **how):
    frames = table(spark, sf_dir, "lidar_frame")
    return compact(
        frames,
        shared_dir(spark, "lidar-compacted"),
        record=["recording", "frame_id", "points", "orientation"],
        file_id="file_id",
        cluster_by=["recording", "frame_id", "lidar_ts"],
        size="n_bytes",
        **how,
    )


#: Files that p4_file_sizes asks for, whatever the size of the table.
MANY = 16


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _lidar_compaction(spark, sf_dir).membership
    return m.where("kept_id <> file_id").select(F.col("kept_id").alias("file_id_a"), F.col("file_id").alias("file_id_b"))


def p4_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compacted records, read back from the written files."""
    done = _lidar_compaction(spark, sf_dir)
    return done.records.select("file_id", "recording", "frame_id", "lidar_ts", "n_bytes", F.size("points").alias("n_points"))


def p4_file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compaction into about MANY files, judged by what was written: records, files, evenness, and whether the files' key ranges lie apart."""
    total = table(spark, sf_dir, "lidar_frame").agg(F.sum(F.when(F.col("n_bytes") >= 0, F.col("n_bytes")))).first()[0] or 1
    done = _lidar_compaction(spark, sf_dir, target_bytes=max(1, total // MANY))
    key = F.struct("recording", "frame_id", "lidar_ts")
    files = done.records.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    # One small row per file.
    order = files.withColumn("next", F.lead("low").over(Window.orderBy("low")))
    return order.agg(
        F.sum("n").alias("records"),
        F.count(F.lit(1)).between(MANY // 2, 2 * MANY).alias("many"),
        (F.max("n") <= 4 * F.avg("n")).alias("even"),
        F.coalesce(F.bool_and(F.col("next").isNull() | (F.col("high") <= F.col("next"))), F.lit(True)).alias("apart"),
    )


_IMU = f"""imu AS (SELECT recording, {TO_NS_SQL.format("ts_ns")} AS ts, sample_id, v FROM sensor_sample
  WHERE sensor = 'imu' AND recording IS NOT NULL AND ts_ns IS NOT NULL AND {usable_sql("sensor", "v")}),
s AS (SELECT recording, CAST(floor(ts // 100000000) AS BIGINT) AS slot, arg_max(v, (ts, sample_id)) AS v FROM imu GROUP BY ALL),
g AS (SELECT recording, unnest(generate_series(min(slot), max(slot))) AS slot FROM s GROUP BY recording),
j AS (SELECT g.recording, g.slot, p.slot AS seen, p.v AS v, n.slot AS next_at, n.v AS next_v
  FROM g ASOF JOIN s p ON g.recording = p.recording AND g.slot >= p.slot
  ASOF LEFT JOIN s n ON g.recording = n.recording AND g.slot < n.slot)"""

QUERIES = {"p3_found": p3_found, "p3_grid": p3_grid, "p3_linear": p3_linear, "p4_found": p4_found, "p4_compacted": p4_compacted, "p4_file_sizes": p4_file_sizes}

SQL = {
    "p3_found": f"WITH {_IMU} SELECT recording, slot FROM j WHERE seen <> slot",
    "p3_grid": f"""WITH {_IMU} SELECT recording, slot,
  CASE WHEN seen = slot THEN 'measured' WHEN slot - seen <= 10 THEN 'filled' ELSE 'missing' END AS status, slot - seen AS age,
  {", ".join(f"CASE WHEN slot - seen <= 10 THEN v[{i}] END AS {n}" for i, n in enumerate(("wx", "wy", "wz", "ax", "ay", "az"), 1))} FROM j""",
    "p3_linear": f"""WITH {_IMU} SELECT recording, CASE WHEN seen = slot THEN 'measured' WHEN slot - seen <= 10 THEN 'filled' ELSE 'missing' END AS status,
  count(*) AS n, round(sum(CASE WHEN seen = slot THEN v[1] WHEN slot - seen <= 10 THEN v[1] + (next_v[1] - v[1]) * (CAST(slot - seen AS DOUBLE) / (next_at - seen)) END), 6) AS sum_wx
  FROM j GROUP BY ALL""",
    "p4_found": """WITH m AS (SELECT file_id, min(file_id) OVER (PARTITION BY recording, frame_id, points, orientation) AS kept FROM lidar_frame)
  SELECT kept AS file_id_a, file_id AS file_id_b FROM m WHERE kept <> file_id""",
    "p4_file_sizes": "SELECT count(*) AS records, true AS many, true AS even, true AS apart FROM (SELECT DISTINCT recording, frame_id, points, orientation FROM lidar_frame)",
    "p4_compacted": """WITH m AS (SELECT *, min(file_id) OVER (PARTITION BY recording, frame_id, points, orientation) AS kept FROM lidar_frame)
  SELECT file_id, recording, frame_id, lidar_ts, n_bytes, CAST(len(points) AS INTEGER) AS n_points FROM m WHERE kept = file_id""",
}
