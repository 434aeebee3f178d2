"""Problem 2: for every scan the nearest imu and gps reading of its vehicle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.timeunits import TO_NS_SQL, to_ns, usable_reading, usable_sql
from aerolith.llm.nearest_time import Side, match_bounded, several_sides, side_rows
from aerolith.runtime import path_handle

SIDES = [Side(1, "imu", 30_000_000), Side(2, "gps", 120_000_000)]
#: Readings arrive up to some ten hours late.
LATENESS_NS = 12 * 3600 * 1_000_000_000
#: About so many batches, of even bytes, make up what the sources hold.
BATCHES = 8


def _stream(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """A table as a stream of its present files, a part of them in each batch; a stream wants a folder, so a lone file is picked out of its own."""
    path = f"{sf_dir}/{name}.parquet"
    fs, p = path_handle(spark, path)
    size = fs.getContentSummary(p).getLength()
    reader = spark.readStream.schema(spark.read.parquet(path).select(*columns).schema).option("maxBytesPerTrigger", max(1, -(-size // BATCHES)))
    return reader.parquet(path) if fs.getFileStatus(p).isDirectory() else reader.option("pathGlobFilter", p.getName()).parquet(sf_dir)


def _matches(spark: SparkSession, sf_dir: str, seen: dict | None = None) -> DataFrame:
    scans = _stream(spark, sf_dir, "scan_buffer", ["scan_id", "vehicle", "lidar_ts"])
    left = side_rows(scans, None, F.col("vehicle"), to_ns(F.col("lidar_ts")), F.col("scan_id"))
    samples = _stream(spark, sf_dir, "sensor_sample", ["sample_id", "vehicle", "sensor", "ts_ns", "v"])
    samples = samples.where(F.col("sensor").isin([s.name for s in SIDES]) & usable_reading(F.col("sensor"), F.col("v")))
    number = F.create_map(*[x for s in SIDES for x in (F.lit(s.name), F.lit(s.number))])[F.col("sensor")]
    right = several_sides(samples, SIDES, number, F.col("vehicle"), to_ns(F.col("ts_ns")), F.col("sample_id"))
    return match_bounded(spark, [left, right], SIDES, LATENESS_NS, seen)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select(F.col("left_id").alias("scan_id"), F.col("side").alias("sensor"), F.col("right_id").alias("sample_id"))


def p2_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart in time the pairs are, per sensor."""
    gap = F.abs(F.col("right_ts") - F.col("left_ts"))
    return (
        _matches(spark, sf_dir).groupBy(F.col("side").alias("sensor"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_gap_ns"), F.count_if(gap == 0).alias("n_exact"))
    )


def _side_sql(s: Side) -> str:
    u = f"u_{s.name}"
    return f"""SELECT scan_id, '{s.name}' AS sensor, ts AS left_ts, CASE WHEN bt IS NULL OR (aft IS NOT NULL AND aft - ts < ts - bt) THEN struct_pack(t := aft, i := ai) ELSE struct_pack(t := bt, i := bi) END AS pick, {s.tolerance_ns} AS tol
  FROM (SELECT s.scan_id, s.ts, b.ts AS bt, b.id AS bi, a.ts AS aft, a.id AS ai FROM s
    ASOF LEFT JOIN {u} b ON s.vehicle = b.vehicle AND s.ts >= b.ts ASOF LEFT JOIN {u} a ON s.vehicle = a.vehicle AND s.ts <= a.ts)"""


_WITH = f"""WITH s AS (SELECT DISTINCT scan_id, vehicle, {TO_NS_SQL.format("lidar_ts")} AS ts FROM scan_buffer WHERE lidar_ts IS NOT NULL AND vehicle IS NOT NULL),
""" + ",\n".join(
    f"u_{s.name} AS (SELECT vehicle, {TO_NS_SQL.format('ts_ns')} AS ts, min(sample_id) AS id FROM sensor_sample WHERE sensor = '{s.name}' AND vehicle IS NOT NULL AND ts_ns IS NOT NULL AND {usable_sql('sensor', 'v')} GROUP BY ALL)"
    for s in SIDES
)
_PAIRS = f"{_WITH}, p AS ({' UNION ALL '.join(_side_sql(s) for s in SIDES)}), m AS (SELECT scan_id, sensor, pick.i AS sample_id, abs(pick.t - left_ts) AS gap FROM p WHERE abs(pick.t - left_ts) <= tol)"

QUERIES = {"p2_found": p2_found, "p2_gaps": p2_gaps}
SQL = {
    "p2_found": f"{_PAIRS} SELECT scan_id, sensor, sample_id FROM m",
    "p2_gaps": f"{_PAIRS} SELECT sensor, count(*) AS n, max(gap) AS max_gap_ns, CAST(count_if(gap = 0) AS BIGINT) AS n_exact FROM m GROUP BY sensor",
}
