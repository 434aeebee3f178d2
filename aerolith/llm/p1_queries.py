"""Problem 1: percentiles of frame timings per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import quantiles as Q
from aerolith.runtime import table

METRICS = ["t_total_ms", "t_gtsam_ms", "t_octo_insert_ms"]
PS = [0.5, 0.9, 0.95, 0.99]
#: Values in a buffer for the ratio of two percentiles of a run of some hundred frames: its sketch collapses from
#: 4 * 128 values on, and is off by 0.4 % of the ranks for each level of its tree.
K_RATIO = 128
#: The same for all runs together: small enough that a few thousand values make several levels.
K_ALL = 64


def _named(d: DataFrame) -> DataFrame:
    return d.select("run_id", "metric", "n", *[F.round(F.col("qs")[i], 6).alias(f"p{round(p * 100)}") for i, p in enumerate(PS)])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Q.group_percentiles(table(spark, sf_dir, "frame_timing"), ["run_id"], METRICS, [0.5, 0.95], K_RATIO)
    return d.where(F.col("qs")[1] > 4 * F.col("qs")[0]).select("run_id", "metric")


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(Q.group_percentiles(table(spark, sf_dir, "frame_timing"), ["run_id"], METRICS, PS))


def p1_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from sketches of single days, as they would be stored, combined per run."""
    t = table(spark, sf_dir, "frame_timing")
    days = t.select("run_id", F.to_date("logged_at").alias("day"), *METRICS)
    daily = Q.merge(Q.sketches(days, ["run_id", "day"], METRICS), ["run_id", "day"], days.rdd.getNumPartitions())
    parts = daily.drop("day").withColumn("part", F.pmod(F.xxhash64("run_id", "n", "moved", "tail"), F.lit(Q.FAN_IN)))
    return _named(Q.percentiles(Q.merge(parts, ["run_id"], Q.FAN_IN), ["run_id"], PS))


def p1_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs together, in sketches that collapse: is each answer as near to its rank as the sketch certifies.

    The true ranks of the answers, three metrics by four percentiles, are counted in one more pass.
    """
    t = table(spark, sf_dir, "frame_timing")
    done = Q.group_percentiles(t.withColumn("all_runs", F.lit("all")), ["all_runs"], METRICS, PS, K_ALL).collect()
    counts = [
        F.count_if((F.col(r["metric"]) >= 0) & (F.col(r["metric"]) < float("inf")) & (F.col(r["metric"]) < q if below else F.col(r["metric"]) <= q)).alias(f"{r['metric']}_{i}_{below}")
        for r in done for i, q in enumerate(r["qs"]) for below in (True, False)
    ]
    if not counts:
        return spark.createDataFrame([], "metric string, p double, n bigint, collapsed boolean, within boolean")
    ranks = t.agg(*counts).first()
    out = []
    for r in done:
        for i, p in enumerate(PS):
            want, low, high = p * (r["n"] - 1), ranks[f"{r['metric']}_{i}_True"], ranks[f"{r['metric']}_{i}_False"]
            out.append((r["metric"], p, r["n"], r["max_rank_error"] > 0, low - 1 - r["max_rank_error"] <= want <= high + r["max_rank_error"]))
    return spark.createDataFrame(out, "metric string, p double, n bigint, collapsed boolean, within boolean")


_LONG = "WITH u AS (" + " UNION ALL ".join(f"SELECT run_id, '{m}' AS metric, {m} AS v FROM frame_timing WHERE {m} IS NOT NULL AND isfinite({m}) AND {m} >= 0" for m in METRICS) + ")"
_ALL = f"{_LONG} SELECT run_id, metric, count(*) AS n, " + ", ".join(f"round(quantile_cont(v, {p}), 6) AS p{round(p * 100)}" for p in PS) + " FROM u GROUP BY run_id, metric"

QUERIES = {"p1_found": p1_found, "p1_percentiles": p1_percentiles, "p1_from_days": p1_from_days, "p1_bounded": p1_bounded}
SQL = {
    "p1_found": f"{_LONG} SELECT run_id, metric FROM u GROUP BY run_id, metric HAVING quantile_cont(v, 0.95) > 4 * quantile_cont(v, 0.5)",
    "p1_percentiles": _ALL,
    "p1_from_days": _ALL,
    "p1_bounded": f"{_LONG} SELECT metric, CAST(p AS DOUBLE) AS p, count(*) AS n, count(*) >= {4 * K_ALL} AS collapsed, true AS within FROM u, (SELECT unnest({PS}) AS p) GROUP BY metric, p",
}
