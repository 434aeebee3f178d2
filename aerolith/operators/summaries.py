"""Aggregates over clouds, timings and trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.operators.voxel import cell


def first_seen(points: DataFrame, group: list[str], frame: str, resolution: float) -> DataFrame:
    """(*group, i, j, k, first): the first frame of each voxel. One partial aggregate; nothing is sorted."""
    idx = [cell(F.col(a), resolution).alias(i) for a, i in zip("xyz", "ijk")]
    return points.groupBy(*group, *idx).agg(F.min(frame).alias("first"))


def downsample(points: DataFrame, group: list[str], resolution: float) -> DataFrame:
    """One mean point per voxel and group, with its number of points."""
    idx = [cell(F.col(a), resolution).alias(i) for a, i in zip("xyz", "ijk")]
    return points.groupBy(*group, *idx).agg(*[F.avg(a).alias(a) for a in "xyz"], F.count(F.lit(1)).alias("n"))


def step_timing(long: DataFrame, step: str, seconds: str) -> DataFrame:
    """Sum, mean, max, min, population deviation, share of all steps' sum in percent, and count."""
    per = long.groupBy(step).agg(
        F.sum(seconds).alias("total_s"), F.avg(seconds).alias("mean_s"), F.max(seconds).alias("max_s"), F.min(seconds).alias("min_s"), F.stddev_pop(seconds).alias("std_s"), F.count(seconds).alias("n")
    )
    # The steps are as few as the names in the log, so one partition for their sum is no bottleneck.
    return per.withColumn("pct", 100 * F.col("total_s") / F.sum("total_s").over(Window.partitionBy()))


def trials(df: DataFrame, label: list[str], metrics: list[str], digits: int = 6) -> DataFrame:
    """Mean and sample deviation (0 for one run) of each metric per label, and the number of runs."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_runs")]
    for m in metrics:
        aggs += [F.round(F.avg(m), digits).alias(m), F.round(F.when(F.count(m) > 0, F.coalesce(F.stddev_samp(m), F.lit(0.0))), digits).alias(f"{m}_std")]
    return df.groupBy(*label).agg(*aggs)


def histogram(df: DataFrame, value: str, top: DataFrame, bins: int) -> DataFrame:
    """(bin, n) of ``bins`` equal bins from 0 to ``top`` (one row, one column); the last bin is closed, larger values are left out."""
    limit = top.scalar()
    d = df.select(F.col(value).alias("v"), limit.alias("top")).where((F.col("v") >= 0) & (F.col("v") <= F.col("top")))
    at = F.least(F.lit(bins), F.floor(F.col("v") / (F.col("top") / bins)) + 1).cast("bigint")
    return d.select(at.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


#: Values that one task may sort to settle a quantile.
SETTLE = 100_000


def exact_quantile(df: DataFrame, value: str, p: float, settle: int = SETTLE) -> float | None:
    """The interpolated quantile of a whole column, exact, without all values in one task; None if there are none.

    An approximate quantile on either side bounds a window around the rank; its values are counted
    exactly and the window is narrowed again until so few are left that one task sorts them. Null and
    NaN are no values. A value that fills the window by its copies is the answer.
    """
    v = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    within, below = v.count(), 0
    if not within:
        return None
    rank, window = p * (within - 1), v
    while within > settle:
        at = (rank - below) / (within - 1)
        low, high = window.agg(F.percentile_approx("v", [max(0.0, at - 0.001), min(1.0, at + 0.001)], 10_000)).first()[0]
        less, some = window.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if not (below + less <= rank and rank + 1 <= below + less + some) or (some == within and low < high):
            break
        window, below, within = window.where(F.col("v").between(low, high)), below + less, some
        if low == high:
            return low
    return window.agg(F.percentile("v", (rank - below) / max(1, within - 1))).first()[0]
