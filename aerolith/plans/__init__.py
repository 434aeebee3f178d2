"""Registered queries and their SQL twins."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that hold QUERIES and SQL.
MODULES = ["core_training", "scalar", "joins", "aggregates", "windows", "planner", "mapping", "files", "streams"]


def registered() -> tuple[dict, dict[str, str]]:
    q: dict = {}
    s: dict[str, str] = {}
    for name in MODULES:
        m = importlib.import_module(f"aerolith.plans.{name}")
        twice = set(q) & set(m.QUERIES)
        if twice:
            raise ValueError(f"queries named twice: {sorted(twice)}")
        q |= m.QUERIES
        s |= m.SQL
    return q, s


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerolith.operators.voxel import occupied_per_group
    from aerolith.runtime import table

    frames = table(spark, sf_dir, "lidar_frame")
    return occupied_per_group(frames, "recording", 0.5)
