"""Plane fits from moment sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_planes(points: DataFrame, group: list[str], least: int = 10) -> DataFrame:
    """Per group: n, slopes dz/dx and dz/dy, and residual (population deviation along the normal).

    The points are reduced to nine moments per group by one partial aggregate; only these rows
    reach Python, where the normal is the eigenvector of the smallest eigenvalue. Fewer than
    ``least`` points give null slopes and an infinite residual; a vertical plane null slopes.
    """
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    m = points.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.covar_pop(a, b), F.lit(0.0)).alias(f"c{a}{b}") for a, b in pairs])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = np.empty((len(b), 3, 3))
            for name, i, j in (("cxx", 0, 0), ("cxy", 0, 1), ("cxz", 0, 2), ("cyy", 1, 1), ("cyz", 1, 2), ("czz", 2, 2)):
                c[:, i, j] = c[:, j, i] = b[name].to_numpy()
            w, v = np.linalg.eigh(c)
            n = v[:, :, 0]
            few = b["n"].to_numpy() < least
            flat = few | (np.abs(n[:, 2]) < 1e-12)
            z = np.where(flat, 1.0, n[:, 2])
            out = b[[*group, "n"]].copy()
            out["slope_x"] = pd.Series(np.where(flat, np.nan, -n[:, 0] / z), index=b.index)
            out["slope_y"] = pd.Series(np.where(flat, np.nan, -n[:, 1] / z), index=b.index)
            out["residual"] = np.where(few, np.inf, np.sqrt(np.maximum(w[:, 0], 0)))
            yield out

    kinds = dict(points.dtypes)
    schema = ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", n bigint, slope_x double, slope_y double, residual double"
    return m.mapInPandas(solve, schema)
