"""Pose graphs: priors, motions between poses, GPS positions and loop closures.

Gauss-Newton over poses only, one group per recording; the normal equations are solved by
conjugate gradients with block-diagonal preconditioning, so memory follows nodes plus edges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators.registration import exp_se3
from aerolith.runtime import spread


def log_se3(m: np.ndarray) -> np.ndarray:
    """Rotation vector and translation of a 4x4."""
    r = m[:3, :3]
    c = np.clip((np.trace(r) - 1) / 2, -1, 1)
    a = np.arccos(c)
    w = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    return np.concatenate([w * (0.5 if a < 1e-9 else a / (2 * np.sin(a))), m[:3, 3]])


def adjoint(m: np.ndarray) -> np.ndarray:
    r, t = m[:3, :3], m[:3, 3]
    k = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]])
    out = np.zeros((6, 6))
    out[:3, :3] = out[3:, 3:] = r
    out[3:, :3] = k @ r
    return out


def _residuals(poses: list[np.ndarray], priors: list[tuple], betweens: list[tuple], gps: list[tuple]):
    """Of each factor the touched poses with their Jacobians, and the weighted residual."""
    for i, z, s in priors:
        yield [(i, np.eye(6) / s)], log_se3(np.linalg.inv(z) @ poses[i]) / s
    for i, j, z, s in betweens:
        rel = np.linalg.inv(poses[i]) @ poses[j]
        yield [(i, -adjoint(np.linalg.inv(rel)) / s), (j, np.eye(6) / s)], log_se3(np.linalg.inv(z) @ rel) / s
    for i, p, s in gps:
        jac = np.zeros((3, 6))
        jac[:, 3:] = poses[i][:3, :3]
        yield [(i, jac / s)], (poses[i][:3, 3] - p) / s


def _gradient_step(blocks: list, n: int, damping: float) -> np.ndarray:
    """Solve the damped normal equations by preconditioned conjugate gradients, all factors at a time."""
    m = len(blocks)
    # Every factor as two poses with 6 rows each; what a factor lacks is zero.
    at, jac, res = np.zeros((m, 2), dtype=np.int64), np.zeros((m, 2, 6, 6)), np.zeros((m, 6))
    for f, (parts, r) in enumerate(blocks):
        res[f, : len(r)] = r
        for s, (i, j) in enumerate(parts):
            at[f, s], jac[f, s, : len(j)] = i, j
    flat, turned = at.reshape(-1), jac.transpose(0, 1, 3, 2).reshape(-1, 6, 6)

    def gathered(v: np.ndarray) -> np.ndarray:
        out = np.zeros((n, *v.shape[1:]))
        np.add.at(out, flat, v)
        return out

    g = -gathered((turned @ np.repeat(res, 2, axis=0)[:, :, None])[:, :, 0])
    diag = gathered(turned @ jac.reshape(-1, 6, 6))
    extra = damping * (np.einsum("nii->ni", diag) + 1e-6)
    # Scaling the unknowns to unit diagonal keeps the blocks invertible whatever the units.
    scale = 1 / np.sqrt(np.einsum("nii->ni", diag) + extra + 1e-12)
    pre = np.linalg.pinv(diag * scale[:, :, None] * scale[:, None, :] + np.einsum("ni,ij->nij", extra * scale**2, np.eye(6)), hermitian=True)

    def times(x: np.ndarray) -> np.ndarray:
        y = x * scale
        v = (jac @ y[at][:, :, :, None]).sum(axis=1)
        return (extra * y + gathered((turned @ np.repeat(v, 2, axis=0))[:, :, 0])) * scale

    x, r = np.zeros((n, 6)), g * scale
    z = (pre @ r[:, :, None])[:, :, 0]
    p, rz = z.copy(), float((r * z).sum())
    stop = 1e-18 * max(rz, 1e-300)
    for _ in range(6 * n + 20):
        if rz <= stop:
            break
        ap = times(p)
        a = rz / float((p * ap).sum())
        x += a * p
        r -= a * ap
        z = (pre @ r[:, :, None])[:, :, 0]
        new = float((r * z).sum())
        p, rz = z + new / rz * p, new
    return x * scale


def solve(poses: list[np.ndarray], priors: list[tuple], betweens: list[tuple], gps: list[tuple], rounds: int = 15) -> list[np.ndarray]:
    """Optimised poses. priors: (i, 4x4, sigma); betweens: (i, j, 4x4, sigma); gps: (i, xyz, sigma).

    Damped: a step that does not lower the summed squared error is not taken.
    """
    poses, damping = [p.copy() for p in poses], 1e-6
    blocks = list(_residuals(poses, priors, betweens, gps))
    cost = sum(float(r @ r) for _, r in blocks)
    for _ in range(rounds):
        x = _gradient_step(blocks, len(poses), damping)
        tried = [q @ exp_se3(d) for q, d in zip(poses, x)]
        new = list(_residuals(tried, priors, betweens, gps))
        total = sum(float(r @ r) for _, r in new)
        if total < cost:
            done = cost - total < 1e-12 * cost or np.abs(x).max() < 1e-9
            poses, blocks, cost, damping = tried, new, total, damping / 5
            if done:
                break
        else:
            damping *= 20
            if damping > 1e6:
                break
    return poses


def pose_matrix(px: float, py: float, pz: float, w: float, x: float, y: float, z: float) -> np.ndarray:
    m = np.eye(4)
    m[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    m[:3, 3] = (px, py, pz)
    return m


def noise(rmse: float) -> float:
    """Standard deviation of a motion that ICP measured with this error; 0.5 where there is no error to go by."""
    return max(0.05, rmse * 0.5, 0.10, rmse * 1.5) if rmse > 0 else 0.5


def optimise(
    nodes: DataFrame,
    group: str,
    order: str,
    gps_sigma: float = 0.2,
    prior_sigma: float = 1e-3,
    odometry: DataFrame | None = None,
    loops: DataFrame | None = None,
    jolt: tuple[float, float, float] | None = None,
) -> DataFrame:
    """(group, order, x, y, z, moved, matrix): poses per group after optimisation, and how far each moved.

    ``nodes``: (group, order, px..pz, qw..qz, gx, gy, gz), GPS null where there is none. ``odometry``:
    (group, order, matrix, rmse), what moves a frame's scan onto that of the frame before it in the
    world; without it the poses' own motion counts. ``loops``: (group, a, b, matrix, rmse), what moves
    b's scan onto a's in the world: pose b as seen from pose a is inverse(a) * matrix * b. The error
    of each measured motion gives its weight. ``jolt`` puts the start of all but the first pose off
    by (x, y, yaw). A group is one recording's poses, never its points.
    """
    kinds = dict(nodes.dtypes)
    schema = f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, x double, y double, z double, moved double, matrix array<double>"
    spark = nodes.sparkSession
    none = spark.createDataFrame([], f"`{group}` {kinds[group]}, a {kinds[order]}, b {kinds[order]}, matrix array<double>, rmse double")
    edges = none
    if odometry is not None:
        edges = edges.unionByName(odometry.select(group, F.lit(None).cast(kinds[order]).alias("a"), F.col(order).alias("b"), "matrix", "rmse"))
    if loops is not None:
        edges = edges.unionByName(loops.select(group, "a", "b", "matrix", "rmse"))

    def run(key: tuple, d: pd.DataFrame, measured: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(order, ignore_index=True)
        raw = [pose_matrix(*r) for r in d[["px", "py", "pz", "qw", "qx", "qy", "qz"]].itertuples(index=False)]
        at = {o: i for i, o in enumerate(d[order].tolist())}
        step, extra = {}, []
        for a, b, m, rmse in measured[["a", "b", "matrix", "rmse"]].itertuples(index=False):
            m = np.asarray(m, dtype=float).reshape(4, 4)
            if pd.isna(a):
                step[at.get(b)] = (m, rmse)
            elif a in at and b in at:
                extra.append((at[a], at[b], np.linalg.inv(raw[at[a]]) @ m @ raw[at[b]], noise(rmse)))
        between = []
        for i in range(1, len(raw)):
            m, rmse = step.get(i, (np.eye(4), 0.0))
            between.append((i - 1, i, np.linalg.inv(raw[i - 1]) @ m @ raw[i], noise(rmse)))
        fix = [(i, np.array(p), gps_sigma) for i, p in enumerate(d[["gx", "gy", "gz"]].to_numpy(dtype=float).tolist()) if np.isfinite(p).all()]
        off = exp_se3(np.array([0.0, 0.0, jolt[2], jolt[0], jolt[1], 0.0])) if jolt else np.eye(4)
        start = [m @ off if i else m for i, m in enumerate(raw)]
        done = solve(start, [(0, raw[0], prior_sigma)] if raw else [], between + extra, fix)
        p = np.array([m[:3, 3] for m in done]).reshape(-1, 3)
        return pd.DataFrame({group: d[group], order: d[order], "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "moved": np.linalg.norm(p - d[["px", "py", "pz"]].to_numpy(), axis=1), "matrix": [m.reshape(-1).tolist() for m in done]})

    return spread(nodes, group).groupBy(group).cogroup(spread(edges, group).groupBy(group)).applyInPandas(run, schema)
