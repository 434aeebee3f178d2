"""Registration of point clouds: per pair of clouds in NumPy, pairs in parallel.

A pair is one group (source cloud, target cloud), as large as two scans, never a whole recording.
Every method has the form (source, target, 4x4 start) -> (4x4, fitness, inlier RMSE).
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.runtime import spread

RESULT = "fitness double, rmse double, tx double, ty double, tz double, angle_deg double, matrix array<double>"


#: Clouds whose product of sizes is no larger are compared as a matrix, others by a hash grid.
DENSE = 1 << 18


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum((a[:, None, c] - b[None, :, c]) ** 2 for c in range(3))


def radius_pairs(a: np.ndarray, b: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All index pairs of rows no farther apart than ``r``, with their squared distances."""
    none = np.empty(0, dtype=np.int64)
    if not len(a) or not len(b):
        return none, none, np.empty(0)
    if len(a) * len(b) <= DENSE:
        d2 = _squared(a, b)
        i, j = np.nonzero(d2 <= r * r)
        return i, j, d2[i, j]
    low = np.minimum(a.min(axis=0), b.min(axis=0)) - r
    ca, cb = (np.floor((x - low) / r).astype(np.int64) for x in (a, b))
    size = np.maximum(ca.max(axis=0), cb.max(axis=0)) + 2

    def key(c: np.ndarray) -> np.ndarray:
        return (c[:, 0] * size[1] + c[:, 1]) * size[2] + c[:, 2]

    order = np.argsort(key(cb), kind="stable")
    sorted_keys = key(cb)[order]
    left, right = [], []
    for step in product((-1, 0, 1), repeat=3):
        near = ca + np.array(step)
        ok = np.flatnonzero((near >= 0).all(axis=1) & (near < size).all(axis=1))
        k = key(near[ok])
        s, e = np.searchsorted(sorted_keys, k, "left"), np.searchsorted(sorted_keys, k, "right")
        n = e - s
        left.append(np.repeat(ok, n))
        right.append(order[np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())])
    i, j = np.concatenate(left), np.concatenate(right)
    d2 = ((a[i] - b[j]) ** 2).sum(axis=1)
    keep = d2 <= r * r
    return i[keep], j[keep], d2[keep]


def nearest_within(a: np.ndarray, b: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``b`` (-1 if none within ``r``) and its distance, per row of ``a``."""
    if len(a) and len(b) and len(a) * len(b) <= DENSE:
        d2 = _squared(a, b)
        index = d2.argmin(axis=1)
        least = d2[np.arange(len(a)), index]
        far = least > r * r
        return np.where(far, -1, index), np.where(far, np.inf, np.sqrt(least))
    i, j, d2 = radius_pairs(a, b, r)
    index, dist = np.full(len(a), -1, dtype=np.int64), np.full(len(a), np.inf)
    order = np.lexsort((j, d2, i))
    first = order[np.flatnonzero(np.diff(i[order], prepend=-1))] if len(i) else order
    index[i[first]], dist[i[first]] = j[first], np.sqrt(d2[first])
    return index, dist


def exp_se3(v: np.ndarray) -> np.ndarray:
    """4x4 of a small motion (rotation vector, translation)."""
    w, t = v[:3], v[3:]
    n = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    m = np.eye(4)
    if n > 1e-12:
        m[:3, :3] += np.sin(n) / n * k + (1 - np.cos(n)) / n**2 * k @ k
    m[:3, 3] = t
    return m


def move(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p @ m[:3, :3].T + m[:3, 3]


def evaluate(src: np.ndarray, tgt: np.ndarray, m: np.ndarray, r: float) -> tuple[float, float]:
    if not len(src):
        return 0.0, 0.0
    _, d = nearest_within(move(m, src), tgt, r)
    hit = np.isfinite(d)
    return float(hit.mean()), float(np.sqrt((d[hit] ** 2).mean())) if hit.any() else 0.0


def voxel_mean(p: np.ndarray, size: float) -> np.ndarray:
    if not len(p):
        return p
    _, back, n = np.unique(np.floor(p / size).astype(np.int64), axis=0, return_inverse=True, return_counts=True)
    out = np.zeros((len(n), 3))
    np.add.at(out, back.reshape(-1), p)
    return out / n[:, None]


def covariances(p: np.ndarray, r: float) -> np.ndarray:
    """Scatter of each point's neighbourhood within ``r``, itself included."""
    i, j, _ = radius_pairs(p, p, r)
    n = np.bincount(i, minlength=len(p)).astype(float)
    mean = np.zeros((len(p), 3))
    np.add.at(mean, i, p[j])
    mean /= n[:, None]
    d = p[j] - mean[i]
    c = np.zeros((len(p), 3, 3))
    np.add.at(c, i, d[:, :, None] * d[:, None, :])
    return c / n[:, None, None]


def _step(jac: np.ndarray, res: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    w = jac if weight is None else jac * weight[:, None]
    h = w.T @ jac + 1e-9 * np.eye(6)
    return -np.linalg.solve(h, w.T @ res)


def state_only(src: np.ndarray, tgt: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float, float]:
    """No registration: the start pose is the answer, and nothing is measured."""
    return start, 0.0, 0.0


def icp_plane(scales: list[tuple[float, int]]) -> Callable:
    """Point-to-plane ICP; ``scales`` are correspondence distances with their iterations, coarse to fine."""

    def run(src: np.ndarray, tgt: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float, float]:
        m = start.copy()
        if len(src) < 6 or len(tgt) < 6:
            return m, *evaluate(src, tgt, m, scales[-1][0])
        for r, iterations in scales:
            normal = np.linalg.eigh(covariances(tgt, 2 * r))[1][:, :, 0]
            for _ in range(iterations):
                p = move(m, src)
                j, _ = nearest_within(p, tgt, r)
                hit = j >= 0
                if hit.sum() < 6:
                    break
                n = normal[j[hit]]
                jac = np.hstack([np.cross(p[hit], n), n])
                d = _step(jac, ((p[hit] - tgt[j[hit]]) * n).sum(axis=1))
                m = exp_se3(d) @ m
                if np.abs(d).max() < 1e-7:
                    break
        return m, *evaluate(src, tgt, m, scales[-1][0])

    return run


def planes(p: np.ndarray, r: float, flat: float = 1e-3) -> np.ndarray:
    """The neighbourhood of each point as a covariance that is thin along its normal and round in its plane."""
    v = np.linalg.eigh(covariances(p, r))[1]
    return v @ np.diag([flat, 1.0, 1.0]) @ v.transpose(0, 2, 1)


def _weighted_step(p: np.ndarray, e: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The Gauss-Newton motion for residuals ``e`` of moved points ``p`` with 3x3 weights."""
    jac = np.zeros((len(p), 3, 6))
    x, y, z = p.T
    jac[:, 0, 1], jac[:, 0, 2], jac[:, 1, 0], jac[:, 1, 2], jac[:, 2, 0], jac[:, 2, 1] = z, -y, -z, x, y, -x
    jac[:, :, 3:] = np.eye(3)
    jw = jac.transpose(0, 2, 1) @ w
    return -np.linalg.solve((jw @ jac).sum(axis=0) + 1e-9 * np.eye(6), (jw @ e[:, :, None]).sum(axis=0)[:, 0])


def gicp(scales: list[tuple[float, int]]) -> Callable:
    """Generalised ICP: both neighbourhoods as flattened covariances, residuals weighted by their sum's inverse."""

    def run(src: np.ndarray, tgt: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float, float]:
        m = start.copy()
        if len(src) < 6 or len(tgt) < 6:
            return m, *evaluate(src, tgt, m, scales[-1][0])
        for r, iterations in scales:
            cs, ct = planes(src, 2 * r), planes(tgt, 2 * r)
            for _ in range(iterations):
                p = move(m, src)
                j, _ = nearest_within(p, tgt, r)
                hit = np.flatnonzero(j >= 0)
                if len(hit) < 6:
                    break
                rot = m[:3, :3]
                w = np.linalg.inv(ct[j[hit]] + rot @ cs[hit] @ rot.T)
                d = _weighted_step(p[hit], p[hit] - tgt[j[hit]], w)
                m = exp_se3(d) @ m
                if np.abs(d).max() < 1e-7:
                    break
        return m, *evaluate(src, tgt, m, scales[-1][0])

    return run


def vgicp(scales: list[tuple[float, int]]) -> Callable:
    """Voxelised GICP: a moved source point meets the Gaussian of the target cell it falls into, without any search for neighbours.

    A cell's Gaussian is the mean of its points and of their flattened covariances. Each scale is a cell size with its iterations.
    """

    def run(src: np.ndarray, tgt: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float, float]:
        m = start.copy()
        if len(src) < 6 or len(tgt) < 6:
            return m, *evaluate(src, tgt, m, scales[-1][0])
        for size, iterations in scales:
            cs, ct = planes(src, 2 * size), planes(tgt, 2 * size)
            cells, back, n = np.unique(np.floor(tgt / size).astype(np.int64), axis=0, return_inverse=True, return_counts=True)
            back = back.reshape(-1)
            mean, cov = np.zeros((len(n), 3)), np.zeros((len(n), 3, 3))
            np.add.at(mean, back, tgt)
            np.add.at(cov, back, ct)
            mean, cov = mean / n[:, None], cov / n[:, None, None]
            at = {c: k for k, c in enumerate(map(tuple, cells.tolist()))}
            for _ in range(iterations):
                p = move(m, src)
                cell = np.array([at.get(c, -1) for c in map(tuple, np.floor(p / size).astype(np.int64).tolist())])
                hit = np.flatnonzero(cell >= 0)
                if len(hit) < 6:
                    break
                k, rot = cell[hit], m[:3, :3]
                w = np.linalg.inv(cov[k] + rot @ cs[hit] @ rot.T) * n[k, None, None]
                d = _weighted_step(p[hit], p[hit] - mean[k], w)
                m = exp_se3(d) @ m
                if np.abs(d).max() < 1e-7:
                    break
        return m, *evaluate(src, tgt, m, scales[-1][0])

    return run


def powell(f: Callable[[np.ndarray], float], x: np.ndarray, step: np.ndarray, rounds: int = 50, most: int = 600) -> np.ndarray:
    """Powell's method: line searches along a set of directions; the one that gained most gives way to the round's whole move.

    A line search brackets the least value by doubling its step and then narrows the bracket by the
    golden ratio. ``most`` bounds the evaluations of ``f``.
    """
    left = most
    golden = (np.sqrt(5) - 1) / 2

    def value(y: np.ndarray) -> float:
        nonlocal left
        left -= 1
        return f(y)

    def line(at: np.ndarray, fat: float, d: np.ndarray) -> tuple[np.ndarray, float]:
        low, high = -1.0, 1.0
        best, fbest = 0.0, fat
        for sign in (1.0, -1.0):
            t = sign
            while left > 0:
                v = value(at + t * d)
                if v >= fbest:
                    break
                best, fbest = t, v
                t *= 2
            if best:
                low, high = sorted((best / 2, t))
                break
        for _ in range(10):
            if left < 2:
                break
            t1, t2 = high - golden * (high - low), low + golden * (high - low)
            v1, v2 = value(at + t1 * d), value(at + t2 * d)
            if v1 < v2:
                high = t2
            else:
                low = t1
            for t, v in ((t1, v1), (t2, v2)):
                if v < fbest:
                    best, fbest = t, v
        return at + best * d, fbest

    directions = [np.eye(len(x))[n] * step[n] for n in range(len(x))]
    fx = value(x)
    for _ in range(rounds):
        begin, fbegin, gains = x.copy(), fx, []
        for d in directions:
            before = fx
            x, fx = line(x, fx, d)
            gains.append(before - fx)
        whole = x - begin
        if left <= 0 or fbegin - fx <= 1e-8 * (abs(fbegin) + abs(fx)) + 1e-12:
            break
        if value(x + whole) < fbegin:
            x, fx = line(x, fx, whole)
            directions[int(np.argmax(gains))] = whole
    return x


def ndt(size: float, most_m: float = 5.0, most_rad: float = 0.3) -> Callable:
    """Distribution transform: cells of 5 points and more as Gaussians, fitted by Powell's method within 50 rounds and 600 evaluations.

    Each point is scored by the Gaussian of the nearest cell mean. A result that moves more than
    ``most_m`` or turns more than ``most_rad`` is taken back to the start.
    """

    def run(src: np.ndarray, tgt: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float, float]:
        if len(tgt):
            _, back, n = np.unique(np.floor(tgt / size).astype(np.int64), axis=0, return_inverse=True, return_counts=True)
            full = np.flatnonzero(n >= 5)
        if not len(src) or not len(tgt) or not len(full):
            return start, 0.0, 0.0
        back = back.reshape(-1)
        cells = [tgt[back == c] for c in full]
        mu = np.array([c.mean(axis=0) for c in cells])
        inv = np.linalg.inv(np.array([np.cov(c.T) + 1e-3 * np.eye(3) for c in cells]))

        def cost(v: np.ndarray) -> float:
            p = move(exp_se3(v) @ start, src)
            # Beyond three cells a point's likelihood is nil.
            j, _ = nearest_within(p, mu, size * 3)
            hit = j >= 0
            d = p[hit] - mu[j[hit]]
            return -float(np.exp(-0.5 * np.minimum(np.einsum("ni,nij,nj->n", d, inv[j[hit]], d), 700.0)).sum())

        v = powell(cost, np.zeros(6), np.array([0.02] * 3 + [size / 8] * 3))
        if np.linalg.norm(v[3:]) > most_m or np.linalg.norm(v[:3]) > most_rad:
            v = np.zeros(6)
        m = exp_se3(v) @ start
        return m, *evaluate(src, tgt, m, size)

    return run


BINS = 11


def point_features(p: np.ndarray, normals: np.ndarray, radius: float) -> np.ndarray:
    """Fast point feature histograms: 33 numbers per point, the same after any rigid motion.

    Of each neighbour three angles between both normals and the line that joins them go into three
    histograms of 11 bins; a point's own histograms are then joined by those of its neighbours,
    weighted by nearness. A point without neighbours has zeros.
    """
    i, j, d2 = radius_pairs(p, p, radius)
    other = d2 > 0
    i, j, dist = i[other], j[other], np.sqrt(d2[other])
    n = np.bincount(i, minlength=len(p))
    u, line = normals[i], (p[j] - p[i]) / dist[:, None]
    v = np.cross(u, line)
    length = np.linalg.norm(v, axis=1)
    v = v / np.where(length > 1e-12, length, 1.0)[:, None]
    w = np.cross(u, v)
    angles = ((v * normals[j]).sum(axis=1) / 2 + 0.5, (u * line).sum(axis=1) / 2 + 0.5, np.arctan2((w * normals[j]).sum(axis=1), (u * normals[j]).sum(axis=1)) / (2 * np.pi) + 0.5)
    own = np.zeros((len(p), 3 * BINS))
    for k, a in enumerate(angles):
        np.add.at(own, (i, k * BINS + np.clip((a * BINS).astype(int), 0, BINS - 1)), 1.0)
    own *= 100.0 / np.maximum(n, 1)[:, None]
    out = own.copy()
    np.add.at(out, i, own[j] / (dist * n[i])[:, None])
    return out


def mutual_matches(a: np.ndarray, b: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` that are each other's nearest; blocks of rows are compared at a time."""
    there = np.empty(len(a), dtype=np.int64)
    back, back_d = np.zeros(len(b), dtype=np.int64), np.full(len(b), np.inf)
    b2 = (b * b).sum(axis=1)
    for s in range(0, len(a), block):
        x = a[s : s + block]
        d = (x * x).sum(axis=1)[:, None] + b2[None] - 2 * x @ b.T
        there[s : s + block] = d.argmin(axis=1)
        k = d.argmin(axis=0)
        least = d[k, np.arange(len(b))]
        better = least < back_d
        back[better], back_d[better] = k[better] + s, least[better]
    i = np.flatnonzero(back[there] == np.arange(len(a)))
    return i, there[i]


def rigid_fits(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and shifts that take each set of rows of ``a`` (sets, rows, 3) closest to those of ``b``."""
    ca, cb = a.mean(axis=1), b.mean(axis=1)
    u, _, vt = np.linalg.svd((a - ca[:, None]).transpose(0, 2, 1) @ (b - cb[:, None]))
    flip = np.ones((len(a), 3))
    flip[:, 2] = np.where(np.linalg.det(vt.transpose(0, 2, 1) @ u.transpose(0, 2, 1)) < 0, -1.0, 1.0)
    r = vt.transpose(0, 2, 1) @ (flip[:, :, None] * u.transpose(0, 2, 1))
    return r, cb - (r @ ca[:, :, None])[:, :, 0]


def feature_ransac(size: float, trials: int = 100_000, sure: float = 0.999, seed: int = 42, most_m: float = 10.0, most_rad: float = 0.5) -> Callable:
    """Point feature histograms, matched both ways, then rigid fits of four sampled matches, the best refined by ICP.

    A sample whose edges differ by more than a tenth between both clouds is not fitted. Trials go on
    until a better fit is unlikely to ``sure``, 100,000 at most. Features reach over 5 cells of
    ``size``, matches agree within 1.5. A result that moves too far is taken back to the identity.
    """

    def run(src: np.ndarray, tgt: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float, float]:
        if len(src) < 8 or len(tgt) < 8:
            return start, *evaluate(src, tgt, start, size)

        def described(p: np.ndarray) -> np.ndarray:
            normal = np.linalg.eigh(covariances(p, 2 * size))[1][:, :, 0]
            out = ((p - p.mean(axis=0)) * normal).sum(axis=1) < 0
            return point_features(p, np.where(out[:, None], -normal, normal), 5 * size)

        moved = move(start, src)
        i, j = mutual_matches(described(moved), described(tgt))
        best, score, done = np.eye(4), 0.0, 0
        need = float(trials) if len(i) >= 4 else 0.0
        a, b = moved[i], tgt[j]
        rng = np.random.default_rng(seed)
        while done < min(need, trials):
            pick = np.argsort(rng.random((512, len(i))), axis=1)[:, :4] if len(i) < 64 else rng.integers(0, len(i), (512, 4))
            done += len(pick)
            ea, eb = (np.linalg.norm(x[pick] - x[np.roll(pick, 1, axis=1)], axis=2) for x in (a, b))
            pick = pick[((ea >= 0.9 * eb) & (eb >= 0.9 * ea) & (ea > 0)).all(axis=1)]
            for s in range(0, len(pick), 64):
                r, t = rigid_fits(a[pick[s : s + 64]], b[pick[s : s + 64]])
                off = np.linalg.norm(a @ r.transpose(0, 2, 1) + t[:, None] - b, axis=2)
                good = np.where((np.take_along_axis(off, pick[s : s + 64], axis=1) <= 1.5 * size).all(axis=1), (off <= 1.5 * size).mean(axis=1), 0.0)
                k = int(good.argmax())
                if good[k] > score:
                    score = float(good[k])
                    best = np.eye(4)
                    best[:3, :3], best[:3, 3] = r[k], t[k]
                    need = np.log(1 - sure) / np.log(max(1e-300, 1 - min(score, 1 - 1e-9) ** 4))
        m, fit, rmse = icp_plane([(size, 25)])(src, tgt, best @ start)
        if np.linalg.norm(m[:3, 3]) > most_m or np.arccos(np.clip((np.trace(m[:3, :3]) - 1) / 2, -1, 1)) > most_rad:
            return np.eye(4), *evaluate(src, tgt, np.eye(4), size)
        return m, fit, rmse

    return run


FINE = [(0.5, 25), (0.25, 12), (0.15, 5)]
COARSE = [(8.0, 25), (4.0, 12), (2.0, 5)]


def methods(scales: list[tuple[float, int]]) -> dict[str, Callable]:
    """The registry of methods by name, over a schedule of distances; some names are aliases."""
    g = gicp(scales)
    return {
        "state_only": state_only, "icp_p2l": icp_plane(scales), "icp_single": icp_plane(scales[:1]), "gicp": g, "icp_gicp": g, "small_gicp": g, "vgicp": vgicp(scales),
        "ndt": ndt(scales[0][0]), "fpfh_ransac": feature_ransac(scales[0][0]),
    }


def register_pairs(pairs: DataFrame, key: list[str], method: str, scales: list[tuple[float, int]]) -> DataFrame:
    """(*key, fitness, rmse, tx, ty, tz, angle_deg, matrix) of each pair.

    ``pairs``: one row per pair with src and tgt as arrays of x, y, z structs. Null or empty clouds
    give the identity, fitness 0. The clouds of a row are all that a call holds.
    """
    f = methods(scales)[method]

    def clouds(c: pa.Array) -> list[np.ndarray]:
        """The points of each row, without null, infinite and all-zero ones."""
        sizes = pc.fill_null(pc.list_value_length(c), 0).to_numpy()
        flat = c.flatten()
        p = np.column_stack([flat.field(a).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for a in range(3)]) if len(flat) else np.empty((0, 3))
        p[~flat.is_valid().to_numpy(zero_copy_only=False)] = np.nan
        good = np.isfinite(p).all(axis=1) & (p != 0).any(axis=1)
        ends = np.cumsum(sizes)
        return [p[e - n : e][good[e - n : e]] for n, e in zip(sizes.tolist(), ends.tolist())]

    def run(batches):
        for b in batches:
            out = []
            for src, tgt in zip(clouds(b.column("src")), clouds(b.column("tgt"))):
                m, fit, rmse = f(src, tgt, np.eye(4))
                ang = np.degrees(np.arccos(np.clip((np.trace(m[:3, :3]) - 1) / 2, -1, 1)))
                out.append((fit, rmse, *m[:3, 3].tolist(), float(ang), m.reshape(-1).tolist()))
            cols = list(zip(*out)) if out else [[] for _ in range(7)]
            done = [pa.array(c, type=pa.list_(pa.float64()) if n == 6 else pa.float64()) for n, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in key], *done], names=[*key, "fitness", "rmse", "tx", "ty", "tz", "angle_deg", "matrix"])

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", " + RESULT
    # Small rows, long work: as many tasks as a few rounds of all cores take, which the optimiser would not make of so few bytes.
    tasks = 4 * pairs.sparkSession.sparkContext.defaultParallelism
    return pairs.select(*key, "src", "tgt").repartition(tasks).mapInArrow(run, schema)


def context_blocks(frames: DataFrame, group: str, order: str, cells: str, rings: int, sectors: int, apart: int, block: int = 256) -> DataFrame:
    """(group, order, best, dist): of each frame the earlier frame of its group that is most alike, by scan context.

    ``frames``: (group, order, cells), ``cells`` an array of (bin, h), bin = ring * sectors + sector.
    ``order`` counts the frames of a group; earlier ones count from ``apart`` back on. The distance
    is 1 less the largest cosine of both whole descriptors over all turns by a sector, infinite where
    either has no height; ties go to the earlier frame. Frames with none before them have no row.

    Blocks of frames meet blocks of earlier frames, so a long recording is as many tasks as it has
    pairs of blocks. Turns come from one Fourier transform along the sectors.
    """
    step = F.floor(F.col(order) / block)
    f = frames.select(group, F.col(order).cast("bigint").alias("__o"), F.col(cells).alias("__c"), step.alias("__b"))
    # A block asks all blocks up to its own, and is asked by all from its own on.
    last = f.groupBy(group).agg(F.max("__b").alias("__last"))
    asks = f.withColumn("__t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__b")))).select(group, F.col("__b").alias("__q"), "__t", F.lit(True).alias("__asks"), "__o", "__c")
    told = f.join(last, group).withColumn("__q", F.explode(F.sequence("__b", "__last"))).select(group, "__q", F.col("__b").alias("__t"), F.lit(False).alias("__asks"), "__o", "__c")
    kind = dict(frames.dtypes)[group]

    def spectra(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = np.zeros((len(rows), rings * sectors))
        for n, c in enumerate(rows["__c"]):
            for x in c if c is not None else ():
                d[n, x["bin"]] = x["h"]
        return rows["__o"].to_numpy(), np.sqrt((d * d).sum(axis=1)), np.fft.rfft(d.reshape(-1, rings, sectors), axis=2).transpose(2, 0, 1)

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        q, t = p[p["__asks"]], p[~p["__asks"]]
        if not len(q) or not len(t):
            return pd.DataFrame({group: [], "__o": [], "best": [], "dist": []}).astype({"__o": "int64", "best": "int64", "dist": "float64"})
        oq, nq, fq = spectra(q)
        ot, nt, ft = spectra(t)
        dots = np.fft.irfft(np.conj(fq) @ ft.transpose(0, 2, 1), n=sectors, axis=0).max(axis=0)
        norm = nq[:, None] * nt[None]
        dist = np.where(norm > 0, np.abs(np.round(1 - dots / np.where(norm > 0, norm, 1.0), 6)), np.inf)
        dist[ot[None] > oq[:, None] - apart] = np.nan
        rank = np.lexsort((np.broadcast_to(ot, dist.shape), dist), axis=1)[:, 0]
        got = np.arange(len(q)), rank
        ok = ~np.isnan(dist[got])
        return pd.DataFrame({group: q[group].to_numpy()[ok], "__o": oq[ok], "best": ot[rank[ok]], "dist": dist[got][ok]})

    found = spread(asks.unionByName(told), group, "__q", "__t").groupBy(group, "__q", "__t").applyInPandas(compare, f"`{group}` {kind}, __o bigint, best bigint, dist double")
    return found.groupBy(group, F.col("__o").alias(order)).agg(F.min_by("best", F.struct("dist", "best")).alias("best"), F.min("dist").alias("dist"))
