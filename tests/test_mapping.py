import numpy as np
import pytest

from aerolith.operators import posegraph as P
from aerolith.operators import registration as R


@pytest.fixture(scope="module")
def room():
    rng = np.random.default_rng(4)
    n = 300
    walls = [np.column_stack([rng.uniform(-5, 5, n), rng.uniform(-5, 5, n), np.zeros(n)]), np.column_stack([rng.uniform(-5, 5, n), np.full(n, 5.0), rng.uniform(0, 4, n)]), np.column_stack([np.full(n, -5.0), rng.uniform(-5, 5, n), rng.uniform(0, 4, n)])]
    box = rng.uniform([1, 1, 0.1], [2, 2, 1], (200, 3))
    return np.vstack([*walls, box])


TRUE = R.exp_se3(np.array([0.01, -0.02, 0.04, 0.15, -0.1, 0.08]))


@pytest.mark.parametrize("name,close", [("icp_p2l", 0.01), ("gicp", 0.01), ("icp_single", 0.02), ("ndt", 0.12), ("fpfh_ransac", 0.05), ("vgicp", 0.05)])
def test_methods_recover_a_known_motion(room, name, close):
    src = R.move(np.linalg.inv(TRUE), room)
    m, fit, rmse = R.methods([(1.0, 30), (0.5, 15)])[name](src, room, np.eye(4))
    assert np.linalg.norm(m[:3, 3] - TRUE[:3, 3]) < close
    assert fit > 0.95


def test_small_and_empty_clouds():
    none, few = np.empty((0, 3)), np.ones((2, 3))
    for name, f in R.methods([(1.0, 5)]).items():
        for a, b in ((none, none), (few, none), (none, few), (few, few)):
            m, _, _ = f(a, b, np.eye(4))
            assert np.allclose(m, np.eye(4)), name


def test_radius_pairs_against_brute_force():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(60, 3)), rng.normal(size=(80, 3))
    i, j, _ = R.radius_pairs(a, b, 0.7)
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(d <= 0.7))))
    idx, dist = R.nearest_within(a, b, 10.0)
    assert (idx == d.argmin(axis=1)).all() and np.allclose(dist, d.min(axis=1))


def test_two_pose_graph():
    start = [np.eye(4), P.pose_matrix(2.1, 0.1, 0, np.cos(0.025), 0, 0, np.sin(0.025))]
    odometry = np.eye(4)
    odometry[0, 3] = 2.0
    done = P.solve(start, [(0, np.eye(4), 0.01)], [(0, 1, odometry, 0.1)], [])
    assert np.allclose(done[1], odometry, atol=1e-6)


def test_gps_and_loops_pull_a_drifted_chain():
    truth = [P.pose_matrix(float(i), 0, 0, 1, 0, 0, 0) for i in range(20)]
    step = P.pose_matrix(1.0, 0.05, 0, 1, 0, 0, 0)
    start = [np.linalg.matrix_power(step, i) for i in range(20)]
    z = [(i, i + 1, step, 0.5) for i in range(19)]
    done = P.solve(start, [(0, truth[0], 1e-3)], z, [(i, truth[i][:3, 3], 0.2) for i in range(0, 20, 2)])
    assert abs(done[-1][1, 3]) < abs(start[-1][1, 3]) / 2
    closed = P.solve(start, [(0, truth[0], 1e-3)], [*z, (0, 19, np.eye(4), 0.01)], [])
    assert np.linalg.norm(closed[-1][:3, 3]) < 0.5


def test_far_jumps_do_not_break_the_solver():
    rng = np.random.default_rng(0)
    poses = [P.pose_matrix(*rng.uniform(-3000, 3000, 3), *(lambda q: q / np.linalg.norm(q))(rng.normal(size=4))) for _ in range(12)]
    z = [(i, i + 1, np.linalg.inv(poses[i]) @ poses[i + 1], 0.5) for i in range(11)]
    done = P.solve(poses, [(0, poses[0], 1e-3)], z, [(i, poses[i][:3, 3] + 1, 0.2) for i in range(12)])
    assert all(np.isfinite(m).all() for m in done)


def test_register_pairs_nulls(spark):
    p = [(1.0, 2.0, 3.0)]
    df = spark.createDataFrame([(1, None, p), (2, [], None), (3, p, p)], "id long, src array<struct<x: float, y: float, z: float>>, tgt array<struct<x: float, y: float, z: float>>")
    rows = R.register_pairs(df, ["id"], "icp_p2l", [(1.0, 3)]).collect()
    assert sorted((r["id"], r["tx"]) for r in rows) == [(1, 0.0), (2, 0.0), (3, 0.0)]


def test_features_do_not_turn_with_the_cloud(room):
    room = room + np.random.default_rng(8).normal(0, 0.02, room.shape)  # exactly flat walls put angles on the borders of bins
    normal = np.linalg.eigh(R.covariances(room, 1.0))[1][:, :, 0]
    f = R.point_features(room, normal, 2.0)
    turn = R.exp_se3(np.array([0.3, -0.4, 0.9, 5, 6, 7]))
    g = R.point_features(R.move(turn, room), normal @ turn[:3, :3].T, 2.0)
    assert f.shape == (len(room), 33) and np.abs(f - g).max(axis=1).mean() < 1.0
    i, j = R.mutual_matches(f, g, block=97)
    assert (i == j).mean() > 0.9


def test_sampled_fits_recover_a_large_motion(room):
    big = R.exp_se3(np.array([0.1, -0.2, 0.3, 1.5, -1.0, 0.8]))
    m, fit, _ = R.methods([(1.0, 30)])["fpfh_ransac"](R.move(np.linalg.inv(big), room), room, np.eye(4))
    assert np.allclose(m, big, atol=0.05) and fit > 0.95


def test_powell_finds_the_least_value():
    x = R.powell(lambda v: float((v[0] - 3) ** 2 + 10 * (v[1] + v[0]) ** 2), np.zeros(2), np.ones(2))
    assert np.allclose(x, [3, -3], atol=0.05)


def test_context_blocks_against_a_loop(spark):
    """Blocks of three frames: the same best frames as comparing each with all before it, turn by turn."""
    rng = np.random.default_rng(2)
    rings, sectors, apart = 3, 8, 2
    descs = np.where(rng.random((14, rings, sectors)) < 0.3, rng.normal(size=(14, rings, sectors)), 0.0)
    descs[9] = np.roll(descs[3], 5, axis=1)
    descs[6] = 0
    data = [("r", n, [{"bin": b, "h": float(h)} for b, h in enumerate(d.reshape(-1)) if h] or None) for n, d in enumerate(descs)]
    df = spark.createDataFrame(data, "g string, idx long, cells array<struct<bin: int, h: double>>")
    got = {r["idx"]: (r["best"], r["dist"]) for r in R.context_blocks(df, "g", "idx", "cells", rings, sectors, apart, block=3).collect()}
    want = {}
    for i in range(apart, 14):
        dist = []
        for j in range(i - apart + 1):
            a, n = descs[i].reshape(-1), np.linalg.norm(descs[i]) * np.linalg.norm(descs[j])
            best = max(float(a @ np.roll(descs[j], s, axis=1).reshape(-1)) for s in range(sectors))
            dist.append((abs(round(1 - best / n, 6)) if n else float("inf"), j))
        d, j = min(dist)
        want[i] = (j, d)
    assert got == want and got[9] == (3, 0.0)


def square(n, drift):
    """Poses around a square that ends where it began, and the same with a yaw drift in every step."""
    truth, seen = [np.eye(4)], [np.eye(4)]
    for i in range(4 * n):
        turn = np.pi / 2 if i % n == n - 1 else 0.0
        truth.append(truth[-1] @ R.exp_se3(np.array([0, 0, turn, 0, 0, 0])) @ P.pose_matrix(1.0, 0, 0, 1, 0, 0, 0))
        seen.append(seen[-1] @ R.exp_se3(np.array([0, 0, turn + drift, 0, 0, 0])) @ P.pose_matrix(1.0, 0, 0, 1, 0, 0, 0))
    return truth, seen


def test_a_confirmed_loop_takes_out_the_drift(spark):
    """The loop's measure moves the last scan onto the first one in the drifted world: the end error falls to a tenth."""
    truth, seen = square(8, 0.01)
    last = len(seen) - 1

    def node(i, m):
        yaw = np.arctan2(m[1, 0], m[0, 0])
        return ("r", i, *map(float, m[:3, 3]), float(np.cos(yaw / 2)), 0.0, 0.0, float(np.sin(yaw / 2)), None, None, None)

    nodes = spark.createDataFrame([node(i, m) for i, m in enumerate(seen)], "g string, n long, px double, py double, pz double, qw double, qx double, qy double, qz double, gx double, gy double, gz double")
    # Both scans see the same wall: seen[0] @ inv(truth[0]) @ truth[last] is where the last pose must lie.
    fix = (seen[0] @ np.linalg.inv(truth[0]) @ truth[last]) @ np.linalg.inv(seen[last])
    loops = spark.createDataFrame([("r", 0, last, fix.reshape(-1).tolist(), 0.01)], "g string, a long, b long, matrix array<double>, rmse double")

    def end(df):
        r = df.where(f"n = {last}").first()
        return np.linalg.norm(np.array([r["x"], r["y"], r["z"]]) - truth[last][:3, 3])

    open_, closed = end(P.optimise(nodes, "g", "n")), end(P.optimise(nodes, "g", "n", loops=loops))
    assert open_ > 1.0 and closed < open_ / 10


def test_two_trees_meet():
    from aerolith.operators.trees import free, grow_two

    course = [(3.0, 3.0, 1.0), (6.0, 5.0, 1.2)]
    for seed in range(4):
        nodes = grow_two(seed, (1.0, 1.0), (9.0, 9.0), 10.0, course)
        path = [n for n in nodes if n[4]]
        assert {(n[2], n[3]) for n in path if n[1] == -1} == {(1.0, 1.0), (9.0, 9.0)}
        assert all(free(n[2], n[3], nodes[n[1]][2], nodes[n[1]][3], course) for n in nodes if n[1] >= 0)


def test_exact_quantile_narrows_its_window(spark):
    from pyspark.sql import functions as F

    from aerolith.operators.summaries import exact_quantile

    d = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.rand(3) * 100).alias("v"))
    x = np.array([r["v"] for r in d.collect()])
    for p in (0.0, 0.05, 0.31, 0.5, 0.99, 1.0):
        assert np.isclose(exact_quantile(d, "v", p, settle=50), np.quantile(x, p), rtol=1e-12), p
    assert exact_quantile(d.limit(0), "v", 0.5) is None
