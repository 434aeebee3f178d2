import math
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from aerolith.operators import folds, paths, planner
from aerolith.operators.voxel import pack_key, unpack_key
from aerolith.runtime import shared_dir
from aerolith.sources import recordings as R
from aerolith.streaming import operators as T


def gate_loop(rows, z, warmup):
    hist, out = [], []
    for s, t in rows:
        s, t = s or 0.0, t or 0.0
        bad = False
        if s > 0 and len(hist) >= max(3, warmup):
            a, b = [h[0] for h in hist], [h[1] for h in hist]
            bad = s > statistics.mean(a) + z * statistics.stdev(a) and t > statistics.mean(b) + z * statistics.stdev(b)
        if s > 0 and not bad:
            hist.append((s, t))
        out.append(bad)
    return out


def test_gate_in_batch_and_stream_against_a_loop(spark):
    rnd = random.Random(2)
    data = [(g, i, i, rnd.choice([None, 0.0, rnd.random(), rnd.random() * 9]), rnd.choice([None, rnd.random() * 5])) for g in ("a", "b", None) for i in range(120)]
    want = {(g, i): bad for g in ("a", "b", None) for i, bad in enumerate(gate_loop([d[3:] for d in data if d[0] == g], 0.7, 5))}
    df = spark.createDataFrame(data, "g string, ord long, id long, s double, t double")
    got = {(r["g"], r["id"]): r["rejected"] for r in folds.outlier_gate(df.repartition(3), "g", ["ord", "id"], "s", "t", 0.7, 5).collect()}
    assert got == want and any(want.values())
    where = shared_dir(spark, "test-gate")
    df.coalesce(1).write.parquet(where)
    stream = spark.readStream.schema(df.schema).parquet(where)
    got = {(r["g"], r["id"]): r["rejected"] for r in T.run_bounded(T.gate(stream, "g", 0.7, 5), "test-gate-out").collect()}
    assert got == want
    assert folds.outlier_gate(df.limit(0), "g", ["ord"], "s", "t", 0.7).count() == 0


def test_spacing_rate_and_queue(spark):
    df = spark.createDataFrame([("p", i, float(x), 0.0, 0.0) for i, x in enumerate([0, 1, 2.9, 3, 3.5, 6.5, 9.4])], "path string, seq long, x double, y double, z double")
    kept = [r["seq"] for r in folds.spaced(df, "path", "seq", ("x", "y", "z"), 3.0).where("kept").orderBy("seq").collect()]
    assert kept == [0, 3, 5]
    t = spark.createDataFrame([("a", 0, 1), ("a", 4, 2), ("a", 10, 3), ("a", 10, 4), ("a", None, 5), ("a", 21, 6)], "g string, ts long, id long")
    assert [r["ts"] for r in folds.rate_limited(t, "g", "ts", "id", 10).where("kept").orderBy("ts").collect()] == [0, 10, 21]
    q = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, None), ("c", 1, True)], "g string, o long, ready boolean")
    assert sorted((r["g"], r["o"]) for r in folds.blocked(q, "g", ["o"], "ready").where("emitted").collect()) == [("a", 1), ("c", 1)]


def test_delay_over_several_batches(spark):
    where = shared_dir(spark, "test-delay")
    schema = "v string, ts_ms long, frame long"
    for batch in ([("a", 100, 1), ("a", 300, 2)], [("a", 650, None)], [("a", 900, None), ("b", 5, 9)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(where)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)
    out = T.run_bounded(T.delayed(s, "v", 500), "test-delay-out")
    assert sorted((r["v"], r["frame"]) for r in out.collect()) == [("a", 1), ("a", 2)]


def test_windowed_counts_wait_for_the_watermark(spark):
    where = shared_dir(spark, "test-window")
    df = spark.sql("SELECT timestamp'2025-01-01 00:00:10' ts, 'a' k UNION ALL SELECT timestamp'2025-01-01 00:00:20', 'a' UNION ALL SELECT timestamp'2025-01-01 00:10:00', 'a'")
    df.coalesce(1).write.parquet(where)
    out = T.run_bounded(T.minutes(spark.readStream.schema(df.schema).parquet(where), "ts", "1 minute", "1 minute", ["k"]), "test-window-out")
    assert [(r["k"], r["n"]) for r in out.collect()] == [("a", 2)]


def test_frame_files_round_trip(spark):
    row = {"points": [{"x": 1.0, "y": 2.0, "z": 3.0}], "timestamp": 5, "position": None, "orientation": None, "imu_angular_vel": None, "imu_linear_acc": {"x": 1.0, "y": 2.0, "z": 3.0}, "gps": None}
    r = R.decode_frame("a/frame_00012-7.npz", R.encode_frame(row))
    zero, identity = (0.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0)
    assert r == ("a/frame_00012-7.npz", 12, 5, None, None, [(1.0, 2.0, 3.0)], zero, identity, zero, identity, None, (1.0, 2.0, 3.0), None)
    full = row | {"state_before_ts": 3, "state_after_ts": 8, "lidar_position": {"x": 0.5, "y": 0.0, "z": 0.0}}
    again = dict(zip(R.COLUMNS, R.decode_frame("frame_00012-7.npz", R.encode_frame(full))))
    assert (again["state_before_ts"], again["state_after_ts"], again["lidar_position"]) == (3, 8, (0.5, 0.0, 0.0))
    assert R.decode_frame("x.npz", R.encode_frame({}))[1:4] == (None, None, None)


def test_binvox_round_trip(spark):
    rng = np.random.default_rng(6)
    cells = np.unique(rng.integers(0, 8, (60, 3)), axis=0)
    raw = R.encode_binvox(cells, [8, 8, 8], [1.0, 2.0, 3.0], 16.0)
    df = spark.createDataFrame([("f", bytearray(raw))], "path string, content binary")
    got = sorted((r["x"], r["y"], r["z"]) for r in R.binvox_points(df, (0.5, 0.0, 0.0)).collect())
    want = sorted(((i + 0.5) * 2 + 1.5, (k + 0.5) * 2 + 2, -((j + 0.5) * 2 + 3)) for i, j, k in cells.tolist())
    assert np.allclose(got, want)


def test_packed_keys_keep_signs_and_wrap(spark):
    data = [(-1, 0, 5), (1048575, -1048576, -7), (1048576, 0, 0)]
    df = spark.createDataFrame(data, "i long, j long, k long").select(pack_key(F.col("i"), F.col("j"), F.col("k")).alias("key"))
    got = [tuple(r) for r in df.select(*unpack_key(F.col("key"))).collect()]
    assert got == [(-1, 0, 5), (1048575, -1048576, -7), (-1048576, 0, 0)]


def test_ray_gain_against_a_loop(spark):
    rng = np.random.default_rng(11)
    occ = {tuple(map(int, c)) for c in rng.integers(-6, 6, (120, 3))}
    unk = sorted({tuple(map(int, c)) for c in rng.integers(-6, 6, (300, 3))} - occ)
    cand = [(1, 0.3, 0.2, -5.5), (2, -2.0, 3.1, -4.0)]
    low, reach, half = (-6, -6, -6), 9.0, 60.0
    pairs = planner.frustum_pairs(spark.createDataFrame(cand, "cid long, x double, y double, z double"), spark.createDataFrame(unk, "i long, j long, k long"), reach, half)
    got = {r["cid"]: r["gain"] for r in planner.ray_gain(pairs, spark.createDataFrame(sorted(occ), "i long, j long, k long"), low).collect()}
    for cid, x, y, z in cand:
        n = 0
        for i, j, k in unk:
            dx, dy, dz = i + 0.5 - x, j + 0.5 - y, k + 0.5 - z
            if not (dz > 0 and dx * dx + dy * dy <= (dz * math.tan(math.radians(half))) ** 2 and dx * dx + dy * dy + dz * dz <= reach * reach):
                continue
            o = (x + 6, y + 6, z + 6)
            d = (i + 6 - o[0], j + 6 - o[1], k + 6 - o[2])
            steps = max(*(abs(round(v)) for v in d), 1)
            n += not any(tuple(int(a + b * (1.0 / steps) * s) - 6 for a, b in zip(o, d)) in occ for s in range(1, steps))
        assert got.get(cid, 0) == n


def test_shortcuts_against_a_loop(spark):
    rng = random.Random(4)
    circles = [(3.0, 3.0, 1.0), (6.0, 5.0, 1.5)]
    pts = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(25)] + [(5.0, 5.0), (5.0, 5.0)]

    def free(a, b):
        return not any(math.hypot(a[0] + (b[0] - a[0]) * i / 9 - x, a[1] + (b[1] - a[1]) * i / 9 - y) <= r for i in range(10) for x, y, r in circles)

    want, i = [0], 0
    while i < len(pts) - 1:
        i = next(j for j in range(len(pts) - 1, i, -1) if j == i + 1 or free(pts[i], pts[j]))
        want.append(i)
    df = spark.createDataFrame([("p", n, x, y, 0.0) for n, (x, y) in enumerate(pts)], "path string, seq long, x double, y double, z double")
    assert [r["seq"] for r in paths.shortcuts(df, "path", "seq", circles).orderBy("hop").collect()] == want
