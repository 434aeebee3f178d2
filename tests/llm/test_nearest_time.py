import random

import pytest
from pyspark.sql import functions as F

from aerolith.llm.nearest_time import Side, join_stream, match_bounded, nearest, side_rows
from aerolith.runtime import shared_dir

SIDES = [Side(1, "a", 30), Side(2, "b", 120)]
BASE = 1_700_000_000_000_000_000


def brute(left, right):
    out = set()
    for lid, e, t in left:
        if e is None or t is None:
            continue
        for s in SIDES:
            best = min(((abs(t - rt), rt, rid) for rid, re, rt, kind in right if re == e and rt is not None and kind == s.name and abs(t - rt) <= s.tolerance_ns), default=None)
            if best:
                out.add((lid, s.name, best[2]))
    return out


def stream(spark, where, files, schema, per_trigger=None):
    for n, data in enumerate(files):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{where}")
    r = spark.readStream.schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(where)


LS, RS = "lid long, e string, t long, id string", "rid long, e string, t long, kind string"


def rows_of(spark, left_files, right_files, shard, per_trigger=None):
    base = shared_dir(spark, "test-nearest")
    l = stream(spark, f"{base}/l", [[(*r, "clash") for r in f] for f in left_files], LS, per_trigger)
    r = stream(spark, f"{base}/r", right_files, RS, per_trigger)
    rows = side_rows(l, None, F.col("e"), F.col("t"), F.col("lid"), shard)
    for s in SIDES:
        rows = rows.union(side_rows(r.where(F.col("kind") == s.name), s, F.col("e"), F.col("t"), F.col("rid"), shard))
    return rows


def found(df):
    return sorted((r["left_id"], r["side"], r["right_id"]) for r in df.collect())


def test_against_brute_force_over_shard_borders(spark):
    rnd = random.Random(7)
    left = [(i, rnd.choice(["v", "w", None]), BASE + rnd.randrange(3000) if rnd.random() < 0.95 else None) for i in range(80)]
    right = [(i, rnd.choice(["v", "w", "x", None]), BASE + rnd.randrange(3000) if rnd.random() < 0.95 else None, rnd.choice("ab")) for i in range(150)]
    left += left[:9]
    right += right[:20]
    for shard in (100, 777):
        got = found(match_bounded(spark, rows_of(spark, [left], [right], shard), SIDES))
        assert got == sorted(brute(left, right))


def test_ties_limits_and_negative_times(spark):
    left = [(1, "v", BASE), (2, "v", BASE + 10_000), (3, "v", -50)]
    right = [(5, "v", BASE - 10, "a"), (4, "v", BASE + 10, "a"), (9, "v", BASE - 120, "b"), (8, "v", BASE - 120, "b"), (7, "v", BASE + 10_031, "a"), (6, "v", BASE + 10_120, "b"), (3, "v", -60, "a")]
    got = found(match_bounded(spark, rows_of(spark, [left], [right], 100), SIDES))
    assert got == [(1, "a", 5), (1, "b", 8), (2, "b", 6), (3, "a", 3)]


def test_empty_sides(spark):
    assert found(match_bounded(spark, rows_of(spark, [[]], [[(1, "v", BASE, "a")]], 100), SIDES)) == []
    assert found(match_bounded(spark, rows_of(spark, [[(1, "v", BASE)]], [[]], 100), SIDES)) == []


def test_several_batches_emit_by_watermark_and_evict(spark):
    """Files come one a trigger; what the watermark has passed goes out before the stream is closed."""
    second = 1_000_000_000
    left = [[(i, "v", BASE + i * 10 * second)] for i in range(6)]
    right = [[(100 + i, "v", BASE + i * 10 * second + 7, "a")] for i in range(6)]
    rows = rows_of(spark, left, right, 60 * second, per_trigger=1)
    base = shared_dir(spark, "test-emit")
    q = join_stream(rows, SIDES, second).writeStream.format("parquet").option("path", f"{base}/o").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    before_close = found(spark.read.parquet(f"{base}/o"))
    assert 3 <= len(before_close) < 6 and all(r == 100 + i for i, _, r in before_close)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert states and max(states) <= 2
    assert len(found(match_bounded(spark, rows_of(spark, left, right, 60 * second, per_trigger=1), SIDES, second))) == 6


def test_ten_batches_with_late_rows(spark):
    """Rows three batches late: a lateness that covers them needs one run, a shorter one goes again; state stays small."""
    second = 1_000_000_000
    rnd = random.Random(3)
    left, right = [[] for _ in range(10)], [[] for _ in range(10)]
    for i in range(400):
        t = BASE + i * 10 * second
        left[min(9, i // 40 + 3 * (rnd.random() < 0.05))].append((i, "v", t))
        right[min(9, i // 40 + 3 * (rnd.random() < 0.05))].append((1000 + i, "v", t + rnd.choice([0, 7, 29, 31]), "a"))
    want = sorted(brute([r for f in left for r in f], [r for f in right for r in f]))
    for lateness, runs in ((2000 * second, 1), (0, 2)):
        seen = {}
        rows = rows_of(spark, left, right, 60 * second, per_trigger=1)
        assert found(match_bounded(spark, rows, SIDES, lateness, seen)) == want
        assert seen["batches"] >= 10 and (seen["runs"] == 1) == (runs == 1)
        if runs == 1:
            assert seen["groups"] < 0.8 * 4000 / 60


@pytest.mark.parametrize("tolerance", [0, 5])
def test_nearest_picks_the_earlier_on_ties(tolerance):
    import numpy as np

    right = np.array([(0, 1), (10, 2)], dtype=[("ts", "<i8"), ("id", "<i8")])
    assert nearest(np.array([5, 0, 16]), right, tolerance).tolist() == ([-1, 0, -1] if tolerance == 0 else [0, 0, -1])
