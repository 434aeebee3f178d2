"""Stateful operators over several batches give what one look at all rows gives."""

import random

from pyspark.sql import functions as F

from aerolith.runtime import shared_dir
from aerolith.streaming import operators as T


def stream(spark, files, schema):
    """One file a trigger."""
    where = shared_dir(spark, "test-stream")
    for f in files:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(where)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)


def parts(rows, n, rnd):
    """Rows by time in n files, some of them a file late."""
    out = [[] for _ in range(n)]
    for k, r in enumerate(rows):
        out[min(n - 1, k * n // len(rows) + (rnd.random() < 0.1))].append(r)
    return out


def test_count_delay(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), t, t) for t in range(60)]
    got = T.run_bounded(T.behind(stream(spark, parts(rows, 5, rnd), "g string, ord long, id long"), "g", 3), "t3").distinct().collect()
    want = {(g, i) for g in "ab" for i in sorted(r[1] for r in rows if r[0] == g)[:-3]}
    assert {(r["g"], r["id"]) for r in got} == want


def test_delay_and_flush(spark):
    rnd = random.Random(2)
    rows = [("v", t * 100, t if rnd.random() < 0.5 else None) for t in range(80)]
    s = stream(spark, parts(rows, 4, rnd), "g string, ts_ms long, frame long")
    newest = max(t for _, t, f in rows if f is None)
    got = T.run_bounded(T.delayed(s, "g", 1000), "t1").collect()
    assert {r["frame"] for r in got} == {f for _, t, f in rows if f is not None and newest - t >= 1000}
    end, where = T.closing_source(spark, "g string, ts_ms long, frame long")
    last = spark.createDataFrame([("v", 0, -1)], "g string, ts_ms long, frame long")
    got = T.run_bounded(T.delayed(s.union(end), "g", 1000), "t6", closing=(last, where)).collect()
    assert {r["frame"] for r in got} == {f for _, _, f in rows if f is not None}


def test_head_of_line(spark):
    rnd = random.Random(3)
    rows = [("v", t, t, None) for t in range(0, 100, 2)] + [("v", t, None, rnd.randrange(2)) for t in range(1, 80)]
    rows.sort(key=lambda r: r[1])
    s = stream(spark, parts(rows, 4, rnd), "g string, ord long, id long, sensor int")
    ready = min(max(r[1] for r in rows if r[3] == n) for n in (0, 1))
    got = T.run_bounded(T.blocked_queue(s, "g", 2), "t4").collect()
    assert {r["id"] for r in got} == {i for _, t, i, _ in rows if i is not None and t <= ready}
    assert T.run_bounded(T.blocked_queue(s, "g", 3), "t4").count() == 0


def test_brackets_by_event_time(spark):
    rnd = random.Random(4)
    second, base = 1_000_000_000, 1_700_000_000_000_000_000
    asks = [("v", base + t * second // 10, t) for t in range(300)]
    seen = [("v", base + rnd.randrange(30 * second)) for _ in range(400)]
    seen.sort(key=lambda r: r[1])
    reach = 50_000_000
    end, where = T.closing_source(spark, T._ROW)
    a = T.bracket_rows(stream(spark, parts(asks, 5, rnd), "entity string, ns long, id long"), False, reach, 2 * second)
    b = T.bracket_rows(stream(spark, parts(seen, 5, rnd), "entity string, ns long"), True, reach, 2 * second)
    last = spark.range(1).select(F.lit("").alias("entity"), F.lit(-1).cast("bigint").alias("shard"), F.lit(T.END_NS).alias("ns"), F.lit(None).cast("bigint").alias("id"), F.timestamp_micros(F.lit(T.END_NS // 1000)).alias("event_time"))
    got = {r["id"]: (r["before"], r["after"]) for r in T.run_bounded(T.bracketing([a.union(end), b.union(end)], reach, "60 seconds"), "t5", closing=(last, where)).collect()}
    times = [t for _, t in seen]
    want = {}
    for _, t, i in asks:
        gaps = [t - x for x in times if x <= t], [x - t for x in times if x >= t]
        want[i] = tuple(min(g) if g and min(g) <= reach else -1 for g in gaps)
    assert got == want


def test_ring(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), rnd.randrange(1000), i) for i in range(80)]
    out = T.run_bounded(T.ring(stream(spark, parts(rows, 4, rnd), "g string, ord long, id long"), "g", 5), "t11", lambda b, n: None, mode="update").collect()
    last = {g: sorted((r[1], r[2]) for r in rows if r[0] == g)[-5:] for g in "ab"}
    assert all({(r["ord"], r["id"]) for r in out if r["g"] == g} >= set(last[g]) for g in "ab")
