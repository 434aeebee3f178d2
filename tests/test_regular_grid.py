import random

from pyspark.sql import functions as F

from aerolith.operators.regular_grid import regular_grid

SCHEMA = "source string, ts long, id long, v array<double>, slot string, value string"
P = 100


def grid(spark, data, **how):
    df = spark.createDataFrame([(s, t, i, v, "x", "y") for s, t, i, v in data], SCHEMA)
    g = regular_grid(df, "source", F.col("ts"), F.col("v"), [F.col("id")], P, **how)
    return sorted((r["source"], r["slot"], r["value"], r["status"], r["age"]) for r in g.collect())


def brute(data, max_fill=None):
    out = []
    for s in {d[0] for d in data if d[0] is not None and d[1] is not None}:
        best = {}
        for _, t, i, v in sorted((d for d in data if d[0] == s and d[1] is not None), key=lambda d: (d[1], d[2])):
            best[t // P] = v
        last = None
        for slot in range(min(best), max(best) + 1):
            if slot in best:
                last = slot
            age = slot - last
            status = "measured" if age == 0 else "filled" if max_fill is None or age <= max_fill else "missing"
            out.append((s, slot, None if status == "missing" else best[last], status, age))
    return sorted(out, key=lambda r: r[:2])


def test_against_brute_force_over_shard_borders(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("ab"), rnd.randrange(-5000, 9000) if rnd.random() < 0.5 else rnd.randrange(40000, 41000), i, [float(i)]) for i in range(60)]
    for size in (1, 3, 7, 512):
        assert grid(spark, data, shard_slots=size, max_fill=4) == brute(data, 4)


def test_nulls_repeats_ties_and_other_columns(spark):
    data = [("a", 10, 1, [1.0]), ("a", 10, 1, [1.0]), ("a", 10, 2, [2.0]), ("a", 350, 3, None), (None, 20, 4, [4.0]), ("a", None, 5, [5.0]), ("b", -1, 6, [6.0])]
    assert grid(spark, data) == [("a", 0, [2.0], "measured", 0), ("a", 1, [2.0], "filled", 1), ("a", 2, [2.0], "filled", 2), ("a", 3, None, "measured", 0), ("b", -1, [6.0], "measured", 0)]


def test_linear(spark):
    data = [("a", 0, 1, [0.0, 10.0]), ("a", 400, 2, [4.0, 2.0])]
    assert [r[2] for r in grid(spark, data, fill="linear", shard_slots=2)] == [[0.0, 10.0], [1.0, 8.0], [2.0, 6.0], [3.0, 4.0], [4.0, 2.0]]


def test_empty(spark):
    assert grid(spark, []) == []


def test_long_gap(spark):
    data = [("a", 0, 1, [1.0]), ("a", 100 * 50_000, 2, [2.0])]
    df = spark.createDataFrame([(s, t, i, v, "x", "y") for s, t, i, v in data], SCHEMA)
    g = regular_grid(df, "source", F.col("ts"), F.col("v"), [F.col("id")], P, max_fill=10)
    assert {r["status"]: r["n"] for r in g.groupBy("status").agg(F.count("*").alias("n")).collect()} == {"measured": 2, "filled": 10, "missing": 49_989}
