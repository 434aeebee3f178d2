import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import graph
from aerolith.operators import spatial as S
from aerolith.operators.asof import bracket
from aerolith.runtime import hot_values, salted_join

L, R = "lid long, e string, t long, kind string", "rid long, e string, t long, kind string, v double"


def brackets(spark, left, right, shard):
    l, r = spark.createDataFrame(left, L), spark.createDataFrame(right, R)
    b = bracket(l, r, "e", "t", F.col("kind"), ["a", "b"], F.col("rid"), F.col("rid"), shard)
    return sorted(((x["lid"], x["e"], x["t"], *(x[f"{s}_{k}"] and x[f"{s}_{k}"]["v"] for k in "ab" for s in ("before", "after"))) for x in b.collect()), key=str)


def brute(left, right):
    out = []
    for lid, e, t, _ in left:
        row = [lid, e, t]
        for k in "ab":
            mine = [(rt, rid) for rid, re, rt, rk, _ in right if rk == k and re == e and e is not None and rt is not None]
            before = [m for m in mine if t is not None and m[0] <= t]
            after = [m for m in mine if t is not None and m[0] > t]
            row += [max(before)[1] if before else None, min(after)[1] if after else None]
        out.append(tuple(row))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [10, 137, 10**9])
def test_bracket_against_brute_force(spark, shard):
    rnd = random.Random(shard)
    left = [(i, rnd.choice(["x", "y", None]), rnd.randrange(-300, 900) if rnd.random() < 0.9 else None, "clash") for i in range(60)]
    right = [(i, rnd.choice(["x", "y", "z", None]), rnd.randrange(-300, 900) if rnd.random() < 0.9 else None, rnd.choice(["a", "b", "c", None]), 1.0) for i in range(80)]
    left += left[:5]
    assert brackets(spark, left, right, shard) == brute(left, right)


def test_bracket_empty_sides(spark):
    assert brackets(spark, [], [(1, "x", 1, "a", 1.0)], 10) == []
    assert brackets(spark, [(1, "x", 5, "c")], [], 10) == [(1, "x", 5, None, None, None, None)]


def cloud(spark, data, name):
    return spark.createDataFrame(data, f"g string, {name} long, x double, y double, z double, dist string")


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(8)
    a = [(rng.choice(["g", "h", "only"]), i, *map(float, rng.normal(0, 20, 3)), "c") for i in range(80)] + [("g", 900, 5000.0, 0.0, 0.0, "c"), ("g", 901, None, 0.0, 0.0, "c"), (None, 902, 0.0, 0.0, 0.0, "c")]
    b = [(rng.choice(["g", "h"]), i, *map(float, rng.normal(0, 20, 3)), "c") for i in range(120)]
    b += [(*b[0][:1], 500, *b[0][2:]), ("g", 501, None, 1.0, 1.0, "c")]
    got = sorted((r["g"], r["qid"], r["tid"], round(r["dist"], 9)) for r in S.nearest(cloud(spark, a, "qid"), cloud(spark, b, "tid"), ["g"], "qid", "tid", 2.0).collect())
    want = []
    for g, i, x, y, z, _ in a:
        d = sorted((np.sqrt((x - p) ** 2 + (y - q) ** 2 + (z - r) ** 2), t) for h, t, p, q, r, _ in b if h == g and None not in (x, p)) if x is not None else []
        if d:
            want.append((g, i, d[0][1], round(float(d[0][0]), 9)))
    assert got == sorted(want)


def test_nearest_empty(spark):
    one = cloud(spark, [("g", 1, 0.0, 0.0, 0.0, "c")], "qid")
    assert S.nearest(one, cloud(spark, [], "tid"), ["g"], "qid", "tid", 1.0).count() == 0
    assert S.nearest(one.limit(0), cloud(spark, [("g", 1, 0.0, 0.0, 0.0, "c")], "tid"), [], "qid", "tid", 1.0).count() == 0


def test_within_and_far_from(spark):
    rng = np.random.default_rng(9)
    a = [("g", i, *map(float, rng.uniform(-5, 5, 3)), "c") for i in range(50)]
    b = [("g", i, *map(float, rng.uniform(-5, 5, 3)), "c") for i in range(30)]
    near = {(p[1], q[1]) for p in a for q in b if sum((p[k] - q[k]) ** 2 for k in (2, 3, 4)) <= 4.0}
    got = S.within(cloud(spark, a, "pid"), cloud(spark, b, "qid"), 2.0, ["g"], "pid", "qid").collect()
    assert {(r["pid"], r["qid"]) for r in got} == near and len(got) == len(near)
    far = S.far_from(cloud(spark, [*a, a[0], ("g", 99, None, 0.0, 0.0, "c")], "pid"), cloud(spark, b, "qid"), 2.0, ["g"]).collect()
    want = [p[1] for p in [*a, a[0]] if p[1] not in {i for i, _ in near}] + [99]
    assert sorted(r["pid"] for r in far) == sorted(want)


@pytest.mark.parametrize("small", [0, 10**6])
def test_graph_paths_agree(spark, small):
    rng = np.random.default_rng(3)
    cells = sorted({tuple(map(int, c)) for c in rng.integers(0, 6, (90, 3))} | {(0, 0, 0)})
    df = spark.createDataFrame([*cells, cells[0], (None, 1, 1)], "i long, j long, k long")
    left, seen, depth = set(cells), {(0, 0, 0)}, {(0, 0, 0): 0}
    queue = [(0, 0, 0)]
    for c in queue:
        for s in graph.FACES:
            n = tuple(a + b for a, b in zip(c, s))
            if n in left and n not in seen:
                seen.add(n)
                depth[n] = depth[c] + 1
                queue.append(n)
    got = {(r["i"], r["j"], r["k"]): r["depth"] for r in graph.reachable(df, (0, 0, 0), small=small).collect()}
    assert got == depth
    comp = {(r["i"], r["j"], r["k"]): tuple(r["cluster"]) for r in graph.components(df, small=small).collect()}
    assert set(comp) == left
    assert {c for c in comp if comp[c] == comp[(0, 0, 0)]} == seen
    assert all(comp[c] == min(d for d in comp if comp[d] == comp[c]) for c in comp)


def test_reachable_without_start(spark):
    df = spark.createDataFrame([(1, 1, 1)], "i long, j long, k long")
    assert graph.reachable(df, (0, 0, 0)).count() == 0 and graph.reachable(df, (0, 0, 0), small=0).count() == 0


def test_salted_join_keeps_everything(spark):
    big = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("k"), F.col("id").alias("b")).union(spark.createDataFrame([(None, 5000)], "k long, b long"))
    small = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("s")).union(spark.createDataFrame([(7, 1)], "k long, s long"))
    hot = hot_values(big, "k", 10)
    assert hot == [7]
    for how in ("inner", "left"):
        assert sorted(map(str, salted_join(big, small, "k", F.col("b"), hot, how).collect())) == sorted(map(str, big.join(small, "k", how).collect()))
