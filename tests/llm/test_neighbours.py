import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.llm import neighbours as N


def brute(data, k):
    ids = np.array([i for i, _ in data])
    x = np.array([v for _, v in data], dtype=float)
    out = {}
    for i, (me, v) in enumerate(data):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != me][:k]
        out[me] = [(round(float(d[j]), 9), int(ids[j])) for j in order]
    return out


def run(spark, data, dims, k, **how):
    df = spark.createDataFrame(data, "vid long, vec array<double>").withColumn("id", F.lit("clash"))
    rows = N.nearest_vectors(df, "vid", F.col("vec"), dims, k, **how).collect()
    return {r["vid"]: [(round(h["d"], 9), h["id"]) for h in r["neighbours"]] for r in rows}


def clustered(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-1000, 1000, (12, dims))
    return [(i * 3 + 1, (centres[rng.integers(12)] + rng.normal(0, rng.choice([0.1, 3, 30]), dims)).tolist()) for i in range(n)]


def test_recall_with_small_cells(spark):
    data = clustered(1500, 16)
    want = brute(data, 4)
    got = run(spark, data, 16, 4, load=60)
    hit = sum(len({i for _, i in got[m]} & {i for _, i in want[m]}) for m in want)
    assert hit / (4 * len(want)) >= 0.9


def test_blocks_change_nothing(spark):
    data = clustered(400, 8, 2)
    one = run(spark, data, 8, 3, load=1e9)
    assert one == brute(data, 3)
    assert run(spark, data, 8, 3, load=1e9, block=37) == one


def test_listed_and_joined_crowded_cells_agree(spark, monkeypatch):
    data = clustered(300, 8, 3)
    want = run(spark, data, 8, 3, load=1e9, block=50)
    monkeypatch.setattr(N, "LISTED", 0)
    assert run(spark, data, 8, 3, load=1e9, block=50) == want


def test_copies_ties_and_repeated_ids(spark):
    data = [(i, [1.0, 2.0]) for i in (9, 7, 5, 3, 1, 11)] + [(20, [1.0, 3.0]), (21, [1.0, 1.0]), (22, [-0.0, 0.0]), (23, [0.0, 0.0])]
    assert run(spark, data + data[:4], 2, 4) == brute(data, 4)


def test_unusable_rows_and_small_collections(spark):
    nan = float("nan")
    bad = [(None, [1.0, 1.0]), (50, None), (51, [1.0]), (52, [1.0, nan]), (53, [None, 1.0])]
    assert run(spark, bad, 2, 4) == {}
    assert run(spark, [(1, [1.0, 1.0]), *bad], 2, 4) == {1: []}
    assert run(spark, [(1, [1.0, 1.0]), (2, [4.0, 5.0]), *bad], 2, 4) == {1: [(5.0, 2)], 2: [(5.0, 1)]}
    assert run(spark, [], 2, 4) == {}


def test_pairs_come_once(spark):
    df = spark.createDataFrame([(1, [(0.0, 2)]), (2, [(0.0, 1), (1.0, 3)]), (3, [])], "vid long, neighbours array<struct<d: double, id: long>>")
    assert sorted(map(tuple, N.pairs(df, "vid", "a", "b").collect())) == [(1, 2), (2, 3)]


@pytest.mark.parametrize("table", ["/root/testdata/sf0.1"])
def test_recall_on_maps(spark, table):
    import os

    if not os.path.isdir(table):
        pytest.skip("no test tables")
    from aerolith.llm.p5_queries import DIMS, map_vector

    maps = spark.read.parquet(f"{table}/slam_map.parquet").select("map_id", "bounds", "points")
    got = {r["map_id"]: {h["id"] for h in r["neighbours"]} for r in N.nearest_vectors(maps, "map_id", map_vector(), DIMS, 4, load=40).collect()}
    vec = maps.withColumn("v", map_vector()).where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c))).groupBy("map_id").agg(F.min("v").alias("v")).collect()
    want = brute([(r["map_id"], r["v"]) for r in vec], 4)
    assert set(got) == set(want)
    assert sum(len(got[m] & {i for _, i in want[m]}) for m in want) / (4 * len(want)) >= 0.9


def test_thin_regions_beside_a_dense_cluster(spark):
    """Nine in ten vectors in one cluster: the others find their neighbours too."""
    rng = np.random.default_rng(7)
    dense = rng.normal(0, 1, (2700, 20))
    thin = rng.normal(0, 300, (300, 20))
    data = list(enumerate(np.concatenate([dense, thin]).tolist()))
    want = brute(data, 4)
    got = run(spark, data, 20, 4, load=60)
    assert all(len(got[i]) == 4 for i, _ in data)
    for part in (range(2700), range(2700, 3000)):
        hit = sum(len({i for _, i in got[m]} & {i for _, i in want[m]}) for m in part)
        assert hit / (4 * len(part)) >= 0.9
