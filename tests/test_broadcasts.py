"""Exploded rows and packed cells are never collected on the driver: Spark sizes them by the bytes they come from."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith import plans
from aerolith.operators import paths
from aerolith.operators.spatial import CROWDED
from aerolith.plans.lattice import Lattice, poses

Q, S = plans.registered()


def sent(spark, run):
    """Rows of each broadcast of all that ``run`` executes."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    done = {store.executionsList().apply(n).executionId() for n in range(store.executionsList().size())}
    run()
    bus.waitUntilEmpty(30_000)
    out, every = [], store.executionsList()
    for e in {every.apply(n).executionId() for n in range(every.size())} - done:
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for n in range(nodes.size()):
            if nodes.apply(n).name() == "BroadcastExchange":
                of = {m.name(): m.accumulatorId() for m in (nodes.apply(n).metrics().apply(k) for k in range(nodes.apply(n).metrics().size()))}
                rows = values.get(of["number of output rows"])
                out.append(int(rows.get().replace(",", "")) if rows.isDefined() else 0)
    return out


@pytest.mark.parametrize("name", ["agg_a17_unknown_in_box", "join_j09_radius_top_k", "join_j08_nearest_mean", "grid_g10_random_target", "grid_g09_wfd_target", "win_w09_trajectory_error", "join_j10_nearest_path_sample"])
def test_exploded_rows_are_not_broadcast(spark, sf, name):
    """On small tables Spark takes every side for small. No broadcast may hold more than a row a frame."""
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")  # estimates before the run are at fault, measured sizes are not
    try:
        got = sent(spark, lambda: Q[name](spark, sf).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert max(got, default=0) <= spark.read.parquet(f"{sf}/lidar_frame.parquet").count()


def test_unknown_near_is_the_listed_cells(spark, sf):
    lat = Lattice(spark, sf)
    places = poses(spark, sf).select("file_id", "recording", "i", "j", "k")
    far = places.withColumn("i", F.col("i") + 1000)  # a box beyond the bounds holds nothing
    box = places
    for i in "ijk":
        box = box.withColumn(i, F.explode(F.sequence(F.col(i) - 3, F.col(i) + 3)))
    want = box.join(lat.unknown, ["recording", "i", "j", "k"]).groupBy("file_id").count()
    got = lat.unknown_near(places.union(far), 3).groupBy("file_id").count()
    assert sorted(want.collect()) == sorted(got.collect()) != []


def test_crowded_cells_send_no_targets(spark):
    """A hovering path crowds one cell of the search. What may be sent is a row for each path and for each crowded cell, of which each holds over CROWDED targets."""
    rng = np.random.default_rng(7)
    long = [("long", n, 20.0 * n, float(n % 3), -5.0) for n in range(200)]
    still = [("still", n, *(float(v) for v in rng.uniform(0, 0.4, 3))) for n in range(1500)]
    path = spark.createDataFrame(long + still, "path string, seq bigint, x double, y double, z double")
    at = [("long", n, float(x), float(y), -5.0) for n, (x, y) in enumerate(rng.uniform((0, -30), (4000, 30), (300, 2)))] + [("still", 1000 + n, *(float(v) for v in rng.uniform(-1, 1.4, 3))) for n in range(300)]
    actual = spark.createDataFrame(at, "path string, scan_id bigint, x double, y double, z double")
    dense, got = paths.densified(path, "path", "seq", 0.5).toPandas(), {}
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        rows = sent(spark, lambda: got.update({r.scan_id: r.error for r in paths.trajectory_error(actual, path, "path", "seq", "scan_id", 0.5).collect()}))
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert max(rows, default=0) <= len(dense) // CROWDED
    places = {p: d[["x", "y", "z"]].to_numpy() for p, d in dense.groupby("path")}
    want = {n: np.sqrt(((places[p] - (x, y, z)) ** 2).sum(1).min()) for p, n, x, y, z in at}
    assert got == pytest.approx(want, abs=1e-9)


def test_worst_errors_of_copies_send_a_row_a_path(spark, sf, tmp_path):
    """Copies of the scans under other keys have the errors of the originals, and no more than a row for each path is sent."""
    name, one = "join_j10_nearest_path_sample", spark.read.parquet(f"{sf}/scan_buffer.parquet")
    copies = [one.withColumns({"scan_id": F.col("scan_id") + n * 1_000_000, "recording": F.concat("recording", F.lit(f"+{n}"))}) for n in range(3)]
    copies[0].union(copies[1]).union(copies[2]).write.parquet(f"{tmp_path}/scan_buffer.parquet")
    got: list = []
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        rows = sent(spark, lambda: got.extend(Q[name](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW scan_buffer AS SELECT * FROM '{sf}/scan_buffer.parquet'")
        want = {(f"{path}+{n}", *rest) for path, *rest in c.execute(S[name]).fetchall() for n in range(3)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert max(rows, default=0) <= len(want)
