"""Queries that must take every row, where a filter by a number's remainder once left most of them out."""

from pyspark.sql import functions as F

from aerolith import plans
from aerolith.plans import planner
from conftest import rows

Q, S = plans.registered()


def test_every_frame_has_a_timing_row(spark, sf, duck):
    want = duck.sql("SELECT run_id, frame, raw_pts, voxel_count FROM frame_timing").df()
    assert rows(Q["snk_k08_frame_rows"](spark, sf).toPandas()) == rows(want)


def test_revisits_look_at_every_pose(spark, sf, monkeypatch):
    """Poses all over each grid: whatever is not rejected before is revisited."""
    d = planner.Grid(spark, sf).bounds
    every = [F.explode(F.sequence(F.col(f"{i}0") - 3, F.col(f"{i}1") + 3)) for i in "ijk"]
    for i, e in zip("xyz", every):
        d = d.withColumn(i, e)
    d = d.select("recording", *[(F.col(a) + 0.5).alias(a) for a in "xyz"], F.lit(1).alias("wid"))
    monkeypatch.setattr(planner, "waypoints", lambda *_: d)
    assert {r.status for r in planner.cascade(spark, sf).collect() if r.dist >= 3} == {"revisited"}
    assert {r.reason for r in planner.cluster_targets(spark, sf)[0].collect()} - {"occupied"} == {"revisited"}
