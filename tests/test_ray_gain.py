"""The gain by marched rays, tile by tile, is that of all pairs and the cells of their rays, and lists neither."""

from aerolith.operators import planner
from aerolith.plans import planner as P


def test_marched_gain_is_that_of_the_pairs(spark, sf, monkeypatch):
    g = P.Grid(spark, sf)
    c = P.written(P.candidates(g), "test-candidates")
    pairs = planner.frustum_pairs(c, g.unknown, P.REACH, P.HALF, P.R)
    want = {(r.recording, r.cid): r.gain for r in planner.ray_gain(pairs, g.occupied, None, P.R).collect()}
    monkeypatch.setattr(planner, "ray_cells", None)  # the query lists no cells of rays
    got = {(r.recording, r.cid): r.gain for r in P.g07(spark, sf).collect()}
    assert got == want != {}
