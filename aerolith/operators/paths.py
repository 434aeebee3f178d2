"""Paths and trajectories: densifying, direction changes, errors and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.geometry import Vec
from aerolith.operators.spatial import nearest


def segments(path: DataFrame, path_id: str, seq: str) -> DataFrame:
    """Each waypoint with the next one (nx, ny, nz) and the length ``seg`` of the segment to it; null at the end."""
    w = Window.partitionBy(path_id).orderBy(seq)
    d = path.withColumns({f"n{a}": F.lead(a).over(w) for a in "xyz"})
    return d.withColumn("seg", (Vec(*[F.col(f"n{a}") for a in "xyz"]) - Vec(*[F.col(a) for a in "xyz"])).norm())


def densified(path: DataFrame, path_id: str, seq: str, step: float) -> DataFrame:
    """(path_id, seq, sub, x, y, z, arc): samples no farther than ``step`` apart, and the arc length up to each.

    ``seq`` is the waypoint a sample's segment starts at; the last waypoint is its own sample.
    """
    s = segments(path, path_id, seq)
    w = Window.partitionBy(path_id).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("before", F.coalesce(F.sum("seg").over(w), F.lit(0.0)))
    n = F.when(F.col("seg").isNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("seg") / step))).cast("int")
    s = s.withColumn("n", n).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    part = F.col("sub") / F.col("n")
    at = [F.when(F.col("seg").isNull(), F.col(a)).otherwise(F.col(a) + (F.col(f"n{a}") - F.col(a)) * part).alias(a) for a in "xyz"]
    return s.select(path_id, seq, "sub", *at, (F.col("before") + F.coalesce(F.col("seg"), F.lit(0.0)) * part).alias("arc"))


def direction_changes(path: DataFrame, path_id: str, seq: str, degrees: float = 3.0) -> DataFrame:
    """Inner waypoints where the direction turns by more than ``degrees``; segments without length count for nothing."""
    import math

    w = Window.partitionBy(path_id).orderBy(seq)
    d = path.withColumns({f"p{a}": F.lag(a).over(w) for a in "xyz"} | {f"n{a}": F.lead(a).over(w) for a in "xyz"})
    here = Vec(*[F.col(a) for a in "xyz"])
    come, go = here - Vec(*[F.col(f"p{a}") for a in "xyz"]), Vec(*[F.col(f"n{a}") for a in "xyz"]) - here
    d = d.withColumns({"a": come.norm(), "b": go.norm(), "c": come.dot(go)}).where("a >= 1e-9 and b >= 1e-9")
    return d.where(F.col("c") / (F.col("a") * F.col("b")) < math.cos(math.radians(degrees))).select(path_id, seq, "x", "y", "z")


def trajectory_error(actual: DataFrame, path: DataFrame, path_id: str, seq: str, sample: str, step: float) -> DataFrame:
    """(path_id, sample, error, segment): each recorded position against the densified path, first sample on ties."""
    last = path.groupBy(path_id).agg(F.max(seq).alias("__end"))
    dense = densified(path, path_id, seq, step).withColumn("__at", F.struct(F.col(seq).alias("seq"), F.col("sub").alias("sub")))
    n = nearest(actual, dense, [path_id], sample, "__at", step)
    return n.join(last, path_id).select(path_id, sample, F.col("dist").alias("error"), F.least(F.col("__at.seq"), F.col("__end") - 1).alias("segment"))


def with_hits(df: DataFrame, circles: list[tuple[float, float, float]], samples: int = 10) -> DataFrame:
    """Adds ``hit``: does the plane segment (ax, ay)-(bx, by) touch a circle, by evenly spaced samples, ends and borders inclusive.

    Of evenly spaced samples the one next to the centre's projection is the nearest, so one is tested
    per circle. The steps are columns of their own, so that each stays small in generated code.
    """
    last = float(samples - 1)
    d = df.withColumns({"__dx": F.col("bx") - F.col("ax"), "__dy": F.col("by") - F.col("ay")})
    d = d.withColumn("__n2", F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy"))
    parts = {}
    for n, (cx, cy, _) in enumerate(circles):
        along = ((F.lit(cx) - F.col("ax")) * F.col("__dx") + (F.lit(cy) - F.col("ay")) * F.col("__dy")) / F.col("__n2")
        parts[f"__t{n}"] = F.when(F.col("__n2") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.floor(along * last + 0.5) / last))).otherwise(F.lit(0.0))
    d = d.withColumns(parts)
    offs = {f"__{c}{n}": F.col(f"a{c}") + F.col(f"__d{c}") * F.col(f"__t{n}") - (cx, cy)[c == "y"] for n, (cx, cy, _) in enumerate(circles) for c in "xy"}
    d = d.withColumns(offs)
    hit = F.lit(False)
    for n, (_, _, r) in enumerate(circles):
        hit = hit | (F.sqrt(F.col(f"__x{n}") * F.col(f"__x{n}") + F.col(f"__y{n}") * F.col(f"__y{n}")) <= r)
    return d.withColumn("hit", hit).drop("__dx", "__dy", "__n2", *parts, *offs)


def shortcuts(path: DataFrame, path_id: str, seq: str, circles: list[tuple[float, float, float]]) -> DataFrame:
    """(path_id, seq, hop): the waypoints that greedy shortcutting keeps, from the start by farthest free successor.

    The next waypoint is always reachable. Pairs of one path are tested as a join of its waypoints,
    and the chain of hops is followed over the path's successor list, which has one entry a waypoint.
    """
    p = path.select(path_id, F.col(seq).alias("s"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    q = path.select(path_id, F.col(seq).alias("t"), F.col("x").alias("bx"), F.col("y").alias("by"))
    ahead = with_hits(p.join(q, path_id).where(F.col("t") > F.col("s")), circles)
    far = ahead.groupBy(path_id, "s").agg(F.max(F.when((F.col("t") == F.col("s") + 1) | ~F.col("hit"), F.col("t"))).alias("t"))
    chain = far.groupBy(path_id).agg(F.map_from_entries(F.collect_list(F.struct("s", "t"))).alias("m"), F.min("s").alias("first"))
    follow = "aggregate(sequence(1, size(m)), array(first), (a, i) -> CASE WHEN m[element_at(a, -1)] IS NULL THEN a ELSE array_append(a, m[element_at(a, -1)]) END)"
    return chain.select(path_id, F.posexplode(F.expr(follow)).alias("hop", seq))
