"""The three-state grid of a recording: what its scans saw in the world frame, cell by cell.

Endpoints of all frames are occupied, the cells that rays pass on the way are free, and all other
cells within the recording's own bounds are unknown. The bounds come from the data: they hold every
endpoint, ray and sensor, so nothing is clipped. A cell is CELL_M metres; lengths on the grid are in cells.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators import graph, planner
from aerolith.plans.book import WORLD, frames, world
from aerolith.runtime import by_sort, written

#: Edge of a cell. Scans of some dozen points see a world of some hundred metres; dense scans want 1 m.
CELL_M = 5.0
FACES = graph.FACES
R = ["recording"]
KEY = ["recording", "i", "j", "k"]


def ball_sql(steps: list[tuple[int, int, int]]) -> str:
    return "(VALUES " + ", ".join(map(str, steps)) + ") AS st(di, dj, dk)"


_CELL = ", ".join(f"CAST(floor({a}) AS BIGINT) AS {i}" for a, i in zip("xyz", "ijk"))


LATTICE = f"""{WORLD},
uw AS (SELECT file_id, recording, pt_id, {", ".join(f"p{a} / {CELL_M} AS o{a}, {a} / {CELL_M} AS {a}" for a in "xyz")} FROM pt),
en AS (SELECT recording, file_id, arg_min(struct_pack(x := x, y := y, z := z, ox := ox, oy := oy, oz := oz), pt_id) AS e FROM uw GROUP BY recording, file_id, floor(x), floor(y), floor(z)),
e2 AS (SELECT recording, file_id, e.x AS x, e.y AS y, e.z AS z, e.ox AS ox, e.oy AS oy, e.oz AS oz FROM en),
ns AS (SELECT file_id, greatest(2, CAST(ceil(max(sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz))) / 0.5) AS INTEGER) + 1) AS n FROM e2 GROUP BY file_id),
ra AS (SELECT recording, file_id, x, y, z, ox, oy, oz, CAST(s AS DOUBLE) / (n - 1) AS t FROM e2 JOIN ns USING (file_id), LATERAL (SELECT unnest(generate_series(0, n - 1)) AS s)),
rc AS (SELECT DISTINCT recording, file_id, {", ".join(f"CAST(floor(o{a} + ({a} - o{a}) * t) AS BIGINT) AS {i}" for a, i in zip("xyz", "ijk"))} FROM ra),
ob AS (SELECT recording, i, j, k, bool_or(e) AS occ FROM (SELECT recording, i, j, k, false AS e FROM rc UNION ALL SELECT recording, {_CELL}, true FROM uw) GROUP BY ALL),
bo AS (SELECT recording, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, min(k) AS k0, max(k) AS k1 FROM ob GROUP BY recording),
un AS (SELECT recording, i, j, k FROM (SELECT recording, i, j, unnest(generate_series(k0, k1)) AS k FROM (SELECT recording, i, k0, k1, unnest(generate_series(j0, j1)) AS j FROM (SELECT *, unnest(generate_series(i0, i1)) AS i FROM bo))) ANTI JOIN ob USING (recording, i, j, k)),
fe AS (SELECT recording, i, j, k FROM ob WHERE NOT occ),
fo AS (SELECT recording, i, j, k FROM fe SEMI JOIN (SELECT recording, i + di AS i, j + dj AS j, k + dk AS k FROM un, {ball_sql(FACES)}) USING (recording, i, j, k)),
sp AS (SELECT recording, arg_min(px, (frame_id, file_id)) / {CELL_M} AS sx, arg_min(py, (frame_id, file_id)) / {CELL_M} AS sy, arg_min(pz, (frame_id, file_id)) / {CELL_M} AS sz FROM fr GROUP BY recording),
po0 AS (SELECT file_id, recording, {", ".join(f"p{a} / {CELL_M} AS {a}, CAST(floor(p{a} / {CELL_M}) AS BIGINT) AS {i}" for a, i in zip("xyz", "ijk"))} FROM fr)"""


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    """World points and their sensor in cells: (recording, file_id, pt_id, x, y, z, ox, oy, oz)."""
    w = world(spark, sf)
    return w.select("recording", "file_id", "pt_id", *[(F.col(a) / CELL_M).alias(a) for a in "xyz"], *[(F.col(f"p{a}") / CELL_M).alias(f"o{a}") for a in "xyz"])


def rays(spark: SparkSession, sf: str) -> DataFrame:
    """(recording, file_id, i, j, k): the cells that the rays of each scan pass, from the sensor outwards."""
    r = planner.raycast(scaled(spark, sf), ["recording", "file_id"], None, None, 1.0)
    return r.select("recording", "file_id", *[F.col(f"i{a}").alias(i) for a, i in zip("xyz", "ijk")])


def floors(prefix: str = "") -> list[Column]:
    return [F.floor(F.col(f"{prefix}{a}")).cast("bigint").alias(i) for a, i in zip("xyz", "ijk")]


def poses(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, recording, x, y, z, i, j, k): every frame's pose in cells, and the cell it lies in."""
    f = frames(spark, sf).select("file_id", "recording", *[(F.col(f"p{a}") / CELL_M).alias(a) for a in "xyz"])
    return f.select("*", *floors())


def starts(spark: SparkSession, sf: str) -> DataFrame:
    """(recording, sx, sy, sz): where each recording's first frame was taken, in cells."""
    first = F.struct("frame_id", "file_id")
    return frames(spark, sf).groupBy("recording").agg(*[(F.min_by(f"p{a}", first) / CELL_M).alias(f"s{a}") for a in "xyz"])


class Lattice:
    """Observed, unknown and frontier cells; the observed ones are written once and read by all."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self._at = (spark, sf)

    @cached_property
    def observed(self) -> DataFrame:
        """(recording, i, j, k, occ)"""
        end = scaled(*self._at).select("recording", *floors(), F.lit(True).alias("occ"))
        passed = rays(*self._at).select(*KEY, F.lit(False).alias("occ"))
        return written(end.unionByName(passed).groupBy(*KEY).agg(F.bool_or("occ").alias("occ")), "lattice")

    @cached_property
    def bounds(self) -> DataFrame:
        """(recording, i0, i1, j0, j1, k0, k1): the box of each recording, one small row; written, so that joins know it as small."""
        box = self.observed.groupBy("recording").agg(*[c for i in "ijk" for c in (F.min(i).alias(f"{i}0"), F.max(i).alias(f"{i}1"))])
        return written(box, "lattice-bounds")

    @cached_property
    def unknown(self) -> DataFrame:
        box = self.bounds
        for i in "ijk":
            box = box.withColumn(i, F.explode(F.sequence(f"{i}0", f"{i}1")))
        return box.select(*KEY).join(by_sort(self.observed.select(*KEY)), KEY, "left_anti")

    def unknown_near(self, places: DataFrame, reach: int) -> DataFrame:
        return unknown_near(places, reach, self.bounds, self.observed.select(*KEY))

    @property
    def free(self) -> DataFrame:
        return self.observed.where("not occ").select(*KEY)

    @property
    def occupied(self) -> DataFrame:
        return self.observed.where("occ").select(*KEY)

    @property
    def frontier(self) -> DataFrame:
        """Free cells with an unknown face neighbour; cells beyond the box are not unknown."""
        return frontier(self.free, self.observed.select(*KEY), self.bounds)


def unknown_near(places: DataFrame, reach: int, bounds: DataFrame, known: DataFrame) -> DataFrame:
    """Each of ``places`` (recording, i, j, k and more) once per cell within ``bounds`` at most ``reach`` cells off each way that is not ``known``; i, j, k are that cell's.

    The work is that of the places: the unknown cells of the grid are never listed.
    """
    d = places.join(bounds, "recording")
    for i in "ijk":
        d = d.withColumn(i, F.explode(F.sequence(F.col(i) - reach, F.col(i) + reach))).where(f"{i} between {i}0 and {i}1")
    return d.select(*places.columns).join(by_sort(known), KEY, "left_anti")


def frontier(free: DataFrame, known: DataFrame, bounds: DataFrame) -> DataFrame:
    """Cells of ``free`` with a face neighbour within ``bounds`` that is not ``known``: the work is that of the free cells, however many are unknown."""
    moves = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(f"d{i}") for i, v in zip("ijk", s)]) for s in FACES])
    here = F.struct("i", "j", "k").alias("__at")
    near = free.select("recording", here, F.explode(moves).alias("__d")).select("recording", "__at", *[(F.col(f"__at.{i}") + F.col(f"__d.d{i}")).alias(i) for i in "ijk"])
    inside = " and ".join(f"{i} between {i}0 and {i}1" for i in "ijk")
    near = near.join(bounds, "recording").where(inside).select(*KEY, "__at").join(by_sort(known), KEY, "left_anti")
    return near.select("recording", "__at.*").distinct()
