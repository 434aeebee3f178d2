"""Exploration planning on the three-state grid of each recording. Lengths are in cells of lattice.CELL_M."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.operators import graph, planner
from aerolith.operators import spatial as S
from aerolith.plans.book import Book, r6
from aerolith.plans.lattice import CELL_M, FACES, KEY, LATTICE, R, Lattice, ball_sql, floors, frontier, poses, rays, starts, unknown_near
from aerolith.runtime import by_sort, table, written

book = Book()


@book.query("grid_g01_raycast", f"WITH {LATTICE} SELECT recording, i, j, k, count(*) AS n_scans FROM rc GROUP BY ALL")
def g01(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that the rays of each scan pass, from the sensor outwards, and by how many scans."""
    return rays(spark, sf).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_scans"))


@book.query("grid_g02_feed_scan", f"WITH {LATTICE} SELECT recording, count(*) AS observed, CAST(count_if(occ) AS BIGINT) AS occupied FROM ob GROUP BY recording")
def g02(spark: SparkSession, sf: str) -> DataFrame:
    """Observed and occupied cells per recording once all its scans are fed; endpoints are occupied."""
    return Lattice(spark, sf).observed.groupBy("recording").agg(F.count(F.lit(1)).alias("observed"), F.count_if("occ").alias("occupied"))


# A cell as one number that sorts as (i, j, k) does: 5000 cells either way of zero.
_LAB = "((i + 5000) * 100000000 + (j + 5000) * 10000 + k + 5000)"


def number(i: Column, j: Column, k: Column) -> Column:
    return (i + 5000) * 100000000 + (j + 5000) * 10000 + k + 5000


_PL = f"""{LATTICE}, sc AS (SELECT recording, sx, sy, sz, CAST(floor(sx) AS BIGINT) AS si, CAST(floor(sy) AS BIGINT) AS sj, CAST(floor(sz) AS BIGINT) AS sk FROM sp SEMI JOIN bo USING (recording)),
blk AS (SELECT recording, si + a AS i, sj + b AS j, sk + c AS k FROM sc, generate_series(-2, 2) x(a), generate_series(-2, 2) y(b), generate_series(-2, 2) z(c)),
pf AS (SELECT recording, i, j, k FROM fe UNION SELECT recording, i, j, k FROM blk), pu AS (SELECT recording, i, j, k FROM un EXCEPT SELECT recording, i, j, k FROM blk), po AS (SELECT recording, i, j, k FROM ob WHERE occ EXCEPT SELECT recording, i, j, k FROM blk),
st AS (SELECT * FROM {ball_sql(FACES)}),
pfo AS (SELECT recording, i, j, k FROM pf SEMI JOIN (SELECT recording, i + di AS i, j + dj AS j, k + dk AS k FROM pu, st) USING (recording, i, j, k)),
re AS (SELECT recording, si AS i, sj AS j, sk AS k FROM sc UNION SELECT pf.recording, pf.i, pf.j, pf.k FROM re, st, pf WHERE pf.recording = re.recording AND pf.i = re.i + di AND pf.j = re.j + dj AND pf.k = re.k + dk),
rf AS (SELECT recording, i, j, k, {_LAB} AS id FROM pfo SEMI JOIN re USING (recording, i, j, k)),
cc (recording, i, j, k, lab) USING KEY (recording, i, j, k) AS (SELECT recording, i, j, k, id FROM rf UNION SELECT rf.recording, rf.i, rf.j, rf.k, min(cc.lab) FROM cc, st, rf, recurring.cc AS own WHERE rf.recording = cc.recording AND rf.i = cc.i + di AND rf.j = cc.j + dj AND rf.k = cc.k + dk AND own.recording = rf.recording AND own.i = rf.i AND own.j = rf.j AND own.k = rf.k AND cc.lab < own.lab GROUP BY rf.recording, rf.i, rf.j, rf.k),
cl AS (SELECT recording, i, j, k, lab FROM cc)"""


class Grid:
    """Free, unknown, occupied and frontier cells of each recording with a block of 5^3 around its start forced free."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        lat = Lattice(spark, sf)
        seq = F.sequence(F.lit(-2).cast("bigint"), F.lit(2).cast("bigint"))
        self.bounds = lat.bounds
        start = starts(spark, sf).join(self.bounds.select("recording"), "recording", "left_semi")
        self.start = written(start.select("*", *[F.floor(f"s{a}").cast("bigint").alias(f"s{i}") for a, i in zip("xyz", "ijk")]), "grid-starts")
        block = self.start
        for i in "ijk":
            block = block.withColumn("d", F.explode(seq)).withColumn(i, F.col(f"s{i}") + F.col("d"))
        block = block.select(*KEY)
        self.free = lat.free.union(block).distinct()
        self.known = lat.observed.select(*KEY).union(block)
        self.unknown = lat.unknown.join(by_sort(block), KEY, "left_anti")
        self.occupied = lat.occupied.join(by_sort(block), KEY, "left_anti")
        self.cells = self.free.select(*KEY, F.lit(False).alias("occ")).unionByName(self.occupied.select(*KEY, F.lit(True).alias("occ")))
        self.frontier = written(frontier(self.free, self.known, self.bounds), "grid-frontier")

    def reached(self, steps: list[tuple[int, int, int]] = FACES) -> DataFrame:
        at = self.start.select("recording", *[F.col(f"s{i}").alias(i) for i in "ijk"])
        return graph.reachable(self.free, at, steps, group=R)

    def clusters(self) -> DataFrame:
        """Frontier cells that can be reached through free cells, with their cluster's number."""
        c = graph.components(self.frontier.join(by_sort(self.reached()), KEY, "left_semi"), group=R)
        return c.select(*KEY, number(F.col("cluster.i"), F.col("cluster.j"), F.col("cluster.k")).alias("lab"))


@book.query("grid_g03_frontier_points", f"WITH RECURSIVE {_PL} SELECT recording, (i + 0.5::DOUBLE) * {CELL_M}::DOUBLE AS x, (j + 0.5::DOUBLE) * {CELL_M}::DOUBLE AS y, (k + 0.5::DOUBLE) * {CELL_M}::DOUBLE AS z FROM pfo")
def g03(spark: SparkSession, sf: str) -> DataFrame:
    """Centres of the frontier cells in metres of the world."""
    return Grid(spark, sf).frontier.select("recording", *[((F.col(i) + 0.5) * CELL_M).alias(a) for i, a in zip("ijk", "xyz")])


@book.query("grid_g04_reachable", f"WITH RECURSIVE {_PL} SELECT recording, i, j, k FROM re")
def g04(spark: SparkSession, sf: str) -> DataFrame:
    return Grid(spark, sf).reached().select(*KEY)


@book.query("grid_g04_frontier_clusters", f"WITH RECURSIVE {_PL} SELECT recording, i, j, k, lab FROM cl")
def g04b(spark: SparkSession, sf: str) -> DataFrame:
    return Grid(spark, sf).clusters()


# Generators in order: frontier clusters at several heights, unknown columns, pseudo-random places near the start, dense blocks.
_RND = "((({n} * 1103515245 + 12345) % 2147483648) / 2147483648.0 * 12.0 - 6.0)"


def _rnd(n: Column) -> Column:
    return ((n * 1103515245 + 12345) % 2147483648) / 2147483648.0 * 12.0 - 6.0


_CAND = f"""{_PL}, cn AS (SELECT recording, lab, avg(i) + 0.5 AS x, avg(j) + 0.5 AS y, avg(k) + 0.5 AS z FROM cl GROUP BY recording, lab HAVING count(*) >= 3),
h1 AS (SELECT recording, 1 AS g, lab * 10 + o AS ord, x, y, CASE WHEN o = 4 THEN sz ELSE z - [0.0, 1.0, 2.0, 4.0][o + 1] END AS z FROM cn JOIN sc USING (recording), generate_series(0, 4) q(o)),
co AS (SELECT recording, i, j FROM (SELECT recording, i, j, row_number() OVER (PARTITION BY recording ORDER BY count(*) DESC, i, j) AS rn FROM pu GROUP BY recording, i, j) WHERE rn <= 10), tf AS (SELECT recording, co.i, co.j, min(k) AS k FROM co JOIN pf USING (recording, i, j) GROUP BY ALL),
h2 AS (SELECT recording, 2 AS g, ((i + 5000) * 10000 + j + 5000) * 10 + o AS ord, i + 0.5 AS x, j + 0.5 AS y, CASE WHEN o = 0 THEN k + 0.5 ELSE sz END AS z FROM (SELECT recording, i, j, k, 0 AS o FROM tf UNION ALL SELECT recording, i, j, 0, 1 FROM co) JOIN sc USING (recording)),
h3r AS (SELECT recording, n, sx + {_RND.format(n='(n * 3 + 1)')} AS x, sy + {_RND.format(n='(n * 3 + 2)')} AS y, sz + {_RND.format(n='(n * 3 + 3)')} AS z FROM sc, generate_series(0, 19) r(n)),
h3 AS (SELECT recording, 3 AS g, n AS ord, x, y, z FROM (SELECT *, CAST(floor(x) AS BIGINT) AS i, CAST(floor(y) AS BIGINT) AS j, CAST(floor(z) AS BIGINT) AS k FROM h3r) ANTI JOIN po USING (recording, i, j, k)),
bl AS (SELECT recording, bi, bj, bk FROM (SELECT recording, (i - i0) // 4 AS bi, (j - j0) // 4 AS bj, (k - k0) // 4 AS bk, row_number() OVER (PARTITION BY recording ORDER BY count(*) DESC, bi, bj, bk) AS rn FROM pu JOIN bo USING (recording) WHERE (i - i0) // 4 < (i1 - i0 + 1) // 4 AND (j - j0) // 4 < (j1 - j0 + 1) // 4 AND (k - k0) // 4 < (k1 - k0 + 1) // 4 GROUP BY recording, bi, bj, bk) WHERE rn <= 5),
bc AS (SELECT recording, (bi * 1000 + bj) * 1000 + bk AS b, i0 + bi * 4 + 2.5 AS x, j0 + bj * 4 + 2.5 AS y, k0 + bk * 4 + 2.5 AS z FROM bl JOIN bo USING (recording)),
h4 AS (SELECT recording, 4 AS g, b * 10 + o AS ord, x + [0, 0, 0, 0, 3, -3, 0, 0][o + 1] AS x, y + [0, 0, 0, 0, 0, 0, 3, -3][o + 1] AS y, CASE o WHEN 1 THEN z - 2 WHEN 2 THEN z - 4 WHEN 3 THEN z ELSE sz END AS z FROM bc JOIN sc USING (recording), generate_series(0, 7) q(o)),
po2 AS (SELECT recording, g, ord, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, k0, k1 FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4) JOIN bo USING (recording) WHERE x BETWEEN i0 + 0.5 AND i1 + 0.5 AND y BETWEEN j0 + 0.5 AND j1 + 0.5),
ca AS (SELECT recording, g, g * 1000000000000000 + ord AS cid, x, y, greatest(k0 + 0.5::DOUBLE, least(k1 + 0.5::DOUBLE, z)) AS z FROM (SELECT *, row_number() OVER (PARTITION BY recording, round_even(x / 0.5, 0), round_even(y / 0.5, 0), round_even(z / 0.5, 0) ORDER BY g, ord) AS rn FROM po2) WHERE rn = 1)"""


def _most(counts: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n rows of each recording with the largest ``n``; ties by ``by``."""
    w = Window.partitionBy("recording").orderBy(F.desc("n"), *by)
    return counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn", "n")


def candidates(grid: Grid) -> DataFrame:
    """(recording, cid, g, x, y, z): viewpoints of the four generators, the first of each half-cell snap."""
    def rows(d: DataFrame, g: int, ordinal: Column, x: Column, y: Column, z: Column) -> DataFrame:
        return d.select("recording", F.lit(g).alias("g"), ordinal.cast("bigint").alias("ord"), x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))

    c = F.col
    start = grid.start.select("recording", "sx", "sy", "sz")
    unknown = written(grid.unknown, "grid-unknown")
    cn = grid.clusters().groupBy("recording", "lab").agg(*[(F.avg(i) + 0.5).alias(a) for i, a in zip("ijk", "xyz")], F.count(F.lit(1)).alias("n")).where("n >= 3")
    cn = cn.join(start, "recording").withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(4))))
    h1 = rows(cn, 1, c("lab") * 10 + c("o"), c("x"), c("y"), F.when(c("o") == 4, c("sz")).otherwise(c("z") - F.element_at(F.array(*map(F.lit, (0.0, 1.0, 2.0, 4.0, 0.0))), c("o") + 1)))
    co = written(_most(unknown.groupBy("recording", "i", "j").agg(F.count(F.lit(1)).alias("n")), ["i", "j"], 10), "grid-columns")
    tf = co.join(grid.free, ["recording", "i", "j"]).groupBy("recording", "i", "j").agg(F.min("k").alias("k")).select(*KEY, F.lit(0).alias("o"))
    cols = tf.unionByName(co.select("recording", "i", "j", F.lit(0).cast("bigint").alias("k"), F.lit(1).alias("o"))).join(start, "recording")
    h2 = rows(cols, 2, ((c("i") + 5000) * 10000 + c("j") + 5000) * 10 + c("o"), c("i") + 0.5, c("j") + 0.5, F.when(c("o") == 0, c("k") + 0.5).otherwise(c("sz")))
    h3 = start.withColumn("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint"))))
    h3 = h3.select("recording", "id", *[(c(f"s{a}") + _rnd(c("id") * 3 + m)).alias(a) for a, m in zip("xyz", (1, 2, 3))]).select("*", *floors()).join(grid.occupied, KEY, "left_anti")
    h3 = rows(h3, 3, c("id"), c("x"), c("y"), c("z"))
    block = {f"b{i}": F.expr(f"({i} - {i}0) div 4") for i in "ijk"}
    whole = " and ".join(f"b{i} < ({i}1 - {i}0 + 1) div 4" for i in "ijk")
    bl = unknown.join(grid.bounds, "recording").withColumns(block).where(whole).groupBy("recording", "bi", "bj", "bk").agg(F.count(F.lit(1)).alias("n"))
    bl = _most(bl, ["bi", "bj", "bk"], 5).join(grid.bounds, "recording").join(start, "recording")
    mid = [(c(f"{i}0") + c(f"b{i}") * 4 + 2.5).alias(a) for i, a in zip("ijk", "xyz")]
    bc = bl.select("recording", "sz", ((c("bi") * 1000 + c("bj")) * 1000 + c("bk")).alias("b"), *mid, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("o"))
    dx, dy = (F.element_at(F.array(*map(F.lit, v)), c("o") + 1) for v in ((0, 0, 0, 0, 3, -3, 0, 0), (0, 0, 0, 0, 0, 0, 3, -3)))
    h4 = rows(bc, 4, c("b") * 10 + c("o"), c("x") + dx, c("y") + dy, F.when(c("o") == 1, c("z") - 2).when(c("o") == 2, c("z") - 4).when(c("o") == 3, c("z")).otherwise(c("sz")))
    pool = h1.unionByName(h2).unionByName(h3).unionByName(h4).join(grid.bounds, "recording").where("x between i0 + 0.5D and i1 + 0.5D and y between j0 + 0.5D and j1 + 0.5D")
    w = Window.partitionBy("recording", *[F.bround(c(a) / 0.5, 0) for a in "xyz"]).orderBy("g", "ord")
    first = pool.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return first.select("recording", (c("g").cast("bigint") * 1000000000000000 + c("ord")).alias("cid"), "g", "x", "y", F.greatest(c("k0") + 0.5, F.least(c("k1") + 0.5, c("z"))).alias("z"))


@book.query("grid_g05_viewpoints", f"WITH RECURSIVE {_CAND} SELECT recording, cid, g, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM ca")
def g05(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(Grid(spark, sf)).select("recording", "cid", "g", *[F.round(a, 9).alias(a) for a in "xyz"])


REACH, HALF = 9.0, 60.0
_TAN = 1.7320508075688767
_FRU = f"""{_CAND}, fu AS (SELECT recording, cid, x, y, z, i, j, k FROM ca JOIN pu USING (recording) WHERE k + 0.5 - z > 0 AND abs(i + 0.5 - x) <= {REACH} AND pow(i + 0.5 - x, 2) + pow(j + 0.5 - y, 2) <= pow((k + 0.5 - z) * {_TAN}, 2) AND pow(i + 0.5 - x, 2) + pow(j + 0.5 - y, 2) + pow(k + 0.5 - z, 2) <= {REACH * REACH})"""
_COL = f"{_FRU}, fb AS (SELECT recording, cid, i, j, min(po.k) AS fk FROM (SELECT DISTINCT recording, cid, z, i, j FROM fu) JOIN po USING (recording, i, j) WHERE po.k >= floor(z) + 1 GROUP BY ALL), cg AS (SELECT recording, cid, count(*) AS gain FROM fu LEFT JOIN fb USING (recording, cid, i, j) WHERE k >= floor(z) + 1 AND (fk IS NULL OR k < fk) GROUP BY recording, cid)"


def with_gain(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Grid]:
    g = Grid(spark, sf)
    c = written(candidates(g), "grid-candidates")
    pairs = planner.frustum_pairs(c, g.unknown, REACH, HALF, R)
    return c, planner.columnar_gain(pairs, g.occupied, R), g


@book.query("grid_g06_columnar_gain", f"WITH RECURSIVE {_COL} SELECT recording, cid, gain FROM cg")
def g06(spark: SparkSession, sf: str) -> DataFrame:
    return with_gain(spark, sf)[1]


@book.query("grid_g07_ray_gain")
def g07(spark: SparkSession, sf: str) -> DataFrame:
    """Gain by marched rays. Cells are reckoned by index, where the reference adds steps up in floating point: tested against a loop."""
    g = Grid(spark, sf)
    return planner.marched_gain(written(candidates(g), "grid-candidates"), g.cells, g.bounds, REACH, HALF, R)


_CAS = f"""{_COL}, cs AS (SELECT ca.recording, ca.cid, g, x, y, z, coalesce(gain, 0) AS gain, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz)) AS dist, EXISTS (SELECT 1 FROM po0 w WHERE w.recording = ca.recording AND pow(w.x - ca.x, 2) + pow(w.y - ca.y, 2) + pow(w.z - ca.z, 2) <= 6.25) AS again,
  EXISTS (SELECT 1 FROM po WHERE po.recording = ca.recording AND po.i = CAST(floor(ca.x) AS BIGINT) AND po.j = CAST(floor(ca.y) AS BIGINT) AND po.k = CAST(floor(ca.z) AS BIGINT)) AS occ FROM ca JOIN sc USING (recording) LEFT JOIN cg ON cg.recording = ca.recording AND cg.cid = ca.cid),
ct AS (SELECT *, CASE WHEN dist < 3 THEN 'too_close' WHEN again THEN 'revisited' WHEN occ THEN 'occupied' WHEN gain <= 0 THEN 'zero_frustum' ELSE 'scored' END AS status FROM cs)"""


def waypoints(spark: SparkSession, sf: str) -> DataFrame:
    """(recording, wid, x, y, z): every different pose of a recording, the whole history that a revisit is judged by."""
    return poses(spark, sf).select("recording", "x", "y", "z").distinct().withColumn("wid", F.xxhash64("x", "y", "z"))


def _from_start(d: DataFrame, grid: Grid) -> DataFrame:
    d = d.join(grid.start.select("recording", "sx", "sy", "sz"), "recording")
    part = [(F.col(a) - F.col(f"s{a}")) * (F.col(a) - F.col(f"s{a}")) for a in "xyz"]
    return d.withColumn("dist", F.sqrt(part[0] + part[1] + part[2])).drop("sx", "sy", "sz")


def cascade(spark: SparkSession, sf: str) -> DataFrame:
    c, gain, g = with_gain(spark, sf)
    key = ["recording", "cid"]
    again = S.within(waypoints(spark, sf), c, 2.5, R, "wid", "cid").select(*key).distinct().withColumn("again", F.lit(True))
    occ = c.select("*", *floors()).join(g.occupied, KEY, "left_semi").select(*key, F.lit(True).alias("occ"))
    d = _from_start(c.join(gain, key, "left").join(again, key, "left").join(occ, key, "left"), g).withColumn("gain", F.coalesce("gain", F.lit(0)))
    status = F.when(F.col("dist") < 3, "too_close").when(F.col("again"), "revisited").when(F.col("occ"), "occupied").when(F.col("gain") <= 0, "zero_frustum").otherwise("scored")
    return d.select(*key, "g", "x", "y", "z", "gain", "dist", status.alias("status"))


@book.query("flt_f14_candidate_cascade", f"WITH RECURSIVE {_CAS} SELECT recording, cid, status FROM ct")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    """Why each viewpoint was dropped; the first reason wins."""
    return cascade(spark, sf).select("recording", "cid", "status")


@book.query("grid_g08_scores", f"WITH RECURSIVE {_CAS} SELECT recording, cid, round(gain / pow(greatest(dist, 0.01), 1.5), 6) AS score FROM ct WHERE status = 'scored'")
def g08(spark: SparkSession, sf: str) -> DataFrame:
    return cascade(spark, sf).where("status = 'scored'").select("recording", "cid", r6(planner.score(F.col("gain"), F.col("dist"), 1.5)).alias("score"))


@book.query("grid_g08_best_viewpoint", f"WITH RECURSIVE {_CAS} SELECT recording, cid, g, gain FROM ct WHERE status = 'scored' QUALIFY row_number() OVER (PARTITION BY recording ORDER BY round(gain / pow(greatest(dist, 0.01), 1.5), 9) DESC, cid) = 1")
def g08b(spark: SparkSession, sf: str) -> DataFrame:
    """The viewpoint of each recording that is flown to next."""
    d = cascade(spark, sf).where("status = 'scored'")
    best = F.struct(F.round(planner.score(F.col("gain"), F.col("dist"), 1.5), 9), -F.col("cid"))
    return d.groupBy("recording").agg(F.max_by(F.struct("cid", "g", "gain"), best).alias("b")).select("recording", "b.*")


_WFD = f"""{_PL}, ce AS (SELECT recording, lab, count(*) AS size, avg(i) + 0.5 AS x, avg(j) + 0.5 AS y, avg(k) + 0.5 AS zf FROM cl GROUP BY recording, lab HAVING count(*) >= 2),
cz AS (SELECT recording, lab, size, greatest(i0 + 0.5::DOUBLE, least(i1 + 0.5::DOUBLE, x)) AS x, greatest(j0 + 0.5::DOUBLE, least(j1 + 0.5::DOUBLE, y)) AS y, greatest(k0 + 0.5::DOUBLE, least(k1 + 0.5::DOUBLE, zf - 2)) AS z, zf FROM ce JOIN bo USING (recording)),
cr AS (SELECT cz.*, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz)) AS dist, EXISTS (SELECT 1 FROM po WHERE po.recording = cz.recording AND po.i = CAST(floor(cz.x) AS BIGINT) AND po.j = CAST(floor(cz.y) AS BIGINT) AND po.k = CAST(floor(cz.z) AS BIGINT)) AS occ,
  EXISTS (SELECT 1 FROM po0 w WHERE w.recording = cz.recording AND pow(w.x - cz.x, 2) + pow(w.y - cz.y, 2) + pow(w.z - cz.z, 2) <= 6.25) AS again FROM cz JOIN sc USING (recording))"""


def cluster_targets(spark: SparkSession, sf: str) -> tuple[DataFrame, Grid]:
    """Cluster centroids, lifted by 2 cells, clamped, with their reject reason."""
    g = Grid(spark, sf)
    key = ["recording", "lab"]
    c = g.clusters().groupBy(*key).agg(F.count(F.lit(1)).alias("size"), *[(F.avg(i) + 0.5).alias(f"m{i}") for i in "ijk"]).where("size >= 2").join(g.bounds, "recording")
    at = {"i": F.col("mi"), "j": F.col("mj"), "k": F.col("mk") - 2}
    side = [F.greatest(F.col(f"{i}0") + 0.5, F.least(F.col(f"{i}1") + 0.5, m)).alias(a) for (i, m), a in zip(at.items(), "xyz")]
    c = written(c.select(*key, "size", *side, F.col("mk").alias("zf")), "grid-targets")
    again = S.within(waypoints(spark, sf), c, 2.5, R, "wid", "lab").select(*key).distinct().withColumn("again", F.lit(True))
    occ = c.select("*", *floors()).join(by_sort(g.occupied), KEY, "left_semi").select(*key, F.lit(True).alias("occ"))
    d = _from_start(c.join(again, key, "left").join(occ, key, "left"), g)
    reason = F.when(F.coalesce("occ", F.lit(False)), "occupied").when(F.coalesce("again", F.lit(False)), "revisited").when(F.greatest("dist", F.lit(0.01)) < 3, "too_close").otherwise("kept")
    return d.withColumn("reason", reason), g


@book.query("flt_f15_cluster_rejects", f"WITH RECURSIVE {_WFD} SELECT recording, lab, size, CASE WHEN occ THEN 'occupied' WHEN again THEN 'revisited' WHEN greatest(dist, 0.01) < 3 THEN 'too_close' ELSE 'kept' END AS reason FROM cr")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    return cluster_targets(spark, sf)[0].select("recording", "lab", "size", "reason")


@book.query(
    "grid_g09_wfd_target",
    f"""WITH RECURSIVE {_WFD}, kp AS (SELECT recording, lab, dist, CAST(floor(x) AS BIGINT) AS ci, CAST(floor(y) AS BIGINT) AS cj, CAST(floor(zf) AS BIGINT) AS ck FROM cr WHERE NOT occ AND NOT again AND greatest(dist, 0.01) >= 3),
  nb AS (SELECT kp.recording, lab, count(*) AS n FROM kp JOIN pu ON pu.recording = kp.recording AND pu.i BETWEEN ci - 3 AND ci + 3 AND pu.j BETWEEN cj - 3 AND cj + 3 AND pu.k BETWEEN ck - 3 AND ck + 3 GROUP BY ALL),
  gn AS (SELECT recording, lab, dist, coalesce(n, 0) AS gain FROM kp LEFT JOIN nb USING (recording, lab))
  SELECT recording, lab, gain, round(gain / pow(greatest(dist, 0.01), 1.0), 6) AS score, row_number() OVER (PARTITION BY recording ORDER BY round(gain / greatest(dist, 0.01), 9) DESC, lab)::INTEGER AS place FROM gn""",
)
def g09(spark: SparkSession, sf: str) -> DataFrame:
    """Kept clusters by the unknown cells in the 7^3 box around them over the distance, ranked within their recording."""
    c, g = cluster_targets(spark, sf)
    key = ["recording", "lab"]
    box = c.where("reason = 'kept'").select(*key, "dist", *[F.floor(a).cast("bigint").alias(i) for a, i in (("x", "i"), ("y", "j"), ("zf", "k"))])
    n = unknown_near(box, 3, g.bounds, g.known).groupBy(*key).agg(F.count(F.lit(1)).alias("gain"))
    d = box.join(n, key, "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    s = planner.score(F.col("gain"), F.col("dist"), 1.0)
    w = Window.partitionBy("recording").orderBy(F.desc(F.round(s, 9)), "lab")
    return d.select(*key, "gain", r6(s).alias("score"), F.row_number().over(w).alias("place"))


def _line_sql(goals: str) -> str:
    """Cells on the straight line from the start to each row (recording, gid, x, y, z) of ``goals``, every 0.3 of a cell."""
    return f"""ls AS (SELECT g.recording, gid, sx, sy, sz, x - sx AS dx, y - sy AS dy, z - sz AS dz, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz)) AS d FROM {goals} g JOIN sc USING (recording)),
lt AS (SELECT *, unnest(generate_series(0, CAST(ceil(d / 0.3) AS INTEGER))) AS s FROM ls WHERE d >= 1e-6),
lc AS (SELECT DISTINCT recording, gid, {", ".join(f"CAST(floor(s{a} + d{a} / d * least(s * 0.3, d)) AS BIGINT) AS {i}" for a, i in zip("xyz", "ijk"))} FROM lt),
hit AS (SELECT DISTINCT recording, gid FROM lc SEMI JOIN po USING (recording, i, j, k))"""


def blocked(goals: DataFrame, grid: Grid, gid: str) -> DataFrame:
    """(recording, gid) of the goals whose straight line from the start meets an occupied cell, by steps of 0.3 of a cell."""
    d = _from_start(goals.select("recording", gid, "x", "y", "z"), grid).where("dist >= 1e-6").join(grid.start.select("recording", "sx", "sy", "sz"), "recording")
    s = d.withColumn("s", F.explode(F.sequence(F.lit(0), F.ceil(F.col("dist") / 0.3).cast("int"))))
    way = F.least(F.col("s") * 0.3, F.col("dist"))
    cells = s.select("recording", gid, *[F.floor(F.col(f"s{a}") + (F.col(a) - F.col(f"s{a}")) / F.col("dist") * way).cast("bigint").alias(i) for a, i in zip("xyz", "ijk")]).distinct()
    return cells.join(grid.occupied, KEY, "left_semi").select("recording", gid).distinct()


@book.query("grid_g12_straight_line_free", f"WITH RECURSIVE {_PL}, gp AS (SELECT recording, file_id AS gid, x, y, z FROM po0), {_line_sql('gp')} SELECT file_id, hit.gid IS NULL AS free FROM po0 LEFT JOIN hit ON hit.gid = po0.file_id")
def g12(spark: SparkSession, sf: str) -> DataFrame:
    """Does the straight line from its recording's start to each pose meet no occupied cell."""
    f = poses(spark, sf)
    hit = blocked(f, Grid(spark, sf), "file_id").select("file_id").withColumn("hit", F.lit(True))
    return f.select("file_id").join(hit, "file_id", "left").select("file_id", F.col("hit").isNull().alias("free"))


#: Straight up first, then the 26 directions of growing shells, in the order they are tried.
ESCAPES = [(0, 0, -d) for d in range(1, 6)] + [(a * r, b * r, c * r) for r in range(1, 4) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
_ESC = "(VALUES " + ", ".join(f"({n}, {a}, {b}, {c})" for n, (a, b, c) in enumerate(ESCAPES)) + ") AS es(rank, di, dj, dk)"


@book.query("grid_g13_nearest_free", f"WITH RECURSIVE {_PL} SELECT c.file_id, CAST(min(rank) AS INTEGER) AS rank FROM po0 c, {_ESC}, pf WHERE pf.recording = c.recording AND pf.i = c.i + di AND pf.j = c.j + dj AND pf.k = c.k + dk GROUP BY c.file_id")
def g13(spark: SparkSession, sf: str) -> DataFrame:
    """The first free cell by the order of escapes; it need not be the nearest."""
    c = poses(spark, sf).select("file_id", *KEY)
    esc = F.array(*[F.struct(F.lit(n).alias("rank"), *[F.lit(v).alias(f"d{i}") for i, v in zip("ijk", s)]) for n, s in enumerate(ESCAPES)])
    e = c.withColumn("e", F.explode(esc)).select("file_id", "recording", "e.rank", *[(F.col(i) + F.col(f"e.d{i}")).alias(i) for i in "ijk"])
    return e.join(Grid(spark, sf).free, KEY, "left_semi").groupBy("file_id").agg(F.min("rank").alias("rank"))


_NEAR26 = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]


@book.query("grid_g14_grid_distance")
def g14(spark: SparkSession, sf: str) -> DataFrame:
    """Steps from the start to every free cell over 26 neighbours: the deterministic stand-in for the sampling planners."""
    return Grid(spark, sf).reached(_NEAR26)


_GOAL = f"go AS (SELECT recording, n AS gid, sx + {_RND.format(n='(n * 3 + 7)')} * 2 AS x, sy + {_RND.format(n='(n * 3 + 8)')} * 2 AS y, sz + {_RND.format(n='(n * 3 + 9)')} AS z FROM sc, generate_series(0, 199) r(n))"


@book.query("flt_f17_random_goals", f"""WITH RECURSIVE {_PL}, {_GOAL}, {_line_sql('go')}, gc AS (SELECT go.*, sz, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz)) AS d, CAST(floor(x) AS BIGINT) AS i, CAST(floor(y) AS BIGINT) AS j, CAST(floor(z) AS BIGINT) AS k FROM go JOIN sc USING (recording))
  SELECT gc.recording, gc.gid AS n, CASE WHEN pf.i IS NULL THEN 'not traversable' WHEN z > sz + 4 THEN 'below ground' WHEN d < 3 THEN 'too near' WHEN hit.gid IS NULL THEN 'straight line free' ELSE 'good' END AS verdict FROM gc LEFT JOIN pf USING (recording, i, j, k) LEFT JOIN hit ON hit.recording = gc.recording AND hit.gid = gc.gid""")
def f17(spark: SparkSession, sf: str) -> DataFrame:
    """Pseudo-random goals around each start and the first reason against each; a goal in free sight is no test of a planner."""
    grid = Grid(spark, sf)
    at = grid.start.withColumn("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(199).cast("bigint"))))
    g = at.select("recording", "n", *[(F.col(f"s{a}") + _rnd(F.col("n") * 3 + m) * scale).alias(a) for a, m, scale in (("x", 7, 2), ("y", 8, 2), ("z", 9, 1))])
    hit = blocked(g, grid, "n").withColumn("hit", F.lit(True))
    d = _from_start(g, grid).join(grid.start.select("recording", "sz"), "recording").select("*", *floors())
    d = d.join(grid.free.withColumn("ok", F.lit(True)), KEY, "left").join(hit, ["recording", "n"], "left")
    verdict = F.when(F.col("ok").isNull(), "not traversable").when(F.col("z") > F.col("sz") + 4, "below ground").when(F.col("dist") < 3, "too near").when(F.col("hit").isNull(), "straight line free")
    return d.select("recording", "n", verdict.otherwise("good").alias("verdict"))


@book.query("grid_g10_random_target", f"WITH RECURSIVE {_PL}, near AS (SELECT DISTINCT po.recording, po.i + di AS i, po.j + dj AS j, po.k + dk AS k FROM po, {ball_sql(S.offsets(2, 'cross'))}) SELECT recording, i, j, k FROM pf SEMI JOIN near USING (recording, i, j, k) QUALIFY row_number() OVER (PARTITION BY recording ORDER BY {_LAB} * 7919 % 10007, i, j, k) = 1")
def g10(spark: SparkSession, sf: str) -> DataFrame:
    """A pseudo-random free cell near an obstacle: the target that the random planner flies to."""
    g = Grid(spark, sf)
    near = g.free.join(by_sort(S.shifted(g.occupied, S.offsets(2, "cross"), group=R)), KEY, "left_semi")
    order = F.struct(number(F.col("i"), F.col("j"), F.col("k")) * 7919 % 10007, "i", "j", "k")
    return near.groupBy("recording").agg(F.min_by(F.struct("i", "j", "k"), order).alias("c")).select("recording", "c.*")


@book.query("grid_g11_perimeter_points", "WITH p AS (SELECT event_id, event_id * 37 % 9700 / 100.0::DOUBLE AS s FROM events) SELECT event_id, round(CASE WHEN s < 24 THEN -12 + s WHEN s < 48.5 THEN 12 WHEN s < 72.5 THEN 12 - (s - 48.5) ELSE -12 END, 6) AS x, round(CASE WHEN s < 24 THEN -12.25 WHEN s < 48.5 THEN -12.25 + (s - 24) WHEN s < 72.5 THEN 12.25 ELSE 12.25 - (s - 72.5) END, 6) AS y FROM p")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    """Points on the rim of a 24 by 24.5 m box by arc length."""
    s = F.col("s")
    p = table(spark, sf, "events").select("event_id", (F.col("event_id") * 37 % 9700 / 100.0).alias("s"))
    x = F.when(s < 24, -12 + s).when(s < 48.5, 12.0).when(s < 72.5, 12 - (s - 48.5)).otherwise(-12.0)
    y = F.when(s < 24, -12.25).when(s < 48.5, -12.25 + (s - 24)).when(s < 72.5, 12.25).otherwise(12.25 - (s - 72.5))
    return p.select("event_id", r6(x).alias("x"), r6(y).alias("y"))


QUERIES, SQL = book.queries, book.sql
