"""Problem 5: the most similar other maps of every saved map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.neighbours import nearest_vectors, pairs
from aerolith.runtime import table

DIMS, NEIGHBOURS = 78, 4


def map_vector() -> Column:
    """6 bounds, then x, y, z of 24 points, a null point or coordinate as zeros; null unless whole."""
    points = F.flatten(F.transform("points", lambda p: F.transform(F.array(p["x"], p["y"], p["z"]), lambda c: F.coalesce(c.cast("double"), F.lit(0.0)))))
    whole = (F.size("bounds") == 6) & (F.size("points") == 24)
    return F.when(whole, F.concat("bounds", points))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = table(spark, sf_dir, "slam_map").select("map_id", "bounds", "points")
    return nearest_vectors(maps, "map_id", map_vector(), DIMS, NEIGHBOURS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(_neighbours(spark, sf_dir), "map_id", "map_id_a", "map_id_b")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked list of every map."""
    n = _neighbours(spark, sf_dir).select("map_id", F.posexplode("neighbours").alias("pos", "hit"))
    return n.select("map_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("neighbour_id"), F.round("hit.d", 6).alias("distance"))


_WITH = """WITH m AS (SELECT map_id, any_value(list_concat(bounds, flatten([[coalesce(CAST(p.x AS DOUBLE), 0), coalesce(CAST(p.y AS DOUBLE), 0), coalesce(CAST(p.z AS DOUBLE), 0)] for p in points]))) AS v
  FROM slam_map WHERE len(bounds) = 6 AND len(points) = 24 AND len([b for b in bounds if b IS NULL OR isnan(b)]) = 0 GROUP BY map_id),
d AS (SELECT a.map_id AS a, b.map_id AS b, list_distance(a.v, b.v) AS d FROM m a JOIN m b ON a.map_id <> b.map_id),
r AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM d)"""

QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours}
SQL = {
    "p5_found": f"{_WITH} SELECT DISTINCT least(a, b) AS map_id_a, greatest(a, b) AS map_id_b FROM r WHERE rank <= 4",
    "p5_neighbours": f"{_WITH} SELECT a AS map_id, CAST(rank AS INTEGER) AS rank, b AS neighbour_id, round(d, 6) AS distance FROM r WHERE rank <= 4",
}
