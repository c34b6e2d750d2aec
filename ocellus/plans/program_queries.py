"""Queries of what whole programs do: masks of a grid from a point cloud, and indices of a tie-point file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.operators import masks
from ocellus.operators.iteration import scratch
from ocellus.plans.registry import Registry, with_
from ocellus.plans.standins import POINTS_SQL, points, table
from ocellus.sources import tiepoints

R = Registry()
SIDE = 40
_MAP = ((0.0, 0.05, 0.0, 20.0), (0.05, 0.0, 0.0, 20.0))
_PLACED = f"placed AS (SELECT *, CAST(round(0.05::DOUBLE * y + 20) AS INT) AS i, CAST(round(0.05::DOUBLE * x + 20) AS INT) AS j FROM points WHERE round(0.05::DOUBLE * y + 20) BETWEEN 0 AND {SIDE - 1} AND round(0.05::DOUBLE * x + 20) BETWEEN 0 AND {SIDE - 1})"
_GRID = f"grid AS (SELECT CAST(a AS INT) AS i, CAST(b AS INT) AS j FROM range({SIDE}) r(a) CROSS JOIN range({SIDE}) s(b))"
_MASK = "mask AS (SELECT i, j, CASE WHEN count(p.pt) > 0 THEN 255 ELSE 0 END AS mask FROM grid LEFT JOIN (SELECT * FROM placed WHERE cluster IN (1, 3)) p USING (i, j) GROUP BY i, j)"


def _class_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.class_mask(points(spark, sf_dir), [1, 3], _MAP, SIDE, SIDE)


def _swept(name: str, of: str, pick: str) -> str:
    return f"{name} AS (SELECT c.i, c.j, {pick}(n.mask) AS mask FROM grid c JOIN {of} n ON abs(n.i - c.i) <= 1 AND abs(n.j - c.j) <= 1 GROUP BY c.i, c.j)"


R.add("class_mask", _class_mask, with_(POINTS_SQL, _PLACED, _GRID, _MASK) + "SELECT i, j, CAST(mask AS INT) AS mask FROM mask")
R.add("class_mask_closed", lambda s, d: masks.closed(_class_mask(s, d).withColumn("img", F.lit(0)), 1).select("i", "j", "mask"),
      with_(POINTS_SQL, _PLACED, _GRID, _MASK, _swept("wide", "mask", "max"), _swept("shut", "wide", "min")) + "SELECT i, j, CAST(mask AS INT) AS mask FROM shut")
R.add("cluster_mask", lambda s, d: masks.cluster_mask(points(s, d), _MAP, SIDE, SIDE),
      with_(POINTS_SQL, _PLACED, _GRID) + "SELECT i, j, CAST(coalesce(max(cluster) + 1, 0) AS INT) AS cluster FROM grid LEFT JOIN placed USING (i, j) GROUP BY i, j")


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A tie-point file: ten vectors to an image, whose points are shared by every fiftieth vector."""
    e = F.col("embedding").cast("array<double>")
    whole = lambda k: F.round(F.get(e, F.lit(k)) * 1000, 0).cast("bigint").cast("string")
    one = F.concat_ws(" ", whole(0), whole(1), (F.col("vec_id") % 50).cast("string"))
    rows = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).cast("string").alias("img")).agg(F.array_sort(F.collect_list(F.struct("vec_id", one.alias("one")))).alias("all"))
    places = F.concat_ws(" ", F.transform("all", lambda x: x["one"]))
    at = scratch(spark)
    rows.select(F.concat(F.col("img"), F.lit(" 640 480 img_"), F.col("img"), F.lit(".jpg\n"), places).alias("value")).write.text(at)
    return at


def _tie_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, seen = tiepoints.tie_points(spark, _written(spark, sf_dir))
    by_point = tiepoints.images_of_points(seen).select("point", F.concat_ws(",", "images").alias("images"))
    first = seen.join(images, "image").groupBy("point").agg(F.min("name").alias("name"), F.sum("x").cast("long").alias("x"), F.sum("y").cast("long").alias("y"))
    n = tiepoints.shuffled(seen).agg(F.count("*").alias("points"), (F.max("turn") + 1).alias("turns")).first()
    return by_point.join(first, "point").select("point", "images", "name", "x", "y", F.lit(n.points).alias("points"), F.lit(n.turns).alias("turns"))


R.add("tie_points", _tie_points, """WITH p AS (SELECT vec_id % 50 AS point, vec_id // 10 AS image, CAST(round(CAST(embedding[1] AS DOUBLE) * 1000, 0) AS BIGINT) AS x, CAST(round(CAST(embedding[2] AS DOUBLE) * 1000, 0) AS BIGINT) AS y FROM embeddings)
SELECT point, string_agg(CAST(image AS VARCHAR), ',' ORDER BY image) AS images, min('img_' || image || '.jpg') AS name, CAST(sum(x) AS BIGINT) AS x, CAST(sum(y) AS BIGINT) AS y,
  (SELECT count(DISTINCT point) FROM p) AS points, (SELECT count(DISTINCT point) FROM p) AS turns FROM p GROUP BY point""")
