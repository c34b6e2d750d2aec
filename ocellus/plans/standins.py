"""Stand-in images, features, points, signals and graphs over the driver's tables.

Each builder has an SQL twin, a list of common table expressions, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

H, W, IMAGES, SHIFT = 32, 48, 4, 2
#: Orders that share a block of IMAGES images; images grow in number with the table.
ORDERS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _block() -> Column:
    return F.floor(F.col("l_orderkey") / ORDERS)


def grid(lines: DataFrame) -> DataFrame:
    """All cells of the images of each block of orders. Dealt out once more, so that a join weighs the cells and not the few blocks that they come of."""
    k = F.col("k")
    cells = lines.select(_block().alias("b")).distinct().select("b", F.explode(F.sequence(F.lit(0), F.lit(IMAGES * H * W - 1))).alias("k"))
    out = cells.select((F.col("b") * IMAGES + F.floor(k / (H * W))).cast("int").alias("img"), (k / W % H).cast("int").alias("i"), (k % W).cast("int").alias("j"))
    return out.repartition("img", "i", "j")


def raster(spark: SparkSession, sf_dir: str, measure: str = "l_quantity", scale: float = 1.0) -> DataFrame:
    """img, i, j, value: whole-numbered means of a measure on a dense grid, 0 where there is none."""
    lines = table(spark, sf_dir, "lineitem")
    cell = {"img": _block() * IMAGES + F.col("l_linenumber") % IMAGES, "i": F.col("l_partkey") % H, "j": F.col("l_orderkey") % W}
    means = lines.groupBy(*[c.cast("int").alias(n) for n, c in cell.items()]).agg(F.floor(F.sum(F.round(F.col(measure) * scale, 0)) / F.count("*")).cast("double").alias("value"))
    return grid(lines).join(means, ["img", "i", "j"], "left").select("img", "i", "j", F.coalesce("value", F.lit(0.0)).alias("value"))


def raster_sql(name: str = "cells", measure: str = "l_quantity", scale: float = 1.0) -> str:
    return f"""{name}_g AS (SELECT CAST(l_orderkey // {ORDERS} * {IMAGES} + l_linenumber % {IMAGES} AS INT) AS img, CAST(l_partkey % {H} AS INT) AS i, CAST(l_orderkey % {W} AS INT) AS j,
    floor(sum(round({measure} * {scale}, 0)) / count(*)) AS value FROM lineitem GROUP BY ALL),
{name} AS (SELECT CAST(b * {IMAGES} + k // {H * W} AS INT) AS img, CAST(k // {W} % {H} AS INT) AS i, CAST(k % {W} AS INT) AS j, CAST(coalesce(value, 0) AS DOUBLE) AS value
    FROM (SELECT DISTINCT l_orderkey // {ORDERS} AS b FROM lineitem) CROSS JOIN range({IMAGES * H * W}) r(k) LEFT JOIN {name}_g g ON g.img = b * {IMAGES} + k // {H * W} AND g.i = k // {W} % {H} AND g.j = k % {W})"""


def shifted(cells: DataFrame, shift: int = SHIFT) -> DataFrame:
    """The source image of the stereo pair: source(i, j) = target(i, j + shift), 0 outside."""
    return stereo(cells, shift).select("img", "i", "j", F.col("s").alias("value"))


def stereo(cells: DataFrame, shift: int = SHIFT) -> DataFrame:
    """img, i, j, s, t: the source's value, looked up along the row, beside the target's. One sort, where a join takes two."""
    there = Window.partitionBy("img", "i").orderBy("j").rangeBetween(shift, shift)
    return cells.select("img", "i", "j", F.coalesce(F.max("value").over(there), F.lit(0.0)).alias("s"), F.col("value").alias("t"))


SOURCE_SQL = f"""source AS (SELECT c.img, c.i, c.j, coalesce(n.value, 0.0) AS value FROM cells c
    LEFT JOIN cells n ON n.img = c.img AND n.i = c.i AND n.j = c.j + {SHIFT})"""


def around_sql(name: str, ri: int, rj: int, of: str = "cells") -> str:
    """name: each cell with each place of its window; v is 0 outside, nv null."""
    return f"""{name} AS (SELECT c.img, c.i, c.j, c.value AS centre, a.di, b.dj, coalesce(n.value, 0.0) AS v, n.value AS nv FROM {of} c
    CROSS JOIN (SELECT unnest(range({-ri}, {ri + 1})) AS di) a CROSS JOIN (SELECT unnest(range({-rj}, {rj + 1})) AS dj) b
    LEFT JOIN {of} n ON n.img = c.img AND n.i = c.i + a.di AND n.j = c.j + b.dj)"""


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, i, j, r, g, b, each 0 to 255."""
    r, g, b = (raster(spark, sf_dir, m, s).withColumnRenamed("value", c) for m, s, c in (("l_quantity", 5.0, "r"), ("l_discount", 2000.0, "g"), ("l_tax", 2500.0, "b")))
    return r.join(g, ["img", "i", "j"]).join(b, ["img", "i", "j"])


RGB_SQL = ",\n".join(
    [raster_sql("red", "l_quantity", 5.0), raster_sql("green", "l_discount", 2000.0), raster_sql("blue", "l_tax", 2500.0),
     "rgb AS (SELECT red.img, red.i, red.j, red.value AS r, green.value AS g, blue.value AS b FROM red JOIN green USING (img, i, j) JOIN blue USING (img, i, j))"]
)


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding (a) with the next one by vec_id (b)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(n, "vec_id")


PAIRS_SQL = """pairs AS (SELECT x.vec_id, unnest(range(1, 65)) AS k, x.embedding AS ea, y.embedding AS eb FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1),
flat AS (SELECT vec_id, k, CAST(ea[k] AS DOUBLE) AS a, CAST(eb[k] AS DOUBLE) AS b FROM pairs),
zeroed AS (SELECT vec_id, k, a - avg(a) OVER (PARTITION BY vec_id) AS a, b - avg(b) OVER (PARTITION BY vec_id) AS b FROM flat)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pt, x, y, z, cluster: the first three coordinates of each embedding, in whole thousandths."""
    e = F.col("embedding").cast("array<double>")
    xyz = [(F.round(F.get(e, F.lit(k)) * 1000, 0) + 0.0).alias(c) for k, c in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pt"), *xyz, F.col("label").alias("cluster"))


POINTS_SQL = "points AS (SELECT vec_id AS pt, " + ", ".join(f"round(CAST(embedding[{k + 1}] AS DOUBLE) * 1000, 0) + 0.0 AS {c}" for k, c in enumerate("xyz")) + ", label AS cluster FROM embeddings)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, w: parts and suppliers (suppliers below 0) that share line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("u"), (-1 - F.col("l_suppkey")).alias("v")).agg(F.count("*").alias("w"))


EDGES_SQL = "edges AS (SELECT l_partkey AS u, -1 - l_suppkey AS v, count(*) AS w FROM lineitem GROUP BY ALL)"
