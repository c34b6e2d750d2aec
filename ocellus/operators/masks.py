"""Masks of a grid from classified points: one class or several, clusters by number or colour, and the closing of their holes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.operators.raster import CELL, neighbourhood

#: An affine map from (x, y, z) to a place: two rows of three factors and an offset.
Map = Sequence[Sequence[float]]


def placed(points: DataFrame, to_grid: Map, h: int, w: int) -> DataFrame:
    """points with the cell (i, j) that each falls into, rounded; those outside the grid are left out."""
    at = [F.round(sum((float(f) * F.col(c) for f, c in zip(row, "xyz", strict=False)), F.lit(float(row[3])))) for row in to_grid]
    inside = (F.col("_i") >= 0) & (F.col("_j") >= 0) & (F.col("_i") < h) & (F.col("_j") < w)
    rows = points.withColumns({"_i": at[0], "_j": at[1]}).where(inside)
    return rows.withColumns({"i": F.col("_i").cast("int"), "j": F.col("_j").cast("int")}).drop("_i", "_j")


def _grid(own: DataFrame, h: int, w: int, **fill: int) -> DataFrame:
    """All cells of the grid, row by row of it in tasks of their own, with fill where own has none."""
    rows = own.sparkSession.range(h).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("j"))
    return rows.join(own, ["i", "j"], "left").fillna(fill)


def class_mask(points: DataFrame, classes: Sequence[int], to_grid: Map, h: int, w: int, name: str = "cluster") -> DataFrame:
    """i, j, mask: 255 where a point of one of the classes falls, else 0."""
    own = placed(points.where(F.col(name).isin(list(classes))), to_grid, h, w).select("i", "j").distinct().withColumn("mask", F.lit(255))
    return _grid(own, h, w, mask=0)


def cluster_mask(points: DataFrame, to_grid: Map, h: int, w: int, name: str = "cluster") -> DataFrame:
    """i, j, cluster: 1 more than the greatest cluster number in each cell, 0 where there is none."""
    own = placed(points, to_grid, h, w).groupBy("i", "j").agg((F.max(name) + 1).cast("int").alias("cluster"))
    return _grid(own, h, w, cluster=0)


def cover_mask(points: DataFrame, to_grid: Map, h: int, w: int, seed: int = 1, name: str = "cluster") -> DataFrame:
    """i, j, r, g, b: each cluster in a colour of 25 to 255, drawn by the seed and its number; black where there is none."""
    shade = lambda k: F.when(F.col("cluster") > 0, 25 + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("cluster")), F.lit(231))).otherwise(0).cast("int")
    return cluster_mask(points, to_grid, h, w, name).select("i", "j", *[shade(k).alias(c) for k, c in enumerate("rgb")])


def closed(mask: DataFrame, r: int, value: str = "mask") -> DataFrame:
    """The mask (img, i, j and a value) with holes and gaps up to twice r across filled: the greatest value of a square, then the least of those; the border does not eat into it."""

    def swept(rows: DataFrame, pick) -> DataFrame:
        near = neighbourhood(rows.withColumn("_v", F.col(value).cast("double")), r, r, value="_v", out="_f", outside=None)
        return near.select(*CELL, _of_known(pick).cast("int").alias(value))

    return swept(swept(mask, F.array_max), F.array_min)


def _of_known(pick) -> Column:
    return pick(F.array_compact("_f"))
