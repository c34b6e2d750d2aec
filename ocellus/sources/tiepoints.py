"""Tie-point files: for each image a line with its number and file, then a line of places and point numbers in threes.

Such a file is read as text, by as many tasks as it has splits. A line's number
comes from the counts of the splits before its own, so a pair of lines may lie
on both sides of a split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), value of the text files at a path, without reading any whole file in one task."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # A row for each split: the running sum stays small whatever the file.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "first", before.alias("before"))
    met = rows.join(starts, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    return met.select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def _words() -> Column:
    return F.filter(F.split("value", r"[\x20\x09\r]+"), lambda w: w != "")


def tie_points(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Images (image, name) and points (image, seq, point, x, y) of the files at a path.

    An image line's first word is its number and its last the file's name. Words that are left over at the end of a
    line of places, and places that are no numbers, are dropped; a missing line of places has none.
    """
    lines = numbered_lines(spark, path).select("file", F.floor(F.col("line") / 2).alias("pair"), (F.col("line") % 2).alias("part"), _words().alias("words"))
    own = lines.groupBy("file", "pair").agg(F.max(F.when(F.col("part") == 0, F.col("words"))).alias("head"), F.max(F.when(F.col("part") == 1, F.col("words"))).alias("places"))
    own = own.where(F.size("head") > 0).withColumn("image", F.try_element_at("head", F.lit(1)).try_cast("long")).where("image IS NOT NULL")
    images = own.select("image", F.element_at("head", -1).alias("name"))
    threes = F.transform(F.sequence(F.lit(0), F.floor(F.size("places") / 3).cast("int") - 1), lambda k: F.slice("places", 3 * k + 1, 3))
    listed = own.where(F.size("places") >= 3).select("image", F.posexplode(threes).alias("seq", "p"))
    number = lambda k, kind: F.get("p", F.lit(k)).try_cast(kind)
    points = listed.select("image", "seq", number(2, "long").alias("point"), number(0, "double").alias("x"), number(1, "double").alias("y"))
    return images, points.where("point IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")


def images_of_points(points: DataFrame) -> DataFrame:
    """point, images: where each point was seen, by image and place in its line."""
    return points.groupBy("point").agg(F.transform(F.array_sort(F.collect_list(F.struct("image", "seq"))), lambda x: x["image"]).alias("images"))


def points_of_images(points: DataFrame) -> DataFrame:
    """image, points: the points of each image in the order of its line."""
    return points.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "point"))), lambda x: x["point"]).alias("points"))


def shuffled(points: DataFrame, seed: int = 4269) -> DataFrame:
    """point, turn: each point once, and a number from 0 on in an order drawn by the seed; of points of one hash the lesser comes first."""
    own = points.select("point").distinct().withColumn("h", F.xxhash64(F.lit(seed), F.col("point")))
    # Ranges of hashes are numbered apart, then moved by the counts before them.
    parts = own.withColumn("part", F.shiftright("h", 54))
    within = F.row_number().over(Window.partitionBy("part").orderBy("h", "point"))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("part").alias("_p"), before.alias("before"))
    return parts.withColumn("w", within).join(starts, F.col("part") == F.col("_p")).select("point", (F.col("before") + F.col("w") - 1).alias("turn"))
