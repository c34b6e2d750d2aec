"""Histograms, thresholds and order statistics of rasters, by image."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bounds(cells: DataFrame) -> DataFrame:
    return cells.groupBy("img").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def integer_histogram(cells: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """img, bin, n over the data's range, or a given one into which values are clamped; empty bins too."""
    b = _bounds(cells)
    if lo is not None and hi is not None:
        b = b.select("img", F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    bins = b.select("img", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("hi") - F.col("lo")).cast("bigint"))).alias("bin"))
    own = cells.join(b, "img").select("img", (F.least(F.greatest("value", "lo"), "hi") - F.col("lo")).cast("bigint").alias("bin"))
    counts = own.groupBy("img", "bin").agg(F.count("*").alias("n"))
    return bins.join(counts, ["img", "bin"], "left").select("img", "bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def float_histogram(cells: DataFrame, n: int) -> DataFrame:
    """img, bin, n, lo, hi: equal bins over the data's range, the greatest value in the last."""
    b = _bounds(cells)
    share = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    own = cells.join(b, "img").select("img", F.coalesce(F.least(F.floor(share * n), F.lit(n - 1)), F.lit(0)).cast("bigint").alias("bin"))
    counts = own.groupBy("img", "bin").agg(F.count("*").alias("n"))
    bins = b.select("img", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("bin"))
    return bins.join(counts, ["img", "bin"], "left").select("img", "bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "lo", "hi")


def summary(histogram: DataFrame) -> DataFrame:
    """img, total, and the sum of squared counts."""
    return histogram.groupBy("img").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("entropy"))


def otsu(histogram: DataFrame) -> DataFrame:
    """img and the lower bound of the class above the split of greatest between-class variance, the first of equal ones."""
    own = Window.partitionBy("img")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram.withColumns({"n0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col("bin")).over(upto), "nt": F.sum("n").over(own), "st": F.sum(F.col("n") * F.col("bin")).over(own), "bins": F.count("*").over(own)})
    n1 = F.col("nt") - F.col("n0")
    gap = F.try_divide(F.col("s0"), F.col("n0")) - F.try_divide(F.col("st") - F.col("s0"), n1)
    variance = F.coalesce(F.col("n0").cast("double") * n1 * gap * gap, F.lit(0.0))
    at = F.max_by(F.struct("bin", "lo", "hi", "bins"), F.struct(F.round(variance, 3), -F.col("bin")))
    return h.groupBy("img").agg(at.alias("t")).select("img", (F.col("t.lo") + (F.col("t.bin") + 1) * (F.col("t.hi") - F.col("t.lo")) / F.col("t.bins")).alias("threshold"))


def balanced_threshold(histogram: DataFrame) -> DataFrame:
    """img and the bin where, dropping the end bin of the heavier side in turn, both sides meet."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf.sort_values("bin")["n"].to_numpy()
        lo, hi = 0, len(n) - 1
        mid = (lo + hi) // 2
        left, right = n[: mid + 1].sum(), n[mid + 1 :].sum()
        while lo < hi:
            if right > left:
                right -= n[hi]
                hi -= 1
                if (lo + hi) // 2 < mid:
                    right, left = right + n[mid], left - n[mid]
                    mid -= 1
            else:
                left -= n[lo]
                lo += 1
                if (lo + hi) // 2 >= mid and mid + 1 <= hi:
                    left, right = left + n[mid + 1], right - n[mid + 1]
                    mid += 1
        return pd.DataFrame({"img": [pdf["img"].iloc[0]], "bin": [mid]})

    return histogram.groupBy("img").applyInPandas(run, "img int, bin long")


#: Buckets of an image's range of values, of which one is looked into.
BUCKETS = 4096


def order_statistics(cells: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """img and, for each name, the value of a rank (from 0, a function of the image's number of cells); null beyond the ends.

    Counts of buckets, summed on the cells' side, tell which bucket a rank falls in; only that bucket's distinct values are
    counted one by one. An image is never sorted by one task.
    """
    ends = cells.groupBy("img").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    share = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    placed = cells.select("img", value).join(ends, "img").select("img", F.col(value).alias("_v"), F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).alias("_b"))
    counts = placed.groupBy("img", "_b").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("img").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = ends.select("img", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).alias("k")) for name, rank in ranks.items()])).alias("_r")).select("img", "_r.*")
    at = counts.withColumn("_before", before).join(asked, "img").where((F.col("k") >= F.col("_before")) & (F.col("k") < F.col("_before") + F.col("_c")))
    inside = placed.join(at.select("img", "_b", "name", (F.col("k") - F.col("_before")).alias("k")), ["img", "_b"]).groupBy("img", "name", "k", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("img", "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_upto", upto).where(F.col("_upto") > F.col("k")).groupBy("img").pivot("name", list(ranks)).agg(F.min("_v"))
    return ends.select("img").join(found, "img", "left")


def percentile_stretch(cells: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Values between two order statistics of the image, scaled to 0 and 1 and clamped."""
    ends = order_statistics(cells, "value", {c: (lambda n, q=q: F.floor(F.lit(q) * n).cast("long")) for q, c in ((low, "lo"), (high, "hi"))})
    scaled = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return cells.join(ends, "img").select("img", "i", "j", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)).alias("value"))


def weighted_median(rows: DataFrame) -> DataFrame:
    """g and the first v whose cumulated weight w exceeds half the group's. Equal values are summed first."""
    sums = rows.groupBy("g", "v").agg(F.sum("w").alias("w"))
    own = Window.partitionBy("g")
    cum = sums.withColumns({"c": F.sum("w").over(own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "t": F.sum("w").over(own)})
    return cum.where(2 * F.col("c") > F.col("t")).groupBy("g").agg(F.min("v").alias("median"))
