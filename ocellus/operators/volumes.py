"""Cost volumes of image pairs and what is chosen from them.

A volume is an array column of costs, one for each disparity, beside each cell:
the target's features for all disparities come from one sort along the rows,
so no row is repeated and nothing is joined but the two images.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators.raster import CELL, average_pool, neighbourhood

Cost = Callable[[Column, Column], Column]


def feature_pair(source: DataFrame, target: DataFrame, ri: int = 1, rj: int = 1) -> DataFrame:
    """img, i, j, s, t: both images' windows around each cell that both have; 0 outside.

    Values are joined before windows are made of them, so only narrow rows are shuffled and sorted. The last sort is along
    rows and serves the search for disparities as well.
    """
    s, t = (x.select(*CELL, F.col("value").alias(n), F.lit(True).alias(f"_in_{n}")) for n, x in (("s", source), ("t", target)))
    return _windows(s.join(t, CELL, "full"), ri, rj)


def pair_of(cells: DataFrame, ri: int = 1, rj: int = 1) -> DataFrame:
    """feature_pair of two images whose values s and t lie beside each other: nothing is joined."""
    return _windows(cells.select(*CELL, "s", "t", F.lit(True).alias("_in_s"), F.lit(True).alias("_in_t")), ri, rj)


def _windows(rows: DataFrame, ri: int, rj: int) -> DataFrame:
    """rows: img, i, j, the values s and t, and _in_s and _in_t, whether the images have the cell."""
    across, along = Window.partitionBy("img", "j").orderBy("i"), Window.partitionBy("img", "i").orderBy("j")
    rows = rows.select(*CELL, "_in_s", "_in_t", *[F.col(n).cast("double").alias(f"_{n}") for n in "st"])

    def column(n: str) -> Column:
        """The values above and below a cell; those that this image lacks are outside."""
        at = lambda c, d: F.lag(c, -d).over(across) if d else F.col(c)
        return F.array(*[F.when(at(f"_in_{n}", d), at(f"_{n}", d)).otherwise(0.0) for d in range(-ri, ri + 1)])

    def window(n: str) -> Column:
        side = lambda d, k: F.coalesce(F.get(F.lag(f"_c{n}", -d).over(along), F.lit(k)), F.lit(0.0))
        return F.array(*[side(d, k) if d else F.get(f"_c{n}", F.lit(k)) for k in range(2 * ri + 1) for d in range(-rj, rj + 1)])

    rows = rows.select(*CELL, "_in_s", "_in_t", column("s").alias("_cs"), column("t").alias("_ct"))
    rows = rows.select(*CELL, "_in_s", "_in_t", window("s").alias("s"), window("t").alias("t"))
    return rows.where("_in_s AND _in_t").select(*CELL, "s", "t")


def cost_volume(pair: DataFrame, cost: Cost, disparities: int, sign: int = 1, offset: int = 0, truncate: bool = False) -> DataFrame:
    """Adds costs: of s(i, j) against t(i, j + sign * (d + offset)) for d from 0; outside t is a zero vector, or the cost null with truncate."""
    along = Window.partitionBy("img", "i").orderBy("j")
    zero = F.transform("t", lambda v: F.lit(0.0))
    rows = pair.withColumns({f"_t{d}": F.lag("t", -sign * (d + offset)).over(along) for d in range(disparities)})

    def one(d: int) -> Column:
        t = F.col(f"_t{d}")
        return F.when(t.isNotNull(), cost(F.col("s"), t)) if truncate else cost(F.col("s"), F.coalesce(t, zero))

    return rows.withColumn("costs", F.array(*[one(d) for d in range(disparities)])).select(*CELL, "costs")


def cost_volume_2d(pair: DataFrame, cost: Cost, di: tuple[int, int], dj: tuple[int, int]) -> DataFrame:
    """img, i, j, d1, d2, cost over a rectangle of shifts (ends included); zero vectors outside."""
    shifts = [(a, b) for a in range(di[0], di[1] + 1) for b in range(dj[0], dj[1] + 1)]
    asked = pair.select(*CELL, "s", F.explode(F.array(*[F.struct(F.lit(a).alias("d1"), F.lit(b).alias("d2")) for a, b in shifts])).alias("d"))
    asked = asked.select(*CELL, "s", "d.*", (F.col("i") + F.col("d.d1")).alias("_i"), (F.col("j") + F.col("d.d2")).alias("_j"))
    target = pair.select("img", F.col("i").alias("_i"), F.col("j").alias("_j"), "t")
    hit = asked.join(target, ["img", "_i", "_j"], "left")
    return hit.select(*CELL, "d1", "d2", cost(F.col("s"), F.coalesce(F.col("t"), F.transform("s", lambda v: F.lit(0.0)))).alias("cost"))


def winner(volume: DataFrame, score: bool = False) -> DataFrame:
    """Adds d, the place of the least cost (or greatest score); of equal ones the last."""
    best = F.array_max("costs") if score else F.array_min("costs")
    return volume.withColumn("d", (F.size("costs") - F.array_position(F.reverse("costs"), best)).cast("int"))


def winner_2d(volume: DataFrame) -> DataFrame:
    """img, i, j, d1, d2 of the least cost; of equal ones the last in order."""
    best = F.max_by(F.struct("d1", "d2"), F.struct(-F.col("cost"), "d1", "d2"))
    return volume.groupBy(*CELL).agg(best.alias("d")).select(*CELL, "d.*")


def disparity(volume: DataFrame, sign: int = 1, offset: int = 0) -> DataFrame:
    return winner(volume).select(*CELL, (sign * (F.col("d") + offset)).alias("disparity"))


def selected_cost(volume: DataFrame, score: bool = False) -> DataFrame:
    return winner(volume, score).select(*CELL, "d", F.get("costs", "d").alias("cost"))


def truncated(volume: DataFrame, r: int) -> DataFrame:
    """img, i, j, d, costs: the 2r+1 costs around the winner; null outside the volume."""
    w = winner(volume)
    around = F.array(*[F.when((F.col("d") + k >= 0) & (F.col("d") + k < F.size("costs")), F.get("costs", F.col("d") + k)) for k in range(-r, r + 1)])
    return w.select(*CELL, "d", around.alias("costs"))


def guided(cells: DataFrame, reference: DataFrame, r: int, spatial: Callable[[int, int], float], match: Cost) -> DataFrame:
    """Weighted means of value over windows; a place weighs spatial(di, dj) * match(reference there, at the centre)."""
    f = neighbourhood(cells, r, r, outside=None).select(*CELL, "f")
    g = neighbourhood(reference, r, r, out="g", outside=None).select(*CELL, "g", F.col("value").alias("_c"))
    rows = f.join(g, CELL)
    w = F.lit(0.0)
    s = F.lit(0.0)
    for k, (a, b) in enumerate((a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)):
        weight = F.when(F.get("g", F.lit(k)).isNotNull(), spatial(a, b) * match(F.get("g", F.lit(k)), F.col("_c"))).otherwise(0.0)
        w = w + weight
        s = s + weight * F.coalesce(F.get("f", F.lit(k)), F.lit(0.0))
    return rows.select(*CELL, F.try_divide(s, w).alias("value"))


def template(pair: DataFrame, pattern: list[float], cost: Cost, column: str = "s") -> DataFrame:
    """img, i, j, cost of one vector against each cell's."""
    return pair.select(*CELL, cost(F.col(column), F.array(*[F.lit(float(v)) for v in pattern])).alias("cost"))


def hierarchical(source: DataFrame, target: DataFrame, cost: Cost, levels: int, disparities: int, r: int = 1) -> DataFrame:
    """img, i, j, disparity: the coarsest level is searched in full, and each finer one within r of twice the coarser result."""
    pyramid = [(source, target)]
    for _ in range(levels - 1):
        pyramid.append(tuple(average_pool(x, 2) for x in pyramid[-1]))
    pair = feature_pair(*pyramid[-1])
    found = disparity(cost_volume(pair, cost, max(1, disparities >> (levels - 1))))
    for s, t in reversed(pyramid[:-1]):
        coarse = found.select("img", F.col("i").alias("_ci"), F.col("j").alias("_cj"), (2 * F.col("disparity")).alias("_g"))
        pair = feature_pair(s, t).withColumns({"_ci": F.floor(F.col("i") / 2).cast("int"), "_cj": F.floor(F.col("j") / 2).cast("int")})
        asked = pair.join(coarse, ["img", "_ci", "_cj"]).select(*CELL, "s", F.explode(F.array(*[F.greatest(F.col("_g") + k, F.lit(0)) for k in range(-r, r + 1)])).alias("d"))
        there = pair.select("img", "i", F.col("j").alias("_j"), "t")
        hit = asked.withColumn("_j", F.col("j") + F.col("d")).join(there, ["img", "i", "_j"], "left")
        value = cost(F.col("s"), F.coalesce(F.col("t"), F.transform("s", lambda v: F.lit(0.0))))
        found = hit.select(*CELL, "d", value.alias("cost")).groupBy(*CELL).agg(F.max_by("d", F.struct(-F.col("cost"), "d")).alias("disparity"))
    return found


def background_mask(frame: DataFrame, background: DataFrame, tolerance: int) -> DataFrame:
    """img, i, j, foreground: the frame's disparity differs from the background's by tolerance or more."""
    b = background.select(*CELL, F.col("disparity").alias("_b"))
    return frame.join(b, CELL).select(*CELL, (F.abs(F.col("disparity") - F.col("_b")) >= tolerance).alias("foreground"))


def barycentric(pair: DataFrame, cost: Cost, disparities: int) -> DataFrame:
    """img, i, j, disparity: the winner, moved towards the neighbour on either side by the share of the two targets' mix that is nearest to the source, if that lies between them and is nearer than the winner alone. Winners at the range's ends stay."""
    along = Window.partitionBy("img", "i").orderBy("j")
    zero = F.transform("t", lambda v: F.lit(0.0))
    volume = pair.withColumns({f"_t{d}": F.coalesce(F.lag("t", -d).over(along), zero) for d in range(disparities)})
    volume = volume.withColumns({"ts": F.array(*[F.col(f"_t{d}") for d in range(disparities)]), "costs": F.array(*[cost(F.col("s"), F.col(f"_t{d}")) for d in range(disparities)])})
    w = winner(volume).withColumns({"a": F.get("ts", F.col("d")), "up": F.get("ts", F.col("d") + 1), "down": F.get("ts", F.col("d") - 1)})

    def against(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    def minus(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda p, q: p - q)

    gap = minus(F.col("s"), F.col("a"))
    for side in ("up", "down"):
        step = minus(F.col(side), F.col("a"))
        w = w.withColumns({f"{side}_p": against(gap, step), f"{side}_q": against(step, step)})
    for side in ("up", "down"):
        share = F.try_divide(F.col(f"{side}_p"), F.col(f"{side}_q"))
        w = w.withColumn(f"{side}_a", F.when((share > 0) & (share < 1), share)).withColumn(f"{side}_g", F.coalesce(F.col(f"{side}_a") * F.col(f"{side}_p"), F.lit(0.0)))
    inside = (F.col("d") > 0) & (F.col("d") < disparities - 1)
    moved = F.when(F.round("up_g", 6) >= F.round("down_g", 6), F.coalesce("up_a", F.lit(0.0))).otherwise(-F.coalesce("down_a", F.lit(0.0)))
    return w.select(*CELL, (F.col("d") + F.when(inside, moved).otherwise(0.0)).alias("disparity"))


def accuracy(found: DataFrame, truth: DataFrame | Column, within: float) -> DataFrame:
    """img, n, mae, rmse, snr (decibels) of disparities within a bound of the truth, and the share of such inliers. A truth that is a column of found is not joined."""
    known = found.withColumn("_t", truth) if isinstance(truth, Column) else found.join(truth.select(*CELL, F.col("disparity").alias("_t")), CELL)
    e = known.withColumn("_e", F.col("disparity") - F.col("_t"))
    inlier = F.abs("_e") <= within
    own = [F.avg(F.when(inlier, F.abs("_e"))).alias("mae"), F.sqrt(F.avg(F.when(inlier, F.col("_e") * F.col("_e")))).alias("rmse")]
    power = F.avg(F.when(inlier, F.col("_t") * F.col("_t")))
    snr = 10 * F.log10(F.try_divide(power, F.avg(F.when(inlier, F.col("_e") * F.col("_e")))))
    return e.groupBy("img").agg(F.count_if(inlier).alias("n"), *own, snr.alias("snr"), F.avg(F.when(inlier, 1.0).otherwise(0.0)).alias("share"))
