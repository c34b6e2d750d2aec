"""Sub-pixel refinement by mixtures of neighbouring targets under any cost, and by interpolation in two directions.

A winner's targets, and those beside them, come from windows along rows (and
columns), so no cell is repeated or joined for its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions.affine import Share, Shares
from ocellus.operators.raster import CELL, width
from ocellus.operators.volumes import Cost, winner


def _minus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: p - q)


def _plus(x: Column, share: Column, step: Column) -> Column:
    return F.zip_with(x, step, lambda p, u: p + share * u)


def _beside(pair: DataFrame, cost: Cost, disparities: int) -> DataFrame:
    """The winner's target _own, the steps _up and _down from it to the targets on both sides, the way _gap from it to the source, and whether both sides are in the image."""
    along = Window.partitionBy("img", "i").orderBy("j")
    zero = F.transform("s", lambda v: F.lit(0.0))
    rows = pair.withColumn("w", width()).withColumns({f"_t{d + 1}": F.coalesce(F.lag("t", -d).over(along), zero) for d in range(-1, disparities + 1)})
    rows = rows.withColumns({"_ts": F.array(*[F.col(f"_t{d}") for d in range(disparities + 2)]), "costs": F.array(*[cost(F.col("s"), F.col(f"_t{d + 1}")) for d in range(disparities)])})
    r = winner(rows).withColumn("_own", F.get("_ts", F.col("d") + 1))
    partner = F.col("j") + F.col("d")
    r = r.withColumns({"_gap": _minus(F.col("s"), F.col("_own")), "_up": _minus(F.get("_ts", F.col("d") + 2), F.col("_own")), "_down": _minus(F.get("_ts", F.col("d")), F.col("_own"))})
    return r.select(*CELL, "s", "d", "_own", "_gap", "_up", "_down", ((partner >= 1) & (partner + 1 < F.col("w"))).alias("_inside"))


def one_sided(pair: DataFrame, cost: Cost, share: Share, disparities: int) -> DataFrame:
    """img, i, j, disparity: the winner moved towards one side by that share of the step which the sense of the cost asks for.

    A share counts between 0 and 1, and where the mixture costs less than the target alone and than the other side's.
    Targets at the image's border stay.
    """
    rows = _beside(pair, cost, disparities)
    rows = rows.withColumns({f"{n}_r": share(F.col("_gap"), F.col(n)) for n in ("_up", "_down")})
    price = lambda n: F.when((F.col(f"{n}_r") > 0) & (F.col(f"{n}_r") < 1), F.round(cost(F.col("s"), _plus(F.col("_own"), F.col(f"{n}_r"), F.col(n))), 9))
    rows = rows.withColumns({"_c": F.round(cost(F.col("s"), F.col("_own")), 9), "_up_c": price("_up"), "_down_c": price("_down")})
    up = F.coalesce(F.col("_up_c") < F.col("_c"), F.lit(False))
    down = F.coalesce(F.col("_down_c") < F.least("_c", "_up_c"), F.lit(False))
    move = F.when(down, -F.col("_down_r")).when(up, F.col("_up_r")).otherwise(0.0)
    return rows.select(*CELL, (F.col("d") + F.when(F.col("_inside"), move).otherwise(0.0)).alias("disparity"))


def two_sided(pair: DataFrame, cost: Cost, shares: Shares, disparities: int) -> DataFrame:
    """img, i, j, disparity: the winner moved by the share of the step up less that of the step down, if that is by less than 1. Targets at the image's border stay."""
    rows = _beside(pair, cost, disparities).withColumn("_s", shares(F.col("_gap"), F.col("_down"), F.col("_up")))
    move = F.col("_s.q") - F.col("_s.p")
    return rows.select(*CELL, (F.col("d") + F.when(F.col("_inside") & (F.abs(move) < 1), move).otherwise(0.0)).alias("disparity"))


def kernel_refined_2d(pair: DataFrame, winners: DataFrame, cost: Cost, kernel: Callable[[Column], Column], radius: int = 1, cut: int = 4) -> DataFrame:
    """img, i, j, y, x: winners (img, i, j, d1, d2) moved by the multiples of 1 / cut, less than 1 either way, at which the interpolated target costs least.

    The search is nested: the targets' lines are mixed once for each move along the columns, and these mixtures once for
    each move along the rows. Of equal ones the shortest move is taken, then the lesser. Targets within the kernel's
    radius of the border stay.
    """
    along, across = Window.partitionBy("img", "i").orderBy("j"), Window.partitionBy("img", "j").orderBy("i")
    line = F.array(*[F.lag("t", -p).over(along) for p in range(-radius, radius + 1)])
    block = F.array(*[F.lag("_line", -p).over(across) for p in range(-radius, radius + 1)])
    target = pair.withColumn("_line", line).select("img", F.col("i").alias("_i"), F.col("j").alias("_j"), block.alias("_block"))
    target = target.where(F.forall("_block", lambda x: x.isNotNull() & F.forall(x, lambda t: t.isNotNull())))
    asked = pair.select(*CELL, "s").join(winners.select(*CELL, "d1", "d2"), CELL).withColumns({"_i": F.col("i") + F.col("d1"), "_j": F.col("j") + F.col("d2")})
    rows = asked.join(target, ["img", "_i", "_j"], "left")

    def mixed(vectors: Callable[[int], Column], move: Column) -> Column:
        out = F.transform("s", lambda v: F.lit(0.0))
        for p in range(-radius, radius + 1):
            out = _plus(out, kernel(F.lit(float(p)) - move), vectors(p))
        return out

    moves = F.array(*[F.lit(k / cut) for k in range(1 - cut, cut)])
    at = lambda a, b: F.get(F.get("_block", F.lit(a + radius)), F.lit(b + radius))
    lines = F.transform(moves, lambda y: F.struct(y.alias("y"), F.array(*[mixed(lambda a, b=b: at(a, b), y) for b in range(-radius, radius + 1)]).alias("v")))

    def of_line(e: Column) -> Column:
        tried = F.transform(moves, lambda x: F.struct(F.round(cost(F.col("s"), mixed(lambda b: F.get(e["v"], F.lit(b + radius)), x)), 9).alias("cost"), (e["y"] * e["y"] + x * x).alias("size"), e["y"].alias("y"), x.alias("x")))
        return F.array_min(tried)

    rows = rows.withColumn("_lines", F.when(F.col("_block").isNotNull(), lines)).withColumn("_best", F.array_min(F.transform("_lines", of_line)))
    return rows.select(*CELL, (F.col("d1") + F.coalesce("_best.y", F.lit(0.0))).alias("y"), (F.col("d2") + F.coalesce("_best.x", F.lit(0.0))).alias("x"))
