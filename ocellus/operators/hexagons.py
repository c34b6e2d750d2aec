"""Hexagonal colour targets: six dots on an ellipse, one of a main colour, the others' two colours read in order as bits.

Dots are components of what is dark or coloured. Six dots are a target if each
of them has the same five as its nearest: that is agreed on, not grown from one
dot after another, so the result does not depend on an order of dots.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators.graphs import mask_components
from ocellus.operators.raster import CELL, sizes

COLOURS = ("r", "g", "b")


def dots(cells: DataFrame, dark: float, coloured: float, least: int = 10, most: int = 800, roundness: float = 0.6, full: bool = True) -> DataFrame:
    """img, label, n, y, x and mean r, g, b of components of cells (img, i, j, r, g, b) with a channel of dark at most, or channels coloured apart or more.

    Kept are those of least to most cells whose minor axis is roundness of the major one or more.
    """
    low, high = F.least(*COLOURS), F.greatest(*COLOURS)
    chosen = cells.where((low <= dark) | (high - low >= coloured))
    held = mask_components(chosen.select(*CELL), full).join(chosen.select(*[F.col(c).alias(c) for c in (*CELL, *COLOURS)]), CELL)
    own = held.groupBy("img", "label").agg(
        F.count("*").alias("n"), F.avg("i").alias("y"), F.avg("j").alias("x"), F.var_pop("i").alias("_yy"), F.var_pop("j").alias("_xx"), F.covar_pop("i", "j").alias("_xy"), *[F.avg(c).alias(c) for c in COLOURS],
    )
    middle = (F.col("_yy") + F.col("_xx")) / 2
    reach = F.sqrt((F.col("_yy") - F.col("_xx")) * (F.col("_yy") - F.col("_xx")) / 4 + F.col("_xy") * F.col("_xy"))
    # Axes are as the roots of the variances along them.
    round_enough = F.greatest(middle - reach, F.lit(0.0)) >= roundness * roundness * (middle + reach)
    return own.where(F.col("n").between(least, most) & round_enough).select("img", "label", "n", "y", "x", *COLOURS)


def sixes(found: DataFrame, reach: float) -> DataFrame:
    """img, six, label: dots whose five nearest within reach (of equal ones those of lesser labels) are each other's; six is the least label."""
    cell = lambda c: F.floor(F.col(c) / reach)
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    p = found.select("img", "label", "y", "x", around.alias("s")).withColumns({"_i": cell("y") + F.col("s.a"), "_j": cell("x") + F.col("s.b")}).alias("p")
    q = found.select("img", F.col("label").alias("other"), F.col("y").alias("oy"), F.col("x").alias("ox")).withColumns({"_i": cell("oy"), "_j": cell("ox")}).alias("q")
    near = p.join(q, (F.col("p.img") == F.col("q.img")) & (F.col("p._i") == F.col("q._i")) & (F.col("p._j") == F.col("q._j")) & (F.col("label") != F.col("other")))
    d2 = F.round((F.col("oy") - F.col("y")) * (F.col("oy") - F.col("y")) + (F.col("ox") - F.col("x")) * (F.col("ox") - F.col("x")), 6)
    ranked = near.select(F.col("p.img").alias("img"), "label", "other", d2.alias("d2")).where(F.col("d2") <= reach * reach)
    ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy("img", "label").orderBy("d2", "other"))).where("k <= 5")
    sets = ranked.groupBy("img", "label").agg(F.array_sort(F.array_append(F.collect_list("other"), F.first("label"))).alias("six")).where(F.size("six") == 6)
    agreed = sets.groupBy("img", "six").agg(F.count("*").alias("n")).where("n = 6")
    return agreed.select("img", F.get("six", F.lit(0)).alias("six"), F.explode("six").alias("label"))


def _solved(m: list[list[Column]], v: list[Column]) -> list[Column]:
    """x of a symmetric system of three, by cofactors; null where it has none."""

    def det(a: list[list[Column]]) -> Column:
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    whole = det(m)
    return [F.try_divide(det([[v[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]), whole) for k in range(3)]


def on_ellipses(members: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """The rows of members (img, six, y, x and others) with cy and cx, their six's centre, where the six lie on an ellipse around it to within tolerance."""
    w = Window.partitionBy("img", "six")
    rows = members.withColumns({"cy": F.avg("y").over(w), "cx": F.avg("x").over(w)})
    u, v = F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
    rows = rows.withColumns({"_a0": u * u, "_a1": u * v, "_a2": v * v})
    sums = {f"_m{r}{c}": F.sum(F.col(f"_a{r}") * F.col(f"_a{c}")).over(w) for r in range(3) for c in range(r, 3)} | {f"_v{r}": F.sum(f"_a{r}").over(w) for r in range(3)}
    rows = rows.withColumns(sums)
    m = [[F.col(f"_m{min(r, c)}{max(r, c)}") for c in range(3)] for r in range(3)]
    rows = rows.withColumns({f"_p{k}": x for k, x in enumerate(_solved(m, [F.col(f"_v{r}") for r in range(3)]))})
    off = F.abs(F.col("_p0") * F.col("_a0") + F.col("_p1") * F.col("_a1") + F.col("_p2") * F.col("_a2") - 1)
    rows = rows.withColumn("_off", F.max(off).over(w))
    ellipse = (F.col("_p0") > 0) & (4 * F.col("_p0") * F.col("_p2") > F.col("_p1") * F.col("_p1"))
    return rows.where((F.col("_off") <= tolerance) & ellipse).select(*members.columns, "cy", "cx")


def hexagons(cells: DataFrame, dark: float, coloured: float, reach: float, main: str = "b", positive: str = "r", gains: tuple[float, float, float] = (1.0, 1.0, 1.0), tolerance: float = 0.1, **options) -> DataFrame:
    """img, six, y, x of the main dot, bits, and dots: the other five in order (y, x, positive).

    A dot's colour is that of its greatest mean channel after gains (of equal ones blue before green before red). Order
    is by angle from the main dot on, from the axis of columns towards that of rows; the first dot is bits' lowest bit.
    """
    if main == positive or main not in COLOURS or positive not in COLOURS:
        raise ValueError("the main and the positive colour are two of r, g and b")
    found = dots(cells, dark, coloured, **options)
    told = sixes(found, reach).join(found, ["img", "label"])
    r, g, b = (F.col(c) * k for c, k in zip(COLOURS, gains, strict=True))
    colour = F.when((r > g) & (r > b), "r").when(g > b, "g").otherwise("b")
    rows = on_ellipses(told.withColumn("colour", colour), tolerance)
    w = Window.partitionBy("img", "six")
    angle = F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))
    rows = rows.withColumns({"_mains": F.count_if(F.col("colour") == main).over(w), "_angle": angle}).where("_mains = 1")
    rows = rows.withColumn("_from", F.max(F.when(F.col("colour") == main, F.col("_angle"))).over(w))
    rows = rows.withColumn("_turn", F.when(F.col("colour") == main, 0.0).otherwise(F.col("_angle") - F.col("_from") + F.when(F.col("_angle") < F.col("_from"), 2 * math.pi).otherwise(0.0)))
    listed = F.array_sort(F.collect_list(F.struct("_turn", "label", "y", "x", (F.col("colour") == positive).alias("positive"))))
    out = rows.groupBy("img", "six").agg(listed.alias("all"))
    bits = F.aggregate(F.transform(F.slice("all", 2, 5), lambda d, k: F.when(d["positive"], F.get(F.array(*[F.lit(1 << b) for b in range(5)]), k)).otherwise(0)), F.lit(0), lambda acc, v: acc + v)
    others = F.transform(F.slice("all", 2, 5), lambda d: F.struct(d["y"].alias("y"), d["x"].alias("x"), d["positive"].alias("positive")))
    return out.select("img", "six", F.get("all", F.lit(0))["y"].alias("y"), F.get("all", F.lit(0))["x"].alias("x"), bits.cast("int").alias("bits"), others.alias("dots"))


def reach_of(cells: DataFrame, share: float = 0.2) -> float:
    """The greatest distance within a target: a share of the largest side of any image."""
    side = sizes(cells).agg(F.max(F.greatest("h", "w"))).first()[0]
    return share * float(side or 1)
