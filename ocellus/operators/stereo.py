"""Slices of cost volumes around their winners, refinements over several lines or images, and growth over a background."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions.refine import parabola
from ocellus.operators.graphs import mask_components
from ocellus.operators.iteration import Step
from ocellus.operators.raster import CELL, height, neighbourhood, width
from ocellus.operators.volumes import Cost, winner

DIRECTIONS = ("same", "reversed", "both")


def _slots(r: int, direction: str) -> list[tuple[int, bool]]:
    """Steps from the winner and whether each goes along the other image's line, in the order of the slice."""
    if direction not in DIRECTIONS:
        raise ValueError(f"no direction {direction}")
    out = []
    for k in range(-r, r + 1):
        if direction != "reversed" or k == 0 and direction == "both":
            out.append((k, False))
        if direction == "reversed" or direction == "both" and k:
            out.append((k, True))
    return out


def _inside(k: int, other: bool, sign: int, h: int) -> Column:
    """Whether the window of radius h along the line around a slot's place, and around its partner, lies in the image."""
    p = F.col("d") + k
    if other:
        jp = F.col("j") - sign * k
        return (p >= 0) & (p < F.col("_n")) & (F.least(jp, F.col("j")) >= h) & (F.greatest(jp, F.col("j")) + h < F.col("_w"))
    partner = F.col("j") + p
    return (p >= 0) & (p < F.col("_n")) & (F.col("j") >= h) & (partner + h < F.col("_w"))


def _sized(volume: DataFrame) -> DataFrame:
    return winner(volume).withColumns({"_n": F.size("costs"), "_w": width()})


def _upright(rows: DataFrame, v: int) -> DataFrame:
    """Adds _rows: whether the window of radius v across the lines lies in the image. Asked last, when a cell's row is narrow."""
    return rows.withColumn("_rows", (F.col("i") >= v) & (F.col("i") + v < height()) if v else F.lit(True))


def slices(volume: DataFrame, r: int, direction: str = "same", h: int = 0, v: int = 0, sign: int = 1) -> DataFrame:
    """img, i, j, d, costs: the costs around the winner along its own line of the volume, along the other image's, or both in turn (2r+1, 2r+1 or 4r+1); null where a window would leave the image."""
    along = Window.partitionBy("img", "i").orderBy("j")
    rows = _sized(volume).withColumns({f"_c{k + r}": F.lag("costs", sign * k).over(along) for k in range(-r, r + 1) if k})

    def slot(k: int, other: bool) -> Column:
        costs = F.col(f"_c{k + r}") if other and k else F.col("costs")
        return F.when(_inside(k, other, sign, h), F.get(costs, F.col("d") + k))

    rows = _upright(rows.select(*CELL, "d", F.array(*[slot(k, o) for k, o in _slots(r, direction)]).alias("costs")), v)
    return rows.select(*CELL, "d", F.transform("costs", lambda c: F.when(F.col("_rows"), c)).alias("costs"))


def in_bounds(volume: DataFrame, r: int, direction: str = "same", h: int = 0, v: int = 0, sign: int = 1) -> DataFrame:
    """img, i, j, d, inside: for each slot of slices(), whether it holds a cost."""
    rows = _sized(volume)
    rows = _upright(rows.select(*CELL, "d", F.array(*[F.coalesce(_inside(k, o, sign, h), F.lit(False)) for k, o in _slots(r, direction)]).alias("inside")), v)
    return rows.select(*CELL, "d", F.transform("inside", lambda c: c & F.col("_rows")).alias("inside"))


def patches_2d(volume: DataFrame) -> DataFrame:
    """img, i, j, d1, d2, f: the winner of a volume with two shifts and the nine costs around it, row by row; null outside the search range."""
    best = F.max_by(F.struct("d1", "d2"), F.struct(-F.col("cost"), "d1", "d2"))
    costs = F.map_from_entries(F.collect_list(F.struct(F.struct(F.col("d1").alias("a"), F.col("d2").alias("b")), "cost")))
    rows = volume.groupBy(*CELL).agg(best.alias("_d"), costs.alias("_m")).select(*CELL, "_d.*", "_m")
    around = [F.try_element_at("_m", F.struct((F.col("d1") + a).alias("a"), (F.col("d2") + b).alias("b"))) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return rows.select(*CELL, "d1", "d2", F.array(*around).alias("f"))


def refine_2d(volume: DataFrame, kernel: Callable[[Column, Column, Column], Column] = parabola, isotropic: bool = True) -> DataFrame:
    """img, i, j, y, x: the winner's shifts refined. Isotropic: along each axis by itself. Else the lines of least cost along either axis, fitted through three rows and three columns, are crossed. Moves beyond 1, or without a patch, are none."""
    p = patches_2d(volume)
    at = lambda a, b: F.get("f", F.lit((a + 1) * 3 + b + 1))
    own = kernel(at(-1, 0), at(0, 0), at(1, 0)), kernel(at(0, -1), at(0, 0), at(0, 1))
    if isotropic:
        dy, dx = own
    else:

        def line(entry: Callable[[int, int], Column], middle: Column) -> tuple[Column, Column]:
            """Slope and height of the line of least costs across three lines; one whose least cost is at an end counts as the middle one."""
            side = {}
            for k in (-1, 1):
                lo, mid, hi = entry(-1, k), entry(0, k), entry(1, k)
                side[k] = F.when((mid <= lo) & (mid < hi), kernel(lo, mid, hi)).otherwise(middle)
            return (side[1] - side[-1]) / 2, (side[-1] + middle + side[1]) / 3

        a0, b0 = line(at, own[0])
        a1, b1 = line(lambda a, b: at(b, a), own[1])
        dy, dx = F.try_divide(a0 * b1 + b0, 1 - a0 * a1), F.try_divide(a1 * b0 + b1, 1 - a0 * a1)
    whole = F.forall("f", lambda c: c.isNotNull())
    moved = p.withColumns({"_y": F.when(whole, dy), "_x": F.when(whole, dx)})
    keep = (F.abs("_y") <= 1) & (F.abs("_x") <= 1)
    return moved.select(*CELL, *[(F.col(d) + F.when(keep, F.col(m)).otherwise(0.0)).alias(n) for d, m, n in (("d1", "_y", "y"), ("d2", "_x", "x"))])


def cost_symmetric(pair: DataFrame, cost: Cost, disparities: int) -> DataFrame:
    """img, i, j, disparity: the mean of the parabola through the winner's costs and of one through the costs of the source half a cell further on, towards the parabola's vertex."""
    along = Window.partitionBy("img", "i").orderBy("j")
    zero = F.transform("t", lambda v: F.lit(0.0))
    rows = pair.withColumn("w", width()).withColumns({f"_t{d}": F.coalesce(F.lag("t", -d).over(along), zero) for d in range(disparities)})
    rows = rows.withColumns({"_before": F.lag("s", 1).over(along), "_after": F.lag("s", -1).over(along)})
    rows = rows.withColumns({"_ts": F.array(*[F.col(f"_t{d}") for d in range(disparities)]), "costs": F.array(*[cost(F.col("s"), F.col(f"_t{d}")) for d in range(disparities)])})
    r = winner(rows)
    around = {k: F.get("_ts", F.col("d") + k) for k in (-1, 0, 1)}
    possible = (F.col("j") > 1) & (F.col("j") + 1 < F.col("w")) & (F.col("d") > 0) & (F.col("d") + 1 < disparities)
    r = r.withColumn("_one", F.when(possible, parabola(*[F.get("costs", F.col("d") + k) for k in (-1, 0, 1)])))
    towards = F.when(F.col("_one") > 0, F.col("_before")).otherwise(F.col("_after"))
    r = r.withColumn("_half", F.zip_with("s", towards, lambda x, y: (x + y) / 2))
    shift = F.when(F.col("_one") > 0, 0.5).otherwise(-0.5)
    c = [cost(F.col("_half"), around[k]) for k in (-1, 0, 1)]
    second = F.try_divide(c[0] - c[2], 2 * (c[2] - 2 * c[1] + c[0])) + shift
    partner = F.col("j") + F.col("d")
    r = r.withColumn("_two", F.when(F.col("_one").isNotNull() & (partner + 1 < F.col("w")) & (partner > 1), second))
    moved = F.when(F.abs("_two") < 1, (F.col("_one") + F.col("_two")) / 2).otherwise(F.col("_one"))
    return r.select(*CELL, (F.col("d") + F.coalesce(moved, F.lit(0.0))).alias("disparity"))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def _minus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: p - q)


def _two_shares(rows: DataFrame, gap: str, one: str, two: str, name: str) -> DataFrame:
    """Adds name_p, name_q and name_g: the shares of two steps whose sum is nearest to gap, and by how much that lessens its squared length; null where the steps are along one line."""
    for n, (a, b) in {"pp": (one, one), "pq": (one, two), "qq": (two, two), "gp": (gap, one), "gq": (gap, two)}.items():
        rows = rows.withColumn(f"_{n}", _dot(F.col(a), F.col(b)))
    det = F.col("_pp") * F.col("_qq") - F.col("_pq") * F.col("_pq")
    p = F.try_divide(F.col("_gp") * F.col("_qq") - F.col("_gq") * F.col("_pq"), det)
    q = F.try_divide(F.col("_gq") * F.col("_pp") - F.col("_gp") * F.col("_pq"), det)
    rows = rows.withColumns({f"{name}_p": p, f"{name}_q": q})
    return rows.withColumn(f"{name}_g", F.col(f"{name}_p") * F.col("_gp") + F.col(f"{name}_q") * F.col("_gq")).drop("_pp", "_pq", "_qq", "_gp", "_gq")


def barycentric_symmetric(pair: DataFrame, cost: Cost, disparities: int) -> DataFrame:
    """img, i, j, disparity: the winner moved by the mix, with shares that sum to 1, of the targets at it and on both sides that is nearest to the source, if that is by less than 1. Winners at the range's ends, and whose neighbours leave the image, stay."""
    along = Window.partitionBy("img", "i").orderBy("j")
    zero = F.transform("t", lambda v: F.lit(0.0))
    rows = pair.withColumn("w", width()).withColumns({f"_t{d}": F.coalesce(F.lag("t", -d).over(along), zero) for d in range(disparities)})
    rows = rows.withColumns({"_ts": F.array(*[F.col(f"_t{d}") for d in range(disparities)]), "costs": F.array(*[cost(F.col("s"), F.col(f"_t{d}")) for d in range(disparities)])})
    r = winner(rows).withColumn("_own", F.get("_ts", F.col("d")))
    r = r.withColumns({"_gap": _minus(F.col("s"), F.col("_own")), "_down": _minus(F.get("_ts", F.col("d") - 1), F.col("_own")), "_up": _minus(F.get("_ts", F.col("d") + 1), F.col("_own"))})
    r = _two_shares(r, "_gap", "_down", "_up", "_m").withColumn("_move", F.col("_m_q") - F.col("_m_p"))
    partner = F.col("j") + F.col("d")
    possible = (F.col("d") > 0) & (F.col("d") + 1 < disparities) & (F.col("j") + 1 < F.col("w")) & (partner >= 1) & (partner + 1 < F.col("w"))
    return r.select(*CELL, (F.col("d") + F.when(possible & (F.abs("_move") < 1), F.col("_move")).otherwise(0.0)).alias("disparity"))


def barycentric_2d(pair: DataFrame, winners: DataFrame) -> DataFrame:
    """img, i, j, y, x: winners (img, i, j, d1, d2) moved, in the quadrant that comes nearest to the source, by the mix of the target there and of its two neighbours on the quadrant's axes; shares sum to 1, moves are 1 at most. Targets on the border stay."""
    along, across = Window.partitionBy("img", "i").orderBy("j"), Window.partitionBy("img", "j").orderBy("i")
    steps = {"up": F.lag("t", 1).over(across), "down": F.lag("t", -1).over(across), "left": F.lag("t", 1).over(along), "right": F.lag("t", -1).over(along)}
    target = pair.withColumns({f"_{n}": c for n, c in steps.items()})
    target = target.select("img", F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("t").alias("_own"), *[_minus(F.col(f"_{n}"), F.col("t")).alias(f"_{n}") for n in steps])
    asked = pair.select(*CELL, "s").join(winners, CELL).withColumns({"_i": F.col("i") + F.col("d1"), "_j": F.col("j") + F.col("d2")})
    rows = asked.join(target, ["img", "_i", "_j"], "left").withColumn("_gap", _minus(F.col("s"), F.col("_own")))
    options = []
    for n, (v, h, dy, dx) in enumerate((("_down", "_right", 1, 1), ("_down", "_left", 1, -1), ("_up", "_right", -1, 1), ("_up", "_left", -1, -1))):
        rows = _two_shares(rows, "_gap", v, h, f"_m{n}")
        y, x, gain = F.col(f"_m{n}_p") * dy, F.col(f"_m{n}_q") * dx, F.round(f"_m{n}_g", 6)
        options.append(F.when((F.abs(y) <= 1) & (F.abs(x) <= 1) & (gain > 0), F.struct(gain.alias("gain"), F.lit(-n).alias("first"), y.alias("y"), x.alias("x"))))
    whole = F.col("_up").isNotNull() & F.col("_down").isNotNull() & F.col("_left").isNotNull() & F.col("_right").isNotNull()
    best = F.when(whole, F.array_max(F.array(*options)))
    return rows.withColumn("_best", best).select(*CELL, (F.col("d1") + F.coalesce(F.col("_best.y"), F.lit(0.0))).alias("y"), (F.col("d2") + F.coalesce(F.col("_best.x"), F.lit(0.0))).alias("x"))


def _added(x: Column, y: Column, weight: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: p + weight * q)


def kernel_refined(pair: DataFrame, cost: Cost, disparities: int, kernel: Callable[[Column], Column], radius: int = 1, cut: int = 10) -> DataFrame:
    """img, i, j, disparity: the winner moved by the multiple of 1 / cut, less than 1 either way, at which the target's line, interpolated by a kernel of that radius, costs least; of equal ones the shortest move, then the lower. Targets on the border stay."""
    along = Window.partitionBy("img", "i").orderBy("j")
    zero = F.transform("t", lambda v: F.lit(0.0))
    rows = pair.withColumn("w", width()).withColumns({f"_t{d}": F.coalesce(F.lag("t", -d).over(along), zero) for d in range(-radius, disparities + radius)})
    rows = rows.withColumns({"_ts": F.array(*[F.col(f"_t{d}") for d in range(-radius, disparities + radius)]), "costs": F.array(*[cost(F.col("s"), F.col(f"_t{d}")) for d in range(disparities)])})
    r = winner(rows)

    def at(move: Column) -> Column:
        out = F.transform("t", lambda v: F.lit(0.0))
        for p in range(-radius, radius + 1):
            out = _added(out, F.get("_ts", F.col("d") + p + radius), kernel(F.lit(float(p)) - move))
        return out

    moves = F.transform(F.sequence(F.lit(1 - cut), F.lit(cut - 1)), lambda k: k / F.lit(float(cut)))
    tried = F.transform(moves, lambda m: F.struct(F.round(cost(F.col("s"), at(m)), 9).alias("cost"), F.abs(m).alias("size"), m.alias("move")))
    partner = F.col("j") + F.col("d")
    possible = (partner >= 1) & (partner + 1 < F.col("w"))
    return r.select(*CELL, (F.col("d") + F.when(possible, F.array_min(tried)["move"]).otherwise(0.0)).alias("disparity"))


def background_growth(frame: DataFrame, background: DataFrame, tolerance: int, ratio: float) -> DataFrame:
    """img, i, j, disparity, foreground of a frame's volume against a background's.

    A cell is compared where its cost at the background's disparity has changed (the lesser over the greater cost is at
    most ratio), and from each found foreground on to its eight neighbours. Compared, it is foreground if its disparity
    is tolerance or more off. What is never compared keeps the background's disparity.
    """
    b = winner(background).select(*CELL, F.col("d").alias("_b"), F.get("costs", "d").alias("_cb"))
    rows = winner(frame).join(b, CELL).withColumn("_cf", F.get("costs", "_b"))
    changed = F.col("_cf").isNotNull() & ~(F.coalesce(F.try_divide(F.least("_cb", "_cf"), F.greatest("_cb", "_cf")), F.lit(0.0)) > ratio)
    # Written once: both volumes would be made again for each use of the cells in a search of components.
    rows = Step(rows.select(*CELL, "d", "_b", changed.alias("_seed"), (F.abs(F.col("d") - F.col("_b")) >= tolerance).alias("_off"))).read()
    groups = mask_components(rows.where("_off"), full=True)
    grown = groups.join(rows.where("_seed AND _off").select(*CELL), CELL).select("img", "label").distinct().withColumn("_grown", F.lit(True))
    marked = rows.join(groups.join(grown, ["img", "label"]).select(*CELL, "_grown"), CELL, "left").withColumn("foreground", F.coalesce("_grown", F.lit(False)))
    near = neighbourhood(marked.withColumn("_v", F.col("foreground").cast("double")), 1, 1, value="_v", out="_f")
    seen = F.col("_seed") | (F.array_max("_f") > 0)
    return near.select(*CELL, F.when(seen, F.col("d")).otherwise(F.col("_b")).alias("disparity"), "foreground")
