"""Checkerboards in images: saddle corners, their filter, places between cells, and the grids that they stand in.

A grid grows over a graph of corners, not from one corner after another. Each
corner finds the steps to its neighbours by itself: the nearest corner of
crossed direction is a first step, the nearest one across it a second, and the
corners next to all four predicted places are its neighbours, if they see it
too. Each neighbour link turns one corner's own frame (two steps and a place)
into the other's, a quarter turn and a shift, so frames are added up along
links, with pointer jumping, until every corner of a board has its place in the
frame of the least one; rounds grow as the logarithm of a board's length.

Angles are in the plane (j, i): from the axis of columns towards that of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators.iteration import Step
from ocellus.operators.raster import CELL, neighbourhood, sizes, weighted

#: Centres of the eight sections around a corner, in opposite pairs.
SECTIONS = [(2, 2), (-2, -2), (0, 2), (0, -2), (-2, 2), (2, -2), (2, 0), (-2, 0)]
#: Images and rows in a corner's number.
IMG, ROW = 1 << 40, 1 << 20


def saddles(cells: DataFrame) -> DataFrame:
    """img, i, j, value, lo, hi, direction: determinant and eigenvalues of the second differences, and the angle of the axis of most curvature."""
    f = neighbourhood(cells, 1, 1)
    h = f.select(*CELL, weighted("f", [0, 1, 0, 0, -2, 0, 0, 1, 0]).alias("yy"), weighted("f", [0, 0, 0, 1, -2, 1, 0, 0, 0]).alias("xx"), weighted("f", [0.25, 0, -0.25, 0, 0, 0, -0.25, 0, 0.25]).alias("xy"))
    mean, half = (F.col("xx") + F.col("yy")) / 2, (F.col("xx") - F.col("yy")) / 2
    root = F.sqrt(half * half + F.col("xy") * F.col("xy"))
    return h.select(*CELL, (F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")).alias("value"), (mean - root).alias("lo"), (mean + root).alias("hi"), (F.atan2(F.col("xy"), half) / 2).alias("direction"))


def corners(cells: DataFrame, least: float) -> DataFrame:
    """img, i, j, value, direction of saddles with eigenvalues beyond -least and least, at a window's least determinant; of equal ones side by side the first."""
    near = neighbourhood(saddles(cells), 1, 1)
    first = F.forall(F.slice("f", 1, 4), lambda v: v > F.col("value"))
    return near.where((F.col("lo") <= -least) & (F.col("hi") >= least) & (F.col("value") == F.array_min("f")) & first).select(*CELL, "value", "direction")


def _section(name: str, di: int, dj: int) -> Column:
    """The sum of the middle five of the nine values around a place of a 7 by 7 window."""
    values = F.array(*[F.get(name, F.lit((3 + di + a) * 7 + 3 + dj + b)) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return F.aggregate(F.slice(F.array_sort(values), 3, 5), F.lit(0.0), lambda acc, v: acc + v)


def plausible(cells: DataFrame, found: DataFrame, hard: float = 0.2, soft: float = 0.6) -> DataFrame:
    """Corners three cells from the border whose opposite sections agree: in three pairs at most beyond hard, in one beyond soft, of the sections' range."""
    own = found.join(neighbourhood(cells, 3, 3, out="_w").select(*CELL, "_w"), CELL).join(sizes(cells), "img")
    own = own.where((F.col("i") >= 3) & (F.col("j") >= 3) & (F.col("i") < F.col("h") - 3) & (F.col("j") < F.col("w") - 3))
    own = own.withColumn("_s", F.array(*[_section("_w", *s) for s in SECTIONS])).withColumn("_range", F.array_max("_s") - F.array_min("_s"))
    apart = [F.abs(F.get("_s", F.lit(2 * k)) - F.get("_s", F.lit(2 * k + 1))) for k in range(4)]
    beyond = lambda share: sum(((a > share * F.col("_range")).cast("int") for a in apart), F.lit(0))
    return own.where((beyond(hard) <= 3) & (beyond(soft) <= 1)).select(*found.columns)


def saddle_points(cells: DataFrame, found: DataFrame, r: int = 2) -> DataFrame:
    """found with y and x: where the surface of second degree that fits a window best, by its normal equations, is level; the cell itself if that is more than a cell away.

    On a whole window the equations part: each second coefficient is a sum of products over a constant.
    """
    n = 2 * r + 1
    steps = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)]
    second = sum(k * k for k in range(-r, r + 1))
    mean = second / n
    spread = n * sum((k * k - mean) ** 2 for k in range(-r, r + 1))
    own = found.join(neighbourhood(cells, r, r, out="_w").select(*CELL, "_w"), CELL)
    taps = {
        "gy": [a / (n * second) for a, _ in steps], "gx": [b / (n * second) for _, b in steps], "yy": [2 * (a * a - mean) / spread for a, _ in steps],
        "xx": [2 * (b * b - mean) / spread for _, b in steps], "xy": [a * b / (second * second) for a, b in steps],
    }
    own = own.withColumns({f"_{k}": weighted("_w", t) for k, t in taps.items()})
    gy, gx, yy, xx, xy = (F.col(f"_{k}") for k in taps)
    det = yy * xx - xy * xy
    own = own.withColumns({"_dy": F.try_divide(xy * gx - xx * gy, det), "_dx": F.try_divide(xy * gy - yy * gx, det)})
    near = (F.abs("_dy") <= 1) & (F.abs("_dx") <= 1)
    return own.select(*found.columns, (F.col("i") + F.when(near, F.col("_dy")).otherwise(0.0)).alias("y"), (F.col("j") + F.when(near, F.col("_dx")).otherwise(0.0)).alias("x"))


def fit_centres(windows: np.ndarray, direction: np.ndarray, rounds: int = 50, tolerance: float = 1e-6) -> np.ndarray:
    """y, x and whether settled, for each window (n, side, side): Gauss-Newton on atan(u v), where (u, v) is the window's plane turned, scaled and shifted.

    A step is halved while it does not lessen the squared error; a fit is settled when its step is within the tolerance.
    """
    n, side, _ = windows.shape
    flat = np.sort(windows.reshape(n, -1), axis=1)
    cut = side * side // 10
    black, white = flat[:, cut], flat[:, side * side - cut - 1]
    span = np.where(white > black, white - black, 1.0)
    seen = (windows.reshape(n, -1) - black[:, None]) / span[:, None] * np.pi - np.pi / 2
    py, px = (g.reshape(-1).astype(float) for g in np.mgrid[-(side // 2) : side // 2 + 1, -(side // 2) : side // 2 + 1])
    turn = np.pi / 4 - direction
    p = np.stack([np.zeros(n), np.zeros(n), np.cos(turn), np.sin(turn)], axis=1)

    def model(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = p[:, 2:3] * px - p[:, 3:4] * py + p[:, 0:1]
        v = p[:, 3:4] * px + p[:, 2:3] * py + p[:, 1:2]
        return u, v, seen - np.arctan(u * v)

    u, v, error = model(p)
    settled = np.zeros(n, dtype=bool)
    for _ in range(rounds):
        fall = 1 / (1 + (u * v) ** 2)
        a = np.stack([fall * v, fall * u, fall * (px * v + py * u), fall * (px * u - py * v)], axis=2)
        normal = np.einsum("nok,nol->nkl", a, a) + 1e-9 * np.eye(4)
        step = np.linalg.solve(normal, np.einsum("nok,no->nk", a, error)[:, :, None])[:, :, 0]
        size, before = np.ones(n), (error**2).sum(axis=1)
        for _ in range(20):
            tried = np.where(settled[:, None], p, p + size[:, None] * step)
            worse = ((model(tried)[2] ** 2).sum(axis=1) > before) & ~settled
            if not worse.any():
                break
            size = np.where(worse, size / 2, size)
        p = tried
        u, v, error = model(p)
        settled |= np.abs(size[:, None] * step).max(axis=1) <= tolerance
        if settled.all():
            break
    c, s = p[:, 2], p[:, 3]
    norm = np.maximum(c * c + s * s, 1e-12)
    # The centre is where u and v are 0.
    return np.stack([(s * p[:, 0] - c * p[:, 1]) / norm, -(c * p[:, 0] + s * p[:, 1]) / norm, settled.astype(float)], axis=1)


def fitted_corners(cells: DataFrame, found: DataFrame, r: int = 3) -> DataFrame:
    """img, i, j, y, x, settled: each corner's centre by the model of crossing edges; the border's cells go on outside the image."""
    rows = found.select(*CELL, "direction").join(sizes(cells), "img")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-r, r + 1) for b in range(-r, r + 1)]))
    asked = rows.withColumn("s", steps).withColumns({"_i": F.greatest(F.lit(0), F.least(F.col("h") - 1, F.col("i") + F.col("s.a"))), "_j": F.greatest(F.lit(0), F.least(F.col("w") - 1, F.col("j") + F.col("s.b")))})
    values = cells.select("img", F.col("i").alias("_i"), F.col("j").alias("_j"), "value")
    windows = asked.join(values, ["img", "_i", "_j"]).groupBy(*CELL, "direction").agg(F.transform(F.array_sort(F.collect_list(F.struct("s.a", "s.b", "value"))), lambda x: x["value"].cast("double")).alias("_w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                side = 2 * r + 1
                made = fit_centres(np.stack(pdf["_w"].to_numpy()).reshape(-1, side, side), pdf["direction"].to_numpy())
                yield pd.DataFrame({"img": pdf["img"], "i": pdf["i"], "j": pdf["j"], "y": pdf["i"] + made[:, 0], "x": pdf["j"] + made[:, 1], "settled": made[:, 2] > 0})

    return windows.mapInPandas(run, "img int, i int, j int, y double, x double, settled boolean")


def _crossed(tolerance: float) -> Column:
    """Whether two corners' directions are at right angles, within the tolerance."""
    return F.cos(2 * (F.col("p.direction") - F.col("q.direction"))) <= -float(np.cos(2 * tolerance))


def crossed_pairs(points: DataFrame, reach: float, angle: float) -> DataFrame:
    """p, q, dy, dx, d2: corners within reach whose directions are crossed; joined by the cells of a grid of that size."""
    cell = lambda c: F.floor(F.col(c) / reach)
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    p = points.withColumn("s", around).withColumns({"_i": cell("y") + F.col("s.a"), "_j": cell("x") + F.col("s.b")}).alias("p")
    q = points.withColumns({"_i": cell("y"), "_j": cell("x")}).alias("q")
    near = p.join(q, (F.col("p.img") == F.col("q.img")) & (F.col("p._i") == F.col("q._i")) & (F.col("p._j") == F.col("q._j")) & (F.col("p.node") != F.col("q.node")) & _crossed(angle))
    dy, dx = F.col("q.y") - F.col("p.y"), F.col("q.x") - F.col("p.x")
    d2 = F.round(dy * dy + dx * dx, 6)
    return near.select(F.col("p.node").alias("p"), F.col("q.node").alias("q"), dy.alias("dy"), dx.alias("dx"), d2.alias("d2")).where(F.col("d2") <= reach * reach)


def neighbour_links(pairs: DataFrame, tolerance: float) -> DataFrame:
    """p, q, a, b: q is at p's place predicted by a of its first steps and b of its second, within tolerance of the step's length; each sees the other so."""
    nearest = Window.partitionBy("p").orderBy("d2", "q")
    own = pairs.withColumn("_n", F.row_number().over(nearest))
    first = own.where("_n = 1").select("p", F.col("dy").alias("uy"), F.col("dx").alias("ux"))
    rows = pairs.join(first, "p")
    along = F.col("dy") * F.col("uy") + F.col("dx") * F.col("ux")
    across = rows.where(4 * along * along <= F.col("d2") * (F.col("uy") * F.col("uy") + F.col("ux") * F.col("ux"))).withColumn("_n", F.row_number().over(nearest))
    # The second step is a left turn of the first: columns towards rows.
    side = F.signum(F.col("ux") * F.col("dy") - F.col("uy") * F.col("dx"))
    second = across.where("_n = 1").select("p", (side * F.col("dy")).alias("vy"), (side * F.col("dx")).alias("vx"))
    rows = rows.join(second, "p", "left")
    options = []
    for a, b in ((1, 0), (0, 1), (-1, 0), (0, -1)):
        sy, sx = (F.col(f"{'u' if a else 'v'}{c}") for c in "yx")
        ey, ex = F.col("dy") - (a + b) * sy, F.col("dx") - (a + b) * sx
        miss = F.round(ey * ey + ex * ex, 6)
        options.append(F.when(miss <= tolerance * tolerance * (sy * sy + sx * sx), F.struct(miss.alias("miss"), F.lit(a).alias("a"), F.lit(b).alias("b"))))
    rows = rows.withColumn("o", F.array_min(F.array_compact(F.array(*options)))).where("o IS NOT NULL").select("p", "q", "o.*")
    # One corner for each place, and one place for each corner (the least miss).
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy("p", "a", "b").orderBy("miss", "q"))).where("_n = 1").select("p", "q", "a", "b")
    back = best.select(F.col("p").alias("q"), F.col("q").alias("p"), F.col("a").alias("c"), F.col("b").alias("d"))
    return best.join(back, ["p", "q"])


def _quarter(a: str, b: str) -> Column:
    """0 to 3: the quarter turns of a unit step."""
    return F.when(F.col(a) == 1, 0).when(F.col(b) == 1, 1).when(F.col(a) == -1, 2).otherwise(3)


def _turned(x: Column, y: Column, k: Column) -> tuple[Column, Column]:
    """(x, y) after k quarter turns."""
    return F.when(k == 0, x).when(k == 1, -y).when(k == 2, -x).otherwise(y), F.when(k == 0, y).when(k == 1, x).when(k == 2, -y).otherwise(-x)


def frames(links: DataFrame) -> DataFrame:
    """node, root, x, y, k: each corner's place and turn in the frame of the least corner it is linked with."""
    # A link as seen from q: where p stands in q's frame, and how p's frame is turned there.
    turn = F.pmod(_quarter("c", "d") + 2 - _quarter("a", "b"), F.lit(4))
    seen = Step(links.select(F.col("p").alias("node"), F.col("q").alias("by"), F.col("c").alias("cx"), F.col("d").alias("cy"), turn.alias("ck")))
    state = Step(seen.read().select("node").distinct().select("node", F.col("node").alias("root"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("k")))
    before = None
    while True:
        said = state.read().agg(F.sum(F.col("root").cast("decimal(38,0)")), F.count("*")).first()
        if said == before:
            seen.drop()
            return state.read()
        before = said
        s = state.read()
        of = s.select(F.col("node").alias("by"), "root", "x", "y", "k")
        tx, ty = _turned(F.col("cx"), F.col("cy"), F.col("k"))
        told = seen.read().join(of, "by").select("node", F.struct("root", (F.col("x") + tx).alias("x"), (F.col("y") + ty).alias("y"), F.pmod(F.col("k") + F.col("ck"), F.lit(4)).alias("k")).alias("f"))
        hooked = s.select("node", F.struct("root", "x", "y", "k").alias("f")).unionByName(told).groupBy("node").agg(F.min("f").alias("f")).select("node", "f.*")
        up = s.select(F.col("node").alias("root"), F.col("root").alias("r"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("k").alias("rk"))
        jx, jy = _turned(F.col("x"), F.col("y"), F.col("rk"))
        jumped = hooked.join(up, "root").select("node", F.col("r").alias("root"), (F.col("rx") + jx).alias("x"), (F.col("ry") + jy).alias("y"), F.pmod(F.col("rk") + F.col("k"), F.lit(4)).alias("k"))
        made = Step(jumped)
        state.drop()
        state = made


def consistent(links: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of placed whose board has no link that its places contradict, and no place twice."""
    p = placed.select(F.col("node").alias("p"), "root", F.col("x").alias("px"), F.col("y").alias("py"), F.col("k").alias("pk"))
    q = placed.select(F.col("node").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("k").alias("qk"))
    tx, ty = _turned(F.col("a"), F.col("b"), F.col("pk"))
    turn = F.pmod(F.col("pk") + _quarter("a", "b") + 2 - _quarter("c", "d"), F.lit(4))
    wrong = links.join(p, "p").join(q, "q").where((F.col("px") + tx != F.col("qx")) | (F.col("py") + ty != F.col("qy")) | (turn != F.col("qk"))).select("root")
    twice = placed.groupBy("root", "x", "y").agg(F.count("*").alias("_n")).where("_n > 1").select("root")
    return placed.join(wrong.unionByName(twice).distinct(), "root", "left_anti")


def grids(points: DataFrame, reach: float, tolerance: float = 0.2, angle: float = 0.15, least: int = 4) -> DataFrame:
    """img, board, row, col, y, x of corners (img, i, j, direction, y, x) that stand in a grid of at least so many.

    Rows and columns count from 0 along the image's own, as nearly as quarter turns allow. board is the number of the
    board's least corner. Boards whose links contradict one another are left out.
    """
    key = F.col("img").cast("bigint") * IMG + F.col("i").cast("bigint") * ROW + F.col("j")
    own = Step(points.select("img", key.alias("node"), "direction", "y", "x"))
    links = Step(neighbour_links(crossed_pairs(own.read(), reach, angle), tolerance))
    placed = Step(consistent(links.read(), frames(links.read())))
    at = placed.read().join(own.read().select("node", "img", F.col("y").alias("py"), F.col("x").alias("px")), "node")
    # The mean step along the board's first axis says how its frame is turned: the sum over corners of place times offset.
    w = Window.partitionBy("root")
    middle = at.withColumns({"_mx": F.avg("x").over(w), "_my": F.avg("y").over(w), "_n": F.count("*").over(w)})
    mx, my = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")
    # Of the two axes' steps the sum of the first and of the second turned back.
    east, south = F.sum(mx * F.col("px") + my * F.col("py")).over(w), F.sum(mx * F.col("py") - my * F.col("px")).over(w)
    quarter = F.pmod(F.round(F.atan2(F.round(south, 6), F.round(east, 6)) / (np.pi / 2)).cast("int"), F.lit(4))
    turned = middle.where(F.col("_n") >= least).withColumn("_q", quarter)
    rx, ry = _turned(F.col("x"), F.col("y"), F.col("_q"))
    turned = turned.withColumns({"_x": rx, "_y": ry})
    return turned.select("img", F.col("root").alias("board"), (F.col("_y") - F.min("_y").over(w)).cast("int").alias("row"), (F.col("_x") - F.min("_x").over(w)).cast("int").alias("col"), F.col("py").alias("y"), F.col("px").alias("x"))


def largest(found: DataFrame) -> DataFrame:
    """The rows of each image's board with most corners; of equal ones the one of the least corner."""
    size = found.groupBy("img", "board").agg(F.count("*").alias("_n"))
    best = size.groupBy("img").agg(F.max(F.struct("_n", -F.col("board"))).alias("_b")).select("img", (-F.col("_b.col2")).alias("board"))
    return found.join(best, ["img", "board"])


def checkerboards(cells: DataFrame, least: float, reach: float, **options) -> DataFrame:
    """Corners, filter, places between cells and grids in a row."""
    found = plausible(cells, corners(cells, least))
    return grids(saddle_points(cells, found), reach, **options)
