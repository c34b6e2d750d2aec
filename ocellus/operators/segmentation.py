"""Masks by minimum cuts, shading and reflectance, normals and heights, and target detection: an image to a task where it is solved as a whole."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators.graphs import source_side
from ocellus.operators.iteration import NotSettled
from ocellus.operators.sequential import _laplace, _long, conjugate_gradient, image


def neighbour_edges(cells: DataFrame, price: Callable, value: str = "value") -> DataFrame:
    """img, a, b, w of edges to the right and downward neighbours; cells are numbered i * 2^20 + j."""
    key = F.col("i").cast("bigint") * (1 << 20) + F.col("j")
    along, across = Window.partitionBy("img", "i").orderBy("j"), Window.partitionBy("img", "j").orderBy("i")
    rows = cells.withColumns({"a": key, "_r": F.lead(value).over(along), "_d": F.lead(value).over(across)})
    right = rows.where("_r IS NOT NULL").select("img", "a", (F.col("a") + 1).alias("b"), price(F.col(value), F.col("_r")).alias("w"))
    return right.unionByName(rows.where("_d IS NOT NULL").select("img", "a", (F.col("a") + (1 << 20)).alias("b"), price(F.col(value), F.col("_d")).alias("w")))


def guided_edges(guide: DataFrame, channels: list[str], switch: float, least: float = 0.0) -> DataFrame:
    """img, a, b, w: what unlike marks of neighbours cost, from least where a guide's channels differ most to switch where they differ least."""
    high, low = max(switch, least), min(switch, least)
    packed = guide.withColumn("_g", F.array(*[F.col(c).cast("double") for c in channels]))
    gap = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)
    edges = neighbour_edges(packed, gap, "_g")
    ends = edges.groupBy("img").agg(F.min("w").alias("_lo"), F.max("w").alias("_hi"))
    share = F.coalesce(F.try_divide(F.col("_hi") - F.col("w"), F.col("_hi") - F.col("_lo")), F.lit(1.0))
    return edges.join(ends, "img").select("img", "a", "b", (low + (high - low) * share).alias("w"))


def masked_edges(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Those of edges (img, a, b, w) between two cells of a mask (img, i, j)."""
    inside = cells.select("img", (F.col("i").cast("bigint") * (1 << 20) + F.col("j")).alias("a")).distinct()
    return edges.join(inside, ["img", "a"], "left_semi").join(inside.withColumnRenamed("a", "b"), ["img", "b"], "left_semi").select("img", "a", "b", "w")


def settled(fore: np.ndarray, back: np.ndarray, smooth: float) -> np.ndarray:
    """1 and 0 where every least cut, or the one of fewest true cells, agrees whatever its neighbours are, and so on from those that are settled; else -1.

    A cell that costs more as false than all its open links together is true; one that costs as much or more as true is false.
    """
    known = np.full(fore.shape, -1)
    while True:
        pad = np.pad(known, 1, constant_values=-2)
        near = np.stack([pad[:-2, 1:-1], pad[2:, 1:-1], pad[1:-1, :-2], pad[1:-1, 2:]])
        false, true, free = (smooth * (near == k).sum(axis=0) for k in (0, 1, -1))
        new = np.where(known >= 0, known, np.where(back + true > fore + false + free, 1, np.where(fore + false >= back + true + free, 0, -1)))
        if (new == known).all():
            return known
        known = new


def cut_mask(fore: np.ndarray, back: np.ndarray, smooth: np.ndarray | float) -> np.ndarray:
    """The mask of least cost, of several the one of fewest true cells: fore where true, back where false, smooth for each pair of unlike neighbours.

    With one price for all pairs, cells that no neighbour can turn are settled first, and only the others are cut.
    """
    if np.isscalar(smooth) and smooth >= 0:
        fore, back = fore.astype(float), back.astype(float)
        return partial_cut_mask(fore, back, float(smooth), settled(fore, back, float(smooth)))
    h, w = fore.shape
    edges = []
    for i in range(h):
        for j in range(w):
            k = i * w + j
            edges += [(-1, k, float(back[i, j])), (k, -2, float(fore[i, j]))]
            for a, b in ((i, j + 1), (i + 1, j)):
                if a < h and b < w:
                    s = float(smooth if np.isscalar(smooth) else smooth[i, j])
                    edges += [(k, a * w + b, s), (a * w + b, k, s)]
    seen = source_side(edges, -1, -2)
    return np.array([[i * w + j in seen for j in range(w)] for i in range(h)])


def partial_cut_mask(fore: np.ndarray, back: np.ndarray, smooth: float, known: np.ndarray) -> np.ndarray:
    """The mask of least cost among those that agree with known (1 true, 0 false, -1 open)."""
    h, w = fore.shape
    fore, back, edges = fore.astype(float), back.astype(float), []
    for i, j in zip(*np.nonzero(known < 0), strict=True):
        for a, b in ((i, j + 1), (i + 1, j), (i, j - 1), (i - 1, j)):
            if 0 <= a < h and 0 <= b < w and known[a, b] >= 0:
                # A neighbour that is settled adds to what the other side costs.
                (back if known[a, b] else fore)[i, j] += smooth
    for i, j in zip(*np.nonzero(known < 0), strict=True):
        k = int(i * w + j)
        edges += [(-1, k, float(back[i, j])), (k, -2, float(fore[i, j]))]
        for a, b in ((i, j + 1), (i + 1, j)):
            if a < h and b < w and known[a, b] < 0:
                edges += [(k, int(a * w + b), smooth), (int(a * w + b), k, smooth)]
    mask = known == 1
    if not edges:
        return mask
    seen = source_side(edges, -1, -2)
    for k in seen - {-1}:
        mask[k // w, k % w] = True
    return mask


def hierarchical_cut_mask(fore: np.ndarray, back: np.ndarray, smooth: float, depth: int) -> np.ndarray:
    """A mask cut at half the size first (costs of 2 x 2 cells together), then opened again along its border only."""
    h, w = fore.shape
    if depth <= 0 or h < 4 or w < 4:
        return cut_mask(fore, back, smooth)
    pad = ((0, h % 2), (0, w % 2))
    halves = [np.pad(x, pad).reshape((h + 1) // 2, 2, (w + 1) // 2, 2).sum(axis=(1, 3)) for x in (fore, back)]
    coarse = np.kron(hierarchical_cut_mask(*halves, 2 * smooth, depth - 1), np.ones((2, 2), dtype=bool))[:h, :w]
    around = np.pad(coarse, 2, mode="edge")
    views = [around[a : a + h, b : b + w] for a in range(5) for b in range(5)]
    border = np.any(views, axis=0) & ~np.all(views, axis=0)
    return partial_cut_mask(fore, back, smooth, np.where(border, -1, coarse.astype(int)))


def hierarchical_masks(cells: DataFrame, threshold: float, smooth: float, depth: int = 2) -> DataFrame:
    """img, i, j, mask as min_cut_masks(), from coarse to fine."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = image(pdf)
        return _long(pdf["img"].iloc[0], mask=hierarchical_cut_mask(np.maximum(threshold - x, 0), np.maximum(x - threshold, 0), smooth, depth))

    return cells.select("img", "i", "j", "value").groupBy("img").applyInPandas(run, "img int, i int, j int, mask boolean")


#: Fixed value: how many thresholds the automatic decomposition tries.
THRESHOLDS = 12


def automatic_retinex(x: np.ndarray, low: float = 0.05, high: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """The decomposition, of those with thresholds between low and high, whose reflectance has the least spread of levels (entropy of its histogram)."""
    best = None
    for t in np.geomspace(low, high, THRESHOLDS):
        r, s = retinex(x, float(t))
        n = np.histogram(np.log(np.maximum(r, 1e-6)), bins=64)[0].astype(float)
        share = n[n > 0] / n.sum()
        entropy = float(-(share * np.log(share)).sum())
        if best is None or entropy < best[0] - 1e-12:
            best = entropy, r, s, float(t)
    return best[1], best[2], best[3]


def min_cut_masks(cells: DataFrame, threshold: float, smooth: float) -> DataFrame:
    """img, i, j, mask: cells above threshold, smoothed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = image(pdf)
        return _long(pdf["img"].iloc[0], mask=cut_mask(np.maximum(threshold - x, 0), np.maximum(x - threshold, 0), smooth))

    # Small rows of long work: with a number of its own, the exchange is not merged into few tasks.
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.select("img", "i", "j", "value").repartition(tasks, "img").groupBy("img").applyInPandas(run, "img int, i int, j int, mask boolean")


def retinex(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Reflectance and shading: steps of the logarithm above threshold belong to the reflectance, others to the shading."""
    log = np.log(np.maximum(x, 1e-3))
    rhs = np.zeros_like(log)
    for axis in (0, 1):
        d = np.diff(log, axis=axis)
        d = np.where(np.abs(d) > threshold, 0, d)
        lo, hi = [slice(None)] * 2, [slice(None)] * 2
        lo[axis], hi[axis] = slice(None, -1), slice(1, None)
        rhs[tuple(lo)] -= d
        rhs[tuple(hi)] += d
    shade = conjugate_gradient(lambda v: _laplace(v) + 1e-6 * v, rhs)
    shade += np.log(max(x.max(), 1e-3)) - shade.max()
    return np.exp(log - shade), np.exp(shade)


def decompose(cells: DataFrame, threshold: float) -> DataFrame:
    """img, i, j, reflectance, shading."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, s = retinex(image(pdf), threshold)
        return _long(pdf["img"].iloc[0], reflectance=r, shading=s)

    return cells.select("img", "i", "j", "value").groupBy("img").applyInPandas(run, "img int, i int, j int, reflectance double, shading double")


def light_direction(cells: DataFrame) -> DataFrame:
    """img and the direction (lx, ly, lz) whose products with normals (nx, ny, nz) are nearest to value."""
    names = ("nx", "ny", "nz")
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"m{i}{j}") for i, a in enumerate(names) for j, b in enumerate(names)] + [F.sum(F.col(a) * F.col("value")).alias(f"v{i}") for i, a in enumerate(names)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf[[f"m{i}{j}" for i in range(3) for j in range(3)]].to_numpy().reshape(-1, 3, 3)
        v = pdf[[f"v{i}" for i in range(3)]].to_numpy()
        light = np.array([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(m, v, strict=True)]).reshape(-1, 3)
        light /= np.maximum(np.linalg.norm(light, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({"img": pdf["img"], "lx": light[:, 0], "ly": light[:, 1], "lz": light[:, 2]})

    return cells.groupBy("img").agg(*sums).mapInPandas(lambda it: (run(p) for p in it), "img int, lx double, ly double, lz double")


def height_of(nx: np.ndarray, ny: np.ndarray, nz: np.ndarray) -> np.ndarray:
    """Heights whose differences are nearest to the mean slopes of neighbours; 0 at the first pixel. Slopes are held to 50."""
    gy, gx = (np.clip(n / np.where(np.abs(nz) < 1e-9, 1e-9, nz), -50, 50) for n in (ny, nx))
    rhs = np.zeros_like(gx)
    for axis, g in ((0, gy), (1, gx)):
        lo, hi = [slice(None)] * 2, [slice(None)] * 2
        lo[axis], hi[axis] = slice(None, -1), slice(1, None)
        d = -(g[tuple(lo)] + g[tuple(hi)]) / 2
        rhs[tuple(lo)] -= d
        rhs[tuple(hi)] += d
    z = conjugate_gradient(_laplace, rhs - rhs.mean())
    return z - z[0, 0]


def normals_from_shading(x: np.ndarray, light: np.ndarray, smooth: float = 0.25, limit: int = 20_000, tol: float = 1e-6) -> np.ndarray:
    """h, w, 3: unit normals whose shading is near x, smoothed, by steepest descent until no normal moves by more than tol; an error if the limit comes first."""
    n = np.zeros((*x.shape, 3))
    n[:] = light / np.linalg.norm(light)
    for _ in range(limit):
        error = n @ light - x
        grad = error[:, :, None] * light + smooth * np.stack([_laplace(n[:, :, c]) for c in range(3)], axis=2)
        new = n - 0.1 * grad
        new /= np.maximum(np.linalg.norm(new, axis=2, keepdims=True), 1e-9)
        moved, n = float(np.abs(new - n).max()), new
        if moved <= tol:
            return n
    raise NotSettled(f"normals still move by {moved} after {limit} steps")


def shape_from_shading(cells: DataFrame, light: tuple[float, float, float]) -> DataFrame:
    """img, i, j, nx, ny, nz, height."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = image(pdf)
        n = normals_from_shading(x / max(float(x.max()), 1e-9), np.array(light))
        return _long(pdf["img"].iloc[0], nx=n[:, :, 0], ny=n[:, :, 1], nz=n[:, :, 2], height=height_of(n[:, :, 0], n[:, :, 1], n[:, :, 2]))

    return cells.select("img", "i", "j", "value").groupBy("img").applyInPandas(run, "img int, i int, j int, nx double, ny double, nz double, height double")


def checkerboard_corners(cells: DataFrame, least: float) -> DataFrame:
    """img, i, j, value of saddle points: second differences with eigenvalues beyond -least and least, at a window's least determinant."""
    from ocellus.operators.raster import CELL, neighbourhood, weighted

    f = neighbourhood(cells, 1, 1)
    h = f.select(*CELL, weighted("f", [0, 1, 0, 0, -2, 0, 0, 1, 0]).alias("yy"), weighted("f", [0, 0, 0, 1, -2, 1, 0, 0, 0]).alias("xx"), weighted("f", [0.25, 0, -0.25, 0, 0, 0, -0.25, 0, 0.25]).alias("xy"))
    mean, root = (F.col("xx") + F.col("yy")) / 2, F.sqrt(((F.col("xx") - F.col("yy")) / 2) * ((F.col("xx") - F.col("yy")) / 2) + F.col("xy") * F.col("xy"))
    d = h.select(*CELL, (F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")).alias("value"), (mean - root).alias("lo"), (mean + root).alias("hi"))
    near = neighbourhood(d, 1, 1)
    return near.where((F.col("lo") <= -least) & (F.col("hi") >= least) & (F.col("value") == F.array_min("f"))).select(*CELL, "value")


def round_targets(stats: DataFrame, least: int, most: int, ratio: float) -> DataFrame:
    """Components (of component_stats) of a fitting size whose axes differ by ratio at most, each with its five nearest others."""
    ok = stats.where((F.col("n").between(least, most)) & (F.col("major") <= ratio * F.greatest("minor", F.lit(1e-9)))).select("img", "label", "ci", "cj")
    a, b = ok.alias("a"), ok.alias("b")
    gap = (F.col("a.ci") - F.col("b.ci")) * (F.col("a.ci") - F.col("b.ci")) + (F.col("a.cj") - F.col("b.cj")) * (F.col("a.cj") - F.col("b.cj"))
    # Targets that belong together lie within a few diameters, so cells of a grid of that size are joined.
    size = 4 * math.sqrt(most)
    cell = lambda x: (F.floor(F.col(f"{x}.ci") / size), F.floor(F.col(f"{x}.cj") / size))
    steps = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)]))
    left = ok.withColumn("s", steps).alias("a").select("a.*", (cell("a")[0] + F.col("a.s.p")).alias("_i"), (cell("a")[1] + F.col("a.s.q")).alias("_j")).alias("a")
    right = b.select("b.*", cell("b")[0].alias("_i"), cell("b")[1].alias("_j")).alias("b")
    near = left.join(right, (F.col("a.img") == F.col("b.img")) & (F.col("a._i") == F.col("b._i")) & (F.col("a._j") == F.col("b._j")) & (F.col("a.label") != F.col("b.label")))
    ranked = near.select("a.img", "a.label", F.col("b.label").alias("other"), gap.alias("d2")).withColumn("rank", F.row_number().over(Window.partitionBy("img", "label").orderBy("d2", "other")))
    return ranked.where("rank <= 5").select("img", "label", "rank", "other", "d2")
