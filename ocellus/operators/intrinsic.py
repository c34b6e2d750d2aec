"""Reflectance and shading of colour images by retinex with texture links, and turned normal maps.

Which places share a texture is found by Spark: a patch of chromaticities in
whole grains, turned to the least of its quarter turns, is a key, and each place
is linked with the one before it of its key, so links are as many as places. The
sparse system of an image is solved in one task, by conjugate gradients until
its residual is small; one that does not get there is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators.iteration import NotSettled
from ocellus.operators.raster import CELL, neighbourhood, rotate_window, sizes

RGB = ["r", "g", "b"]
DARK = 1e-3
#: Share of an image's greatest intensity from which a pixel counts as fully lit.
LIT = 0.95


def chromaticities(cells: DataFrame) -> DataFrame:
    """cells (img, i, j, r, g, b) with cr and cg, red's and green's shares, which shading leaves as they are."""
    total = F.greatest(F.col("r") + F.col("g") + F.col("b"), F.lit(DARK))
    return cells.withColumns({"cr": F.col("r") / total, "cg": F.col("g") / total})


def texture_links(cells: DataFrame, grain: float) -> DataFrame:
    """img, i, j, pi, pj: each place whose window lies in the image, and the one before it (row by row) of the same texture, whichever way it is turned."""
    c = chromaticities(cells)
    for name in ("cr", "cg"):
        c = neighbourhood(c.withColumn("_v", F.round(F.col(name) / grain)), 1, 1, value="_v", out=f"_{name}")
    own = c.join(sizes(cells), "img").where((F.col("i") > 0) & (F.col("j") > 0) & (F.col("i") + 1 < F.col("h")) & (F.col("j") + 1 < F.col("w")))
    turns = [F.concat(*[rotate_window(F.col(f"_{n}"), 1, k) for n in ("cr", "cg")]).cast("array<bigint>") for k in range(4)]
    keyed = own.select(*CELL, F.array_min(F.array(*turns)).alias("_key"))
    before = Window.partitionBy("img", "_key").orderBy("i", "j")
    linked = keyed.select(*CELL, F.lag("i").over(before).alias("pi"), F.lag("j").over(before).alias("pj"))
    return linked.where("pi IS NOT NULL")


def solve_edges(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, pull: np.ndarray, pinned: np.ndarray, tolerance: float = 1e-9, limit: int | None = None) -> np.ndarray:
    """x of the least sum of weight (x_a - x_b)^2 - 2 pull (x_a - x_b) over edges and of pinned x^2 over places, by conjugate gradients with the diagonal taken out."""
    diagonal = np.bincount(a, weight, n) + np.bincount(b, weight, n) + pinned
    diagonal = np.where(diagonal > 0, diagonal, 1.0)

    def apply(x: np.ndarray) -> np.ndarray:
        flow = weight * (x[a] - x[b])
        return np.bincount(a, flow, n) - np.bincount(b, flow, n) + pinned * x

    side = np.bincount(a, pull, n) - np.bincount(b, pull, n)
    x, r = np.zeros(n), side.copy()
    z = r / diagonal
    p, rz, least = z.copy(), float(r @ z), tolerance * max(float(np.linalg.norm(side)), 1e-30)
    for _ in range(limit or 20 * n + 100):
        if np.linalg.norm(r) <= least:
            return x
        ap = apply(p)
        step = rz / float(p @ ap)
        x, r = x + step * p, r - step * ap
        z = r / diagonal
        new = float(r @ z)
        p, rz = z + new / rz * p, new
    raise NotSettled("conjugate gradients ended at their limit")


def log_shading(image: np.ndarray, links: np.ndarray, threshold: float, weights: tuple[float, float, float] = (1.0, 1.0, 1000.0), constancy: float = 100.0) -> np.ndarray:
    """The logarithm of the shading of an image (h, w, 3); links: rows i, j, pi, pj of one texture.

    Neighbours' shadings are to be alike, and so are their reflectances where chromaticities differ by threshold at most
    (constancy times as much); linked places' reflectances are to be alike; fully lit places are to have shading 1.
    """
    h, w, _ = image.shape
    log = np.log(np.maximum(image, DARK)).reshape(-1, 3)
    chroma = (image / np.maximum(image.sum(axis=2, keepdims=True), DARK))[:, :, :2].reshape(-1, 2)
    place = np.arange(h * w).reshape(h, w)
    a = np.concatenate([place[:, 1:].ravel(), place[1:].ravel()])
    b = np.concatenate([place[:, :-1].ravel(), place[:-1].ravel()])
    alike = np.where(((chroma[a] - chroma[b]) ** 2).sum(axis=1) <= threshold**2, constancy, 0.0)
    edge, texture, scale = weights
    one, two = links[:, 0] * w + links[:, 1], links[:, 2] * w + links[:, 3]
    weight = np.concatenate([3 * edge * (1 + alike), np.full(len(one), 3 * texture)])
    pull = np.concatenate([edge * alike * (log[a] - log[b]).sum(axis=1), texture * (log[one] - log[two]).sum(axis=1)])
    bright = image.sum(axis=2).ravel()
    pinned = np.where(bright >= LIT * bright.max(), scale, 0.0)
    return solve_edges(h * w, np.concatenate([a, one]), np.concatenate([b, two]), weight, pull, pinned).reshape(h, w)


def retinex_with_texture(cells: DataFrame, threshold: float, grain: float = 0.01, weights: tuple[float, float, float] = (1.0, 1.0, 1000.0)) -> DataFrame:
    """img, i, j, shading, and the reflectances r, g, b of each cell (img, i, j, r, g, b)."""

    def run(pdf: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        h = int(pdf["i"].max()) + 1
        image = pdf[RGB].to_numpy(dtype=float).reshape(h, -1, 3)
        shade = np.exp(log_shading(image, links[["i", "j", "pi", "pj"]].to_numpy(dtype=np.int64), threshold, weights))
        own = np.maximum(image, DARK) / shade[:, :, None]
        return pd.DataFrame({**{c: pdf[c].to_numpy() for c in CELL}, "shading": shade.ravel(), **{c: own[:, :, k].ravel() for k, c in enumerate(RGB)}})

    links = texture_links(cells, grain).toDF("_img", "i", "j", "pi", "pj")
    rows = cells.select(*[F.col(c).alias(c) for c in (*CELL, *RGB)])
    return rows.groupBy("img").cogroup(links.groupBy("_img")).applyInPandas(run, "img int, i int, j int, shading double, r double, g double, b double")


def rectify_normals(normals: DataFrame, mask: Column | None = None) -> DataFrame:
    """img, i, j, nx, ny, nz turned so that the mean normal of each image (where mask holds) is (0, 0, 1); an image of no such mean stays."""
    names = ["nx", "ny", "nz"]
    inside = F.lit(True) if mask is None else mask
    w = Window.partitionBy("img")
    rows = normals.withColumns({f"_{n}": F.avg(F.when(inside, F.col(n))).over(w) for n in names})
    length = F.sqrt(F.col("_nx") * F.col("_nx") + F.col("_ny") * F.col("_ny") + F.col("_nz") * F.col("_nz"))
    rows = rows.withColumns({"_l": length}).withColumns({f"_{n}": F.try_divide(F.col(f"_{n}"), F.col("_l")) for n in names})
    # The turn that takes m to (0, 0, 1) about m x (0, 0, 1): v -> v - (v.m + v.z) / (1 + m.z) (m + z) + 2 (v.m) z.
    x, y, z, mx, my, mz = (F.col(c) for c in ("nx", "ny", "nz", "_nx", "_ny", "_nz"))
    along = x * mx + y * my + z * mz
    share = F.try_divide(along + z, 1 + mz)
    turned = {"nx": x - share * mx, "ny": y - share * my, "nz": z - share * (mz + 1) + 2 * along}
    # The mean of a map that looks straight down is turned about x by half a circle.
    flipped = {"nx": x, "ny": -y, "nz": -z}
    return rows.select(*CELL, *[F.when(F.coalesce(F.col("_l"), F.lit(0.0)) < 1e-12, F.col(n)).when(1 + mz < 1e-12, flipped[n]).otherwise(turned[n]).alias(n) for n in names])
