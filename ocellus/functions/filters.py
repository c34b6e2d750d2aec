"""Standard filter kernels as lists of taps, and the maps of lenses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ocellus.functions.geometry import distort, image_to_normalised


def constant(r: int) -> list[float]:
    return [1 / (2 * r + 1)] * (2 * r + 1)


def gaussian(sigma: float, r: int | None = None) -> list[float]:
    """Taps that sum to 1, to three sigmas unless r says otherwise."""
    r = math.ceil(3 * sigma) if r is None else r
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [v / sum(raw) for v in raw]


def finite_difference(order: int = 1) -> list[float]:
    return {1: [-0.5, 0.0, 0.5], 2: [1.0, -2.0, 1.0]}[order]


def linear_extension() -> list[float]:
    """What goes across a finite difference."""
    return [1.0, 2.0, 1.0]


def outer(rows: list[float], columns: list[float]) -> list[tuple[int, int, float]]:
    """A kernel of two axes as offsets and weights."""
    ri, rj = len(rows) // 2, len(columns) // 2
    return [(a - ri, b - rj, x * y) for a, x in enumerate(rows) for b, y in enumerate(columns) if x * y]


def lens_map(i: Column, j: Column, focal: float, width: int, height: int, radial: tuple[float, float, float]) -> dict[str, Column]:
    """Where each pixel of the undistorted image lies in the distorted one."""
    n = image_to_normalised(j, i, focal, width, height)
    d = distort(n["nx"], n["ny"], radial)
    return {"si": d["dy"] * focal + (height - 1) / 2, "sj": d["dx"] * focal + (width - 1) / 2}
