"""Sub-pixel refinement of a cost minimum, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def parabola(a: Column, b: Column, c: Column) -> Column:
    """Offset of the vertex through costs at -1, 0, 1; 0 for a flat triplet."""
    return F.coalesce(F.try_divide(a - c, 2 * (a - 2 * b + c)), F.lit(0.0))


def equiangular(a: Column, b: Column, c: Column) -> Column:
    """Offset where two lines of equal and opposite slope meet; 0 for a flat triplet."""
    steep = F.when(c < a, a - b).otherwise(c - b)
    return F.coalesce(F.try_divide(a - c, 2 * steep), F.lit(0.0))


def gaussian(a: Column, b: Column, c: Column) -> Column:
    """The parabola through logarithms; 0 unless all are positive."""
    return F.when((a > 0) & (b > 0) & (c > 0), parabola(F.ln(a), F.ln(b), F.ln(c))).otherwise(0.0)


def patch(f: Column) -> dict[str, Column]:
    """dy, dx: the optimum of the least-squares quadratic through a 3x3 patch of costs; 0 where it has none.

    Sums are kept over common denominators, so whole-numbered costs stay exact.
    """
    places = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)]

    def total(weight: Callable[[int, int], int]) -> Column:
        return sum((F.get(f, F.lit(k)) * float(weight(y, x)) for k, (y, x) in enumerate(places) if weight(y, x)), F.lit(0.0))

    gy, gx, xy = total(lambda y, x: y), total(lambda y, x: x), total(lambda y, x: x * y)
    yy, xx = total(lambda y, x: 3 * y * y - 2), total(lambda y, x: 3 * x * x - 2)
    det = 16 * yy * xx - 9 * xy * xy
    return {"dy": F.coalesce(F.try_divide(6 * xy * gx - 8 * xx * gy, det), F.lit(0.0)), "dx": F.coalesce(F.try_divide(6 * xy * gy - 8 * yy * gx, det), F.lit(0.0))}
