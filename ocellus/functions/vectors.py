"""Matching costs and norms of feature vectors, as column expressions over arrays of doubles.

All run on the JVM. A score is better when higher, a cost when lower. Arrays of
one call have one length; an empty array gives null where a mean is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column


def total(x: Vector) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def mean(x: Vector) -> Column:
    return F.try_divide(total(x), F.size(x))


def zero_mean(x: Vector) -> Vector:
    return F.transform(x, lambda v: v - mean(x))


def dot(a: Vector, b: Vector) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(x: Vector) -> Column:
    return F.sqrt(dot(x, x))


def _differences(a: Vector, b: Vector) -> Vector:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def cc(a: Vector, b: Vector) -> Column:
    return dot(a, b)


def ncc(a: Vector, b: Vector) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def ssd(a: Vector, b: Vector) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def sad(a: Vector, b: Vector) -> Column:
    return total(_differences(a, b))


def medad(a: Vector, b: Vector) -> Column:
    """The upper median of the absolute differences."""
    return F.get(F.array_sort(_differences(a, b)), F.floor(F.size(a) / 2).cast("int"))


def _zeroed(f: Callable[[Vector, Vector], Column]) -> Callable[[Vector, Vector], Column]:
    return lambda a, b: f(zero_mean(a), zero_mean(b))


def hamming(a: Vector, b: Vector) -> Column:
    """Differing bits of two arrays of integers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, v: acc + v)


def census(x: Vector, centre: int) -> Column:
    """Words of 32 bits; bit f of them is set where the centre exceeds feature f, the centre itself left out."""
    middle = F.get(x, F.lit(centre))
    others = F.concat(F.slice(x, 1, centre), F.slice(x, centre + 2, F.greatest(F.size(x) - centre - 1, F.lit(0))))
    bits = F.transform(others, lambda v: F.when(middle > v, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    words = F.sequence(F.lit(0), F.floor((F.size(others) - 1) / 32).cast("int"))
    return F.transform(
        words,
        lambda w: F.aggregate(
            F.transform(F.slice(bits, w * 32 + 1, F.lit(32)), lambda v, k: F.call_function("shiftleft", v, k)), F.lit(0).cast("bigint"), lambda acc, v: acc.bitwiseOR(v)
        ),
    )


def census_cost(a: Vector, b: Vector, centre: int) -> Column:
    return hamming(census(a, centre), census(b, centre))


def kermi(a: Vector, b: Vector) -> Column:
    """Mutual information by Gaussian kernels of width (max - min) / n."""
    n = F.size(a)

    def width(x: Vector) -> Column:
        return F.greatest((F.array_max(x) - F.array_min(x)) / n, F.lit(1e-12))

    def kernel(d: Column, w: Column) -> Column:
        return F.exp(-(d * d) / (2 * w * w))

    def term(i: Column, w: Column) -> Column:
        none = F.struct(*[F.lit(0.0).alias(c) for c in ("j", "s", "t")])

        def add(acc: Column, pair: Column) -> Column:
            return F.struct((acc["j"] + pair["s"] * pair["t"]).alias("j"), (acc["s"] + pair["s"]).alias("s"), (acc["t"] + pair["t"]).alias("t"))

        pairs = F.zip_with(a, b, lambda x, y: F.struct(kernel(F.get(a, i) - x, w["a"]).alias("s"), kernel(F.get(b, i) - y, w["b"]).alias("t")))
        return F.aggregate(pairs, none, add, lambda acc: acc["j"] * F.ln(acc["j"] * n / (acc["s"] * acc["t"])))

    # An array of one element holds the widths, so that they are computed once.
    widths = F.array(F.struct(width(a).alias("a"), width(b).alias("b")))
    return F.get(F.transform(widths, lambda w: total(F.transform(F.sequence(F.lit(0), n - 1), lambda i: term(i, w)))), F.lit(0))


SCORES: dict[str, Callable[[Vector, Vector], Column]] = {"cc": cc, "ncc": ncc, "zcc": _zeroed(cc), "zncc": _zeroed(ncc)}
COSTS: dict[str, Callable[[Vector, Vector], Column]] = {
    "ssd": ssd, "zssd": _zeroed(ssd), "sad": sad, "zsad": _zeroed(sad), "medad": medad, "zmedad": _zeroed(medad),
}
