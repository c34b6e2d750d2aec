"""Filters over any number of axes of a keyed relation: one row for each place of a dense grid, an integer column for each axis.

Separable filters take one window frame for each axis they move along. Other
kernels gather each place's taps by one equi-join. Columns that are named in
neither are batches: places of different batches never meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators.raster import _inside

#: Offsets, one for each axis, and the weight of what stands there.
Tap = tuple[tuple[int, ...], float]


def separable_nd(rows: DataFrame, taps: dict[str, Sequence[float]], batch: Sequence[str] = (), value: str = "value") -> DataFrame:
    """The rows with the value filtered along each axis in turn by an odd number of taps (correlation: the kernel is not flipped); 0 outside the grid."""
    axes = list(taps)
    out = rows
    for axis, own in taps.items():
        r = len(own) // 2
        if len(own) % 2 == 0:
            raise ValueError(f"the taps along {axis} have no middle")
        w = Window.partitionBy(*batch, *[a for a in axes if a != axis]).orderBy(axis)
        total = F.lit(0.0)
        for k, t in zip(range(-r, r + 1), own, strict=True):
            total = total + float(t) * (F.coalesce(F.lag(value, -k).over(w), F.lit(0.0)) if k else F.col(value))
        out = out.withColumn(value, total)
    return out


def box_nd(rows: DataFrame, radius: dict[str, int], batch: Sequence[str] = (), value: str = "value") -> DataFrame:
    """The rows with the mean of the box around each place that lies in the grid: a running sum and a count for each axis."""
    axes, out = list(radius), rows.withColumn("_n", F.lit(1.0))
    for axis, r in radius.items():
        w = Window.partitionBy(*batch, *[a for a in axes if a != axis]).orderBy(axis).rowsBetween(-r, r)
        out = out.withColumns({value: F.sum(value).over(w), "_n": F.sum("_n").over(w)})
    return out.withColumn(value, F.col(value) / F.col("_n")).drop("_n")


def correlate_nd(rows: DataFrame, axes: Sequence[str], kernels: dict[str, Sequence[Tap]], batch: Sequence[str] = (), value: str = "value", padding: str = "constant") -> DataFrame:
    """For each place the batch and axis columns, and a column for each kernel: the weighted sum of its taps. padding: constant (0), periodic or mirror.

    All kernels share one gathering of the offsets that any of them has.
    """
    extent = [(F.max(a) + 1).alias(f"_n_{a}") for a in axes]
    if batch:
        sized = rows.join(rows.groupBy(*batch).agg(*extent), list(batch))
    else:
        sized = rows.withColumns({name: F.lit(n) for name, n in rows.agg(*extent).first().asDict().items()})
    offsets = sorted({o for own in kernels.values() for o, _ in own})
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(x).alias(f"o{n}") for n, x in enumerate(o)]) for k, o in enumerate(offsets)]))
    asked = sized.select(*batch, *axes, *[f"_n_{a}" for a in axes], steps.alias("_s"))
    asked = asked.select(*batch, *axes, "_s.k", *[_inside(F.col(a) + F.col(f"_s.o{n}"), F.col(f"_n_{a}"), padding).alias(f"_at_{a}") for n, a in enumerate(axes)])
    there = rows.select(*batch, *[F.col(a).cast("long").alias(f"_at_{a}") for a in axes], F.col(value).alias("_v"))
    met = asked.join(there, [*batch, *[f"_at_{a}" for a in axes]], "left")

    def summed(taps: Sequence[Tap]) -> Column:
        weight = F.create_map(*[F.lit(x) for o, t in taps for x in (offsets.index(o), float(t))])
        return F.sum(F.coalesce(F.try_element_at(weight, F.col("k")), F.lit(0.0)) * F.coalesce(F.col("_v"), F.lit(0.0)))

    return met.groupBy(*batch, *axes).agg(*[summed(taps).alias(name) for name, taps in kernels.items()])


def aggregate_axis(rows: DataFrame, axis: str, weights: dict[str, Sequence[float]], keep: Sequence[str], value: str = "value") -> DataFrame:
    """The keep columns and a column for each list of weights: the sum along the axis of the values times the weight of their place; the axis is gone."""
    own = [F.sum(F.coalesce(F.get(F.array(*[F.lit(float(x)) for x in w]), F.col(axis)), F.lit(0.0)) * F.col(value)).alias(name) for name, w in weights.items()]
    return rows.groupBy(*keep).agg(*own)
