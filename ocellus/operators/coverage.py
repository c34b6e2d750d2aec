"""How much of each cell a polygon or a line of some width covers: exact areas of clipped polygons, by column functions.

A cell (i, j) is the square of side 1 around that place. A polygon is cut into
the strips of rows first and each strip into cells, so the rows made are as many
as the cells covered, not as those of the box around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _turned(ring: Column) -> Column:
    """The ring from its second corner on."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def clip(ring: Column, axis: str, bound: Column, below: bool) -> Column:
    """The part of a convex ring (an array of structs y, x) on one side of a line across an axis; maybe empty."""
    inside = (lambda p: p[axis] <= bound) if below else (lambda p: p[axis] >= bound)
    other = "x" if axis == "y" else "y"
    none = F.filter(ring, lambda p: F.lit(False))

    def cut(a: Column, b: Column) -> Column:
        along = a[other] + (b[other] - a[other]) * ((bound - a[axis]) / (b[axis] - a[axis]))
        return F.struct((bound if axis == "y" else along).cast("double").alias("y"), (bound if axis == "x" else along).cast("double").alias("x"))

    def edge(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return F.when(e["p"] & e["q"], F.array(a)).when(e["p"], F.array(a, cut(a, b))).when(e["q"], F.array(cut(a, b))).otherwise(none)

    sides = F.zip_with(ring, _turned(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b"), inside(a).alias("p"), inside(b).alias("q")))
    return F.flatten(F.transform(sides, edge))


def area(ring: Column) -> Column:
    """The area of a ring, by its corners' cross products; 0 of less than three."""
    crossed = F.zip_with(ring, _turned(ring), lambda a, b: a["x"] * b["y"] - a["y"] * b["x"])
    return F.abs(F.aggregate(crossed, F.lit(0.0), lambda acc, v: acc + v)) / 2


def _between(rows: DataFrame, axis: str, place: str) -> DataFrame:
    """A row for each place along an axis that the ring reaches, with the ring clipped to it."""
    least, most = (f(F.transform("_ring", lambda p: p[axis])) for f in (F.array_min, F.array_max))
    rows = rows.where(F.size("_ring") > 2).withColumn(place, F.explode(F.sequence(F.floor(least + 0.5).cast("int"), F.ceil(most - 0.5).cast("int"))))
    rows = rows.withColumn("_ring", clip(F.col("_ring"), axis, F.col(place) - 0.5, False))
    return rows.withColumn("_ring", clip(F.col("_ring"), axis, F.col(place) + 0.5, True))


def polygon_cells(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """The polygons' other columns, i, j and weight: the area of each cell that a convex polygon (an array of structs y, x, either way round) covers."""
    keep = [c for c in polygons.columns if c != ring]
    point = lambda p: F.struct(p["y"].cast("double").alias("y"), p["x"].cast("double").alias("x"))
    least = lambda axis: F.array_max(F.transform(ring, lambda p: p[axis])) > F.array_min(F.transform(ring, lambda p: p[axis]))
    rows = polygons.where(least("y") & least("x")).select(*keep, F.transform(ring, point).alias("_ring"))
    cells = _between(_between(rows, "y", "i"), "x", "j")
    return cells.select(*keep, "i", "j", area(F.col("_ring")).alias("weight")).where("weight > 0")


def triangle_ring(names: list[str]) -> Column:
    """A ring from the names of three corners' columns, y and x in turn."""
    return F.array(*[F.struct(F.col(names[2 * k]).cast("double").alias("y"), F.col(names[2 * k + 1]).cast("double").alias("x")) for k in range(3)])


def line_ring(i0: str, j0: str, i1: str, j1: str, width: float = 1.0) -> Column:
    """The rectangle of a width around a line; of a point, null."""
    dy, dx = F.col(i1) - F.col(i0), F.col(j1) - F.col(j0)
    length = F.nullif(F.sqrt(dy * dy + dx * dx), F.lit(0.0))
    ny, nx = dx / length * (width / 2), -dy / length * (width / 2)
    corners = [(F.col(i) + s * ny, F.col(j) + s * nx) for i, j, s in ((i0, j0, 1), (i1, j1, 1), (i1, j1, -1), (i0, j0, -1))]
    return F.when(length.isNotNull(), F.array(*[F.struct(y.alias("y"), x.alias("x")) for y, x in corners]))
