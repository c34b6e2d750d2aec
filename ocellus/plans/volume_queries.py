"""Queries over three axes, of coverage by triangles and lines, and of decompositions with a planted texture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.operators import axes, coverage, intrinsic
from ocellus.operators.raster import CELL
from ocellus.plans.registry import Registry, with_
from ocellus.plans.standins import IMAGES, H, W, points, raster, raster_sql

R = Registry()
CELLS = raster_sql()

# --- three axes: the images of a block of orders are the layers of a volume

AXES = ["z", "i", "j"]


def _volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).select(F.floor(F.col("img") / IMAGES).cast("int").alias("b"), (F.col("img") % IMAGES).alias("z"), "i", "j", "value")


_VOLUME = f"vol AS (SELECT CAST(img // {IMAGES} AS INT) AS b, CAST(img % {IMAGES} AS INT) AS z, i, j, value FROM cells)"
_NEAR = """near AS (SELECT c.b, c.z, c.i, c.j, a.d AS dz, e.d AS di, f.d AS dj, n.value AS v FROM vol c CROSS JOIN (SELECT unnest(range(-1, 2)) AS d) a CROSS JOIN (SELECT unnest(range(-1, 2)) AS d) e
  CROSS JOIN (SELECT unnest(range(-1, 2)) AS d) f LEFT JOIN vol n ON n.b = c.b AND n.z = c.z + a.d AND n.i = c.i + e.d AND n.j = c.j + f.d)"""
_OUT = lambda df, *names: df.select("b", *AXES, *[(F.round(n, 5) + 0.0).alias(n) for n in names])
_GAUSS = [0.25, 0.5, 0.25]
R.add("gauss_3d", lambda s, d: _OUT(axes.separable_nd(_volume(s, d), dict.fromkeys(AXES, _GAUSS), ["b"]), "value"),
      with_(CELLS, _VOLUME, _NEAR) + "SELECT b, z, i, j, round(sum(coalesce(v, 0) * (2 - abs(dz)) * (2 - abs(di)) * (2 - abs(dj)) / 64.0::DOUBLE), 5) + 0.0 AS value FROM near GROUP BY b, z, i, j")
R.add("box_3d", lambda s, d: _OUT(axes.box_nd(_volume(s, d), dict.fromkeys(AXES, 1), ["b"]), "value"), with_(CELLS, _VOLUME, _NEAR) + "SELECT b, z, i, j, round(avg(v), 5) + 0.0 AS value FROM near GROUP BY b, z, i, j")
_KERNELS = {"edge": [((-1, 0, 0), -1.0), ((1, 0, 0), 1.0), ((0, 1, 1), 0.5)], "corner": [((0, -1, 0), 1.0), ((0, 0, 1), -2.0), ((1, 1, 1), 1.0)]}


def _mirrored(x: str, n: int) -> str:
    return f"CASE WHEN ({x} + {2 * n}) % {2 * n} < {n} THEN ({x} + {2 * n}) % {2 * n} ELSE {2 * n - 1} - ({x} + {2 * n}) % {2 * n} END"


def _kernels_sql() -> str:
    taps = " UNION ALL ".join(f"SELECT '{name}' AS k, {o[0]} AS dz, {o[1]} AS di, {o[2]} AS dj, {w}::DOUBLE AS w" for name, own in _KERNELS.items() for o, w in own)
    places = " AND ".join(f"n.{a} = {_mirrored(f'c.{a} + t.d{a}', n)}" for a, n in (("z", IMAGES), ("i", H), ("j", W)))
    sums = ", ".join(f"round(coalesce(sum(t.w * n.value) FILTER (WHERE t.k = '{name}'), 0), 5) + 0.0 AS {name}" for name in _KERNELS)
    return with_(CELLS, _VOLUME, f"t AS ({taps})") + f"SELECT c.b, c.z, c.i, c.j, {sums} FROM vol c CROSS JOIN t JOIN vol n ON n.b = c.b AND {places} GROUP BY c.b, c.z, c.i, c.j"


R.add("kernels_3d", lambda s, d: _OUT(axes.correlate_nd(_volume(s, d), AXES, _KERNELS, ["b"], padding="mirror"), *_KERNELS), _kernels_sql())
R.add("aggregate_axis", lambda s, d: axes.aggregate_axis(_volume(s, d), "z", {"sum": [1.0] * IMAGES, "slope": [-1.5, -0.5, 0.5, 1.5]}, ["b", "i", "j"]),
      with_(CELLS, _VOLUME) + "SELECT b, i, j, sum(value) AS sum, sum((z - 1.5::DOUBLE) * value) AS slope FROM vol GROUP BY b, i, j")

# --- coverage: triangles and lines from the points' numbers


def _triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = {"ya": F.col("x") / 40, "xa": F.col("y") / 40, "yb": F.col("z") / 40, "xb": F.col("x") / 50 + 3, "yc": F.col("y") / 45 - 2, "xc": F.col("z") / 35}
    return points(spark, sf_dir).select("pt", *[c.alias(n) for n, c in corner.items()])


_TRIANGLES = """tri AS (SELECT vec_id AS pt, x / 40 AS ya, y / 40 AS xa, z / 40 AS yb, x / 50 + 3 AS xb, y / 45 - 2 AS yc, z / 35 AS xc
  FROM (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 1000, 0) + 0.0 AS x, round(CAST(embedding[2] AS DOUBLE) * 1000, 0) + 0.0 AS y, round(CAST(embedding[3] AS DOUBLE) * 1000, 0) + 0.0 AS z FROM embeddings))"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _triangles(spark, sf_dir)
    made = coverage.polygon_cells(rows.select("pt", coverage.triangle_ring(["ya", "xa", "yb", "xb", "yc", "xc"]).alias("ring")))
    moments = [F.sum("weight").alias("area"), F.count_if(F.col("weight") > 1 - 1e-9).alias("whole"), F.max("weight").alias("most")]
    made = made.groupBy("pt").agg(*moments)
    return made.select("pt", (F.round(F.col("area") + 1e-7, 5) + 0.0).alias("area"), (F.col("most") <= 1 + 1e-9).alias("within"), (F.col("whole") <= F.col("area") + 1e-6).alias("inside"))


_AREA = "abs((xb - xa) * (yc - ya) - (xc - xa) * (yb - ya)) / 2"
R.add("triangle_coverage", _covered, with_(_TRIANGLES) + f"SELECT pt, round({_AREA} + 1e-7, 5) + 0.0 AS area, true AS within, true AS inside FROM tri WHERE {_AREA} > 0")


def _line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _triangles(spark, sf_dir)
    made = coverage.polygon_cells(rows.select("pt", coverage.line_ring("ya", "xa", "yb", "xb").alias("ring")).where("ring IS NOT NULL"))
    return made.groupBy("pt").agg((F.round(F.sum("weight"), 5) + 0.0).alias("length"))


R.add("line_coverage", _line_coverage, with_(_TRIANGLES) + "SELECT pt, round(sqrt((yb - ya) ** 2 + (xb - xa) ** 2), 5) + 0.0 AS length FROM tri WHERE ya <> yb OR xa <> xb")

# --- a texture of two paints in checks, under a lamp; the images' own values flicker the light

_PAINTS, _SPREAD = ((0.8, 0.3, 0.2), (0.2, 0.5, 0.7)), 900.0


def _painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lamp = 0.4 + 0.6 * F.exp(-((F.col("i") - 16) * (F.col("i") - 16) + (F.col("j") - 24) * (F.col("j") - 24)) / _SPREAD)
    first = (F.floor(F.col("i") / 3) + F.floor(F.col("j") / 3)) % 2 == 0
    rows = raster(spark, sf_dir).withColumn("light", lamp * (1 + 1e-4 * F.col("value")))
    return rows.select(*CELL, *[(255 * F.col("light") * F.when(first, p).otherwise(q)).alias(c) for c, p, q in zip("rgb", *_PAINTS, strict=True)], "light")


def _decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _painted(spark, sf_dir)
    links = intrinsic.texture_links(rows, 0.01).groupBy(F.col("img").alias("_img")).agg(F.count("*").alias("links"))
    made = intrinsic.retinex_with_texture(rows, 0.05).select(*CELL, "shading").join(rows.select(*[F.col(c).alias(c) for c in (*CELL, "light")]), CELL)
    gap = made.select("img", (F.log("shading") - F.log("light")).alias("e"))
    spread = gap.groupBy("img").agg((F.stddev_pop("e") < 0.02).alias("close"))
    return links.join(spread, F.col("_img") == F.col("img")).select("img", "links", "close")


def _decomposed_sql() -> str:
    """Links: places inside less the different patches of paints, alike however turned."""
    order = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    turns = [order, [(b, -a) for a, b in order], [(-a, -b) for a, b in order], [(-b, a) for a, b in order]]
    patch = lambda o: " || ".join(f"CAST(((i + {a}) // 3 + (j + {b}) // 3) % 2 AS VARCHAR)" for a, b in o)
    return with_(CELLS, f"k AS (SELECT img, least({', '.join(patch(o) for o in turns)}) AS k FROM cells WHERE i BETWEEN 1 AND {H - 2} AND j BETWEEN 1 AND {W - 2})") + "SELECT img, count(*) - count(DISTINCT k) AS links, true AS close FROM k GROUP BY img"


R.add("retinex_texture", _decomposed, _decomposed_sql())


def _turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals that lean by the image's own values, and straightened again."""
    x, y = F.col("value") / 100 + 0.2, F.col("j") / 200 - 0.1
    n = F.sqrt(x * x + y * y + 1)
    rows = raster(spark, sf_dir).select(*CELL, (x / n).alias("nx"), (y / n).alias("ny"), (1 / n).alias("nz"))
    return intrinsic.rectify_normals(rows, F.col("i") % 2 == 0).select(*CELL, *[(F.round(c, 5) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


R.add("rectify_normals", _turned, with_(
    CELLS, "v AS (SELECT img, i, j, value / 100 + 0.2::DOUBLE AS x, j / 200.0::DOUBLE - 0.1::DOUBLE AS y FROM cells)",
    "n AS (SELECT img, i, j, x / sqrt(x * x + y * y + 1) AS nx, y / sqrt(x * x + y * y + 1) AS ny, 1 / sqrt(x * x + y * y + 1) AS nz FROM v)",
    "s AS (SELECT img, avg(nx) AS mx, avg(ny) AS my, avg(nz) AS mz FROM n WHERE i % 2 = 0 GROUP BY img)",
    "m AS (SELECT img, mx / l AS mx, my / l AS my, mz / l AS mz FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS l FROM s))",
    # About the axis (my, -mx, 0) by the angle of m to (0, 0, 1), by Rodrigues' formula.
    "a AS (SELECT img, mz AS c, sqrt(mx * mx + my * my) AS s, my / sqrt(mx * mx + my * my) AS ax, -mx / sqrt(mx * mx + my * my) AS ay FROM m)",
) + """SELECT img, i, j, round(nx * c + ay * nz * s + ax * (ax * nx + ay * ny) * (1 - c), 5) + 0.0 AS nx, round(ny * c - ax * nz * s + ay * (ax * nx + ay * ny) * (1 - c), 5) + 0.0 AS ny,
  round(nz * c + (ax * ny - ay * nx) * s, 5) + 0.0 AS nz FROM n JOIN a USING (img)""")  # fmt: skip
