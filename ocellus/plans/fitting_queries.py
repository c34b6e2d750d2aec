"""Queries of consensus fits and ray alignments with planted models among the tables' own numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.functions import geometry as g
from ocellus.operators import pose, rays, robust, segmentation
from ocellus.operators.pose import rotation
from ocellus.plans.registry import Registry, with_
from ocellus.plans.standins import POINTS_SQL, H, W, points, raster, raster_sql, table

R = Registry()
TRIALS, SEED = 20, 1

# --- planes: seven of ten points stand on one, to the nearest whole number

_ON = "CASE WHEN pt % 10 < 7 THEN round(0.2::DOUBLE * x - 0.3::DOUBLE * y + 5) ELSE z END"
_PLANE_POINTS = f"p AS (SELECT pt, x, y, {_ON} + 0.0 AS z FROM points)"


def _plane_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.round(0.2 * F.col("x") - 0.3 * F.col("y") + 5)
    return points(spark, sf_dir).withColumn("z", F.when(F.col("pt") % 10 < 7, own).otherwise(F.col("z")) + 0.0)


def _draws_sql(n: int) -> str:
    p = robust.PRIME
    return f"""seeds AS (SELECT p.*, t AS trial, (pt % {p} * 7919 + t * 104729 + {SEED}) % {p} AS s FROM p CROSS JOIN range({TRIALS}) r(t)),
drawn AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY (s * s % {p} * 48271 + s) % {p} DESC, pt) AS k FROM seeds QUALIFY k <= {n})"""


_PLANES = f"""{_draws_sql(3)},
three AS (SELECT trial, {', '.join(f'max({c}) FILTER (WHERE k = {k}) AS {c}{k}' for k in (1, 2, 3) for c in 'xyz')} FROM drawn GROUP BY trial),
normals AS (SELECT trial, x1, y1, z1, (y2 - y1) * (z3 - z1) - (z2 - z1) * (y3 - y1) AS a, (z2 - z1) * (x3 - x1) - (x2 - x1) * (z3 - z1) AS b, (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1) AS c FROM three),
planes AS (SELECT trial, a / n AS a, b / n AS b, c / n AS c, -(a * x1 + b * y1 + c * z1) / n AS d FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM normals) WHERE n >= 1e-9),
errors AS (SELECT trial, abs(a * x + b * y + c * z + d) AS e FROM planes CROSS JOIN p)"""


def _said(spark: SparkSession, found: robust.Found, names: str) -> DataFrame:
    values = ", ".join(f"CAST({round(v, 5) + 0.0!r} AS DOUBLE) AS {n}" for n, v in zip(names.split(), found.model, strict=True))
    return spark.range(1).selectExpr(f"CAST({found.trial} AS INT) AS trial", *values.split(", "), f"CAST({round(found.score, 5)!r} AS DOUBLE) AS score")


def _fit_plane(how, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _said(spark, how(_plane_points(spark, sf_dir), "pt", ["x", "y", "z"], 3, robust.plane, robust.plane_distance, trials=TRIALS, seed=SEED, **options), "a b c d")

    return run


_BEST_PLANE = "SELECT CAST(trial AS INT) AS trial, round(a, 5) + 0.0 AS a, round(b, 5) + 0.0 AS b, round(c, 5) + 0.0 AS c, round(d, 5) + 0.0 AS d, CAST(round(score, 5) AS DOUBLE) AS score FROM scored JOIN planes USING (trial) ORDER BY {} LIMIT 1"
R.add("ransac_plane", _fit_plane(robust.consensus, threshold=1.0), with_(POINTS_SQL, _PLANE_POINTS, _PLANES, "scored AS (SELECT trial, count(*) FILTER (WHERE e < 1.0) AS score FROM errors GROUP BY trial)") + _BEST_PLANE.format("score DESC, trial"))
R.add("lmeds_plane", _fit_plane(robust.least_median), with_(POINTS_SQL, _PLANE_POINTS, _PLANES, "scored AS (SELECT trial, list(e ORDER BY e)[CAST(count(*) // 2 AS INT) + 1] AS score FROM errors GROUP BY trial)") + _BEST_PLANE.format("score, trial"))

# --- a homography that three of four points follow

_H = [1.1, 0.05, 20.0, -0.04, 0.95, -10.0, 1e-4, -5e-5, 1.0]


def _carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    over = _H[6] * F.col("x") + _H[7] * F.col("y") + 1
    off = F.when(F.col("pt") % 4 == 3, F.lit(50.0) + F.abs("z") % 97).otherwise(0.0)
    u, v = ((_H[3 * k] * F.col("x") + _H[3 * k + 1] * F.col("y") + _H[3 * k + 2]) / over for k in (0, 1))
    return rows.select("pt", "x", "y", (u + off).alias("u"), (v - off).alias("v"))


def _homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _carried(spark, sf_dir)
    found = robust.consensus(rows, "pt", ["x", "y", "u", "v"], 4, robust.homography, robust.transfer_distance, 0.5, trials=TRIALS, seed=SEED)
    said = ", ".join(f"struct({k} AS k, CAST({round(v, 6) + 0.0!r} AS DOUBLE) AS value)" for k, v in enumerate(found.model))
    return spark.range(1).selectExpr(f"explode(array({said})) AS m").selectExpr("CAST(m.k AS INT) AS k", "m.value AS value", f"CAST({found.score} AS BIGINT) AS inliers")


R.add("ransac_homography", _homography, "SELECT CAST(k AS INT) AS k, value, (SELECT count(*) FROM embeddings WHERE vec_id % 4 < 3) AS inliers FROM (VALUES " + ", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in enumerate(_H)) + ") AS m(k, value)")

# --- rays: of each vector's numbers a point, and lines through it seen from two frames

_TURN, _SHIFT = rotation(np.array([0.3, -0.2, 0.5])), np.array([0.5, -0.25, 0.75])


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


def _three(at: int, *more: float) -> Column:
    return F.array(*[4 * F.get("e", F.lit(at + k)) + x for k, x in enumerate(more or (0.0, 0.0, 0.0))])


def _rays(spark: SparkSession, sf_dir: str, astray: bool = False) -> DataFrame:
    """Pairs of rays that meet under the planted pose; with astray, each fifth is shifted off."""
    rows = _numbers(spark, sf_dir).select("vec_id", _three(0).alias("o"), _three(3, 0.0, 0.0, 1.0).alias("d"), _three(6, 0.0, 1.0, 0.0).alias("e2"))
    r, t = F.array(*[F.lit(float(x)) for x in _TURN.ravel()]), F.array(*[F.lit(float(x)) for x in _SHIFT])
    met = g.add(g.apply(r, g.add(F.col("o"), g.scale(F.col("d"), 2.0))), t)
    off = F.array(*[F.when(F.col("vec_id") % 5 == 0, x).otherwise(0.0) for x in (0.3, -0.4, 0.2)]) if astray else F.array(*[F.lit(0.0)] * 3)
    rows = rows.withColumn("p", g.add(g.add(met, g.scale(F.col("e2"), -1.5)), off))
    return rows.select("vec_id", *[F.get(c, F.lit(k)).alias(f"{n}{x}") for n, c in (("o", "o"), ("d", "d"), ("p", "p"), ("e", "e2")) for k, x in enumerate("xyz")])


def _values(spark: SparkSession, values: np.ndarray, n: int) -> DataFrame:
    said = ", ".join(f"struct({k} AS k, CAST({round(float(v), 6) + 0.0!r} AS DOUBLE) AS value)" for k, v in enumerate(values))
    return spark.range(1).selectExpr(f"explode(array({said})) AS m").selectExpr("CAST(m.k AS INT) AS k", "m.value AS value", f"CAST({n} AS BIGINT) AS n")


def _values_sql(values: np.ndarray) -> str:
    return "SELECT CAST(k AS INT) AS k, value, (SELECT count(*) FROM embeddings) AS n FROM (VALUES " + ", ".join(f"({k}, {round(float(v), 6) + 0.0!r}::DOUBLE)" for k, v in enumerate(values)) + ") AS m(k, value)"


def _aligned(how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _rays(spark, sf_dir)
        r, t = how(rows)
        return _values(spark, np.concatenate([r.ravel(), t]), rows.count())

    return run


def _robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rays(spark, sf_dir, astray=True)
    r, t = rays.align_robust(rows, 1e-3)
    met = rows.where("vec_id % 5 <> 0").agg(F.count_if(F.abs(rays.miss(r, t)) < 5e-3).alias("met"))
    return met.select(F.lit(bool(np.abs(r - _TURN).max() < 5e-3)).alias("turned"), F.lit(bool(np.abs(t - _SHIFT).max() < 5e-3)).alias("shifted"), "met")


_POSE_SQL = _values_sql(np.concatenate([_TURN.ravel(), _SHIFT]))
R.add("rays_relaxed", _aligned(rays.align_relaxed), _POSE_SQL)
R.add("rays_aligned", _aligned(rays.align), _POSE_SQL)
R.add("rays_robust", _robust, "SELECT true AS turned, true AS shifted, count(*) AS met FROM embeddings WHERE vec_id % 5 <> 0")


def _axis_pairs(spark: SparkSession, sf_dir: str, astray: bool = False) -> DataFrame:
    """Directions that the planted turn carries into frames of which a known turn and shift lead from one to the other."""
    rows = _numbers(spark, sf_dir).select("vec_id", _three(0, 0.0, 0.0, 1.0).alias("a"), g.rodrigues(_three(3)).alias("r12"), _three(6, 1.0, 0.0, 0.0).alias("t"))
    back = F.array(*[F.lit(float(x)) for x in _TURN.T.ravel()])
    ray = g.add(g.scale(g.apply(F.col("r12"), F.col("a")), 1.5), g.scale(F.col("t"), 0.7))
    off = F.array(*[F.when(F.col("vec_id") % 5 == 0, x).otherwise(0.0) for x in (0.3, -0.4, 0.2)]) if astray else F.array(*[F.lit(0.0)] * 3)
    return rows.select("vec_id", g.apply(back, F.col("a")).alias("v1"), g.apply(back, g.add(ray, off)).alias("v2"), "r12", "t")


def _turned(how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _axis_pairs(spark, sf_dir)
        return _values(spark, how(rows).ravel(), rows.count())

    return run


def _turned_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _axis_pairs(spark, sf_dir, astray=True)
    x = rays.axis_robust(rows, 1e-3)
    met = rows.where("vec_id % 5 <> 0").agg(F.count_if(F.abs(rays.axis_miss(x)) < 5e-3).alias("met"))
    return met.select(F.lit(bool(np.abs(x - _TURN).max() < 5e-3)).alias("turned"), "met")


R.add("rays_axis_relaxed", _turned(rays.axis_relaxed), _values_sql(_TURN.ravel()))
R.add("rays_axis", _turned(rays.align_axis), _values_sql(_TURN.ravel()))
R.add("rays_axis_robust", _turned_robust, "SELECT true AS turned, count(*) AS met FROM embeddings WHERE vec_id % 5 <> 0")


# --- maps of points, projections of an image into another camera, and the light of a map of normals

_A = np.array([[1.2, 0.1, -0.3], [0.05, 0.9, 0.2], [-0.1, 0.15, 1.1]])
_OFF = np.array([5.0, -7.0, 3.0])


def _tied(spark: SparkSession, sf_dir: str, a: np.ndarray) -> DataFrame:
    """Points and where a map takes them."""
    moved = [(sum(float(a[k, c]) * F.col(n) for c, n in enumerate("xyz")) + float(_OFF[k])).alias(f"{n}2") for k, n in enumerate("xyz")]
    return points(spark, sf_dir).select("x", "y", "z", *moved)


def _mapped(how, a: np.ndarray):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ties = _tied(spark, sf_dir, a)
        return _values(spark, np.concatenate([np.ravel(x) for x in how(ties)]), ties.count())

    return run


R.add("affine_map", _mapped(pose.affine_map, _A), _values_sql(np.concatenate([_A.ravel(), _OFF])))
R.add("quasi_similarity", _mapped(pose.quasi_similarity, 1.5 * _TURN), _values_sql(np.concatenate([[1.5], _TURN.ravel(), _OFF])))
R.add("scale_and_translation", _mapped(pose.scale_and_translation, 1.5 * np.eye(3)), _values_sql(np.concatenate([[1.5], _OFF])))

_STEP = (0.5, -0.25, 0.0)


def _seen_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image from a camera that stands aside, at depths of its own values."""
    rows = raster(spark, sf_dir)
    depth = rows.select("img", "i", "j", (F.col("value") / 10 + 2).alias("depth"))
    return pose.reprojected_image(rows, depth, np.eye(3), np.array(_STEP), 20.0)


R.add("reprojected_image", _seen_from, with_(raster_sql()) + f"""SELECT c.img, c.i, c.j, m.value FROM cells c LEFT JOIN (SELECT img, i, j, arg_min(value, (depth, value)) AS value FROM (
  SELECT img, value, value / 10 + 2 AS depth, CAST(round(((i - {(H - 1) / 2}::DOUBLE) / 20 * (value / 10 + 2) + {_STEP[1]}::DOUBLE) / (value / 10 + 2) * 20 + {(H - 1) / 2}::DOUBLE) AS INT) AS i,
    CAST(round(((j - {(W - 1) / 2}::DOUBLE) / 20 * (value / 10 + 2) + {_STEP[0]}::DOUBLE) / (value / 10 + 2) * 20 + {(W - 1) / 2}::DOUBLE) AS INT) AS j FROM cells) GROUP BY img, i, j) m
  ON m.img = c.img AND m.i = c.i AND m.j = c.j""")

_LIGHT = np.array([0.2, 0.3, 0.93]) / np.linalg.norm([0.2, 0.3, 0.93])


def _light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals that lean by the image's own values and places, lit by a planted lamp."""
    x, y = F.col("value") / 40 - 0.6, (F.col("j") + F.col("i")) / 40 - 1
    n = F.sqrt(x * x + y * y + 1)
    rows = raster(spark, sf_dir).select("img", (x / n).alias("nx"), (y / n).alias("ny"), (1 / n).alias("nz"))
    lit = rows.withColumn("value", sum(float(k) * F.col(c) for k, c in zip(_LIGHT, ("nx", "ny", "nz"), strict=True)))
    return segmentation.light_direction(lit).select("img", *[(F.round(c, 6) + 0.0).alias(c) for c in ("lx", "ly", "lz")])


R.add("light_direction", _light, with_(raster_sql()) + f"SELECT DISTINCT img, {', '.join(f'{round(float(v), 6)!r}::DOUBLE AS {c}' for v, c in zip(_LIGHT, ('lx', 'ly', 'lz'), strict=True))} FROM cells")
