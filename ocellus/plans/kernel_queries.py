"""Queries of sequential kernels, solvers and files. Those without SQL (seeded draws, iterations to a tolerance) are held against brute force in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ocellus.operators import sequential as q
from ocellus.operators import solve
from ocellus.plans import kernel_sql
from ocellus.plans.registry import Registry
from ocellus.plans.spatial_queries import _holes
from ocellus.plans.standins import POINTS_SQL, points, raster, table
from ocellus.plans.stereo_queries import _volume

R = Registry()
R.add("sgm", lambda s, d: q.sgm(_volume()(s, d), 10.0, 60.0))
R.add("dp_scanline", lambda s, d: q.dp_scanline(_volume()(s, d), 10.0))
R.add("fast_match", lambda s, d: q.fast_match(_volume()(s, d)))
R.add("patchmatch", lambda s, d: q.patch_match(_volume()(s, d)))
R.add("l0_fusion", lambda s, d: q.l0_fusion(raster(s, d), 20.0))
R.add("inpaint_diffusion", lambda s, d: q.inpaint_diffusion(_holes(s, d)))
R.add("fft_rows", lambda s, d: q.fft_rows(raster(s, d)).select("img", "i", "k", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im")))
_KEYS = "value > 40"
R.add("circle_descriptor", lambda s, d: q.circle_descriptors(raster(s, d), raster(s, d).where(_KEYS)).select("img", "i", "j", F.round(F.get("f", F.lit(0)), 4).alias("f0"), F.size("f").alias("n")))
_PAIRS = [(a, b, b, -a) for a in range(-3, 4) for b in range(-3, 4) if (a, b) != (0, 0)][:40]
R.add("brief", lambda s, d: q.brief(raster(s, d), raster(s, d).where(_KEYS), _PAIRS).select("img", "i", "j", F.get("words", F.lit(0)).alias("w0"), F.get("words", F.lit(1)).alias("w1")))
R.add("line_pixels", lambda s, d: q.rasterise_lines(table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("line"), F.lit(0).alias("i0"), F.col("n_regionkey").cast("int").alias("j0"), F.col("n_nationkey").cast("int").alias("i1"), F.lit(9).alias("j1"))))
R.add("mean_shift", lambda s, d: q.mean_shift(points(s, d), ["x", "y", "z"], 80.0).select("pt", *[F.round(c, 3).alias(c) for c in "xyz"]))


def _lines(s, d):
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k"))


def _sixth(c):
    """Six decimals by the arithmetic of the SQL; Spark's round() goes by the number's decimal text, and exact halves are frequent here."""
    v = F.col(c) * 1e6
    return (F.signum(v) * F.floor(F.abs(v) + 0.5) / 1e6 + 0.0).alias(c)


def _rounded(found, *names):
    return found.select("g", *[_sixth(c) for c in names], *[c for c in found.columns if c not in ("g", *names)])


R.add("ransac", lambda s, d: _rounded(solve.ransac_lines(_lines(s, d), 20, 5.0), "slope", "intercept"), kernel_sql.RANSAC)
R.add("lmeds", lambda s, d: _rounded(solve.lmeds_lines(_lines(s, d), 20), "slope", "intercept", "median"), kernel_sql.LMEDS)
R.add("l1", lambda s, d: solve.l1_lines(_lines(s, d)))


def _vector(s, values):
    return s.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(values)], "k int, value double")


def _xy():
    return F.col("l_quantity"), F.col("l_extendedprice") / 1000


R.add("pca", lambda s, d: _vector(s, solve.pca(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])[0]))
R.add("gauss_newton", lambda s, d: _vector(s, solve.gauss_newton(table(s, d, "lineitem"), lambda p: p[0] * _xy()[0] + p[1] - _xy()[1], lambda p: [_xy()[0], F.lit(1.0)], [1.0, 0.0])))
R.add("gauss_newton_huber", lambda s, d: _vector(s, solve.gauss_newton(table(s, d, "lineitem"), lambda p: p[0] * _xy()[0] + p[1] - _xy()[1], lambda p: [_xy()[0], F.lit(1.0)], [1.0, 0.0], weight=lambda r: F.when(F.abs(r) <= 5, 1.0).otherwise(5 / F.abs(r)), steps=20)))
def _bfgs(s, d):
    def off(p):
        x, y = _xy()
        return p[0] * x / 50 + p[1] - y / 50

    rows = table(s, d, "lineitem")
    return _vector(s, solve.l_bfgs(rows, lambda p: off(p) * off(p) / 1000, lambda p: [off(p) * _xy()[0] / 25000, off(p) / 500], [0.0, 0.0]))


R.add("l_bfgs", _bfgs)


def _costs(s, d):
    o = table(s, d, "orders")
    return o.groupBy((F.col("o_custkey") % 25).alias("g"), (F.col("o_orderkey") % 6).alias("a"), (F.col("o_orderkey") / 7 % 8).cast("bigint").alias("b")).agg(F.min("o_totalprice").alias("cost"))


R.add("assignment", lambda s, d: solve.assignment(_costs(s, d)))
R.add("assign_extend", lambda s, d: solve.with_non_matches(_costs(s, d), 100.0), """WITH c AS (SELECT o_custkey % 25 AS g, o_orderkey % 6 AS a, CAST(trunc(o_orderkey / 7 % 8) AS BIGINT) AS b, min(o_totalprice) AS cost FROM orders GROUP BY ALL)
SELECT g, a, b, cost FROM c UNION ALL SELECT DISTINCT g, a, -1 - a, 100.0 FROM c""")


def _round_trip(kind, schema, columns):
    def run(s, d):
        from ocellus.sources.readers import decode_points, encode_points

        p = points(s, d).select(*[c.alias(n) for n, c in columns().items()])
        return decode_points(encode_points(p, kind), kind, schema)

    return run


R.add("pcd_roundtrip", _round_trip("pcd", "x double, y double, z double, cluster int", lambda: {**{c: F.col(c) for c in "xyz"}, "cluster": F.col("cluster")}), "WITH " + POINTS_SQL + " SELECT x, y, z, CAST(cluster AS INT) AS cluster FROM points")
R.add(
    "las_roundtrip",
    _round_trip(
        "las",
        "x double, y double, z double, red int, green int, blue int",
        lambda: {**{c: F.col(c) for c in "xyz"}, "red": F.col("cluster"), "green": F.col("cluster") * 2, "blue": F.col("cluster") * 3},
    ),
    "WITH " + POINTS_SQL + " SELECT x, y, z, CAST(cluster AS INT) AS red, CAST(cluster * 2 AS INT) AS green, CAST(cluster * 3 AS INT) AS blue FROM points",
)
R.add("sdc_roundtrip", _round_trip("sdc", "x double, y double, z double, amplitude int", lambda: {**{c: F.col(c) for c in "xyz"}, "amplitude": F.col("cluster")}), "WITH " + POINTS_SQL + " SELECT x, y, z, CAST(cluster AS INT) AS amplitude FROM points")


def _ties(s, d):
    """Points before two cameras, the second turned and moved."""
    import numpy as np
    from ocellus.operators.pose import rotation

    r, t = rotation(np.array([0.02, -0.05, 0.01])), np.array([-0.4, 0.1, 0.05])
    p = points(s, d).select("pt", (F.col("x") / 200).alias("x"), (F.col("y") / 200).alias("y"), (F.col("z") / 200 + 5).alias("z"))
    moved = [sum((float(r[k, c]) * F.col(n) for c, n in enumerate("xyz")), F.lit(float(t[k]))) for k in range(3)]
    q = p.select("*", *[m.alias(f"{n}2") for m, n in zip(moved, "xyz", strict=True)])
    return q.select("pt", "x", "y", "z", F.col("x2").alias("bx"), F.col("y2").alias("by"), F.col("z2").alias("bz"), (F.col("x") / F.col("z")).alias("x1"), (F.col("y") / F.col("z")).alias("y1"), (F.col("x2") / F.col("z2")).alias("x2"), (F.col("y2") / F.col("z2")).alias("y2"))


def _posed(s, d):
    from ocellus.operators import pose

    ties = _ties(s, d)
    r, t = pose.select_pose(ties, pose.essential(ties))
    return _vector(s, [float(v) + 0.0 for v in (*r.ravel(), *t)])


def _rectified(s, d):
    import numpy as np
    from ocellus.operators import pose

    a, b = pose.rectify(pose.rotation(np.array([0.02, -0.05, 0.01])), np.array([-0.4, 0.1, 0.05]))
    return _vector(s, [float(v) + 0.0 for v in (*a.ravel(), *b.ravel())])


def _similar(s, d):
    from ocellus.operators import pose

    k, r, t = pose.similarity(_ties(s, d).select("x", "y", "z", (2 * F.col("bx") + 1).alias("x2"), (2 * F.col("by")).alias("y2"), (2 * F.col("bz")).alias("z2")))
    return _vector(s, [k, *r.ravel(), *t])


def _pnp(s, d):
    from ocellus.operators import pose

    v = _ties(s, d).select((F.col("pt") % 10).alias("g"), "x", "y", "z", F.col("x2").alias("u"), F.col("y2").alias("v"))
    return pose.pnp(v).select("g", *[F.round(F.get("t", F.lit(k)), 4).alias(f"t{k}") for k in range(3)])


R.add("essential", _posed)
R.add("rectify", _rectified)
R.add("similarity_align", _similar)
R.add("pnp", _pnp)


def _segmented(f):
    from ocellus.operators import segmentation

    return lambda s, d: f(segmentation, raster(s, d))


R.add("min_cut_mask", _segmented(lambda m, x: m.min_cut_masks(x, 25.0, 4.0)))
R.add("hierarchical_mask", _segmented(lambda m, x: m.hierarchical_masks(x, 25.0, 4.0)))
R.add("retinex", _segmented(lambda m, x: m.decompose(x.withColumn("value", F.col("value") + 1), 0.3)))
R.add("shape_from_shading", _segmented(lambda m, x: m.shape_from_shading(x, (0.2, 0.3, 0.93))))
R.add("checkerboard_corners", _segmented(lambda m, x: m.checkerboard_corners(x, 10.0)))

R.sql |= {
    "sgm": kernel_sql.sgm(10.0, 60.0), "dp_scanline": kernel_sql.dp_scanline(10.0), "fast_match": kernel_sql.FAST_MATCH, "fft_rows": kernel_sql.FFT_ROWS, "brief": kernel_sql.brief(_PAIRS, _KEYS),
    "circle_descriptor": kernel_sql.circle_descriptor(_KEYS, 16, 14), "line_pixels": kernel_sql.LINE_PIXELS, "pca": kernel_sql.PCA, "gauss_newton": kernel_sql.GAUSS_NEWTON, "assignment": kernel_sql.ASSIGNMENT,
    "essential": kernel_sql.ESSENTIAL, "similarity_align": kernel_sql.SIMILARITY, "pnp": kernel_sql.PNP, "mean_shift": kernel_sql.MEAN_SHIFT, "gauss_newton_huber": kernel_sql.GAUSS_NEWTON_HUBER, "rectify": kernel_sql.RECTIFY, "checkerboard_corners": kernel_sql.CHECKERBOARD,
}
