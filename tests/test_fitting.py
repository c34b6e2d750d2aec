"""Consensus fits, ray alignment, decompositions, filters over many axes and coverage, against brute force and planted answers."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from ocellus.operators import axes, coverage, intrinsic, rays, robust
from ocellus.operators.pose import rotation
from pyspark.sql import functions as F


def _plane_rows(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(-50, 50, (2, n))
    z = 0.5 * x - 0.2 * y + 3 + rng.normal(0, 0.02, n)
    z[::4] = rng.uniform(-80, 80, len(z[::4]))
    made = [(int(k), float(a), float(b), float(c), float(k % 4 != 0)) for k, (a, b, c) in enumerate(zip(x, y, z, strict=True))]
    return spark.createDataFrame(made, "id long, x double, y double, z double, w double").repartition(5), np.array([r[1:4] for r in made])


def test_draws_are_the_least_keys_of_all_rows(spark):
    df, _ = _plane_rows(spark)
    got = robust.draws(df, "id", ["x", "y", "z"], 3, 7, seed=9).collect()
    u = (robust.draw_numbers(np.arange(400), 7, 9) + 1) / (robust.PRIME + 1)
    for t in range(7):
        assert sorted(r.id for r in got if r.trial == t) == sorted(np.argsort(-np.log(u[:, t]))[:3].tolist())
    # Rows of no weight are never drawn, and the shuffled rows do not grow with the table.
    assert all(r.id % 4 for r in robust.draws(df, "id", ["x"], 3, 50, weight=F.col("w")).collect())


def test_consensus_and_least_median_of_planes(spark):
    df, p = _plane_rows(spark)
    found = robust.consensus(df, "id", ["x", "y", "z"], 3, robust.plane, robust.plane_distance, 0.2, trials=30)
    m = np.array(found.model)
    assert found.score == np.count_nonzero(np.abs(p @ m[:3] + m[3]) < 0.2) >= 295
    fitted = robust.models(robust.draws(df, "id", ["x", "y", "z"], 3, 30, 1), ["x", "y", "z"], 3, robust.plane)
    medians = robust.median_errors(df, fitted, robust.plane_distance)
    for t, model in fitted.items():
        e = np.sort(np.abs(p @ np.array(model[:3]) + model[3]))
        assert medians[t] == pytest.approx(e[len(e) // 2], rel=1e-12)
    best = robust.least_median(df, "id", ["x", "y", "z"], 3, robust.plane, robust.plane_distance, trials=30)
    assert best.score == min(medians.values()) and best.model == fitted[best.trial]
    assert robust.consensus(df.limit(0), "id", ["x", "y", "z"], 3, robust.plane, robust.plane_distance, 0.2) is None
    assert robust.least_median(df.limit(2), "id", ["x", "y", "z"], 3, robust.plane, robust.plane_distance) is None


def test_homography_of_four_points():
    h = np.array([[1.2, 0.1, 5], [-0.2, 0.9, 3], [1e-3, 2e-3, 1]])
    x, y = np.array([0.0, 10, 0, 12]), np.array([0.0, 0, 9, 11])
    q = h @ np.stack([x, y, np.ones(4)])
    assert np.allclose(robust.homography(x, y, q[0] / q[2], q[1] / q[2]), h.ravel())
    assert robust.homography(np.zeros(4), y, y, y) is None


def _ray_rows(spark, n=80, astray=()):
    rng = np.random.default_rng(8)
    r, t = rotation(np.array([0.4, 0.3, -0.6])), np.array([0.7, -0.4, 0.2])
    o, d, e = rng.normal(0, 1, (3, n, 3))
    p = (o + 1.7 * d) @ r.T + t - 0.8 * e
    p[list(astray)] += 1.0
    names = ", ".join(f"{a}{c} double" for a in "odpe" for c in "xyz")
    return spark.createDataFrame([tuple(float(x) for x in row) for row in np.concatenate([o, d, p, e], axis=1)], names).repartition(3), r, t


def test_rays_meet(spark):
    df, r, t = _ray_rows(spark)
    for how in (rays.align_relaxed, rays.align):
        fr, ft = how(df)
        assert np.abs(fr - r).max() < 1e-6 and np.abs(ft - t).max() < 1e-6
    assert df.agg(F.max(F.abs(rays.miss(r, t)))).first()[0] < 1e-9
    bad, r, t = _ray_rows(spark, astray=range(0, 80, 8))
    fr, ft = rays.align_robust(bad, 1e-3)
    assert np.abs(fr - r).max() < 1e-2 and np.abs(ft - t).max() < 1e-2
    assert np.abs(rays.align_relaxed(bad)[0] - r).max() > 1e-2
    with pytest.raises(rays.NotSettled):
        rays.align(bad, (np.eye(3), np.zeros(3)), limit=1)


def test_gram_is_the_sum_of_outer_products(spark):
    a = np.random.default_rng(1).normal(0, 1, (50, 5))
    df = spark.createDataFrame([(row.tolist(), float(k)) for k, row in enumerate(a)], "a array<double>, w double").repartition(4)
    assert np.allclose(rays.gram(df, F.col("a"), 5, F.col("w")), a.T @ (a * np.arange(50)[:, None]))


def test_axis_alignment(spark):
    rng = np.random.default_rng(3)
    x = rotation(np.array([0.2, -0.5, 0.3]))
    rows = []
    for _ in range(60):
        r12, t, a = rotation(rng.normal(0, 0.5, 3)), rng.normal(0, 1, 3), rng.normal(0, 1, 3)
        b = r12 @ a * 1.3 + 0.6 * t
        rows.append(((x.T @ a).tolist(), (x.T @ b).tolist(), r12.ravel().tolist(), t.tolist()))
    df = spark.createDataFrame(rows, "v1 array<double>, v2 array<double>, r12 array<double>, t array<double>")
    assert np.abs(rays.axis_relaxed(df) - x).max() < 1e-6
    assert np.abs(rays.align_axis(df, rotation(np.array([0.3, -0.4, 0.2]))) - x).max() < 1e-7
    assert df.agg(F.max(F.abs(rays.axis_miss(x)))).first()[0] < 1e-9


def test_texture_against_a_dense_solve():
    """The image's system written out row by row and solved directly."""
    rng = np.random.default_rng(5)
    h = w = 12
    image = rng.uniform(20, 200, (h, w, 3))
    image[4:8, 4:8] = image[4, 4] * rng.uniform(0.5, 1, (4, 4, 1))
    links = np.array([(i, j, i - 1, j - 2) for i in range(2, 11) for j in range(3, 11)])
    weights, constancy, threshold = (1.0, 2.0, 500.0), 100.0, 0.05
    log, chroma, bright = np.log(image), image / image.sum(axis=2, keepdims=True), image.sum(axis=2)
    m, b = np.zeros((h * w, h * w)), np.zeros(h * w)

    def equation(p, q, shade, reflect, scale):
        u, v = p[0] * w + p[1], q[0] * w + q[1]
        for c in range(3):
            for x, y, s in ((u, v, 1), (v, u, -1)):
                m[x, x] += scale * (shade + reflect)
                m[x, y] -= scale * (shade + reflect)
                b[x] += s * scale * reflect * (log[p][c] - log[q][c])

    for i, j in itertools.product(range(h), range(w)):
        for q in ((i, j - 1), (i - 1, j)):
            if min(q) >= 0:
                same = ((chroma[i, j, :2] - chroma[q][:2]) ** 2).sum() <= threshold**2
                equation((i, j), q, 1.0, constancy * same, weights[0])
        if bright[i, j] >= 0.95 * bright.max():
            m[i * w + j, i * w + j] += weights[2]
    for i, j, pi, pj in links.tolist():
        equation((i, j), (pi, pj), 0.0, 1.0, weights[1])
    got = intrinsic.log_shading(image, links, threshold, weights, constancy)
    assert np.allclose(got.ravel(), np.linalg.solve(m, b), atol=1e-6)


def test_texture_links_hold_turned_patches(spark):
    i, j = np.mgrid[0:14, 0:14]
    paint = np.where(((i // 2 + j // 2) % 2 == 0)[:, :, None], [0.7, 0.2, 0.1], [0.1, 0.3, 0.6]) * np.exp(-0.05 * i)[:, :, None] * 200
    cells = spark.createDataFrame([(0, int(a), int(b), *map(float, paint[a, b])) for a, b in zip(i.ravel(), j.ravel(), strict=True)], "img int, i int, j int, r double, g double, b double")
    links = intrinsic.texture_links(cells, 0.01)
    kinds = {min(tuple(np.rot90((((i // 2 + j // 2) % 2)[a - 1 : a + 2, b - 1 : b + 2]), k).ravel()) for k in range(4)) for a in range(1, 13) for b in range(1, 13)}
    assert links.count() == 144 - len(kinds)

    def spread(texture):
        made = intrinsic.retinex_with_texture(cells, 0.05, weights=(1.0, texture, 1000.0)).toPandas().sort_values(["i", "j"])
        return (np.log(made["shading"].to_numpy().reshape(14, 14)) + 0.05 * i).std()

    assert spread(100.0) < 0.25 * spread(0.0) and spread(1.0) < spread(0.0)


def test_normals_are_straightened(spark):
    rng = np.random.default_rng(2)
    for tilt in ([0.4, -0.3, 0.9], [0.0, 0.0, 1.0], [0.0, 0.0, -1.0], [1.0, 0.0, 0.0]):
        n = np.array(tilt) + rng.normal(0, 0.1, (30, 3))
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        df = spark.createDataFrame([(0, 0, k, *map(float, v)) for k, v in enumerate(n)], "img int, i int, j int, nx double, ny double, nz double")
        got = intrinsic.rectify_normals(df).orderBy("j").toPandas()[["nx", "ny", "nz"]].to_numpy()
        assert np.allclose(got @ got.T, n @ n.T) and np.allclose(got.mean(axis=0)[:2], 0, atol=1e-9) and got.mean(axis=0)[2] > 0


@pytest.mark.parametrize("padding", ["constant", "periodic", "mirror"])
def test_filters_over_four_axes(spark, padding):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (2, 4, 3, 5, 4))
    rows = [(*map(int, k), float(v)) for k, v in np.ndenumerate(x) for k in [k]]
    df = spark.createDataFrame([(*k[:-1], k[-1]) for k in rows], "b int, p int, q int, r int, s int, value double").repartition(4)
    names = ["p", "q", "r", "s"]
    taps = [((0, 0, 0, 0), 2.0), ((1, -1, 2, 0), -0.5), ((-2, 0, 1, 1), 0.25)]
    mode = {"constant": "constant", "periodic": "wrap", "mirror": "symmetric"}[padding]
    wide = np.pad(x, [(0, 0)] + [(2, 2)] * 4, mode=mode)
    want = sum(w * wide[:, *[slice(2 + o, 2 + o + n) for o, n in zip(at, x.shape[1:], strict=True)]] for at, w in taps)
    got = {tuple(r[c] for c in ["b", *names]): r.k for r in axes.correlate_nd(df, names, {"k": taps}, ["b"], padding=padding).collect()}
    assert all(got[k] == pytest.approx(v) for k, v in np.ndenumerate(want))
    if padding == "constant":
        own = {"p": [0.5, 1.0, 0.25], "r": [1.0, 0.0, -1.0], "s": [2.0], "q": [1.0]}
        wide = np.pad(x, [(0, 0), (1, 1), (0, 0), (1, 1), (0, 0)])
        want = 2 * sum(a * c * wide[:, 1 + i : 1 + i + 4, :, 1 + k : 1 + k + 5] for i, a in zip((-1, 0, 1), own["p"], strict=True) for k, c in zip((-1, 0, 1), own["r"], strict=True))
        got = {tuple(r[c] for c in ["b", *names]): r.value for r in axes.separable_nd(df, own, ["b"]).collect()}
        assert all(got[k] == pytest.approx(v) for k, v in np.ndenumerate(want))


def test_coverage_against_samples(spark):
    """Weights of each cell against a fine raster of points, for triangles either way round and a slanted line."""
    tri = [(0, 0.3, 0.2, 4.7, 1.1, 2.2, 6.4), (1, 2.2, 6.4, 4.7, 1.1, 0.3, 0.2), (2, 1.1, 1.2, 1.3, 1.2, 1.2, 1.4), (3, 0.0, 0.0, 1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(tri, "id int, ya double, xa double, yb double, xb double, yc double, xc double")
    got = {(r.id, r.i, r.j): r.weight for r in coverage.polygon_cells(df.select("id", coverage.triangle_ring(["ya", "xa", "yb", "xb", "yc", "xc"]).alias("ring"))).collect()}
    g = (np.arange(0, 8 * 40) + 0.5) / 40 - 0.5
    y, x = np.meshgrid(g, g, indexing="ij")
    for k, *c in tri[:3]:
        side = [(c[2 * n + 3] - c[2 * n + 1]) * (y - c[2 * n]) - (c[2 * n + 2] - c[2 * n]) * (x - c[2 * n + 1]) if n < 2 else (c[1] - c[5]) * (y - c[4]) - (c[0] - c[4]) * (x - c[5]) for n in range(3)]
        inside = np.all([s >= 0 for s in side], axis=0) | np.all([s <= 0 for s in side], axis=0)
        share = inside.reshape(8, 40, 8, 40).mean(axis=(1, 3))
        for i, j in itertools.product(range(8), range(8)):
            assert got.get((k, i, j), 0.0) == pytest.approx(share[i, j], abs=0.03)
    assert not any(k == 3 for k, _, _ in got)
    line = spark.createDataFrame([(0, 0.0, 0.0, 3.0, 4.0)], "id int, a double, b double, c double, d double")
    made = coverage.polygon_cells(line.select("id", coverage.line_ring("a", "b", "c", "d").alias("ring"))).agg(F.sum("weight"), F.max("weight")).first()
    assert made[0] == pytest.approx(5.0) and made[1] <= 1 + 1e-9
