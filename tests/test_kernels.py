"""Kernels, solvers and spatial searches against brute force, known answers and exact inverses."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from ocellus.operators import graphs, histograms, pose, segmentation, sequential, solve, spatial, stereo, volumes
from pyspark.sql import functions as F


def _cells(spark, *images):
    rows = [(k, i, j, float(x[i, j])) for k, x in enumerate(images) for i in range(x.shape[0]) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "img int, i int, j int, value double")


def _pose():
    return pose.rotation(np.array([0.2, -0.3, 0.1])), np.array([0.3, -0.2, 4.0])


def _views(n, seed=0):
    r, t = _pose()
    world = np.random.default_rng(seed).uniform(-1, 1, (n, 3))
    seen = world @ r.T + t
    return world, seen[:, :2] / seen[:, 2:]


def test_three_points_allow_the_pose():
    r, t = _pose()
    for seed in range(20):
        world, image = _views(3, seed)
        found = pose.p3p(world, image)
        assert 1 <= len(found) <= 4
        assert min(np.abs(a - r).max() + np.abs(b - t).max() for a, b in found) < 1e-4
    assert pose.p3p(np.zeros((3, 3)), np.zeros((3, 2))) == []


def test_views_of_four_points_and_more(spark):
    r, t = _pose()
    rows = [(g, *w, *x) for g, n in enumerate((3, 4, 5, 6, 9)) for w, x in zip(*_views(n, g), strict=True)]
    got = {v.g: v for v in pose.pnp(spark.createDataFrame([tuple(map(float, x[1:])) + (x[0],) for x in rows], "x double, y double, z double, u double, v double, g long")).collect()}
    assert set(got) == {1, 2, 3, 4}
    for v in got.values():
        assert np.allclose(v.r, r.ravel(), atol=1e-5) and np.allclose(v.t, t, atol=1e-5)


def _ties(spark, a, t, n=60, noise=0.0):
    p = np.random.default_rng(4).normal(size=(n, 3))
    q = p @ np.asarray(a).T + t + noise * np.random.default_rng(5).normal(size=(n, 3))
    return spark.createDataFrame([tuple(map(float, (*x, *y))) for x, y in zip(p, q, strict=True)], "x double, y double, z double, x2 double, y2 double, z2 double"), p, q


def test_maps_of_point_clouds(spark):
    a, t = np.array([[1.0, 0.2, 0], [0, 2, -0.3], [0.1, 0, 0.5]]), np.array([1.0, 2, 3])
    ties, p, q = _ties(spark, a, t, noise=0.1)
    got, moved = pose.affine_map(ties)
    want = np.linalg.lstsq(np.column_stack([p, np.ones(len(p))]), q, rcond=None)[0]
    assert np.allclose(got, want[:3].T) and np.allclose(moved, want[3])
    r, _ = _pose()
    ties, p, q = _ties(spark, 2.5 * r, t)
    s, rr, tt = pose.quasi_similarity(ties)
    assert abs(s - 2.5) < 1e-9 and np.allclose(rr, r) and np.allclose(tt, t)
    ties, p, q = _ties(spark, r, t)
    s, rr, tt = pose.quasi_similarity(ties, scaled=False)
    assert s == 1.0 and np.allclose(rr, r) and np.allclose(tt, t)
    ties, p, q = _ties(spark, np.eye(3) * 1.7, t)
    s, tt = pose.scale_and_translation(ties)
    assert abs(s - 1.7) < 1e-9 and np.allclose(tt, t)
    ties, p, q = _ties(spark, np.eye(3), t)
    assert np.allclose(pose.translation(ties), t)


def test_reprojection(spark):
    r, t = _pose()
    rows = [(0.1, -0.2, 3.0), (0.4, 0.1, 0.5), (0.0, 0.0, -100.0)]
    got = pose.reproject(spark.createDataFrame(rows, "u double, v double, depth double"), r, t).collect()
    for (u, v, d), x in zip(rows, got, strict=True):
        p = r @ (np.array([u, v, 1]) * d) + t
        assert (x.u2 is None) == (p[2] <= 0)
        if x.u2 is not None:
            assert np.allclose([x.u2, x.v2, x.depth2], [p[0] / p[2], p[1] / p[2], p[2]])
    cells = _cells(spark, np.arange(30.0).reshape(5, 6))
    same = pose.reprojected_image(cells, cells.withColumn("depth", F.lit(2.0)), np.eye(3), np.zeros(3), 10.0)
    assert {(c.i, c.j): c.value for c in same.collect()} == {(c.i, c.j): c.value for c in cells.collect()}


def test_homography_and_rays(spark):
    h = np.array([[1.1, 0.1, 0.3], [-0.2, 0.9, 0.1], [0.01, -0.02, 1.0]])
    p = np.random.default_rng(1).uniform(-1, 1, (12, 2))
    q = np.column_stack([p, np.ones(12)]) @ h.T
    ties = spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(p, q[:, :2] / q[:, 2:], strict=True)], "x1 double, y1 double, x2 double, y2 double")
    assert np.allclose(pose.homography(ties), h, atol=1e-8)
    r, t = pose.rotation(np.array([0.02, -0.05, 0.03])), np.array([0.1, -0.2, 0.05])
    rng = np.random.default_rng(3)
    o, d, e = rng.normal(size=(40, 3)), rng.normal(size=(40, 3)), rng.normal(size=(40, 3))
    met = (o + d * rng.uniform(1, 3, (40, 1))) @ r.T + t
    rows = [tuple(map(float, (*a, *b, *c, *f))) for a, b, c, f in zip(o, d, met - e * rng.uniform(1, 2, (40, 1)), e, strict=True)]
    names = [f"{n}{c} double" for n in "odpe" for c in "xyz"]
    rr, tt = pose.align_rays(spark.createDataFrame(rows, ", ".join(names)))
    assert np.allclose(rr, r, atol=1e-5) and np.allclose(tt, t, atol=1e-5)


def test_order_statistics(spark):
    rng = np.random.default_rng(2)
    images = [rng.normal(size=(20, 30)), np.full((5, 5), 3.0), np.where(rng.random((10, 10)) < 0.9, 1.0, rng.normal(size=(10, 10)) * 1e6), np.array([[7.0]])]
    for q in (0.0, 0.3, 0.95):
        got = {r.img: r.x for r in histograms.order_statistics(_cells(spark, *images), "value", {"x": lambda n, q=q: F.floor(F.lit(q) * n).cast("long")}).collect()}
        assert got == {k: np.sort(x.ravel())[int(q * x.size)] for k, x in enumerate(images)}


def _boxes_and_points(spark, n=60):
    rng = np.random.default_rng(8)
    low = np.round(rng.uniform(-50, 50, (n, 3)), 1)
    high = low + np.round(rng.choice([0.0, 1.0, 8.0, 60.0], (n, 1)) * rng.uniform(0.2, 1, (n, 3)), 1)
    names = ", ".join(f"{c}{k} double" for k in (0, 1) for c in "xyz")
    boxes = spark.createDataFrame([(k, *map(float, (*a, *b))) for k, (a, b) in enumerate(zip(low, high, strict=True))], f"box long, {names}")
    return boxes, low, high, rng


@pytest.mark.parametrize("size", [0.5, 20.0, 500.0])
def test_boxes_that_contain_points(spark, size):
    boxes, low, high, rng = _boxes_and_points(spark)
    points = np.concatenate([np.round(rng.uniform(-60, 60, (80, 3)), 1), low[:10], high[:10]])
    got = {(r.pt, r.box) for r in spatial.containing(boxes, spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "pt long, x double, y double, z double"), size).collect()}
    assert got == {(k, b) for k, p in enumerate(points) for b in range(len(low)) if (p >= low[b]).all() and (p <= high[b]).all()}


@pytest.mark.parametrize("size", [None, 3.0])
def test_first_box_on_a_ray(spark, size):
    boxes, low, high, rng = _boxes_and_points(spark)
    rays = [(*rng.uniform(-80, 80, 3), *rng.normal(size=3)) for _ in range(60)] + [(*rng.uniform(-80, 80, 3), 0.0, 0.0, 1.0), (-100.0, *low[3][1:], 1.0, 0.0, 0.0), (*((low[5] + high[5]) / 2), 1.0, 1.0, 0.0), (0.0, 0.0, 500.0, 0.0, 0.0, 1.0)]
    names = ", ".join(f"{n}{c} double" for n in "od" for c in "xyz")
    got = {r.ray: (r.box, round(r.t, 9)) for r in spatial.first_hit(boxes, spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rays)], f"ray long, {names}"), size).collect()}
    want = {}
    for k, r in enumerate(rays):
        o, d = np.array(r[:3]), np.array(r[3:])
        for b in range(len(low)):
            t0, t1 = 0.0, np.inf
            for c in range(3):
                if d[c] == 0:
                    if not low[b][c] <= o[c] <= high[b][c]:
                        t0, t1 = np.inf, -np.inf
                else:
                    near, far = sorted(((low[b][c] - o[c]) / d[c], (high[b][c] - o[c]) / d[c]))
                    t0, t1 = max(t0, near), min(t1, far)
            if t0 <= t1 and (k not in want or (t0, b) < (want[k][1], want[k][0])):
                want[k] = (b, t0)
    assert got == {k: (b, round(t, 9)) for k, (b, t) in want.items()}


def test_nearest_returns_every_query(spark):
    rng = random.Random(3)
    points = spark.createDataFrame([(k, *[float(rng.randrange(-900, 900)) for _ in range(3)]) for k in range(50)], "pt long, x double, y double, z double")
    got = {r.pt: r.nearest for r in spatial.nearest(points, points, 10.0, 4000.0).collect()}
    p = {r.pt: np.array([r.x, r.y, r.z]) for r in points.collect()}
    assert got == {k: min((float(((p[k] - p[q]) ** 2).sum()), q) for q in p if q != k)[1] for k in p}
    alone = points.where("pt = 1")
    assert [(r.pt, r.nearest) for r in spatial.nearest(alone, alone, 10.0, 100.0).collect()] == [(1, None)]


def test_lines_among_outliers(spark):
    rng = random.Random(4)
    rows = [(g, float(x), 2.0 * x + g + (rng.uniform(-0.1, 0.1) if k % 3 else rng.uniform(20, 90)), 1.0 if k % 3 else 1e-9) for g in range(3) for k in range(60) for x in [rng.uniform(0, 50)]]
    df = spark.createDataFrame(rows, "g long, x double, y double, priority double")
    for lines in (solve.ransac_lines(df.drop("priority"), 40, 0.5), solve.ransac_lines(df, 10, 0.5), solve.lmeds_lines(df.drop("priority"), 40)):
        got = {r.g: r for r in lines.collect()}
        assert set(got) == {0, 1, 2} and all(abs(r.slope - 2) < 0.05 and abs(r.intercept - g) < 1.5 for g, r in got.items())
    counted = {r.g: r.inliers for r in solve.ransac_lines(df, 10, 0.5).collect()}
    best = {r.g: r for r in solve.ransac_lines(df, 10, 0.5).collect()}
    assert counted == {g: sum(abs(y - best[g].slope * x - best[g].intercept) < 0.5 for h, x, y, _ in rows if h == g) for g in best}
    single = spark.createDataFrame([(9, 1.0, 1.0)], "g long, x double, y double")
    assert solve.ransac_lines(single, 5, 1.0).count() == 0


def test_least_absolute_residuals():
    rng = np.random.default_rng(7)
    for _ in range(20):
        a, b = np.column_stack([rng.normal(size=9), np.ones(9)]), rng.normal(size=9)
        best = min(np.abs(a @ np.linalg.solve(a[list(k)], b[list(k)]) - b).sum() for k in itertools.combinations(range(9), 2))
        assert np.abs(a @ solve.l1_fit(a, b) - b).sum() <= best * 1.05


def test_flow_is_the_least_cut():
    rng = random.Random(5)
    for _ in range(30):
        edges = [(u, v, float(rng.randint(0, 9))) for u in (-1, 0, 1, 2, 3) for v in (0, 1, 2, 3, -2) if u != v and rng.random() < 0.6]
        cuts = []
        for s in itertools.product([False, True], repeat=4):
            side = {-1: True, -2: False, **dict(enumerate(s))}
            cuts.append(sum(w for u, v, w in edges if side[u] and not side[v]))
        assert graphs.flow(edges, -1, -2)[0] == min(cuts)


def _mask_cost(mask, fore, back, smooth):
    return float(np.where(mask, fore, back).sum() + smooth * ((mask[1:] != mask[:-1]).sum() + (mask[:, 1:] != mask[:, :-1]).sum()))


def test_masks_of_least_cost():
    rng = np.random.default_rng(6)
    for _ in range(6):
        fore, back = rng.integers(0, 9, (3, 4)).astype(float), rng.integers(0, 9, (3, 4)).astype(float)
        options = [np.array(m).reshape(3, 4) for m in itertools.product([False, True], repeat=12)]
        best = min(_mask_cost(m, fore, back, 2.0) for m in options)
        assert _mask_cost(segmentation.cut_mask(fore, back, 2.0), fore, back, 2.0) == best
        known = rng.integers(-1, 2, (3, 4))
        fits = [m for m in options if all(known[i, j] < 0 or m[i, j] == known[i, j] for i in range(3) for j in range(4))]
        got = segmentation.partial_cut_mask(fore, back, 2.0, known)
        assert ((known < 0) | (got == known)).all() and _mask_cost(got, fore, back, 2.0) == min(_mask_cost(m, fore, back, 2.0) for m in fits)


def test_hierarchical_masks_agree_with_the_whole_cut():
    i, j = np.mgrid[:40, :50]
    disc = (i - 18) ** 2 + (j - 24) ** 2 < 150
    x = disc * 4.0 + np.random.default_rng(1).normal(0, 1.5, disc.shape)
    fore, back = np.maximum(2 - x, 0), np.maximum(x - 2, 0)
    whole, fine = segmentation.cut_mask(fore, back, 1.5), segmentation.hierarchical_cut_mask(fore, back, 1.5, 2)
    assert (fine == disc).mean() > 0.98 and (fine == whole).mean() > 0.98


def test_reflectance_and_shading():
    i, j = np.mgrid[:24, :24]
    paint, light = np.where((i // 8 + j // 8) % 2, 1.0, 0.3), 0.5 + j / 40
    r, s = segmentation.retinex(paint * light, 0.3)
    assert np.allclose(r * s, paint * light) and np.corrcoef(np.log(s).ravel(), np.log(light).ravel())[0, 1] > 0.99
    r, s, t = segmentation.automatic_retinex(paint * light)
    assert 0.05 <= t <= 1 and np.corrcoef(np.log(s).ravel(), np.log(light).ravel())[0, 1] > 0.98


def test_heights_from_normals_and_light(spark):
    i, j = np.mgrid[:16, :16] / 8 - 1
    z = 0.4 * i**2 - 0.2 * i * j + 0.3 * j
    gy, gx = (0.8 * i - 0.2 * j) / 8, (-0.2 * i + 0.3) / 8
    n = np.stack([-gx, -gy, np.ones_like(gx)], axis=2)
    n /= np.linalg.norm(n, axis=2, keepdims=True)
    assert np.allclose(segmentation.height_of(n[:, :, 0], n[:, :, 1], n[:, :, 2]), z - z[0, 0], atol=2e-3)
    light = np.array([0.3, -0.2, 0.9]) / np.linalg.norm([0.3, -0.2, 0.9])
    rows = [(0, *map(float, v), float(v @ light)) for v in n.reshape(-1, 3)]
    (got,) = segmentation.light_direction(spark.createDataFrame(rows, "img int, nx double, ny double, nz double, value double")).collect()
    assert np.allclose([got.lx, got.ly, got.lz], light, atol=1e-6)


def test_checkerboard_and_round_targets(spark):
    i, j = np.mgrid[:24, :24]
    got = {(r.i, r.j) for r in segmentation.checkerboard_corners(_cells(spark, 100 * np.sin(np.pi * i / 8) * np.sin(np.pi * j / 8)), 10.0).collect()}
    assert {(8, 8), (8, 16), (16, 8), (16, 16)} <= got and all(a % 8 in (0, 1, 7) and b % 8 in (0, 1, 7) for a, b in got)
    rows = [(0, k, 30, float(10 * k), 5.0, 2.0, 1.5) for k in range(4)] + [(0, 9, 30, 5.0, 5.0, 9.0, 1.0), (0, 10, 900, 5.0, 5.0, 1.0, 1.0)]
    near = segmentation.round_targets(spark.createDataFrame(rows, "img int, label long, n long, ci double, cj double, major double, minor double"), 10, 50, 2.0)
    assert {(r.label, r.other) for r in near.where("rank = 1").collect()} == {(0, 1), (1, 0), (2, 1), (3, 2)}


def test_fusion_and_inpainting():
    x = np.where(np.mgrid[:12, :12][1] < 6, 10.0, 50.0)
    noisy = x + np.random.default_rng(0).normal(0, 1, x.shape)

    class Held:
        def select(self, *_):
            return self

        groupBy = select  # noqa: N815

        def applyInPandas(self, run, _):  # noqa: N802
            return run

    i, j = np.mgrid[:12, :12]
    frame = lambda v: __import__("pandas").DataFrame({"img": 0, "i": i.ravel(), "j": j.ravel(), "value": v.ravel()})
    fused = sequential.l0_fusion(Held(), 60.0)(frame(noisy))["value"].to_numpy().reshape(12, 12)
    assert len(np.unique(fused)) == 2 and abs(fused - x).max() < 1
    holes = noisy.copy()
    holes[3:6, 2:7] = np.nan
    got = sequential.inpaint_diffusion(Held())(frame(holes))["value"].to_numpy()
    known = ~np.isnan(holes.ravel())
    lap = np.stack([sequential._laplace(e.reshape(12, 12)).ravel() for e in np.eye(144)])
    assert np.allclose(got, np.linalg.solve(np.diag(known.astype(float)) + lap, np.where(known, holes.ravel(), 0)), atol=1e-4)


def test_patches_spread_along_lines(spark):
    rng = np.random.default_rng(0)
    c = rng.uniform(1, 2, (10, 12, 8))
    truth = np.where(np.arange(12) < 6, 2, 5)
    for j in range(12):
        c[:, j, truth[j]] = 0
    rows = [(0, i, j, c[i, j].tolist()) for i in range(10) for j in range(12)]
    got = {(r.i, r.j): r.d for r in sequential.patch_match(spark.createDataFrame(rows, "img int, i int, j int, costs array<double>")).collect()}
    assert sum(got[i, j] == truth[j] for i, j in got) > 0.9 * len(got)


def test_mean_shift_against_all_pairs(spark):
    p = np.random.default_rng(9).normal(size=(120, 3)) * 30
    at = p.copy()
    done = np.zeros(len(p), dtype=bool)
    while not done.all():
        for k in np.flatnonzero(~done):
            new = p[((p - at[k]) ** 2).sum(axis=1) <= 25.0**2].mean(axis=0)
            done[k] = np.linalg.norm(new - at[k]) <= 1e-3
            at[k] = new
    rows = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "pt long, x double, y double, z double")
    got = {r.pt: (r.x, r.y, r.z) for r in sequential.mean_shift(rows, ["x", "y", "z"], 25.0).collect()}
    assert all(np.allclose(got[k], at[k], atol=1e-6) for k in range(len(p)))


def test_robust_fits_by_iteration(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(x, 3 * x - 2 + (rng.uniform(-0.1, 0.1) if k % 5 else 60.0)) for k in range(200) for x in [rng.uniform(-5, 5)]], "x double, y double")
    r = lambda p: p[0] * F.col("x") + p[1] - F.col("y")
    got = solve.gauss_newton(rows, r, lambda p: [F.col("x"), F.lit(1.0)], [0.0, 0.0], weight=lambda e: F.when(F.abs(e) <= 0.5, 1.0).otherwise(0.5 / F.abs(e)), steps=60)
    assert abs(got[0] - 3) < 0.05 and abs(got[1] + 2) < 0.2
    got = solve.l_bfgs(rows.where("y < 30"), lambda p: r(p) * r(p), lambda p: [2 * r(p) * F.col("x"), 2 * r(p)], [0.0, 0.0])
    assert abs(got[0] - 3) < 0.02 and abs(got[1] + 2) < 0.02


def test_slices_say_the_same_as_their_bounds(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, j, rng.uniform(size=5).tolist()) for i in range(6) for j in range(9)]
    volume = spark.createDataFrame(rows, "img int, i int, j int, costs array<double>")
    for direction, n in (("same", 3), ("reversed", 3), ("both", 5)):
        a = {(r.i, r.j): [c is not None for c in r.costs] for r in stereo.slices(volume, 1, direction, 1, 1).collect()}
        b = {(r.i, r.j): r.inside for r in stereo.in_bounds(volume, 1, direction, 1, 1).collect()}
        assert a == b and all(len(x) == n for x in a.values())
    whole = {(r.i, r.j): r.costs for r in volumes.truncated(volume, 1).collect()}
    same = {(r.i, r.j): r.costs for r in stereo.slices(volume, 1).collect()}
    assert all(x is None or x == whole[k][n] for k, v in same.items() for n, x in enumerate(v))
    with pytest.raises(ValueError):
        stereo.slices(volume, 1, "sideways")


def test_weights_that_sum_to_one():
    rng = np.random.default_rng(11)
    a, x = rng.normal(size=(30, 3)), np.array([0.5, 0.7, -0.2])
    b = a @ x
    b[:6] += 40
    for fit in (solve.affine_l1, solve.affine_median):
        got = fit(a, b)
        assert abs(got.sum() - 1) < 1e-9 and np.allclose(got, x, atol=1e-6)
    for seed in range(10):
        rng = np.random.default_rng(seed)
        a, b = rng.uniform(0.2, 1, (5, 3)), rng.uniform(0.2, 1, 5)
        unit = lambda v: v / np.linalg.norm(v)
        miss = lambda y: np.linalg.norm(unit(a @ y) - unit(b))  # noqa: E731, B023
        got = solve.spherical_affine(a, b)
        near = min(miss(got + np.array([p, q, -p - q])) for p in (-1e-3, 0, 1e-3) for q in (-1e-3, 0, 1e-3))
        assert abs(got.sum() - 1) < 1e-9 and (miss(got) <= near + 1e-9 or miss(got) > 1)


def _paths(w, n):
    """Every scan-line path from disparity 0 to 0, as its steps."""

    def go(j, d):
        if j == w and d == 0:
            yield []
        if j < w:
            for rest in go(j + 1, d):
                yield [(sequential.MATCH, j, d), *rest]
            if d:
                for rest in go(j + 1, d - 1):
                    yield [(sequential.PAST_SOURCE, j, d), *rest]
        if d + 1 < n and (w - j) > d:
            for rest in go(j, d + 1):
                yield [(sequential.PAST_TARGET, j, d), *rest]

    return go(0, 0)


def test_scan_line_paths_are_the_cheapest():
    rng = np.random.default_rng(5)

    def price(path, cost):
        total, before = 0.0, sequential.MATCH
        for kind, j, d in path:
            total += cost[j, d] if kind == sequential.MATCH else (1.0 if kind == before else 3.0)
            before = kind
        return total

    for _ in range(12):
        cost = rng.integers(0, 12, (5, 3)).astype(float)
        options = {}
        for p in _paths(5, 3):
            found = [-1] * 5
            for kind, j, d in p:
                if kind == sequential.MATCH:
                    found[j] = d
            options[tuple(found)] = min(options.get(tuple(found), np.inf), price(p, cost))
        got = tuple(sequential.match_and_skip(cost, 3.0, 1.0).tolist())
        assert options[got] == min(options.values())


def test_rays_that_miss_weigh_less(spark):
    r, t = pose.rotation(np.array([0.02, -0.03, 0.01])), np.array([0.05, -0.1, 0.05])
    rng = np.random.default_rng(8)
    o, d, e = (rng.normal(size=(60, 3)) for _ in range(3))
    met = (o + d * rng.uniform(1, 3, (60, 1))) @ r.T + t
    met[:6] += rng.normal(size=(6, 3))
    rows = [tuple(map(float, (*a, *b, *c, *f))) for a, b, c, f in zip(o, d, met - e, e, strict=True)]
    rays = spark.createDataFrame(rows, ", ".join(f"{n}{c} double" for n in "odpe" for c in "xyz"))
    plain, robust = (pose.align_rays(rays, 40, b) for b in (None, 0.01))
    miss = lambda x: np.abs(x[0] - r).max() + np.abs(x[1] - t).max()
    assert miss(robust) < 0.5 * miss(plain) and miss(robust) < 0.05
