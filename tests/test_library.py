"""Operators of images, points, graphs and files against brute force on small inputs."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from ocellus import catalogue
from ocellus.functions import kernels, refine
from ocellus.operators import graphs, raster, sequential, solve, spatial, volumes
from ocellus.sources import formats
from pyspark.sql import functions as F


def cells(spark, x, img=0):
    return spark.createDataFrame([(img, i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(x)], "img int, i int, j int, value double")


def as_array(df, column="value"):
    rows = df.collect()
    out = np.full((max(r.i for r in rows) + 1, max(r.j for r in rows) + 1), np.nan)
    for r in rows:
        out[r.i, r.j] = r[column]
    return out


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(1).integers(0, 50, (7, 9)).astype(float)


def test_median_and_dilation(spark, x):
    p = np.pad(x, 1)
    windows = np.lib.stride_tricks.sliding_window_view(p, (3, 3)).reshape(7, 9, 9)
    assert np.array_equal(as_array(raster.median(cells(spark, x), 1)), np.sort(windows)[:, :, 4])
    assert np.array_equal(as_array(raster.dilate(cells(spark, x), 1)), windows.max(axis=2))


@pytest.mark.parametrize(("mode", "pad"), [("constant", "constant"), ("periodic", "wrap"), ("mirror", "symmetric")])
def test_paddings(spark, x, mode, pad):
    taps = [(a, b, float(3 * a + b + 5)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    p = np.pad(x, 1, mode=pad)
    want = sum(w * p[1 + a : 8 + a, 1 + b : 10 + b] for a, b, w in taps)
    assert np.allclose(as_array(raster.gather(cells(spark, x), taps, mode)), want)


def test_known_shift_is_found(spark):
    t = np.random.default_rng(2).integers(0, 99, (8, 16)).astype(float)
    s = np.zeros_like(t)
    s[:, :-2] = t[:, 2:]
    pair = volumes.feature_pair(cells(spark, s), cells(spark, t))
    from ocellus.functions.vectors import sad

    volume = volumes.cost_volume(pair, sad, 5)
    d = as_array(volumes.disparity(volume), "disparity")
    assert (d[:, 1:12] == 2).all()
    for run in (lambda v: sequential.sgm(v, 5.0, 20.0), lambda v: sequential.dp_scanline(v, 5.0), lambda v: sequential.patch_match(v, 20)):
        assert (as_array(run(volume), "d")[1:-1, 2:11] == 2).mean() > 0.9


def test_path_costs_follow_the_recurrence():
    c = np.random.default_rng(3).random((3, 5, 4))
    got = sequential.path_costs(c, (0, 1), 0.1, 0.3)
    want = c.copy()
    for i, j, d in itertools.product(range(3), range(1, 5), range(4)):
        before = want[i, j - 1]
        options = [before[d], before.min() + 0.3] + [before[k] + 0.1 for k in (d - 1, d + 1) if 0 <= k < 4]
        want[i, j, d] = c[i, j, d] + min(options) - before.min()
    assert np.allclose(got, want)


def test_refinements(spark):
    row = spark.range(1).select(*[F.lit(v).alias(c) for c, v in zip("abc", (4.0, 1.0, 2.0), strict=True)])
    got = row.select(refine.parabola(*map(F.col, "abc")), refine.equiangular(*map(F.col, "abc"))).first()
    assert np.allclose(list(got), [2 / 8, 2 / 6])


def test_nearest_inpainting_and_diffusion(spark, x):
    h = x.copy()
    h[2:4, 3:5] = np.nan
    filled = as_array(spatial.inpaint_nearest(cells(spark, h), 3))
    assert not np.isnan(filled).any() and filled[2, 3] == x[1, 3]
    smooth = as_array(sequential.inpaint_diffusion(cells(spark, h)))
    assert not np.isnan(smooth).any()


def test_nearest_inpainting_of_a_hole_wider_than_the_reach(spark):
    h = np.random.default_rng(9).random((30, 41))
    h[2:29, 3:40] = np.nan
    h[12, 20] = 5.0
    at = np.argwhere(~np.isnan(h))
    want = h.copy()
    for i, j in np.argwhere(np.isnan(h)):
        want[i, j] = h[tuple(at[((at - (i, j)) ** 2).sum(axis=1).argmin()])]
    both = cells(spark, h).unionByName(cells(spark, np.full((2, 2), np.nan), 1))
    for reach in (1, 3):
        got = spatial.inpaint_nearest(both, reach)
        assert np.array_equal(as_array(got.where("img = 0")), want)
        assert got.where("img = 1 AND value IS NULL").count() == 4


def test_nearest(spark):
    p = np.random.default_rng(4).random((60, 3)) * 100
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(p)], "pt long, x double, y double, z double")
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2) + np.eye(60) * 1e9
    assert {r.pt: r.nearest for r in spatial.nearest(df, df, 5.0, 200.0).collect()} == dict(enumerate(d.argmin(axis=1).tolist()))


def test_mean_shift_goes_on_until_no_place_moves(spark):
    p = np.zeros((300, 3))
    p[:, 0] = np.sort(np.round(np.random.default_rng(8).random(300) ** 0.6 * 400))
    want, live, rounds = p.copy(), np.arange(300), 0
    while len(live):
        near = ((want[live, None] - p[None]) ** 2).sum(axis=2) <= 40 * 40
        new = near @ p / near.sum(axis=1)[:, None]
        moved, want[live], rounds = np.sqrt(((new - want[live]) ** 2).sum(axis=1)), new, rounds + 1
        live = live[moved > 1e-3]
    assert rounds > 30
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(p)], "pt long, x double, y double, z double")
    got = {r.pt: [r.x, r.y, r.z] for r in sequential.mean_shift(df, ["x", "y", "z"], 40.0).collect()}
    assert np.allclose([got[k] for k in range(300)], want, atol=1e-6)


def test_flow_and_components(spark):
    edges = [(-1, 1, 3.0), (-1, 2, 2.0), (1, 2, 1.0), (1, -2, 2.0), (2, -2, 3.0)]
    assert graphs.flow(edges, -1, -2)[0] == 5.0
    chain = spark.createDataFrame([(k, k + 1, 1) for k in range(40)] + [(100, 101, 1)], "u long, v long, w long")
    assert {r.component for r in graphs.components(chain).collect()} == {0, 100}
    cut = chain.where("u = 20")
    assert graphs.reachable(chain, cut, spark.createDataFrame([(5,)], "node long")).count() == 21


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(5)
    for shape in ((3, 3), (3, 5), (5, 3), (1, 4)):
        c = rng.integers(0, 20, shape).astype(float)
        got = sum(c[i, j] for i, j in solve.hungarian(c))
        small = c if shape[0] <= shape[1] else c.T
        want = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert got == want


def test_lmeds_median_is_exact_in_a_large_group(spark):
    x, y = np.random.default_rng(10).random((2, 60001))
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(x, y, strict=True)], "g int, x double, y double")
    best = solve.lmeds_lines(df, 3).first()
    want = np.sort((y - best.slope * x - best.intercept) ** 2)[30000]
    assert np.isclose(best.median, want, rtol=1e-12, atol=0)


def test_l1_is_no_worse_than_least_squares():
    rng = np.random.default_rng(6)
    a = np.stack([rng.random(30), np.ones(30)], axis=1)
    b = a @ [2.0, 1.0] + np.where(rng.random(30) < 0.2, 10, 0)
    assert np.allclose(solve.l1_fit(a, b), [2.0, 1.0], atol=1e-6)


def test_matern_general_meets_the_closed_forms():
    x = np.linspace(0.01, 5, 20)
    assert np.allclose(kernels.matern_values(x, 1.5), (1 + x) * np.exp(-x), atol=1e-6)


def test_files():
    xyz = {c: np.array([1.25, np.nan, -3.5], dtype="f4") for c in "xyz"} | {"r g": np.array([1, 2, 3], dtype="u2")}
    for binary in (True, False):
        h, rows = formats.pcd_records(formats.pcd_bytes(xyz, binary))
        assert h.fields == ["x", "y", "z", "r_g"] and np.array_equal(rows["x"], xyz["x"], equal_nan=True)
    points = {c: np.array([1.25, np.nan, -3.5]) for c in "xyz"} | {"red": np.array([1, 2, 3]), "returnNumber": np.array([1, 2, 2]), "GPSTime": np.array([0.5, 1, 2])}
    h, got = formats.las_records(formats.las_bytes(points))
    assert h["format"] == 7 and np.allclose(got["x"], points["x"], equal_nan=True) and got["returnNumber"].tolist() == [1, 2, 2] and got["GPSTime"].tolist() == [0.5, 1, 2]
    for minor in range(1, 5):
        head, rows = formats.sdc_records(formats.sdc_bytes({"x": np.array([1.0, 2.0]), "classid": np.array([3, 4])}, 5, minor))
        assert head["minor"] == minor and rows["x"].tolist() == [1, 2] and ("classid" in rows.dtype.names) == (minor >= 2)
    flow = np.random.default_rng(0).random((3, 4, 2)).astype("f4")
    assert np.array_equal(formats.flow_array(formats.flow_bytes(flow)), flow)
    assert np.array_equal(formats.dense_array(formats.dense_bytes(flow)), flow)
    assert formats.metacloud("# x\nPOINTS_FILES\na.las\nb.las\nEXTRA_ATTRIBUTES\nc int8 n")["POINTS_FILES"] == ["a.las", "b.las"]


def test_reading_files_and_members(spark, tmp_path):
    from ocellus.sources.readers import read_arrays, read_points

    (tmp_path / "a.las").write_bytes(formats.las_bytes({c: np.array([1.0, 2.0]) for c in "xyz"}))
    (tmp_path / "b.pcd").write_bytes(formats.pcd_bytes({c: np.array([3.0]) for c in "xyz"}))
    (tmp_path / "m.metacloud").write_text("POINTS_FILES\na.las\nb.pcd\n")
    rows = read_points(spark, str(tmp_path / "m.metacloud")).orderBy("member", "row").collect()
    assert [r.x for r in rows] == [1.0, 2.0, 3.0] and rows[2].intensity is None
    (tmp_path / "f.flo").write_bytes(formats.flow_bytes(np.ones((2, 3, 2))))
    assert read_arrays(spark, str(tmp_path / "f.flo"), "flo").count() == 12


def test_stream_of_frames(spark, tmp_path):
    from ocellus.streaming.background import mask_stream, write_masks

    frame = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 1, 2)], "img int, i int, j int, disparity int")
    frame.write.parquet(str(tmp_path / "in"))
    background = spark.createDataFrame([(0, 0, 2), (0, 1, 2)], "i int, j int, disparity int")
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    write_masks(mask_stream(stream, background, 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.j, r.foreground) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(0, True), (1, False)}


def test_every_query_has_a_name_of_its_own_and_sql_belongs_to_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
