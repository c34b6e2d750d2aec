"""Findings on larger tables: what is shuffled, broadcast and held, and that results stay whole."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocellus.functions import affine, vectors
from ocellus.functions import geometry as g
from ocellus.operators import mixtures, pose, segmentation, sequential, solve, spatial, stereo, volumes
from ocellus.plans import standins, stereo_queries


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution()
    df.collect()
    return plan.executedPlan().toString()


def limited(spark, size, f):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    try:
        return f()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cells_of_a_grid_are_not_taken_for_its_blocks_by_a_join(spark):
    lines = spark.range(2_000_000).select((F.col("id") * 2 / 5).cast("long").alias("l_orderkey"))
    some = spark.range(400_000).select(F.col("id").cast("int").alias("img"), (F.col("id") % 32).cast("int").alias("i"), (F.col("id") % 48).cast("int").alias("j")).repartition(4, "img")
    joined = standins.grid(lines).join(some, ["img", "i", "j"])
    assert "BroadcastHashJoin" not in limited(spark, "512k", lambda: final_plan(joined))
    assert standins.grid(lines).count() == 40 * standins.IMAGES * standins.H * standins.W


def test_rotation_speed_about_one_axis_is_the_plain_difference(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(t)) for a, b, t in zip(np.round(rng.random(2000) * 560, 2) / 200, np.round(rng.random(2000) * 560, 2) / 200, rng.integers(1, 2000, 2000) / 1e9, strict=True)]
    z = F.lit(0.0)
    got = spark.createDataFrame(rows, "a double, b double, t double").select("a", "b", "t", g.at(g.rotation_speed(g.vec(z, z, F.col("b")), g.vec(z, z, F.col("a")), F.col("t")), 2).alias("s")).collect()
    assert all(r.s == (r.a - r.b) / r.t for r in got)
    turned = spark.range(1).select(g.rotation_speed(g.vec(z, z, F.lit(-2.0)), g.vec(z, z, F.lit(2.0)), F.lit(1.0)).alias("s")).first().s
    assert np.allclose(turned, [0, 0, 4 - 2 * np.pi], atol=1e-9)


def lines_by_hand(rows, trials, seed=7):
    """g: the (trial, slope, intercept) of the drawn lines, by the draw's own whole-number arithmetic."""
    out = {}
    for g_ in sorted({r[0] for r in rows}):
        for t in range(trials):
            drawn = []
            for _, x, y, k in (r for r in rows if r[0] == g_):
                once = (k % 2147483647 + t * 7919 + seed * 104729) * 2654435761 % 4294967296
                drawn.append(((once ^ (once >> 16)) * 40503 % 4294967296, x, y))
            (_, px, py), (_, qx, qy) = min(drawn), max(drawn)
            if px != qx:
                out.setdefault(g_, []).append((t, (qy - py) / (qx - px), py - (qy - py) / (qx - px) * px))
    return out


def test_lines_are_drawn_and_counted_without_a_sort_of_rows_for_trials(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), float(b), float(c), k) for k, (a, b, c) in enumerate(zip(rng.integers(0, 4, 400), rng.integers(0, 30, 400), rng.integers(0, 90, 400), strict=True))]
    df = spark.createDataFrame(rows, "g long, x double, y double, k long")
    want = {}
    for g_, lines in lines_by_hand(rows, 6).items():
        n = [(sum(abs(y - a * x - b) < 9 for h, x, y, _ in rows if h == g_), -t, a, b) for t, a, b in lines]
        want[g_] = max(n)
    found = solve.ransac_lines(df, 6, 9.0)
    assert {r.g: (r.inliers, r.slope, r.intercept) for r in found.collect()} == {k: (v[0], v[2], v[3]) for k, v in want.items()}
    assert "SortAggregate" not in final_plan(solve.ransac_lines(df, 6, 9.0))


def test_least_medians_of_small_and_large_groups_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(int(a), float(b), float(c), k) for k, (a, b, c) in enumerate(zip(rng.integers(0, 3, 600) ** 2, rng.integers(0, 30, 600), rng.random(600) * 90, strict=True))]
    df = spark.createDataFrame(rows, "g long, x double, y double, k long")
    want = {}
    for g_, lines in lines_by_hand(rows, 6).items():
        e = {t: sorted((y - a * x - b) ** 2 for h, x, y, _ in rows if h == g_) for t, a, b in lines}
        m, t = min((v[(len(v) - 1) // 2], t) for t, v in e.items())
        want[g_] = (*next(line[1:] for line in lines if line[0] == t), m)
    for held in (1 << 20, 150, 1):
        monkeypatch.setattr(solve, "HELD", held)
        got = {r.g: (r.slope, r.intercept, r.median) for r in solve.lmeds_lines(df, 6).collect()}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-12, atol=0) for k in want)
    assert "percentile" not in final_plan(solve.lmeds_lines(df, 6))


def test_large_views_are_solved_from_sums(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g_, turn, t in ((3, [0.1, -0.3, 0.2], [0.4, -0.2, 6.0]), (8, [-0.2, 0.1, 0.7], [-0.5, 0.3, 9.0])):
        p = rng.random((300, 3)) * 2 - 1
        q = p @ pose.rotation(np.array(turn)).T + t
        rows += [(g_, *map(float, a), float(b[0] / b[2]), float(b[1] / b[2])) for a, b in zip(p, q, strict=True)]
        want[g_] = pose.rotation(np.array(turn)), np.array(t)
    df = spark.createDataFrame(rows + [r for r in rows[:40] for r in [(1, *r[1:])]], "g long, x double, y double, z double, u double, v double")
    monkeypatch.setattr(pose, "HELD", 100)
    got = {r.g: r for r in pose.pnp(df).collect()}
    assert set(got) == {1, 3, 8}
    for k, (r, t) in {**want, 1: want[3]}.items():
        assert np.allclose(got[k].r, r.ravel(), atol=1e-6) and np.allclose(got[k].t, t, atol=1e-6)


def test_a_linear_start_holds_no_square_of_the_points():
    import tracemalloc

    p = np.random.default_rng(1).random((3000, 3))
    q = p + [0.0, 0.0, 5.0]
    tracemalloc.start()
    r, t = pose.pnp_solve(p, q[:, :2] / q[:, 2:])
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert np.allclose(r, np.eye(3), atol=1e-6) and np.allclose(t, [0, 0, 5], atol=1e-6)


def test_growth_over_a_background_makes_its_volumes_once(spark):
    k = F.col("id")
    frame = spark.range(60).select(F.lit(0).alias("img"), (k / 10).cast("int").alias("i"), (k % 10).cast("int").alias("j"), F.array((k % 7).cast("double"), (k % 5).cast("double"), (k % 3).cast("double")).alias("costs"))
    grown = stereo.background_growth(frame, frame.withColumn("costs", F.reverse("costs")), 1, 0.5)
    assert grown.count() == 60 and "reverse" not in grown._jdf.queryExecution().optimizedPlan().toString()


def test_cuts_of_settled_cells_are_the_whole_cuts():
    rng = np.random.default_rng(4)
    for k in range(8):
        x = np.floor(rng.integers(1, 51, (1 + k % 4, 14, 17)).mean(axis=0))
        fore, back = np.maximum(25 - x, 0), np.maximum(x - 25, 0)
        assert (segmentation.cut_mask(fore, back, 4.0) == segmentation.cut_mask(fore, back, np.full(x.shape, 4.0))).all()
        some = segmentation.settled(fore, back, 4.0)
        assert (some >= 0).any() and ((some < 0) | (some == segmentation.cut_mask(fore, back, 4.0))).all()


def test_means_of_near_places_share_what_lies_within_radius_of_all():
    rng = np.random.default_rng(11)
    points, places = np.round(rng.normal(size=(30_000, 3)) * 30), rng.normal(size=(30_000, 3)) * 0.5
    began = time.process_time()
    got = sequential.shifted_means(points, places, 80.0)
    # All pairs of these take some ten seconds.
    assert time.process_time() - began < 3
    for k in range(0, 30_000, 500):
        assert (got[k] == points[((places[k] - points) ** 2).sum(axis=1) <= 6400].mean(axis=0)).all()
    far = np.array([[900.0, 0.0, 0.0]])
    assert (sequential.shifted_means(points, far, 80.0) == far).all()


def test_places_of_a_crowded_tile_are_dealt_over_groups(spark):
    rows = spark.range(45_000).select(F.col("id").alias("pt"), *[F.lit(float(v)).alias(c) for v, c in zip((40, 50, 60), "xyz", strict=True)])
    got = sequential.mean_shift(rows, ["x", "y", "z"], 80.0)
    assert got.groupBy("x", "y", "z").count().collect() == [(40.0, 50.0, 60.0, 45_000)]


def test_nearest_points_of_crowded_cells_are_looked_for_in_smaller_ones_and_pairs_are_not_sorted(spark):
    rng = np.random.default_rng(12)
    p = np.concatenate([np.round(rng.normal(size=(1500, 3)) * 40), np.repeat([[7.0, 8.0, 9.0]], 300, axis=0), rng.normal(size=(40, 3)) * 900, [[39.0, 39.0, 5000.0], [0.0, 0.0, 5039.0], [39.0, 0.0, 5078.0]]])
    rows = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "pt long, x double, y double, z double")
    places = spatial._places(rows)
    assert spatial._uncrowded(places, 60.0)[0] < 20
    closest = final_plan(spatial._closest(places, rows, lambda a, b: spatial.within(a, b, 15.0, dealt=True)))
    assert "SortAggregate" not in closest
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = {k: (int(d[k].argmin()), float(d[k].min())) for k in range(len(p))}
    got = {r.pt: (r.nearest, r.d2) for r in spatial.nearest(rows, rows, 60.0, 9000.0).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - v[1]) <= 1e-9 * v[1] for k, v in want.items())
    d[(np.abs(p[:, None] - p[None]) > 40).any(axis=2)] = np.inf
    boxed = {r.pt: r.nearest for r in spatial.nearest_in_box(rows, rows, 40.0).collect()}
    assert boxed == {k: int(d[k].argmin()) if np.isfinite(d[k].min()) else None for k in range(len(p))}
    # One that lies farther than 40 off, in a corner of the cube.
    assert boxed[len(p) - 3] == len(p) - 2


def test_windows_of_a_pair_are_made_after_its_join_and_sorted_once_more_only(spark):
    rng = np.random.default_rng(13)
    s, t = (rng.integers(0, 99, (9, n)).astype(float) for n in (11, 12))
    frames = [spark.createDataFrame([(0, i, j, float(x[i, j])) for i in range(9) for j in range(x.shape[1])], "img int, i int, j int, value double") for x in (s, t)]
    pair = volumes.feature_pair(*frames)
    pad = {n: np.pad(x, 1) for n, x in (("s", s), ("t", t))}
    rows = pair.collect()
    assert len(rows) == 9 * 11
    for r in rows:
        for n in "st":
            assert r[n] == pad[n][r.i : r.i + 3, r.j : r.j + 3].ravel().tolist()
    for made in (volumes.cost_volume(pair, vectors.sad, 4), mixtures.two_sided(pair, vectors.sad, affine.two_by_absolutes(9), 4)):
        plan = final_plan(made).split("Initial Plan")[-1]
        # Two for the join, two for the windows; the search for disparities and the image's width need none.
        assert plan.count("Sort [") <= 4 and plan.count("Exchange hashpartitioning") <= 4


def test_shares_of_pairs_of_entries_are_solved_in_batches():
    rng = np.random.default_rng(14)
    gap, one, two = (rng.integers(-5, 6, (20_000, 9)).astype(float) for _ in range(3))
    one[0] = two[0] = 0
    began = time.process_time()
    p, q = affine.two_solved(gap, one, two, affine._sad_of)
    assert time.process_time() - began < 4
    assert np.isnan(p[0])
    for k in range(1, 200):
        tried = []
        for a in range(9):
            for b in range(a + 1, 9):
                det = one[k, a] * two[k, b] - two[k, a] * one[k, b]
                if det:
                    x = ((gap[k, a] * two[k, b] - two[k, a] * gap[k, b]) / det, (one[k, a] * gap[k, b] - gap[k, a] * one[k, b]) / det)
                    tried.append((round(float(np.abs(gap[k] - x[0] * one[k] - x[1] * two[k]).sum()), 9), len(tried), x))
        assert (p[k], q[k]) == min(tried)[2]


def lines(spark, path):
    """Line items of two blocks of orders, with gaps, as the table of a folder."""
    k = F.col("id")
    cols = {"l_orderkey": k * 7, "l_partkey": k * k % 97, "l_linenumber": (k % 5).cast("int"), "l_quantity": (k * 31 % 50 + 1).cast("double")}
    spark.range(5000).select(*[c.alias(n) for n, c in cols.items()]).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_a_pair_made_of_one_image_joins_no_images(spark, tmp_path):
    folder = lines(spark, tmp_path)
    pair = stereo_queries._pair(spark, folder)
    # The grid's own.
    assert pair._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    target = standins.raster(spark, folder)
    value = {(r.img, r.i, r.j): r.value for r in target.collect()}
    source = {(m, i, j): value.get((m, i, j + standins.SHIFT), 0.0) for m, i, j in value}
    rows = pair.collect()
    assert len(rows) == len(value) == 2 * standins.IMAGES * standins.H * standins.W
    for r in rows:
        for image, f in ((source, r.s), (value, r.t)):
            assert f == [image.get((r.img, r.i + a, r.j + b), 0.0) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def test_a_shifted_image_with_missing_cells_looks_up_places_not_rows(spark):
    cells = spark.createDataFrame([(0, 0, j, float(j + 1)) for j in (0, 1, 3, 4, 7, 9)] + [(0, 1, 2, 5.0)], "img int, i int, j int, value double")
    got = {(r.i, r.j): r.value for r in standins.shifted(cells, 2).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 4.0, (0, 3): 0.0, (0, 4): 0.0, (0, 7): 10.0, (0, 9): 0.0, (1, 2): 0.0}


def test_slices_of_a_volume_are_not_joined_to_the_size_of_its_image(spark):
    rng = np.random.default_rng(15)
    sizes, n = {0: (6, 9), 1: (5, 7)}, 4
    cost = {(m, i, j): rng.permutation(n).astype(float).tolist() for m, (h, w) in sizes.items() for i in range(h) for j in range(w)}
    volume = spark.createDataFrame([(*k, c) for k, c in cost.items()], "img int, i int, j int, costs array<double>")

    def slot(m, i, j, d, k, other):
        h, w = sizes[m]
        least, most = (min(j - k, j), max(j - k, j)) if other else (j, j + d + k)
        if 1 <= i < h - 1 and 0 <= d + k < n and least >= 1 and most + 1 < w:
            return cost[m, i, j - k if other else j][d + k]

    for direction in stereo.DIRECTIONS:
        made, held = stereo.slices(volume, 1, direction, 1, 1), stereo.in_bounds(volume, 1, direction, 1, 1)
        assert all("Join " not in x._jdf.queryExecution().optimizedPlan().toString() for x in (made, held))
        inside = {(r.img, r.i, r.j): r.inside for r in held.collect()}
        rows = made.collect()
        assert len(rows) == len(cost) == len(inside)
        for r in rows:
            c = cost[r.img, r.i, r.j]
            assert r.d == c.index(min(c))
            assert r.costs == [slot(r.img, r.i, r.j, r.d, k, o) for k, o in stereo._slots(1, direction)]
            assert inside[r.img, r.i, r.j] == [x is not None for x in r.costs]
        # Without a window across the lines all lines count.
        assert {r.i for r in stereo.in_bounds(volume, 1, direction).where("exists(inside, x -> x)").collect()} == set(range(6))


def test_accuracy_against_a_column_is_that_against_the_joined_truth(spark, tmp_path):
    rng = np.random.default_rng(16)
    rows = [(m, i, j, float(rng.normal(2, 1)), float(rng.integers(1, 4))) for m in range(3) for i in range(5) for j in range(6)]
    found = spark.createDataFrame(rows, "img int, i int, j int, disparity double, known double")
    joined = volumes.accuracy(found.drop("known"), found.select("img", "i", "j", F.col("known").alias("disparity")), 1.0)
    beside = volumes.accuracy(found, F.col("known"), 1.0)
    for a, b in zip(joined.orderBy("img").collect(), beside.orderBy("img").collect(), strict=True):
        assert a.asDict() == {k: v if k in ("img", "n") else pytest.approx(v) for k, v in b.asDict().items()}
    assert "Join " not in beside._jdf.queryExecution().optimizedPlan().toString()
    # The grid's own.
    assert stereo_queries.R.queries["disparity_accuracy"](spark, lines(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
