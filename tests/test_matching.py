"""Priced scan-line paths against all paths, and refinements by mixtures against searches."""

from __future__ import annotations

import numpy as np
import pytest
from ocellus.functions import affine, vectors
from ocellus.operators import mixtures, scanlines
from ocellus.operators.scanlines import MATCH, PAST_SOURCE, PAST_TARGET
from pyspark.sql import functions as F


def _all_paths(cost, policy, weight):
    """The least price of any path, and all disparities of paths that reach it."""
    w, n = cost.shape
    best = [np.inf, []]

    def go(j, d, kind, run, price, out):
        if price > best[0] + 1e-9:
            return
        if j == w and d == 0:
            if price < best[0] - 1e-9:
                best[:] = [price, []]
            best[1].append(tuple(out))
        for to in (MATCH, PAST_TARGET, PAST_SOURCE):
            step = policy.prices[to, kind, min(run, policy.runs)]
            nr = run + 1 if to == kind else 1
            if to == MATCH and j < w:
                go(j + 1, d, to, nr, price + cost[j, d] + step, [*out, d])
            elif to == PAST_TARGET and d + 1 < n:
                go(j, d + 1, to, nr, price + step * weight[max(j - 1, 0)], out)
            elif to == PAST_SOURCE and j < w and d:
                go(j + 1, d - 1, to, nr, price + step * weight[j], [*out, -1])

    go(0, 0, MATCH, 0, 0.0, [])
    return best


@pytest.mark.parametrize("policy", [scanlines.two_prices(3.0, 1.0), scanlines.free_after(2.0, 1.5, 1), scanlines.growing(1.0, 0.75, 2)])
def test_priced_paths_against_all_paths(policy):
    rng = np.random.default_rng(3)
    for _ in range(12):
        cost, weight = rng.integers(0, 8, (5, 3)).astype(float), rng.integers(1, 5, 5) / 2
        got = tuple(scanlines.paths(cost[None], policy, weight[None])[0].tolist())
        assert got in _all_paths(cost, policy, weight)[1]


def test_two_prices_are_the_older_paths(spark):
    """Rows of several tasks, and the same result as the kernel without run lengths."""
    from ocellus.operators import sequential

    rng = np.random.default_rng(5)
    rows = [(0, i, j, rng.integers(0, 30, 4).astype(float).tolist()) for i in range(20) for j in range(9)]
    volume = spark.createDataFrame(rows, "img int, i int, j int, costs array<double>")
    own = {(r.i, r.j): r.d for r in scanlines.priced_paths(volume, scanlines.two_prices(7.0, 2.0)).collect()}
    assert own == {(r.i, r.j): r.d for r in sequential.scanline_paths(volume, 7.0, 2.0).collect()}


def _vectors(spark, n=9, rows=40):
    rng = np.random.default_rng(11)
    made = [(k, *[rng.integers(-20, 20, n).astype(float).tolist() for _ in range(3)]) for k in range(rows)] + [(rows, [1.0] * n, [0.0] * n, [0.0] * n)]
    return spark.createDataFrame(made, "k int, g array<double>, u array<double>, w array<double>"), made


def test_shares_of_one_step(spark):
    df, made = _vectors(spark)
    g, u = F.col("g"), F.col("u")
    got = df.select("k", affine.by_squares(g, u).alias("s"), affine.by_absolutes(g, u).alias("a"), affine.by_median(g, u).alias("m"), affine.by_median(g, u, [[0, 1, 2], [6, 7, 8]]).alias("p")).orderBy("k").collect()
    median = lambda e: np.sort(np.abs(e))[len(e) // 2]
    for (_, gap, step, _), r in zip(made, got, strict=True):
        gap, step = np.array(gap), np.array(step)
        if not step.any():
            assert (r.s, r.a, r.m, r.p) == (None, None, None, None)
            continue
        tried = np.linspace(-30, 30, 6001)
        assert r.s == pytest.approx(gap @ step / (step @ step))
        assert np.abs(gap - r.a * step).sum() <= np.abs(gap - tried[:, None] * step).sum(axis=1).min() + 1e-6
        own = gap[step != 0] / step[step != 0]
        assert median(gap - r.m * step) == pytest.approx(min(median(gap - x * step) for x in own))
        parts = [gap[p] @ step[p] / (step[p] @ step[p]) for p in ([0, 1, 2], [6, 7, 8]) if step[p].any()]
        assert median(gap - r.p * step) == pytest.approx(min(median(gap - x * step) for x in parts))


def test_shares_of_two_steps(spark):
    df, made = _vectors(spark)
    g, u, w = F.col("g"), F.col("u"), F.col("w")
    got = df.select("k", affine.two_by_squares(g, u, w).alias("s"), affine.two_by_absolutes(9)(g, u, w).alias("a"), affine.two_by_median(9)(g, u, w).alias("m")).orderBy("k").collect()
    for (_, gap, one, two), r in zip(made, got, strict=True):
        gap, a = np.array(gap), np.stack([one, two], axis=1)
        if not a.any():
            assert (r.s, r.a, r.m) == (None, None, None)
            continue
        want = np.linalg.lstsq(a, gap, rcond=None)[0]
        assert (r.s.p, r.s.q) == pytest.approx(tuple(want))
        near = np.abs(gap - a @ np.array([r.a.p, r.a.q])).sum()
        rng = np.random.default_rng(0)
        assert all(near <= np.abs(gap - a @ (np.array([r.a.p, r.a.q]) + d)).sum() + 1e-9 for d in rng.normal(0, 0.3, (300, 2)))
        pairs = [np.linalg.solve(a[[x, y]], gap[[x, y]]) for x in range(9) for y in range(x + 1, 9) if np.linalg.det(a[[x, y]]) != 0]
        median = lambda x: np.sort(np.abs(gap - a @ x))[4]  # noqa: B023, E731
        assert median(np.array([r.m.p, r.m.q])) == pytest.approx(min(map(median, pairs)))


def test_refinements_find_a_planted_shift(spark):
    """A target that is the source half a cell on: each refinement says so, at all places but the border's."""
    j = np.arange(40)
    line = lambda x, i: 100 * np.sin(x / 4.0 + i) + 3 * x
    source = [(0, i, int(k), float((line(k + 1, i) + line(k + 2, i)) / 2)) for i in range(6) for k in j]
    target = [(0, i, int(k), float(line(k, i))) for i in range(6) for k in j]
    schema = "img int, i int, j int, value double"
    from ocellus.operators import volumes

    pair = volumes.feature_pair(spark.createDataFrame(source, schema), spark.createDataFrame(target, schema))
    inner = lambda df: [r.disparity for r in df.where("i BETWEEN 1 AND 4 AND j BETWEEN 3 AND 33").collect()]
    for share, cost in ((affine.by_squares, vectors.ssd), (affine.by_absolutes, vectors.sad), (affine.by_median, vectors.medad)):
        assert np.allclose(inner(mixtures.one_sided(pair, cost, share, 4)), 1.5)
    assert np.mean(np.abs(np.array(inner(mixtures.two_sided(pair, vectors.sad, affine.two_by_absolutes(9), 4))) - 1.5) < 1e-6) > 0.9
    winners = volumes.winner_2d(volumes.cost_volume_2d(pair, vectors.sad, (0, 0), (0, 3)))
    made = mixtures.kernel_refined_2d(pair, winners, vectors.ssd, lambda t: F.greatest(1 - F.abs(t), F.lit(0.0)), 1, 2).where("i BETWEEN 1 AND 4 AND j BETWEEN 3 AND 33").collect()
    assert {(r.y, r.x) for r in made} == {(0.0, 1.5)}
