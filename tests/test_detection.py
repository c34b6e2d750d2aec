"""Boards, targets and their grids on planted images, against what was planted."""

from __future__ import annotations

import numpy as np
import pytest
from ocellus.operators import checkerboard, hexagons

POINTS = "img int, i int, j int, direction double, y double, x double"


def _board(rng, origin, angle, size, rows, cols, holes):
    """Corners of a slightly bent board: their planted places in the grid, and directions that cross from one to the next."""
    out = {}
    for r in range(rows):
        for c in range(cols):
            if (r, c) in holes:
                continue
            x, y = c * size * (1 + 0.01 * c) + rng.normal(0, 0.15), r * size * (1 + 0.01 * r) + rng.normal(0, 0.15)
            px, py = origin[1] + x * np.cos(angle) - y * np.sin(angle), origin[0] + x * np.sin(angle) + y * np.cos(angle)
            out[(r, c)] = (py, px, angle + np.pi / 4 + np.pi / 2 * ((r + c) % 2) + rng.normal(0, 0.02))
    return out


def _same_grid(planted, found):
    """Whether found (y, x: row, col) is planted but for quarter turns and a shift."""
    want = np.array([k for k, v in planted.items() if (round(v[0], 6), round(v[1], 6)) in found])
    got = np.array([found[(round(v[0], 6), round(v[1], 6))] for v in planted.values() if (round(v[0], 6), round(v[1], 6)) in found])
    for _ in range(4):
        want = np.stack([want[:, 1], -want[:, 0]], axis=1)
        if (want - want.min(axis=0) == got).all():
            return True
    return False


def test_two_boards_with_holes(spark):
    """Two boards in one image, one in another, corners astray: each board whole, its holes left open, and nothing else."""
    rng = np.random.default_rng(7)
    boards = [(0, _board(rng, (20, 30), 0.3, 9.0, 6, 7, {(2, 3), (0, 0), (5, 1)})), (0, _board(rng, (150, 160), 1.1, 12.0, 5, 5, {(1, 1), (3, 3)})), (1, _board(rng, (40, 10), -0.2, 10.0, 4, 8, set()))]
    rows = [(img, round(y), round(x), float(d), float(y), float(x)) for img, b in boards for y, x, d in b.values()]
    astray = [(0, 300, 20, 0.1, 300.0, 20.0), (0, 305, 26, 0.1 + np.pi / 2, 305.0, 26.0), (1, 400, 400, 1.0, 400.0, 400.0)]
    found = checkerboard.grids(spark.createDataFrame(rows + astray, POINTS).repartition(3), 18.0).collect()
    by_board = {}
    for r in found:
        by_board.setdefault((r.img, r.board), {})[(round(r.y, 6), round(r.x, 6))] = (r.row, r.col)
    assert sorted(len(b) for b in by_board.values()) == sorted(len(b) for _, b in boards)
    for img, planted in boards:
        own = next(b for (i, _), b in by_board.items() if i == img and (round(next(iter(planted.values()))[0], 6), round(next(iter(planted.values()))[1], 6)) in b)
        assert len(own) == len(planted) and _same_grid(planted, own)
    most = checkerboard.largest(spark.createDataFrame(found)).groupBy("img").count().collect()
    assert sorted((r["img"], r["count"]) for r in most) == [(0, 39), (1, 32)]


def test_contradicting_links_are_left_out(spark):
    """A link that closes a board onto itself: its places cannot agree, so no grid is given."""
    ring = [(k, (k + 1) % 3) for k in range(3)]
    links = [(p, q, 1, 0, -1, 0) for p, q in ring] + [(q, p, -1, 0, 1, 0) for p, q in ring]
    df = spark.createDataFrame([(*x,) for x in links], "p long, q long, a int, b int, c int, d int")
    assert checkerboard.consistent(df, checkerboard.frames(df)).count() == 0


def _crossing(y, x, angle, side=7, scale=1.5, gain=40.0):
    py, px = (g - side // 2 for g in np.mgrid[0:side, 0:side].astype(float))
    u, v = ((px - x) * np.cos(angle) - (py - y) * np.sin(angle)) * scale, ((px - x) * np.sin(angle) + (py - y) * np.cos(angle)) * scale
    return 100 + gain * np.arctan(u * v)


def test_centres_between_cells():
    rng = np.random.default_rng(2)
    want = rng.uniform(-0.6, 0.6, (60, 2))
    angle = rng.uniform(-1.5, 1.5, 60)
    windows = np.stack([_crossing(y, x, a) for (y, x), a in zip(want, angle, strict=True)])
    made = checkerboard.fit_centres(windows, np.pi / 4 - angle + rng.normal(0, 0.05, 60))
    assert made[:, 2].mean() > 0.95
    assert np.abs(made[made[:, 2] > 0, :2] - want[made[:, 2] > 0]).max() < 0.05


def test_board_in_an_image(spark):
    """From cells to places: a turned board with soft edges is found, filtered, fitted and laid out."""
    i, j = np.mgrid[0:60, 0:72].astype(float)
    turn = 0.15
    x, y = (j - 8.3) * np.cos(turn) + (i - 6.6) * np.sin(turn), (i - 6.6) * np.cos(turn) - (j - 8.3) * np.sin(turn)
    image = 100 * np.sin(np.pi * x / 10) * np.sin(np.pi * y / 10)
    cells = spark.createDataFrame([(0, int(a), int(b), float(image[int(a), int(b)])) for a, b in zip(i.ravel(), j.ravel(), strict=True)], "img int, i int, j int, value double")
    found = checkerboard.plausible(cells, checkerboard.corners(cells, 5.0))
    for made in (checkerboard.saddle_points(cells, found), checkerboard.fitted_corners(cells, found)):
        for r in made.collect():
            u, v = (r.x - 8.3) * np.cos(turn) + (r.y - 6.6) * np.sin(turn), (r.y - 6.6) * np.cos(turn) - (r.x - 8.3) * np.sin(turn)
            assert abs(u - 10 * round(u / 10)) < 0.1 and abs(v - 10 * round(v / 10)) < 0.1
    grid = checkerboard.grids(checkerboard.saddle_points(cells, found), 15.0).collect()
    assert len(grid) >= 12 and len({r.board for r in grid}) == 1
    for r in grid:
        u, v = (r.x - 8.3) * np.cos(turn) + (r.y - 6.6) * np.sin(turn), (r.y - 6.6) * np.cos(turn) - (r.x - 8.3) * np.sin(turn)
        assert (round(v / 10) - r.row, round(u / 10) - r.col) == (round(_row(grid[0], turn)), round(_col(grid[0], turn)))


def _row(r, turn):
    return ((r.y - 6.6) * np.cos(turn) - (r.x - 8.3) * np.sin(turn)) / 10 - r.row


def _col(r, turn):
    return ((r.x - 8.3) * np.cos(turn) + (r.y - 6.6) * np.sin(turn)) / 10 - r.col


def test_empty_board(spark):
    assert checkerboard.grids(spark.createDataFrame([], POINTS), 10.0).count() == 0




DOTS = "img int, label long, n long, y double, x double, r double, g double, b double"
PAINT = {"b": (10.0, 20.0, 200.0), "r": (200.0, 10.0, 20.0), "g": (20.0, 200.0, 10.0)}


def _target(rng, first, centre, size, code, squeeze=1.0, main=0):
    """Six dots around a centre, the main one and five by the bits of a code, in order from a random angle on."""
    start, rows = rng.uniform(0, 6.28), []
    for k in range(6):
        a = start + (k + main) * np.pi / 3
        colour = "b" if k == 0 else "r" if code >> (k - 1) & 1 else "g"
        rows.append((0, first + k, 20, float(centre[0] + size * np.sin(a) * squeeze), float(centre[1] + size * np.cos(a)), *PAINT[colour]))
    return rows


def test_hexagons_and_their_colours(spark, monkeypatch):
    """Targets side by side, one seen aslant, beside stray dots, a six that is no ellipse, and one of two main colours."""
    rng = np.random.default_rng(5)
    want = {0: (100, 100, 13), 10: (100, 145, 0), 20: (150, 100, 31), 30: (150, 150, 6)}
    rows = [r for first, (y, x, code) in want.items() for r in _target(rng, first, (y, x), 10.0, code, 0.8 if first == 30 else 1.0)]
    spoilt = _target(rng, 40, (300, 300), 10.0, 9)
    spoilt[3] = (*spoilt[3][:3], spoilt[3][3] + 7.0, spoilt[3][4] - 6.0, *spoilt[3][5:])
    twice = _target(rng, 50, (400, 300), 10.0, 9)
    twice[2] = (*twice[2][:5], *PAINT["b"])
    stray = [(0, 90 + k, 20, 600.0 + 40 * k, 50.0, *PAINT["b"]) for k in range(3)]
    df = spark.createDataFrame(rows + spoilt + twice + stray, DOTS).repartition(3)
    monkeypatch.setattr(hexagons, "dots", lambda cells, *a, **k: cells)
    got = {r.six: r for r in hexagons.hexagons(df, 0.0, 0.0, 25.0).collect()}
    assert {k: r.bits for k, r in got.items()} == {k: code for k, (_, _, code) in want.items()}
    for k, r in got.items():
        planted = {row[1]: row for row in rows}
        assert (r.y, r.x) == planted[k][3:5] and [(d.y, d.x) for d in r.dots] == [planted[k + n][3:5] for n in range(1, 6)]
    with pytest.raises(ValueError, match="two of"):
        hexagons.hexagons(df, 0.0, 0.0, 25.0, "b", "b")


def test_dots_by_size_and_roundness(spark):
    image = np.full((40, 40, 3), 220.0)
    y, x = np.mgrid[0:40, 0:40]
    image[(y - 8) ** 2 + (x - 8) ** 2 <= 9] = PAINT["r"]
    image[(np.abs(y - 25) <= 1) & (np.abs(x - 20) <= 12)] = PAINT["g"]
    image[(y - 30) ** 2 + (x - 5) ** 2 <= 1] = PAINT["b"]
    cells = spark.createDataFrame([(0, int(a), int(b), *map(float, image[a, b])) for a, b in zip(y.ravel(), x.ravel(), strict=True)], "img int, i int, j int, r double, g double, b double")
    got = hexagons.dots(cells, 100.0, 90.0).collect()
    assert [(r.n, r.y, r.x, r.r, r.g, r.b) for r in got] == [(29, 8.0, 8.0, *PAINT["r"])]
    assert hexagons.reach_of(cells) == 8.0
