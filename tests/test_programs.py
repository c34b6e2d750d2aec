"""Tie-point files in small splits, and masks of a grid, against plain Python."""

from __future__ import annotations

import numpy as np
from ocellus.operators import masks
from ocellus.sources import tiepoints
from pyspark.sql import functions as F


def test_tie_points_over_splits(spark, tmp_path):
    """Pairs of lines on both sides of splits, odd white space, places that are no numbers, and a missing last line."""
    rng = np.random.default_rng(4)
    want, lines = [], []
    for image in range(40):
        own = [(float(rng.integers(0, 500)) / 4, float(rng.integers(0, 500)) / 4, int(rng.integers(0, 60))) for _ in range(int(rng.integers(0, 30)))]
        lines += [f"{image} 640  480 dir/img {image}.png", "  ".join(f"{x} {y} {p}" for x, y, p in own) + (" 7 8" if image % 3 == 0 else "")]
        want += [(image, k, p, x, y) for k, (x, y, p) in enumerate(own)]
    lines += ["40 1 1 bad.png", "1.0 x 3 2 2 5", "no number here", "1 1 1", "41 1 1 last.png"]
    want.append((40, 1, 5, 2.0, 2.0))
    (tmp_path / "a.txt").write_text("\n".join(lines))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "300")
        spark.conf.set(keys[1], "0")
        numbered = tiepoints.numbered_lines(spark, str(tmp_path))
        assert numbered.select("value").rdd.getNumPartitions() > 5
        assert [r.value for r in numbered.orderBy("line").collect()] == lines and [r.line for r in numbered.orderBy("line").collect()] == list(range(len(lines)))
        images, points = tiepoints.tie_points(spark, str(tmp_path))
        assert sorted(tuple(r) for r in points.select("image", "seq", "point", "x", "y").collect()) == sorted(want)
        assert {r.image: r.name for r in images.collect()} == {k: f"{k}.png" for k in range(40)} | {40: "bad.png", 41: "last.png"}
        by_point = {r.point: r.images for r in tiepoints.images_of_points(points).collect()}
        assert by_point == {p: [w[0] for w in sorted(want) if w[2] == p] for p in {w[2] for w in want}}
        by_image = {r.image: r.points for r in tiepoints.points_of_images(points).collect()}
        assert by_image == {i: [w[2] for w in sorted(want) if w[0] == i] for i in {w[0] for w in want}}
        turns = tiepoints.shuffled(points).orderBy("turn").collect()
        assert [r.turn for r in turns] == list(range(len(by_point))) and {r.point for r in turns} == set(by_point)
        assert [r.point for r in turns] != sorted(by_point) and turns == tiepoints.shuffled(points).orderBy("turn").collect()
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def test_masks(spark):
    rng = np.random.default_rng(9)
    p = [(float(x), float(y), 0.0, int(c)) for x, y, c in zip(rng.uniform(-3, 12, 60), rng.uniform(-3, 12, 60), rng.integers(0, 4, 60), strict=True)]
    df = spark.createDataFrame(p, "x double, y double, z double, cluster int")
    to_grid = ((0.0, 1.0, 0.0, 0.5), (1.0, 0.0, 0.0, 0.25))
    cells = {}
    for x, y, _, c in p:
        i, j = int(np.floor(y + 0.5 + 0.5)), int(np.floor(x + 0.25 + 0.5))
        if 0 <= i < 8 and 0 <= j < 9:
            cells.setdefault((i, j), []).append(c)
    got = {(r.i, r.j): r.mask for r in masks.class_mask(df, [1, 2], to_grid, 8, 9).collect()}
    assert got == {(i, j): 255 if {1, 2} & set(cells.get((i, j), [])) else 0 for i in range(8) for j in range(9)}
    own = {(r.i, r.j): r.cluster for r in masks.cluster_mask(df, to_grid, 8, 9).collect()}
    assert own == {(i, j): max(cells[i, j]) + 1 if (i, j) in cells else 0 for i in range(8) for j in range(9)}
    colours = {}
    for r in masks.cover_mask(df, to_grid, 8, 9).collect():
        colours.setdefault(own[r.i, r.j], set()).add((r.r, r.g, r.b))
    assert colours.pop(0) == {(0, 0, 0)} and all(len(c) == 1 and min(next(iter(c))) >= 25 for c in colours.values())


def test_closing_fills_holes_and_keeps_the_border(spark):
    x = np.zeros((9, 9), dtype=int)
    x[:5, :5] = 255
    x[2, 2] = x[0, 3] = 0
    x[6, 6] = 255
    df = spark.createDataFrame([(0, int(i), int(j), int(v)) for (i, j), v in np.ndenumerate(x)], "img int, i int, j int, mask int")
    got = np.zeros_like(x)
    for r in masks.closed(df, 1).select("i", "j", F.col("mask")).collect():
        got[r.i, r.j] = r.mask
    want = x.copy()
    want[2, 2] = want[0, 3] = 255
    assert (got == want).all()
