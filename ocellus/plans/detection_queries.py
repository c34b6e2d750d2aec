"""Queries over planted targets: boards drawn into the stand-in images, whose own values stay as noise."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.operators import checkerboard, hexagons
from ocellus.operators.raster import CELL
from ocellus.plans.registry import Registry, with_
from ocellus.plans.standins import H, W, around_sql, raster, raster_sql

R = Registry()
LEAST, REACH, TOLERANCE, ANGLE = 10.0, 12.0, 0.2, 0.15


def board_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slanted board in each image, by waves of 8 and 7 cells, over a fiftieth of the image's own values."""
    x = F.col("j") - 0.1 * F.col("i") + F.col("img") % 4
    y = F.col("i") + 0.1 * F.col("j")
    wave = 100 * F.sin(x * math.pi / 8) * F.sin(y * math.pi / 7)
    return raster(spark, sf_dir).select(*CELL, (F.round(wave + F.col("value") / 50, 3) + 0.0).alias("value"))


BOARD_CELLS = f"""board AS (SELECT img, i, j, round(100 * sin((j - 0.1::DOUBLE * i + img % 4) * {math.pi!r} / 8) * sin((i + 0.1::DOUBLE * j) * {math.pi!r} / 7) + value / 50, 3) + 0.0 AS value FROM cells)"""


def _corner_parts() -> list[str]:
    """Saddles, their filter and their places between cells."""
    tap = lambda e: f"sum({e} * v)"
    sections = []
    for di, dj in checkerboard.SECTIONS:
        sections.append(f"list_sum(list_sort(list(v) FILTER (WHERE abs(w.di - ({di})) <= 1 AND abs(w.dj - ({dj})) <= 1))[3:7])")
    apart = [f"abs(s[{2 * k + 1}] - s[{2 * k + 2}])" for k in range(4)]
    beyond = lambda share: " + ".join(f"CAST({a} > {share} * (list_max(s) - list_min(s)) AS INT)" for a in apart)
    mean = "2.0"
    spread = 5 * sum((k * k - 2) ** 2 for k in range(-2, 3))
    return [
        around_sql("nb", 1, 1, "board"),
        f"h AS (SELECT img, i, j, {tap('CASE WHEN dj = 0 THEN 3 * di * di - 2 ELSE 0 END')} AS yy, {tap('CASE WHEN di = 0 THEN 3 * dj * dj - 2 ELSE 0 END')} AS xx, {tap('di * dj')} / 4 AS xy FROM nb GROUP BY img, i, j)",
        "det AS (SELECT img, i, j, xx * yy - xy * xy AS value, (xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy * xy) AS lo, (xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy * xy) AS hi, atan2(xy, (xx - yy) / 2) / 2 AS direction FROM h)",
        around_sql("near", 1, 1, "det"),
        "least_ AS (SELECT img, i, j, min(v) AS m, bool_and(v > centre) FILTER (WHERE di < 0 OR di = 0 AND dj < 0) AS first_ FROM near GROUP BY img, i, j)",
        f"corner AS (SELECT d.* FROM det d JOIN least_ USING (img, i, j) WHERE lo <= -{LEAST} AND hi >= {LEAST} AND d.value = m AND first_)",
        "wide AS (SELECT c.img, c.i, c.j, a.di, b.dj, coalesce(n.value, 0.0) AS v FROM corner c CROSS JOIN (SELECT unnest(range(-3, 4)) AS di) a CROSS JOIN (SELECT unnest(range(-3, 4)) AS dj) b LEFT JOIN board n ON n.img = c.img AND n.i = c.i + a.di AND n.j = c.j + b.dj)",
        f"sections AS (SELECT img, i, j, [{', '.join(sections)}] AS s FROM wide w GROUP BY img, i, j)",
        f"good AS (SELECT c.* FROM corner c JOIN sections USING (img, i, j) WHERE c.i >= 3 AND c.j >= 3 AND c.i < {H - 3} AND c.j < {W - 3} AND {beyond(0.2)} <= 3 AND {beyond(0.6)} <= 1)",
        f"""fit AS (SELECT img, i, j, {tap('di / 50.0::DOUBLE')} AS gy, {tap('dj / 50.0::DOUBLE')} AS gx, {tap(f'2 * (di * di - {mean}) / {spread}.0::DOUBLE')} AS yy, {tap(f'2 * (dj * dj - {mean}) / {spread}.0::DOUBLE')} AS xx, {tap('di * dj / 100.0::DOUBLE')} AS xy
  FROM wide WHERE abs(di) <= 2 AND abs(dj) <= 2 GROUP BY img, i, j)""",
        "moved AS (SELECT img, i, j, (xy * gx - xx * gy) / nullif(yy * xx - xy * xy, 0) AS dy, (xy * gy - yy * gx) / nullif(yy * xx - xy * xy, 0) AS dx FROM fit)",
        f"""pts AS (SELECT img, img::BIGINT * {checkerboard.IMG} + i::BIGINT * {checkerboard.ROW} + j AS node, direction, i + CASE WHEN abs(dy) <= 1 AND abs(dx) <= 1 THEN dy ELSE 0.0 END AS y, j + CASE WHEN abs(dy) <= 1 AND abs(dx) <= 1 THEN dx ELSE 0.0 END AS x
  FROM good JOIN moved USING (img, i, j))""",
    ]


def _turn(x: str, y: str, k: str) -> tuple[str, str]:
    return f"CASE {k} WHEN 0 THEN {x} WHEN 1 THEN -({y}) WHEN 2 THEN -({x}) ELSE {y} END", f"CASE {k} WHEN 0 THEN {y} WHEN 1 THEN {x} WHEN 2 THEN -({y}) ELSE -({x}) END"


def _grid_parts() -> list[str]:
    quarter = lambda a, b: f"CASE WHEN {a} = 1 THEN 0 WHEN {b} = 1 THEN 1 WHEN {a} = -1 THEN 2 ELSE 3 END"
    cases = []
    for a, b in ((1, 0), (0, 1), (-1, 0), (0, -1)):
        s = "u" if a else "v"
        cases.append(f"SELECT p, q, {a} AS a, {b} AS b, round((dy - {a + b} * {s}y) ** 2 + (dx - {a + b} * {s}x) ** 2, 6) AS miss, {s}y ** 2 + {s}x ** 2 AS step2 FROM framed")
    tx, ty = _turn("l.c", "l.d", "f.k")
    rx, ry = _turn("x", "y", "quarter")
    return [
        f"""pairs AS (SELECT p.node AS p, q.node AS q, q.y - p.y AS dy, q.x - p.x AS dx, round((q.y - p.y) ** 2 + (q.x - p.x) ** 2, 6) AS d2 FROM pts p JOIN pts q ON p.img = q.img AND p.node <> q.node
  WHERE cos(2 * (p.direction - q.direction)) <= -{math.cos(2 * ANGLE)!r} AND round((q.y - p.y) ** 2 + (q.x - p.x) ** 2, 6) <= {REACH * REACH})""",
        "u AS (SELECT p, dy AS uy, dx AS ux FROM pairs QUALIFY row_number() OVER (PARTITION BY p ORDER BY d2, q) = 1)",
        """v AS (SELECT p, sign(ux * dy - uy * dx) * dy AS vy, sign(ux * dy - uy * dx) * dx AS vx FROM (SELECT * FROM pairs JOIN u USING (p) WHERE 4 * (dy * uy + dx * ux) ** 2 <= d2 * (uy * uy + ux * ux))
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY d2, q) = 1)""",
        "framed AS (SELECT * FROM pairs JOIN u USING (p) LEFT JOIN v USING (p))",
        f"tried AS ({' UNION ALL '.join(cases)})",
        f"one AS (SELECT p, q, a, b, miss FROM tried WHERE miss <= {TOLERANCE * TOLERANCE!r}::DOUBLE * step2 QUALIFY row_number() OVER (PARTITION BY p, q ORDER BY miss, a, b) = 1)",
        "best AS (SELECT p, q, a, b FROM one QUALIFY row_number() OVER (PARTITION BY p, a, b ORDER BY miss, q) = 1)",
        "links AS (SELECT x.*, y.a AS c, y.b AS d FROM best x JOIN best y ON y.p = x.q AND y.q = x.p)",
        # From every corner outwards over links, each new place once; the least start that reaches a corner is its root.
        f"""reach(node, root) AS (SELECT DISTINCT p, p FROM links UNION SELECT l.p, r.root FROM reach r JOIN links l ON l.q = r.node WHERE r.root < l.p)""",
        "roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)",
        f"""frame(node, root, x, y, k) AS (SELECT node, root, 0, 0, 0 FROM roots WHERE node = root
  UNION SELECT l.p, f.root, f.x + {tx}, f.y + {ty}, (f.k + {quarter('l.c', 'l.d')} + 2 - {quarter('l.a', 'l.b')} + 4) % 4 FROM frame f JOIN links l ON l.q = f.node WHERE abs(f.x) + abs(f.y) < 64)""",
        """sound AS (SELECT root FROM frame GROUP BY root HAVING count(*) = count(DISTINCT node) AND count(DISTINCT (x, y)) = count(*))""",
        """spot AS (SELECT f.node, f.root, f.x, f.y, p.img, p.y AS py, p.x AS px, f.x - avg(f.x) OVER w AS mx, f.y - avg(f.y) OVER w AS my, count(*) OVER w AS n
  FROM frame f JOIN sound USING (root) JOIN pts p ON p.node = f.node WINDOW w AS (PARTITION BY root))""",
        f"aimed AS (SELECT *, (CAST(round(atan2(round(sum(mx * py - my * px) OVER w, 6), round(sum(mx * px + my * py) OVER w, 6)) / {math.pi / 2!r}) AS INT) + 4) % 4 AS quarter FROM spot WHERE n >= 4 WINDOW w AS (PARTITION BY root))",
        f"turned AS (SELECT *, {rx} AS nx, {ry} AS ny FROM aimed)",
        "grid AS (SELECT img, root AS board, CAST(ny - min(ny) OVER w AS INT) AS row, CAST(nx - min(nx) OVER w AS INT) AS col, round(py, 4) + 0.0 AS y, round(px, 4) + 0.0 AS x FROM turned WINDOW w AS (PARTITION BY root))",
    ]


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkerboard.checkerboards(board_cells(spark, sf_dir), LEAST, REACH, tolerance=TOLERANCE, angle=ANGLE)
    return found.select("img", "board", "row", "col", (F.round("y", 4) + 0.0).alias("y"), (F.round("x", 4) + 0.0).alias("x"))


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = board_cells(spark, sf_dir)
    found = checkerboard.saddle_points(cells, checkerboard.plausible(cells, checkerboard.corners(cells, LEAST)))
    return found.select(*CELL, (F.round("y", 4) + 0.0).alias("y"), (F.round("x", 4) + 0.0).alias("x"))


R.add("checkerboard_filtered", _filtered, with_(raster_sql(), BOARD_CELLS, *_corner_parts()) + f"SELECT img, CAST(node // {checkerboard.ROW} % {checkerboard.ROW} AS INT) AS i, CAST(node % {checkerboard.ROW} AS INT) AS j, round(y, 4) + 0.0 AS y, round(x, 4) + 0.0 AS x FROM pts")
R.add("checkerboard_grid", _grid, "WITH RECURSIVE " + ",\n".join([raster_sql(), BOARD_CELLS, *_corner_parts(), *_grid_parts()]) + "\nSELECT * FROM grid")


# --- hexagonal targets: six dots around the middle of each image, turned and coded by its number, on the image's own grey

_DOTS = [(round(16 + 11 * math.sin(a)), round(24 + 11 * math.cos(a))) for a in (0.2 + k * math.pi / 3 for k in range(6))]
_CODE = "(img * 5 + 3) % 32"
_GREY = "200 + value / 4"


def _hexagon_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot k of image img is the main one if k = img % 6; the others, in order from it on, are red where a bit of the code is set, else green."""
    rows = raster(spark, sf_dir)
    near = F.coalesce(*[F.when((F.col("i") - y) * (F.col("i") - y) + (F.col("j") - x) * (F.col("j") - x) <= 5, F.lit(k)) for k, (y, x) in enumerate(_DOTS)])
    rows = rows.withColumn("k", near).withColumn("place", F.pmod(F.col("k") - F.col("img") % 6, F.lit(6)))
    bit = F.expr(f"shiftright({_CODE}, place - 1) & 1")
    kind = F.when(F.col("k").isNull(), "none").when(F.col("place") == 0, "main").when(bit == 1, "red").otherwise("green")
    grey = F.col("value") / 4 + 200
    paint = {"r": {"main": 30.0, "red": 210.0, "green": 40.0}, "g": {"main": 40.0, "red": 35.0, "green": 190.0}, "b": {"main": 220.0, "red": 30.0, "green": 45.0}}
    shade = lambda of: F.when(kind == "none", grey).when(kind == "main", of["main"]).when(kind == "red", of["red"]).otherwise(of["green"])
    return rows.select(*CELL, *[shade(of).alias(c) for c, of in paint.items()])


def _hexagons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hexagons.hexagons(_hexagon_cells(spark, sf_dir), 100.0, 90.0, 30.0)
    return found.select("img", "bits", (F.round("y", 4) + 0.0).alias("y"), (F.round("x", 4) + 0.0).alias("x"), F.size("dots").alias("n"))


_PLACES = ", ".join(f"({k}, {y}, {x})" for k, (y, x) in enumerate(_DOTS))
R.add("hexagon_targets", _hexagons, with_(raster_sql()) + f"""SELECT img, CAST({_CODE} AS INT) AS bits, CAST(p.y AS DOUBLE) AS y, CAST(p.x AS DOUBLE) AS x, CAST(5 AS INT) AS n
FROM (SELECT DISTINCT img FROM cells) JOIN (VALUES {_PLACES}) AS p(k, y, x) ON p.k = img % 6""")
