"""Queries of the window, pixel and histogram families."""

from __future__ import annotations


from pyspark.sql import functions as F

from ocellus.functions import colour
from ocellus.operators import histograms, raster as ops
from ocellus.plans.registry import Registry, with_
from ocellus.plans.standins import RGB_SQL, around_sql, raster, raster_sql, rgb

R = Registry()
CELLS = raster_sql()


def _r(c):
    return F.round(c, 6)


def _cells(op, *columns):
    """Runs op over the stand-in raster and rounds value columns."""

    def run(spark, sf_dir):
        out = op(raster(spark, sf_dir))
        return out.select(*[c for c in out.columns if c in ("img", "i", "j", "rank", "run")], *[_r(F.col(c)).alias(c) for c in (columns or ("value",))])

    return run


def _window(select: str, ri: int, rj: int, where: str = "", having: str = "") -> str:
    return with_(CELLS, around_sql("nb", ri, rj)) + f"SELECT img, i, j, {select} FROM nb {where} GROUP BY img, i, j {having}"


def _joined(spark, sf_dir):
    f = ops.neighbourhood(raster(spark, sf_dir), 1, 1)
    return f.select("img", "i", "j", F.array_join(F.transform("f", lambda v: v.cast("int").cast("string")), ",").alias("f"))


R.add("unfold_3x3", _joined, _window("string_agg(CAST(CAST(v AS INT) AS VARCHAR), ',' ORDER BY di, dj) AS f", 1, 1))

MASK = [[1, 1, 2], [3, 4, 2], [3, 5, 0]]


def _superpixel(spark, sf_dir):
    f = ops.superpixel_features(raster(spark, sf_dir), MASK)
    return f.select("img", "i", "j", *[_r(F.get("f", F.lit(k))).alias(f"f{k + 1}") for k in range(5)])


R.add("unfold_superpixel", _superpixel, _window(
    ", ".join(f"round(avg(v) FILTER (WHERE ({' OR '.join(f'(di={a - 1} AND dj={b - 1})' for a in range(3) for b in range(3) if MASK[a][b] == k)})), 6) AS f{k}" for k in range(1, 6)), 1, 1))


def _rotated(spark, sf_dir):
    f = ops.neighbourhood(raster(spark, sf_dir), 1, 1)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("int").cast("string")), ",")
    return f.select("img", "i", "j", *[text(ops.rotate_window(F.col("f"), 1, q)).alias(f"q{q * 90}") for q in range(4)])


_order = {0: "di, dj", 90: "-dj, di", 180: "-di, -dj", 270: "dj, -di"}
R.add("rotate_patch", _rotated, _window(", ".join(f"string_agg(CAST(CAST(v AS INT) AS VARCHAR), ',' ORDER BY {o}) AS q{q}" for q, o in _order.items()), 1, 1))


def _sub(spark, sf_dir):
    rows = [(w, k, p) for w, places in enumerate(ops.sub_windows(4, 2)) for k, p in enumerate(places)]
    return spark.createDataFrame(rows, "win int, k int, place int")


R.add("sub_windows", _sub, """SELECT CAST(a * 3 + b AS INT) AS win, CAST(x * 2 + y AS INT) AS k, CAST((a + x) * 4 + b + y AS INT) AS place
FROM (SELECT unnest(range(3)) AS a), (SELECT unnest(range(3)) AS b), (SELECT unnest(range(2)) AS x), (SELECT unnest(range(2)) AS y)""")
R.add("box_mean", _cells(lambda c: ops.box_mean(c, 2)), _window("round(avg(nv), 6) AS value", 2, 2, having="HAVING count(nv) = 25"))
R.add("sigma_filter", _cells(lambda c: ops.sigma(c, 1)), _window("round(sqrt(var_pop(nv) * 9), 6) AS value", 1, 1, having="HAVING count(nv) = 9"))
R.add("erode", _cells(lambda c: ops.erode(c, 1)), _window("min(v) AS value", 1, 1))
R.add("dilate", _cells(lambda c: ops.dilate(c, 1)), _window("max(v) AS value", 1, 1))
R.add("erode_disc", _cells(lambda c: ops.erode_disc(c, 2)), _window("min(nv) AS value", 2, 2, where="WHERE di * di + dj * dj <= 4"))
R.add("dilate_disc", _cells(lambda c: ops.dilate_disc(c, 2)), _window("max(nv) AS value", 2, 2, where="WHERE di * di + dj * dj <= 4"))
R.add("median_filter", _cells(lambda c: ops.median(c, 1)), _window("list(v ORDER BY v)[5] AS value", 1, 1))
R.add("conv_gauss_sep", _cells(lambda c: ops.separable(c, [0.25, 0.5, 0.25])),
      _window("sum(v * (CASE di WHEN 0 THEN 0.5 ELSE 0.25 END) * (CASE dj WHEN 0 THEN 0.5 ELSE 0.25 END)) AS value", 1, 1))
TAPS = [(a, b, float((a + 2) * 3 + b + 1)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
for _mode, _at in (("constant", "{0}"), ("periodic", "({0} + {1}) % {1}"), ("mirror", "CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} >= {1} THEN 2 * {1} - 1 - ({0}) ELSE {0} END")):
    R.add(f"conv_generic_{_mode}", _cells(lambda c, m=_mode: ops.gather(c, TAPS, m)), with_(CELLS) + f"""
SELECT c.img, c.i, c.j, CAST(sum(((di + 2) * 3 + dj + 1) * coalesce(n.value, 0)) AS DOUBLE) AS value FROM cells c
CROSS JOIN (SELECT unnest(range(-1, 2)) AS di) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dj)
LEFT JOIN cells n ON n.img = c.img AND n.i = {_at.format('(c.i + di)', 32)} AND n.j = {_at.format('(c.j + dj)', 48)} GROUP BY c.img, c.i, c.j""")
_CLAMP = """near AS (SELECT c.img, c.i, c.j, c.value AS centre, di, dj, n.value AS v FROM cells c
    CROSS JOIN (SELECT unnest(range(-1, 2)) AS di) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dj)
    JOIN cells n ON n.img = c.img AND n.i = least(greatest(c.i + di, 0), 31) AND n.j = least(greatest(c.j + dj, 0), 47)),
grad AS (SELECT img, i, j, any_value(centre) AS value, sum(dj * (2 - abs(di)) * v) AS gx, sum(di * (2 - abs(dj)) * v) AS gy FROM near GROUP BY img, i, j)"""
R.add("sobel", lambda s, d: ops.sobel(raster(s, d)).select("img", "i", "j", "gx", "gy"), with_(CELLS, _CLAMP) + "SELECT img, i, j, gx, gy FROM grad")
R.add("gradient_edges", _cells(lambda c: ops.gradient_edges(c, 0.1), "amp"), with_(CELLS, _CLAMP, "a AS (SELECT img, i, j, gx * gx + gy * gy AS amp, row_number() OVER (PARTITION BY img ORDER BY gx * gx + gy * gy) AS k, count(*) OVER (PARTITION BY img) AS n FROM grad)",
      "l AS (SELECT img, amp AS lev FROM a WHERE k = floor(0.9 * (n - 1)) + 1)") + "SELECT a.img, i, j, amp FROM a JOIN l ON a.img = l.img WHERE amp >= lev")
R.add("nms_topk", _cells(lambda c: ops.local_maxima(c, 1, 20.0, 10)), with_(CELLS, around_sql("nb", 1, 1), "m AS (SELECT img, i, j, any_value(centre) AS value FROM nb GROUP BY img, i, j HAVING any_value(centre) = max(v) AND any_value(centre) > 20)",
      "k AS (SELECT *, CAST(row_number() OVER (PARTITION BY img ORDER BY value DESC, i, j) AS INT) AS rank FROM m)") + "SELECT img, i, j, value, rank FROM k WHERE rank <= 10")
R.add("avg_pool", _cells(lambda c: ops.average_pool(c, 5)), with_(CELLS) + "SELECT img, CAST(i // 5 AS INT) AS i, CAST(j // 5 AS INT) AS j, round(avg(value), 6) AS value FROM cells GROUP BY ALL")
R.add("harris", _cells(lambda c: ops.harris(c)), with_(CELLS, _CLAMP, """t AS (SELECT c.img, c.i, c.j, sum(n.gx * n.gx) AS xx, sum(n.gx * n.gy) AS xy, sum(n.gy * n.gy) AS yy FROM grad c
    JOIN grad n ON n.img = c.img AND abs(n.i - c.i) <= 1 AND abs(n.j - c.j) <= 1 GROUP BY c.img, c.i, c.j)""") + "SELECT img, i, j, round(CASE WHEN xx + yy = 0 THEN 0 ELSE (xx * yy - xy * xy) / (xx + yy) END, 6) AS value FROM t")
_ring = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(ops.CIRCLE))
R.add("fast_corner", _cells(lambda c: ops.fast_corner(c, 8.0), "run"), with_(CELLS, f"""ring(k, a, b) AS (VALUES {_ring}), on_ AS (SELECT c.img, c.i, c.j, k, coalesce(n.value > c.value + 8, false) AS up, coalesce(n.value < c.value - 8, false) AS down
    FROM cells c CROSS JOIN ring LEFT JOIN cells n ON n.img = c.img AND n.i = c.i + a AND n.j = c.j + b),
twice AS (SELECT img, i, j, k, up, down FROM on_ UNION ALL SELECT img, i, j, k + 16, up, down FROM on_),
sides AS (SELECT img, i, j, k, 0 AS s, up AS x FROM twice UNION ALL SELECT img, i, j, k, 1, down FROM twice),
gaps AS (SELECT *, k - row_number() OVER (PARTITION BY img, i, j, s ORDER BY k) AS g FROM sides WHERE x),
long AS (SELECT img, i, j, s, g, count(*) AS n FROM gaps GROUP BY ALL)""") + "SELECT c.img, c.i, c.j, CAST(least(coalesce(max(n), 0), 16) AS INT) AS run FROM cells c LEFT JOIN long l ON l.img = c.img AND l.i = c.i AND l.j = c.j GROUP BY c.img, c.i, c.j")
R.queries["fast_corner"] = lambda s, d: ops.fast_corner(raster(s, d), 8.0)
R.add("orientation", _cells(lambda c: ops.orientation(c, 2), "oy", "ox"), with_(CELLS, around_sql("nb", 2, 2), "m AS (SELECT img, i, j, sum(di * v) AS y, sum(dj * v) AS x FROM nb GROUP BY img, i, j)") +
      "SELECT img, i, j, CASE WHEN x = 0 AND y = 0 THEN NULL ELSE round(y / sqrt(x * x + y * y), 6) END AS oy, CASE WHEN x = 0 AND y = 0 THEN NULL ELSE round(x / sqrt(x * x + y * y), 6) END AS ox FROM m")


def _places(spark, sf_dir):
    c = raster(spark, sf_dir)
    return c.select((F.col("img") * 1536 + F.col("i") * 48 + F.col("j")).alias("pt"), "img", (F.col("i") + 0.25).alias("y"), (F.col("j") + 0.625).alias("x"))


_PLACES = "pts AS (SELECT img * 1536 + i * 48 + j AS pt, img, i + 0.25::DOUBLE AS y, j + 0.625::DOUBLE AS x FROM cells)"
R.add("interp_bilinear", lambda s, d: ops.interpolate(raster(s, d), _places(s, d)).select("pt", _r("value").alias("value")), with_(CELLS, _PLACES) + """
SELECT pt, round(sum((1 - abs(y - n.i)) * (1 - abs(x - n.j)) * n.value), 6) AS value FROM pts p JOIN cells n ON n.img = p.img AND abs(y - n.i) < 1 AND abs(x - n.j) < 1 GROUP BY pt""")
_keys = "(CASE WHEN abs({0}) <= 1 THEN 1.5 * abs({0}) ** 3 - 2.5 * abs({0}) ** 2 + 1 ELSE -0.5 * abs({0}) ** 3 + 2.5 * abs({0}) ** 2 - 4 * abs({0}) + 2 END)"
R.add("interp_bicubic", lambda s, d: ops.interpolate(raster(s, d), _places(s, d), "cubic").select("pt", _r("value").alias("value")), with_(CELLS, _PLACES) + f"""
SELECT pt, round(sum({_keys.format('(y - n.i)')} * {_keys.format('(x - n.j)')} * n.value), 6) AS value FROM pts p JOIN cells n ON n.img = p.img AND abs(y - n.i) < 2 AND abs(x - n.j) < 2 GROUP BY pt""")


def _rgb(columns):
    return lambda s, d: rgb(s, d).select("img", "i", "j", *[_r(c).alias(n) for n, c in columns().items()])


_px = "SELECT img, i, j, "
R.add("log_exp", lambda s, d: raster(s, d).select("img", "i", "j", _r(colour.log_colour(F.col("value") + 1)).alias("lv"), _r(colour.exp_colour(F.col("value") / 64)).alias("ev")), with_(CELLS) + _px + "round(ln(value + 1), 6) AS lv, round(exp(value / 64), 6) AS ev FROM cells")
R.add("norm_rgb", _rgb(lambda: colour.normalised_rgb(*map(F.col, "rgb"))), with_(RGB_SQL) + _px + ", ".join(f"round(CASE WHEN r + g + b = 0 THEN NULL ELSE {c} / ((r + g + b) / 3) END, 6) AS n{c}" for c in "rgb") + " FROM rgb")
R.add("rg_chroma", _rgb(lambda: colour.chromaticity(*map(F.col, "rgb"))), with_(RGB_SQL) + _px + ", ".join(f"round(CASE WHEN r + g + b = 0 THEN NULL ELSE {c} / (r + g + b) END, 6) AS c{c}" for c in "rg") + " FROM rgb")
R.add("rgb2hsi", _rgb(lambda: colour.rgb_to_hsi(*map(F.col, "rgb"))), with_(RGB_SQL, """q AS (SELECT *, (r - g + r - b) / 2 AS num, sqrt((r - g) * (r - g) + (r - b) * (g - b)) AS den, (r + g + b) / 3 AS inten FROM rgb),
q2 AS (SELECT *, CASE WHEN den = 0 THEN 0 ELSE degrees(acos(least(greatest(num / den, -1), 1))) END AS th FROM q)""") + _px + "round(CASE WHEN b > g THEN 360 - th ELSE th END, 6) AS hue, round(CASE WHEN inten = 0 THEN 0 ELSE 1 - least(r, g, b) / inten END, 6) AS saturation, round(inten, 6) AS intensity FROM q2")
R.add("to_gray", _rgb(lambda: {"gray": colour.gray(*map(F.col, "rgb"))}), with_(RGB_SQL) + _px + "round(0.2989 * r + 0.5870 * g + 0.1140 * b, 6) AS gray FROM rgb")
R.add("bgr2rgb", _rgb(lambda: dict(zip("rgb", colour.swap_red_blue(*map(F.col, "rgb")), strict=True))), with_(RGB_SQL) + _px + "b AS r, g, r AS b FROM rgb")
R.add("yuv2rgb", lambda s, d: rgb(s, d).select("img", "i", "j", *[c.alias(n) for n, c in colour.yuv_to_rgb(*[F.col(c).cast("int") for c in "rgb"]).items()]), with_(RGB_SQL, "y AS (SELECT img, i, j, CAST(r AS INT) AS y, CAST(g AS INT) - 128 AS u, CAST(b AS INT) - 128 AS v FROM rgb)") + _px + """
CAST(least(greatest(y + ((351 * v) // 256 - CASE WHEN 351 * v % 256 < 0 THEN 1 ELSE 0 END), 0), 255) AS INT) AS r,
CAST(least(greatest(y - (CAST(floor((179 * v + 86 * u) / 256.0) AS INT)), 0), 255) AS INT) AS g,
CAST(least(greatest(y + CAST(floor(443 * u / 256.0) AS INT), 0), 255) AS INT) AS b FROM y""".replace("((351 * v) // 256 - CASE WHEN 351 * v % 256 < 0 THEN 1 ELSE 0 END)", "CAST(floor(351 * v / 256.0) AS INT)"))
R.add("percentile_stretch", _cells(lambda c: histograms.percentile_stretch(c, 0.05, 0.95)), with_(CELLS, """o AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY img) AS n FROM cells),
lo AS (SELECT img, value AS lo FROM o WHERE k = CAST(floor(0.05 * n) AS INT)), hi AS (SELECT img, value AS hi FROM o WHERE k = CAST(floor(0.95 * n) AS INT))""") +
      "SELECT c.img, i, j, CASE WHEN hi = lo THEN 0.0 ELSE round(least(greatest((value - lo) / (hi - lo), 0), 1), 6) END AS value FROM cells c JOIN lo ON lo.img = c.img JOIN hi ON hi.img = c.img")
R.add("hist_int", lambda s, d: histograms.integer_histogram(raster(s, d)), with_(CELLS, "b AS (SELECT img, min(value) AS lo, max(value) AS hi FROM cells GROUP BY img)", "g AS (SELECT img, CAST(unnest(range(0, CAST(hi - lo + 1 AS BIGINT))) AS BIGINT) AS bin, lo FROM b)") +
      "SELECT g.img, g.bin, count(c.value) AS n FROM g LEFT JOIN cells c ON c.img = g.img AND c.value - lo = bin GROUP BY g.img, g.bin")
R.add("hist_int_range", lambda s, d: histograms.integer_histogram(raster(s, d), 10, 40), with_(CELLS, "g AS (SELECT img, CAST(unnest(range(0, 31)) AS BIGINT) AS bin FROM (SELECT DISTINCT img FROM cells))") +
      "SELECT g.img, g.bin, count(c.value) AS n FROM g LEFT JOIN cells c ON c.img = g.img AND least(greatest(c.value, 10), 40) - 10 = bin GROUP BY g.img, g.bin")
_FH = """b AS (SELECT img, min(value) AS lo, max(value) AS hi FROM cells GROUP BY img), h AS (SELECT c.img, CAST(least(floor((value - lo) / (hi - lo) * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM cells c JOIN b ON b.img = c.img GROUP BY ALL),
fh AS (SELECT b.img, k AS bin, coalesce(n, 0) AS n, lo, hi FROM b CROSS JOIN range(10) r(k) LEFT JOIN h ON h.img = b.img AND h.bin = k)"""
R.add("hist_float", lambda s, d: histograms.float_histogram(raster(s, d), 10).select("img", "bin", "n"), with_(CELLS, _FH) + "SELECT img, bin, n FROM fh")
R.add("hist_entropy", lambda s, d: histograms.summary(histograms.float_histogram(raster(s, d), 10)), with_(CELLS, _FH) + "SELECT img, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n * n) AS BIGINT) AS entropy FROM fh GROUP BY img")
R.add("otsu", lambda s, d: histograms.otsu(histograms.float_histogram(raster(s, d), 10)).select("img", _r("threshold").alias("threshold")), with_(CELLS, _FH, """c AS (SELECT *, sum(n) OVER w AS n0, sum(n * bin) OVER w AS s0, sum(n) OVER (PARTITION BY img) AS nt, sum(n * bin) OVER (PARTITION BY img) AS st FROM fh WINDOW w AS (PARTITION BY img ORDER BY bin)),
v AS (SELECT *, CASE WHEN n0 = 0 OR n0 = nt THEN 0 ELSE CAST(n0 AS DOUBLE) * (nt - n0) * (s0 / n0 - (st - s0) / (nt - n0)) ** 2 END AS var FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY round(var, 3) DESC, bin) AS k FROM v)""") + "SELECT img, round(lo + (bin + 1) * (hi - lo) / 10, 6) AS threshold FROM p WHERE k = 1")
R.add("balanced_threshold", lambda s, d: histograms.balanced_threshold(histograms.float_histogram(raster(s, d), 10)))
R.add("threshold_filter", lambda s, d: raster(s, d).where("value > 30"), with_(CELLS) + "SELECT img, i, j, value FROM cells WHERE value > 30")
R.add("weighted_median", lambda s, d: histograms.weighted_median(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w"))), """
WITH c AS (SELECT l_suppkey AS g, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), d AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY v) AS cum, sum(w) OVER (PARTITION BY g) AS tot FROM c)
SELECT g, min(v) AS median FROM d WHERE 2 * cum > tot GROUP BY g""")


def _lens(s, d):
    from ocellus.functions import filters

    c = raster(s, d)
    return c.select("img", "i", "j", *[_r(x).alias(n) for n, x in filters.lens_map(F.col("i"), F.col("j"), 50.0, 48, 32, (-0.1, 0.02, 0.0)).items()])


R.add(
    "lens_map",
    _lens,
    (
        with_(
            CELLS,
            "n AS (SELECT img, i, j, (j - 23.5) / 50 AS x, (i - 15.5) / 50 AS y FROM cells)",
            "k AS (SELECT *, 1 + (x * x + y * y) * (-0.1 + (x * x + y * y) * 0.02) AS k FROM n)",
        )
        + "SELECT img, i, j, round(y * k * 50 + 15.5, 6) AS si, round(x * k * 50 + 23.5, 6) AS sj FROM k"
    ),
)


def _balanced_sql() -> str:
    from ocellus.plans.kernel_sql import BALANCED

    return f"WITH RECURSIVE hf AS ({R.sql['hist_float']})" + BALANCED.format(histogram="hf")


R.sql["balanced_threshold"] = _balanced_sql()
