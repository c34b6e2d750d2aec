"""Queries of slices and refinements of cost volumes, growth over a background, masks, Jacobians, kernels' derivatives and files."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from ocellus.functions import colour, kernels, vectors
from ocellus.functions import geometry as g
from ocellus.operators import raster as ops
from ocellus.operators import attributes, graphs, segmentation, sequential, solve, spatial, stereo
from ocellus.operators import volumes as v
from ocellus.operators.iteration import shared_dir
from ocellus.plans import kernel_sql
from ocellus.plans.registry import Registry, with_
from ocellus.plans.spatial_queries import _GEO, _ROT, _faces, _geo, _r
from ocellus.plans.spatial_queries import R as R_spatial
from ocellus.plans.standins import POINTS_SQL, RGB_SQL, H, W, around_sql, points, raster, raster_sql, rgb, table
from ocellus.plans.stereo_queries import _PARA, _V2, PAIR_SQL, VOLUME_SQL, WIN_SQL, D, _pair, _volume

R = Registry()
CELLS = raster_sql()


def _texts(c):
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("int").cast("string"), F.lit("-"))), ",")


def _slot_sql(k: int, other: bool, h: int, v_: int) -> str:
    """Whether a slot is inside: the window of radius (v_, h) around its place and its partner."""
    rows = f"w.i >= {v_} AND w.i + {v_} < {H} AND w.d + {k} >= 0 AND w.d + {k} < {D}"
    return f"{rows} AND least(w.j - {k}, w.j) >= {h} AND greatest(w.j - {k}, w.j) + {h} < {W}" if other else f"{rows} AND w.j >= {h} AND w.j + w.d + {k} + {h} < {W}"


def _slices_sql(direction: str, value: bool) -> str:
    joins, entries = [], []
    for n, (k, other) in enumerate(stereo._slots(1, direction)):
        inside = _slot_sql(k, other, 1, 1)
        joins.append(f"LEFT JOIN vol o{n} ON o{n}.img = w.img AND o{n}.i = w.i AND o{n}.j = w.j - {k if other else 0} AND o{n}.d = w.d + {k}")
        entries.append(f"CASE WHEN {inside} THEN coalesce(CAST(CAST(o{n}.cost AS INT) AS VARCHAR), '-') ELSE '-' END" if value else f"CASE WHEN {inside} THEN '1' ELSE '0' END")
    name = "costs" if value else "inside"
    return with_(*PAIR_SQL, VOLUME_SQL, WIN_SQL) + f"SELECT w.img, w.i, w.j, w.d, concat_ws(',', {', '.join(entries)}) AS {name} FROM win w " + (" ".join(joins) if value else "")


for _d in ("reversed", "both"):
    R.add(f"truncated_{_d}", lambda s, d, k=_d: stereo.slices(_volume()(s, d), 1, k, 1, 1).select("img", "i", "j", "d", _texts(F.col("costs")).alias("costs")), _slices_sql(_d, True))
R.add("truncated_window", lambda s, d: stereo.slices(_volume()(s, d), 1, "same", 1, 1).select("img", "i", "j", "d", _texts(F.col("costs")).alias("costs")), _slices_sql("same", True))
R.add("in_bound_crop", lambda s, d: stereo.in_bounds(_volume()(s, d), 1, "both", 1, 1).select("img", "i", "j", "d", _texts(F.col("inside")).alias("inside")), _slices_sql("both", False))

_PATCH = ", ".join(f"max(cost) FILTER (WHERE o.d1 = w.d1 + {a} AND o.d2 = w.d2 + {b}) AS f{(a + 1) * 3 + b + 1}" for a in (-1, 0, 1) for b in (-1, 0, 1))
_P2 = [
    *PAIR_SQL, _V2, "w AS (SELECT img, i, j, max_by(struct_pack(d1 := d1, d2 := d2), struct_pack(c := -cost, d1 := d1, d2 := d2)) AS d FROM vol2 GROUP BY img, i, j)",
    f"pt AS (SELECT w.img, w.i, w.j, w.d1, w.d2, {_PATCH} FROM (SELECT img, i, j, d.d1 AS d1, d.d2 AS d2 FROM w) w JOIN vol2 o ON o.img = w.img AND o.i = w.i AND o.j = w.j GROUP BY ALL)",
    f"own AS (SELECT *, {' AND '.join(f'f{k} IS NOT NULL' for k in range(9))} AS whole, {_PARA.format('f1', 'f4', 'f7')} AS y1, {_PARA.format('f3', 'f4', 'f5')} AS x1 FROM pt)",
]
_KEPT = "SELECT img, i, j, round(d1 + CASE WHEN whole AND abs(dy) <= 1 AND abs(dx) <= 1 THEN dy ELSE 0 END, 5) + 0.0 AS y, round(d2 + CASE WHEN whole AND abs(dy) <= 1 AND abs(dx) <= 1 THEN dx ELSE 0 END, 5) + 0.0 AS x FROM m"


def _side(a: int, b: int, c: int, middle: str) -> str:
    return f"CASE WHEN f{b} <= f{a} AND f{b} < f{c} THEN {_PARA.format(f'f{a}', f'f{b}', f'f{c}')} ELSE {middle} END"


def _moved(isotropic):
    out = lambda s, d: stereo.refine_2d(v.cost_volume_2d(_pair(s, d), vectors.sad, (-1, 1), (0, 3)), isotropic=isotropic)
    return lambda s, d: out(s, d).select("img", "i", "j", *[(F.round(c, 5) + 0.0).alias(c) for c in "yx"])


R.add("refine_2d_isotropic", _moved(True), with_(*_P2, "m AS (SELECT *, y1 AS dy, x1 AS dx FROM own)") + _KEPT)
R.add("refine_2d_anisotropic", _moved(False), with_(
    *_P2, f"side AS (SELECT *, {_side(0, 3, 6, 'y1')} AS y0, {_side(2, 5, 8, 'y1')} AS y2, {_side(0, 1, 2, 'x1')} AS x0, {_side(6, 7, 8, 'x1')} AS x2 FROM own)",
    "line AS (SELECT *, (y2 - y0) / 2 AS a0, (y0 + y1 + y2) / 3 AS b0, (x2 - x0) / 2 AS a1, (x0 + x1 + x2) / 3 AS b1 FROM side)",
    "m AS (SELECT *, CASE WHEN 1 - a0 * a1 <> 0 THEN (a0 * b1 + b0) / (1 - a0 * a1) END AS dy, CASE WHEN 1 - a0 * a1 <> 0 THEN (a1 * b0 + b1) / (1 - a0 * a1) END AS dx FROM line)") + _KEPT)

_T = "LEFT JOIN nt {0} ON {0}.img = s.img AND {0}.i = s.i AND {0}.j = s.j + s.d + ({1}) AND {0}.di = s.di AND {0}.dj = s.dj"
_OWN = "s.v * 0.5 + CASE WHEN one > 0 THEN coalesce(p.v, 0) ELSE coalesce(n.v, 0) END * 0.5"
R.add("refine_cost_symmetric", lambda s, d: stereo.cost_symmetric(_pair(s, d), vectors.ssd, D).select("img", "i", "j", (F.round("disparity", 5) + 0.0).alias("disparity")), with_(
    *PAIR_SQL, VOLUME_SQL.replace("sum(abs(s.v - coalesce(t.v, 0)))", "sum((s.v - coalesce(t.v, 0)) ** 2)"), WIN_SQL,
    "tri AS (SELECT w.img, w.i, w.j, w.d, max(cost) FILTER (WHERE o.d = w.d - 1) AS a, max(cost) FILTER (WHERE o.d = w.d) AS b, max(cost) FILTER (WHERE o.d = w.d + 1) AS c FROM win w JOIN vol o ON o.img = w.img AND o.i = w.i AND o.j = w.j GROUP BY ALL)",
    f"one AS (SELECT *, CASE WHEN j > 1 AND j + 1 < {W} AND d > 0 AND d + 1 < {D} THEN {_PARA.format('a', 'b', 'c')} END AS one FROM tri)",
    "s AS (SELECT ns.*, one.d, one FROM ns JOIN one USING (img, i, j))",
    f"""half AS (SELECT s.img, s.i, s.j, s.d, one, sum(({_OWN} - coalesce(x.v, 0)) ** 2) AS ca, sum(({_OWN} - coalesce(y.v, 0)) ** 2) AS cb, sum(({_OWN} - coalesce(z.v, 0)) ** 2) AS cc FROM s
  LEFT JOIN ns p ON p.img = s.img AND p.i = s.i AND p.j = s.j - 1 AND p.di = s.di AND p.dj = s.dj LEFT JOIN ns n ON n.img = s.img AND n.i = s.i AND n.j = s.j + 1 AND n.di = s.di AND n.dj = s.dj
  {_T.format('x', -1)} {_T.format('y', 0)} {_T.format('z', 1)} GROUP BY ALL)""",
    f"two AS (SELECT *, CASE WHEN j + d + 1 < {W} AND j + d > 1 AND cc - 2 * cb + ca <> 0 THEN (ca - cc) / (2 * (cc - 2 * cb + ca)) + CASE WHEN one > 0 THEN 0.5 ELSE -0.5 END END AS two FROM half)") +
    "SELECT img, i, j, round(d + coalesce(CASE WHEN abs(two) < 1 THEN (one + two) / 2 ELSE one END, 0), 5) + 0.0 AS disparity FROM two")


def _grown(s, d):
    found = _volume()(s, d)
    return stereo.background_growth(found, found.withColumn("img", F.col("img") - F.col("img") % 4 + (F.col("img") + 3) % 4), 2, 0.5)


R.add("background_growth", _grown, "WITH RECURSIVE " + ",\n".join([
    *PAIR_SQL, VOLUME_SQL, WIN_SQL,
    "c AS (SELECT f.img, f.i, f.j, f.d, b.d AS b, x.cost AS cb, y.cost AS cf FROM win f JOIN win b ON b.img = f.img - f.img % 4 + (f.img + 1) % 4 AND b.i = f.i AND b.j = f.j JOIN vol x ON x.img = b.img AND x.i = b.i AND x.j = b.j AND x.d = b.d JOIN vol y ON y.img = f.img AND y.i = f.i AND y.j = f.j AND y.d = b.d)",
    "m AS (SELECT img, i, j, d, b, NOT (CASE WHEN greatest(cb, cf) = 0 THEN 0 ELSE least(cb, cf) / greatest(cb, cf) END > 0.5) AS seed, abs(d - b) >= 2 AS apart FROM c)",
    "fg(img, i, j) AS (SELECT img, i, j FROM m WHERE seed AND apart UNION SELECT m.img, m.i, m.j FROM fg JOIN m ON m.apart AND m.img = fg.img AND abs(m.i - fg.i) <= 1 AND abs(m.j - fg.j) <= 1)",
    "near AS (SELECT DISTINCT m.img, m.i, m.j FROM m JOIN fg ON m.img = fg.img AND abs(m.i - fg.i) <= 1 AND abs(m.j - fg.j) <= 1)"]) + """
SELECT m.img, m.i, m.j, CASE WHEN seed OR near.img IS NOT NULL THEN d ELSE b END AS disparity, fg.img IS NOT NULL AS foreground FROM m LEFT JOIN fg USING (img, i, j) LEFT JOIN near USING (img, i, j)""")  # fmt: skip

for _name, _mask in (("r3", ops.MASK_R3), ("r4", ops.MASK_R4)):
    _n, _labels = len(_mask) // 2, ops.labels(_mask)
    R.add(f"unfold_mask17_{_name}", lambda s, d, m=_labels: ops.superpixel_features(raster(s, d), m).select("img", "i", "j", *[_r(F.get("f", F.lit(k))).alias(f"f{k + 1}") for k in range(17)]),
          with_(CELLS, around_sql("nb", _n, _n), "lab(di, dj, k) AS (VALUES " + ", ".join(f"({a - _n}, {b - _n}, {_labels[a][b]})" for a in range(2 * _n + 1) for b in range(2 * _n + 1)) + ")") +
          "SELECT img, i, j, " + ", ".join(f"round(avg(v) FILTER (WHERE k = {k}), 6) AS f{k}" for k in range(1, 18)) + " FROM nb JOIN lab USING (di, dj) GROUP BY img, i, j")

_EPS = "1e-4"


def _rot_at(k: int, axis: str | None, sign: str = "+") -> str:
    """Entry k of the rotation of (rx, ry, rz), one of them moved."""
    x = {c: f"({c} {sign} {_EPS})" if c == axis else c for c in ("rx", "ry", "rz")}
    n = f"sqrt({x['rx']} ** 2 + {x['ry']} ** 2 + {x['rz']} ** 2)"
    out = _ROT[k].replace("a *", "A *").replace("b *", "B *")
    for c in ("rx", "ry", "rz"):
        out = out.replace(c, x[c])
    return out.replace("A *", f"(sin({n}) / {n}) *").replace("B *", f"((1 - cos({n})) / ({n} ** 2)) *")


R.add("rodrigues_jacobian", lambda s, d: _geo(lambda r, q: {f"j{k}": F.round(g.at(g.rodrigues_jacobian(r), k), 4) for k in range(27)})(s, d),
      _GEO + "SELECT pt, " + ", ".join(f"round((({_rot_at(k, c)}) - ({_rot_at(k, c, '-')})) / (2 * {_EPS}), 4) + 0.0 AS j{3 * k + n}" for k in range(9) for n, c in enumerate(("rx", "ry", "rz"))) + " FROM k")
_q = {None: "cos({n} / 2)", **{c: f"({{{c}}}) * sin({{n}} / 2) / {{n}}" for c in ("rx", "ry", "rz")}}


def _quaternion_at(entry: str | None, axis: str, sign: str) -> str:
    x = {c: f"({c} {sign} {_EPS})" if c == axis else c for c in ("rx", "ry", "rz")}
    return _q[entry].format(n=f"sqrt({x['rx']} ** 2 + {x['ry']} ** 2 + {x['rz']} ** 2)", **x)


R.add("quaternion_jacobian", lambda s, d: _geo(lambda r, q: {f"j{k}": F.round(g.at(g.quaternion_jacobian(r), k), 4) for k in range(12)})(s, d),
      _GEO + "SELECT pt, " + ", ".join(f"round((({_quaternion_at(e, c, '+')}) - ({_quaternion_at(e, c, '-')})) / (2 * {_EPS}), 4) + 0.0 AS j{3 * m + n}" for m, e in enumerate((None, "rx", "ry", "rz")) for n, c in enumerate(("rx", "ry", "rz"))) + " FROM k")
for _name, _nu, _f in (("matern12", 0.5, "exp(0 - (value + {0}) / 80)"), ("matern32", 1.5, "(1 + sqrt(3) * (value + {0}) / 80) * exp(0 - sqrt(3) * (value + {0}) / 80)"), ("matern52", 2.5, "(1 + sqrt(5) * (value + {0}) / 80 + 5 * (value + {0}) ** 2 / 19200) * exp(0 - sqrt(5) * (value + {0}) / 80)")):
    R.add(f"{_name}_derivative", lambda s, d, nu=_nu: table(s, d, "events").select("event_id", (F.round(kernels.matern_derivative(F.col("value"), 80.0, nu), 6) + 0.0).alias("rho")),
          f"SELECT event_id, round(({_f.format('1e-4')} - {_f.format('-1e-4')}) / 2e-4, 6) + 0.0 AS rho FROM events")


def _kept_at(s):
    return posixpath.join(shared_dir(s), "ocellus", uuid.uuid4().hex)


def _through_files(kind: str, columns, out, **options):
    """Points written as files by a job and read from them again."""

    def run(s, d):
        from ocellus.sources.readers import read_points
        from ocellus.sources.sinks import write_points

        at = _kept_at(s)
        write_points(points(s, d).select(*[c.alias(n) for n, c in columns().items()]), at, kind, **options)
        return read_points(s, f"{at}/*.{kind}", kind).select(*[c.alias(n) for n, c in out().items()])

    return run


def _own() -> dict:
    return {c: F.col(c) for c in "xyz"}


def _back() -> dict:
    return {c: F.round(c, 3) for c in "xyz"}


_XYZ_SQL = ", ".join(f"round({c}, 3) AS {c}" for c in "xyz")


def _register_files() -> None:
    extra = lambda: {**_own(), "GPSTime": F.col("pt") * 0.25, "height": F.col("z") / 8, "cluster2": (F.col("cluster") - 4).cast("short"), "near": F.col("x") > 0}
    back = lambda: {**_back(), "gps": F.col("GPSTime"), "height": F.col("height"), "cluster2": F.col("cluster2").cast("int"), "near": F.col("near").cast("int")}
    sql = with_(POINTS_SQL) + f"SELECT {_XYZ_SQL}, CAST(pt * 0.25 AS DOUBLE) AS gps, z / 8 AS height, CAST(cluster - 4 AS INT) AS cluster2, CAST(x > 0 AS INT) AS near FROM points"
    for fmt in (1, 6):
        R.add(f"las_extra_bytes_{fmt}", _through_files("las", extra, back, point_format=fmt, offset=(100.0, -50.0, 0.0)), sql)
    old = lambda: {**_own(), "scanAngleRank": (F.col("pt") % 90).cast("byte"), "GPSTime": F.col("pt") * 0.25, "red": F.col("cluster"), "green": F.col("cluster") * 2, "blue": F.col("cluster") * 3, "classification": (F.col("pt") % 32).cast("int"), "returnNumber": (F.col("pt") % 7 + 1).cast("int")}
    R.add("las_legacy_format", _through_files("las", old, lambda: {**_back(), "rank": F.col("scanAngleRank").cast("int"), "gps": F.col("GPSTime"), "blue": F.col("blue").cast("int"), "classification": F.col("classification").cast("int"), "ret": F.col("returnNumber").cast("int")}),
          with_(POINTS_SQL) + f"SELECT {_XYZ_SQL}, CAST(pt % 90 AS INT) AS rank, CAST(pt * 0.25 AS DOUBLE) AS gps, CAST(cluster * 3 AS INT) AS blue, CAST(pt % 32 AS INT) AS classification, CAST(pt % 7 + 1 AS INT) AS ret FROM points")
    wave = lambda: {**_own(), "red": F.col("cluster"), "green": F.col("cluster"), "blue": F.col("cluster"), "NIR": F.col("cluster") * 7, "waveDescriptor": (F.col("pt") % 200).cast("int"), "waveOffset": F.col("pt") * 1000, "waveX": (F.col("pt") * 0.5).cast("float")}
    R.add("las_wave_packets", _through_files("las", wave, lambda: {**_back(), "nir": F.col("NIR").cast("int"), "descriptor": F.col("waveDescriptor").cast("int"), "start": F.col("waveOffset").cast("long"), "wx": F.col("waveX").cast("double")}),
          with_(POINTS_SQL) + f"SELECT {_XYZ_SQL}, CAST(cluster * 7 AS INT) AS nir, CAST(pt % 200 AS INT) AS descriptor, CAST(pt * 1000 AS BIGINT) AS start, CAST(pt * 0.5 AS DOUBLE) AS wx FROM points")


_register_files()


def _header(s, d):
    from ocellus.sources.readers import read_header
    from ocellus.sources.sinks import write_points

    at = _kept_at(s)
    write_points(points(s, d).select("x", "y", "z").coalesce(1), at, "las")
    names = ["versionMajor", "versionMinor", "pointDataRecordFormat", "numberOfPointRecords", "maxX", "minZ"]
    return read_header(s, f"{at}/*.las").where(F.col("name").isin(names)).select("name", F.round(F.get("numbers", F.lit(0)), 3).alias("value"))


R.add("las_header_attributes", _header, with_(POINTS_SQL) + """SELECT 'versionMajor' AS name, 1.0::DOUBLE AS value UNION ALL SELECT 'versionMinor', 4 UNION ALL SELECT 'pointDataRecordFormat', 6
UNION ALL SELECT 'numberOfPointRecords', count(*) FROM points UNION ALL SELECT 'maxX', round(max(x), 3) FROM points UNION ALL SELECT 'minZ', round(min(z), 3) FROM points""")


def _metacloud(s, d):
    """Two members and a side file that counts over both."""
    import struct

    from ocellus.sources.readers import read_points
    from ocellus.sources.sinks import write_files, write_points

    at = _kept_at(s)
    p = points(s, d).select("x", "y", "z", "pt").orderBy("pt").coalesce(1)
    write_points(p.where("pt % 2 = 0").select("x", "y", "z"), f"{at}/even", "las")
    write_points(p.where("pt % 2 = 1").select("x", "y", "z"), f"{at}/odd", "pcd")
    text = f"POINTS_FILES\n{at}/even/part-000000.las {at}/odd/part-000000.pcd\nEXTRA_ATTRIBUTES\nside.bin uint32 number float64 third\n"
    n = p.count()
    side = b"".join(struct.pack("<Id", k, k / 3) for k in range(n))
    write_files(s.createDataFrame([("m.metacloud", text.encode()), ("side.bin", side)], "name string, content binary"), at)
    return read_points(s, f"{at}/m.metacloud").select(*[F.round(c, 3).alias(c) for c in "xyz"], "member", F.col("number").cast("long").alias("number"), "third")


R.add("metacloud_side_file", _metacloud, with_(POINTS_SQL, "n AS (SELECT *, row_number() OVER (ORDER BY pt % 2, pt) - 1 AS k FROM points)") + f"SELECT {_XYZ_SQL}, CAST(pt % 2 AS INT) AS member, CAST(k AS BIGINT) AS number, k / 3 AS third FROM n")


def _picture(s, d):
    from ocellus.sources import images, sinks

    at = _kept_at(s)
    cells = raster(s, d).select("img", "i", "j", (F.col("value") * 4).alias("value"))
    sinks.write_files(images.encode_images(cells), at)
    got = images.read_images(s, at)
    return got.select(F.regexp_extract("file", r"(\d+)\.png$", 1).cast("int").alias("img"), "i", "j", "value")


R.add("picture_roundtrip", _picture, with_(CELLS) + "SELECT img, i, j, CAST(least(greatest(round(value * 4, 0), 0), 255) AS DOUBLE) AS value FROM cells")


def _packed(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.array(*[(c % 256).cast("int") for c in (F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") * 7, F.col("o_custkey") * 3)]).alias("q"))
    both = {order: colour.packed_yuv("q", order) for order in ("yuyv", "yvyu")}
    return o.select("o_orderkey", *[F.get(both[order], F.lit(k))[c].alias(f"{order}_{c}{k}") for order in both for k in (0, 1) for c in "yuv"])


_q4 = ["o_orderkey % 256", "o_custkey % 256", "o_orderkey * 7 % 256", "o_custkey * 3 % 256"]
R.add("packed_yuv", _packed, "SELECT o_orderkey, " + ", ".join(f"CAST({_q4[{'y': 2 * k, 'u': 1 if order == 'yuyv' else 3, 'v': 3 if order == 'yuyv' else 1}[c]]} AS INT) AS {order}_{c}{k}" for order in ("yuyv", "yvyu") for k in (0, 1) for c in "yuv") + " FROM orders")


def _whitened(s, d):
    c = raster(s, d)
    f = ops.whitened_patches(c, c.where("value > 30"), 1)
    return f.select("img", "i", "j", *[(F.round(F.get("f", F.lit(k)), 5) + 0.0).alias(f"f{k}") for k in range(9)])


_W = with_(CELLS, around_sql("nb", 1, 1), "m AS (SELECT *, avg(v) OVER w AS mean, sqrt(var_pop(v) OVER w) AS norm FROM nb WHERE centre > 30 WINDOW w AS (PARTITION BY img, i, j))")
R.add("whitened_patches", _whitened, _W + "SELECT img, i, j, " + ", ".join(f"round(max(CASE WHEN di = {k // 3 - 1} AND dj = {k % 3 - 1} AND norm > 0 THEN (v - mean) / norm END), 5) + 0.0 AS f{k}" for k in range(9)) + " FROM m GROUP BY img, i, j")
_OFFSETS = [(0.0, 0.0), (0.0, 1.0), (0.0, -1.0), (1.0, 0.0), (-1.0, 0.0), (1.5, 0.5)]


def _oriented(s, d):
    c = raster(s, d)
    turned = c.where("value > 30").select("img", "i", "j", F.lit(0.6).alias("oy"), F.lit(0.8).alias("ox"))
    f = ops.oriented_patches(c, turned, _OFFSETS)
    return f.select("img", "i", "j", *[(F.round(F.get("f", F.lit(k)), 5) + 0.0).alias(f"f{k}") for k in range(len(_OFFSETS))])


R.add("oriented_patches", _oriented, with_(
    CELLS, "o(k, a, b) AS (VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(_OFFSETS)) + ")",
    "t AS (SELECT img, i, j, k, i + a * 0.8::DOUBLE + b * 0.6::DOUBLE AS y, j - a * 0.6::DOUBLE + b * 0.8::DOUBLE AS x FROM cells CROSS JOIN o WHERE value > 30)",
    "s AS (SELECT t.img, t.i, t.j, k, coalesce(sum(greatest(1 - abs(y - n.i), 0) * greatest(1 - abs(x - n.j), 0) * n.value), 0) AS v FROM t LEFT JOIN cells n ON n.img = t.img AND n.i BETWEEN floor(y) AND floor(y) + 1 AND n.j BETWEEN floor(x) AND floor(x) + 1 GROUP BY t.img, t.i, t.j, k)",
    "m AS (SELECT *, avg(v) OVER w AS mean, sqrt(var_pop(v) OVER w) AS norm FROM s WINDOW w AS (PARTITION BY img, i, j))") +
    "SELECT img, i, j, " + ", ".join(f"round(max(CASE WHEN k = {k} AND norm > 0 THEN (v - mean) / norm END), 5) + 0.0 AS f{k}" for k in range(len(_OFFSETS))) + " FROM m GROUP BY img, i, j")
R.add("flatten_heights", lambda s, d: ops.flatten_heights(raster(s, d).withColumn("mask", F.col("i") + F.col("j") < 40)).select("img", "i", "j", (F.round("value", 5) + 0.0).alias("value")), with_(
    CELLS, "o AS (SELECT * FROM cells WHERE i + j < 40)",
    "g AS (SELECT img, avg(i) AS mi, avg(j) AS mj, avg(value) AS mv, var_pop(i) AS ii, var_pop(j) AS jj, covar_pop(i, j) AS ij, covar_pop(i, value) AS iv, covar_pop(j, value) AS jv FROM o GROUP BY img)",
    "p AS (SELECT *, (iv * jj - jv * ij) / (ii * jj - ij * ij) AS a, (jv * ii - iv * ij) / (ii * jj - ij * ij) AS b FROM g)",
    "r AS (SELECT o.img, i, j, value - mv - a * (i - mi) - b * (j - mj) AS r FROM o JOIN p USING (img))", "l AS (SELECT img, min(r) AS low FROM r GROUP BY img)") +
    "SELECT c.img, c.i, c.j, round(coalesce(r - low, 0), 5) + 0.0 AS value FROM cells c LEFT JOIN r ON r.img = c.img AND r.i = c.i AND r.j = c.j LEFT JOIN l ON l.img = c.img")
_SOB = "SELECT img, i, j, sum(dj * (2 - abs(di)) * v) AS gx, sum(di * (2 - abs(dj)) * v) AS gy FROM {0} GROUP BY img, i, j"
R.add("harris_masked", lambda s, d: ops.harris(raster(s, d).withColumn("mask", F.col("j") >= F.col("i")), 1, "mask").select("img", "i", "j", (F.round("value", 4) + 0.0).alias("value")), with_(
    CELLS, f"""pad AS (SELECT c.img, c.i, c.j, di, dj, n.value AS v FROM cells c CROSS JOIN (SELECT unnest([-1, 0, 1]) AS di) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dj)
  JOIN cells n ON n.img = c.img AND n.i = least(greatest(c.i + di, 0), {H - 1}) AND n.j = least(greatest(c.j + dj, 0), {W - 1}))""",
    f"g AS ({_SOB.format('pad')})", "t AS (SELECT img, i, j, CASE WHEN j >= i THEN gx * gx ELSE 0 END AS xx, CASE WHEN j >= i THEN gx * gy ELSE 0 END AS xy, CASE WHEN j >= i THEN gy * gy ELSE 0 END AS yy FROM g)",
    "w AS (SELECT c.img, c.i, c.j, sum(t.xx) AS xx, sum(t.xy) AS xy, sum(t.yy) AS yy FROM cells c JOIN t ON t.img = c.img AND abs(t.i - c.i) <= 1 AND abs(t.j - c.j) <= 1 GROUP BY c.img, c.i, c.j)") +
    "SELECT img, i, j, round(CASE WHEN xx + yy = 0 THEN 0 ELSE (xx * yy - xy * xy) / (xx + yy) END, 4) + 0.0 AS value FROM w")


def _barycentric_sql() -> str:
    m = """m AS (SELECT w.img, w.i, w.j, w.d, s.v AS s, coalesce(a.v, 0) AS a, coalesce(u.v, 0) AS u, coalesce(o.v, 0) AS o FROM win w JOIN ns s ON s.img = w.img AND s.i = w.i AND s.j = w.j
    LEFT JOIN nt a ON a.img = w.img AND a.i = w.i AND a.j = w.j + w.d AND a.di = s.di AND a.dj = s.dj LEFT JOIN nt u ON u.img = w.img AND u.i = w.i AND u.j = w.j + w.d + 1 AND u.di = s.di AND u.dj = s.dj
    LEFT JOIN nt o ON o.img = w.img AND o.i = w.i AND o.j = w.j + w.d - 1 AND o.di = s.di AND o.dj = s.dj)"""
    g_ = "g AS (SELECT img, i, j, d, sum((o - a) ** 2) AS pp, sum((u - a) ** 2) AS qq, sum((o - a) * (u - a)) AS pq, sum((s - a) * (o - a)) AS gp, sum((s - a) * (u - a)) AS gq FROM m GROUP BY ALL)"
    h = "h AS (SELECT *, CASE WHEN pp * qq - pq * pq <> 0 THEN (gq * pp - gp * pq) / (pp * qq - pq * pq) - (gp * qq - gq * pq) / (pp * qq - pq * pq) END AS mv FROM g)"
    return with_(*PAIR_SQL, VOLUME_SQL.replace("sum(abs(s.v - coalesce(t.v, 0)))", "sum((s.v - coalesce(t.v, 0)) ** 2)"), WIN_SQL, m, g_, h) + f"""
SELECT img, i, j, round(d + CASE WHEN d > 0 AND d + 1 < {D} AND j + 1 < {W} AND j + d >= 1 AND j + d + 1 < {W} AND abs(mv) < 1 THEN mv ELSE 0 END, 5) + 0.0 AS disparity FROM h"""


R.add("refine_barycentric_symmetric", lambda s, d: stereo.barycentric_symmetric(_pair(s, d), vectors.ssd, D).select("img", "i", "j", (F.round("disparity", 5) + 0.0).alias("disparity")), _barycentric_sql())


def _quadrants(s, d):
    pair = _pair(s, d)
    found = stereo.barycentric_2d(pair, v.winner_2d(v.cost_volume_2d(pair, vectors.sad, (-1, 1), (0, 3))))
    return found.select("img", "i", "j", *[(F.round(c, 4) + 0.0).alias(c) for c in "yx"])


def _quadrants_sql() -> str:
    places = {"a": (0, 0), "dn": (1, 0), "up": (-1, 0), "rt": (0, 1), "lf": (0, -1)}
    joins = " ".join(f"LEFT JOIN nt {n} ON {n}.img = w.img AND {n}.i = w.i + w.d1 + ({p}) AND {n}.j = w.j + w.d2 + ({q}) AND {n}.di = s.di AND {n}.dj = s.dj" for n, (p, q) in places.items())
    sums, options = [], []
    for n in ("dn", "up", "rt", "lf"):
        sums += [f"sum(({n}.v - a.v) ** 2) AS {n}2", f"sum((s.v - a.v) * ({n}.v - a.v)) AS {n}g", f"count({n}.v) AS {n}n"]
    for n, (p, q, dy, dx) in enumerate((("dn", "rt", 1, 1), ("dn", "lf", 1, -1), ("up", "rt", -1, 1), ("up", "lf", -1, -1))):
        sums.append(f"sum(({p}.v - a.v) * ({q}.v - a.v)) AS c{n}")
        det = f"nullif({p}2 * {q}2 - c{n} * c{n}, 0)"
        y, x = f"({p}g * {q}2 - {q}g * c{n}) / {det}", f"({q}g * {p}2 - {p}g * c{n}) / {det}"
        options.append(f"SELECT img, i, j, {n} AS n, {y} * {dy} AS y, {x} * {dx} AS x, round({y} * {p}g + {x} * {q}g, 6) AS gain FROM g WHERE dnn = 9 AND upn = 9 AND rtn = 9 AND lfn = 9")
    return with_(*PAIR_SQL, _V2, "w AS (SELECT img, i, j, d.d1 AS d1, d.d2 AS d2 FROM (SELECT img, i, j, max_by(struct_pack(d1 := d1, d2 := d2), struct_pack(c := -cost, d1 := d1, d2 := d2)) AS d FROM vol2 GROUP BY img, i, j))",
                 f"g AS (SELECT w.img, w.i, w.j, w.d1, w.d2, {', '.join(sums)} FROM w JOIN ns s ON s.img = w.img AND s.i = w.i AND s.j = w.j {joins} GROUP BY ALL)", f"o AS ({' UNION ALL '.join(options)})",
                 "b AS (SELECT * FROM o WHERE abs(y) <= 1 AND abs(x) <= 1 AND gain > 0 QUALIFY row_number() OVER (PARTITION BY img, i, j ORDER BY gain DESC, n) = 1)") + (
        "SELECT w.img, w.i, w.j, round(w.d1 + coalesce(b.y, 0), 4) + 0.0 AS y, round(w.d2 + coalesce(b.x, 0), 4) + 0.0 AS x FROM w LEFT JOIN b USING (img, i, j)")


R.add("refine_barycentric_2d", _quadrants, _quadrants_sql())


def _layers(**options):
    return lambda s, d: spatial.depth_buffer(points(s, d).withColumns({"z": F.col("z") + 500}), 24, 30, 2, **options)


_WHOLE = "a AS (SELECT CAST(k // 60 AS INT) AS i, CAST(k // 2 % 30 AS INT) AS j, CAST(k % 2 AS INT) AS layer FROM range(1440) r(k))"
_RANKED = "r AS (SELECT i, j, z, row_number() OVER (PARTITION BY i, j ORDER BY z) - 1 AS layer FROM (SELECT DISTINCT i, j, z FROM c))"
_SEEN = "SELECT a.i, a.j, a.layer, coalesce(r.z, -1) AS depth FROM a LEFT JOIN r USING (i, j, layer)"
R.add("depth_buffer", _layers(size=30.0), with_(POINTS_SQL, "c AS (SELECT CAST(round(y * (1.0 / 30.0)::DOUBLE + 11.5) AS INT) AS i, CAST(round(x * (1.0 / 30.0)::DOUBLE + 14.5) AS INT) AS j, z + 500 AS z FROM points)", _WHOLE, _RANKED) + _SEEN)
R.add("depth_buffer_pinhole", _layers(focal=20.0), with_(POINTS_SQL, "c AS (SELECT CAST(round(y * (20.0 / (z + 500)) + 11.5) AS INT) AS i, CAST(round(x * (20.0 / (z + 500)) + 14.5) AS INT) AS j, z + 500 AS z FROM points WHERE z + 500 > 0)", _WHOLE, _RANKED) + _SEEN)


def _backward(s, d):
    import numpy as np

    from ocellus.operators import pose

    return pose.backward_map(raster(s, d), pose.rotation(np.array([0.02, -0.05, 0.01])), 50.0).select("img", "i", "j", F.round("si", 5).alias("si"), F.round("sj", 5).alias("sj"))


def _backward_sql() -> str:
    from ocellus.plans.kernel_sql import TURN

    x, y = f"((j - {(W - 1) / 2}) / 50)", f"((i - {(H - 1) / 2}) / 50)"
    p = [f"(({TURN[k]}) * {x} + ({TURN[3 + k]}) * {y} + ({TURN[6 + k]}))" for k in range(3)]
    return with_(CELLS, f"p AS (SELECT img, i, j, {p[0]} AS x, {p[1]} AS y, {p[2]} AS z FROM cells)") + f"SELECT img, i, j, round(y / z * 50 + {(H - 1) / 2}, 5) AS si, round(x / z * 50 + {(W - 1) / 2}, 5) AS sj FROM p"


R.add("rectified_backward_map", _backward, _backward_sql())


def _exterior(s, d):
    e = graphs.with_exterior(graphs.polygon_edges(_faces(s, d), 16))
    return e.select("edge", F.coalesce("face", F.lit(-1).cast("bigint")).alias("face"), "a", "b")


_FACES = R_spatial.sql["half_edge_twin"].partition(" SELECT x.edge")[0]
R.add("half_edge_exterior", _exterior, _FACES.replace("SELECT face * 16 + k AS edge,", "SELECT face * 16 + k AS edge, face,") + """ SELECT edge, face, a, b FROM e UNION ALL
SELECT -1 - edge, -1, b, a FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.a = x.b AND y.b = x.a)""")


def _guided(s, d):
    c = raster(s, d).withColumn("other", F.col("i") * 2.0)
    e = segmentation.masked_edges(segmentation.guided_edges(c, ["value", "other"], 10.0, 1.0), c.where("value < 45"))
    return e.select("img", "a", "b", F.round("w", 6).alias("w"))


R.add("guided_edges", _guided, with_(
    CELLS, "k AS (SELECT *, i * 1048576 + j AS k FROM cells)",
    "e AS (SELECT x.img, x.k AS a, y.k AS b, abs(x.value - y.value) + abs(x.i - y.i) * 2.0 AS w, x.value AS u, y.value AS v FROM k x JOIN k y ON y.img = x.img AND ((y.i = x.i AND y.j = x.j + 1) OR (y.i = x.i + 1 AND y.j = x.j)))",
    "m AS (SELECT img, min(w) AS lo, max(w) AS hi FROM e GROUP BY img)") +
    "SELECT img, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(1 + 9 * (hi - w) / (hi - lo), 6) AS w FROM e JOIN m USING (img) WHERE u < 45 AND v < 45")
R.add("scanline_paths", lambda s, d: sequential.scanline_paths(_volume()(s, d), 20.0, 5.0), kernel_sql.scanline_paths(20.0, 5.0))


def _kernel_sql(cut: int) -> str:
    costs = "c AS (SELECT w.img, w.i, w.j, w.d, k, sum((s.v - (1 - abs(k / {0})) * coalesce(a.v, 0) - greatest(k / {0}, 0) * coalesce(u.v, 0) - greatest(-k / {0}, 0) * coalesce(o.v, 0)) ** 2) AS cost"
    return with_(*PAIR_SQL, VOLUME_SQL.replace("sum(abs(s.v - coalesce(t.v, 0)))", "sum((s.v - coalesce(t.v, 0)) ** 2)"), WIN_SQL, costs.format(cut) + f""" FROM win w CROSS JOIN range({1 - cut}, {cut}) r(k) JOIN ns s ON s.img = w.img AND s.i = w.i AND s.j = w.j
  LEFT JOIN nt a ON a.img = w.img AND a.i = w.i AND a.j = w.j + w.d AND a.di = s.di AND a.dj = s.dj LEFT JOIN nt u ON u.img = w.img AND u.i = w.i AND u.j = w.j + w.d + 1 AND u.di = s.di AND u.dj = s.dj
  LEFT JOIN nt o ON o.img = w.img AND o.i = w.i AND o.j = w.j + w.d - 1 AND o.di = s.di AND o.dj = s.dj GROUP BY ALL)""") + f"""
SELECT img, i, j, d + CASE WHEN j + d >= 1 AND j + d + 1 < {W} THEN min_by(k, struct_pack(c := round(cost, 9), a := abs(k), k := k)) / {cut} ELSE 0 END AS disparity FROM c GROUP BY img, i, j, d"""


R.add("refine_kernel", lambda s, d: stereo.kernel_refined(_pair(s, d), vectors.ssd, D, lambda t: F.greatest(1 - F.abs(t), F.lit(0.0)), 1, 4), _kernel_sql(4))


def _affine(s, d):
    w = solve.affine_least_squares(table(s, d, "lineitem"), [F.col("l_quantity"), F.col("l_discount") * 100], F.col("l_extendedprice") / 1000)
    return s.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(w)], "k int, value double")


_AFFINE = "WITH q AS (SELECT l_quantity - l_discount * 100 AS a, l_extendedprice / 1000 - l_discount * 100 AS b FROM lineitem), f AS (SELECT sum(a * b) / sum(a * a) AS w FROM q)"
R.add("affine_least_squares", _affine, _AFFINE + " SELECT 0::INT AS k, round(w, 6) AS value FROM f UNION ALL SELECT 1, round(1 - w, 6) FROM f")
R.add("drop_colour", lambda s, d: attributes.drop_colour(table(s, d, "part").select("p_partkey", F.col("p_size").alias("Red"), F.col("p_size").alias("nir"), F.col("p_retailprice").alias("greenish"))), "SELECT p_partkey, p_retailprice AS greenish FROM part")
R.add("typed_geometry", lambda s, d: attributes.geometry(points(s, d)).select("pt", *[F.col(f"xyz.{c}").alias(f"g{c}") for c in "xyz"], "cluster"), with_(POINTS_SQL) + "SELECT pt, x AS gx, y AS gy, z AS gz, cluster FROM points")


def _channels(s, d):
    c = raster(s, d)
    return c.select("img", "i", "j", F.explode(F.array(F.struct(F.lit(0).alias("c"), F.col("value")), F.struct(F.lit(1).alias("c"), (F.col("i") + F.col("j")).cast("double").alias("value")))).alias("x")).select("img", "i", "j", "x.*")


_CHANNELS = "ch AS (SELECT img, i, j, 0 AS c, value FROM cells UNION ALL SELECT img, i, j, 1, i + j FROM cells)"
R.add("conv_batched", lambda s, d: ops.gather_channels(_channels(s, d), [(0, 0, None, 2.0), (0, 1, None, -1.0), (1, 0, None, 0.5)]), with_(CELLS, _CHANNELS) + """SELECT x.img, x.i, x.j, CAST(x.c AS INT) AS c, CAST(2 * x.value - coalesce(r.value, 0) + coalesce(b.value, 0) * 0.5 AS DOUBLE) AS value FROM ch x
LEFT JOIN ch r ON r.img = x.img AND r.i = x.i AND r.j = x.j + 1 AND r.c = x.c LEFT JOIN ch b ON b.img = x.img AND b.i = x.i + 1 AND b.j = x.j AND b.c = x.c""")
R.add("conv_aggregated", lambda s, d: ops.gather_channels(_channels(s, d), [(0, 0, 0, 2.0), (0, -1, 1, 1.0), (0, 0, 1, -1.0)]), with_(CELLS, _CHANNELS) + """SELECT x.img, x.i, x.j, 0::INT AS c, CAST(2 * x.value + coalesce(l.value, 0) - y.value AS DOUBLE) AS value FROM ch x
JOIN ch y ON y.img = x.img AND y.i = x.i AND y.j = x.j AND y.c = 1 LEFT JOIN ch l ON l.img = x.img AND l.i = x.i AND l.j = x.j - 1 AND l.c = 1 WHERE x.c = 0""")


def _byte_ranges(s, d):
    from ocellus.sources.ranges import read_point_ranges
    from ocellus.sources.sinks import write_points

    at = _kept_at(s)
    write_points(points(s, d).select("x", "y", "z", F.col("cluster").cast("short").alias("mark")), at, "las")
    return read_point_ranges(s, f"{at}/*.las", "las", range_bytes=4000).select(*[F.round(c, 3).alias(c) for c in "xyz"], F.col("mark").cast("int").alias("mark"))


R.add("las_byte_ranges", _byte_ranges, with_(POINTS_SQL) + f"SELECT {_XYZ_SQL}, CAST(cluster AS INT) AS mark FROM points")


def _spots(s, d):
    return attributes.component_boxes(graphs.mask_components(raster(s, d).where("value > 32")))


R.add("component_boxes", _spots, R_spatial.sql["components"].replace(" SELECT img, i, j, CAST(min(z) AS BIGINT) AS label FROM r GROUP BY img, i, j", ", l AS (SELECT img, i, j, CAST(min(z) AS BIGINT) AS label FROM r GROUP BY img, i, j)") +
      " SELECT img, label, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM l GROUP BY img, label")
_BORDER = "p AS (SELECT img * 1536 + i * 48 + j AS pt, img, i - 0.75::DOUBLE AS y, j + 0.375::DOUBLE AS x FROM cells)"
R.add("interpolate_filled", lambda s, d: ops.interpolate(raster(s, d), raster(s, d).select((F.col("img") * 1536 + F.col("i") * 48 + F.col("j")).alias("pt"), "img", (F.col("i") - 0.75).alias("y"), (F.col("j") + 0.375).alias("x")), fill=100.0).select("pt", F.round("value", 6).alias("value")), with_(
    CELLS, _BORDER, "t AS (SELECT pt, img, y, x, floor(y) + a AS i, floor(x) + b AS j FROM p CROSS JOIN (SELECT unnest([0, 1]) AS a) CROSS JOIN (SELECT unnest([0, 1]) AS b))") +
    "SELECT pt, round(sum((1 - abs(y - t.i)) * (1 - abs(x - t.j)) * coalesce(c.value, 100)), 6) AS value FROM t LEFT JOIN cells c ON c.img = t.img AND c.i = t.i AND c.j = t.j GROUP BY pt")
_CORNERS = {"y0": "s_suppkey % 7 + 0.5", "x0": "s_suppkey % 5", "y1": "10 + s_suppkey % 3", "x1": "s_suppkey % 11 - 2", "y2": "4 - s_suppkey % 2", "x2": "12.25"}
R.add("triangle_cells", lambda s, d: ops.triangle_cells(table(s, d, "supplier").select(F.col("s_suppkey").alias("triangle"), *[F.expr(e).cast("double").alias(c) for c, e in _CORNERS.items()])),
      "WITH t AS (SELECT s_suppkey AS triangle, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _CORNERS.items()) + """ FROM supplier),
c AS (SELECT t.*, i, j FROM t CROSS JOIN range(-5, 20) a(i) CROSS JOIN range(-5, 20) b(j)),
s AS (SELECT *, (x1 - x0) * (i - y0) - (y1 - y0) * (j - x0) AS a, (x2 - x1) * (i - y1) - (y2 - y1) * (j - x1) AS b, (x0 - x2) * (i - y2) - (y0 - y2) * (j - x2) AS d FROM c)
SELECT triangle, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM s WHERE (least(a, b, d) >= 0 OR greatest(a, b, d) <= 0) AND i BETWEEN least(y0, y1, y2) AND greatest(y0, y1, y2) AND j BETWEEN least(x0, x1, x2) AND greatest(x0, x1, x2)""")
R.add("colour_orders", lambda s, d: rgb(s, d).select("img", "i", "j", F.array_join(F.transform(colour.in_order({c: F.col(c) for c in "rgb"}, "bgr"), lambda x: x.cast("int").cast("string")), ",").alias("bgr")),
      with_(RGB_SQL) + "SELECT img, i, j, concat_ws(',', CAST(b AS INT), CAST(g AS INT), CAST(r AS INT)) AS bgr FROM rgb")
